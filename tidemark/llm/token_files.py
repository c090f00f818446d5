"""Token ids in ORC: run-length encoded stripes in doc_id order, row indexes and Bloom filters on doc_id."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches
from tidemark.session import fresh_path

TOKENIZER = "byte_bpe_50k.json"
END = 0
SIGNS = ".,;:!?|&%$#*()-"
CACHE = 900_000  # pieces whose ids a worker remembers; it starts afresh beyond that
LONG = 64  # characters of a piece that is not worth remembering
ROW = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
])
_RUN = re.compile(r"\s (?:\s|$)")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ž]+")  # letters in every Unicode version, so one word of the tokenizer's pattern
_SINGLE = re.compile(r"(?<!\s)(?= \S)")
_state: dict = {}


class Known(dict):
    """Ids of the pieces that a worker has met, as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.own = Tokenizer.from_file(public_tokenizers.path(name))
        # Strings of special tokens are tokens of their own, as the tokenizer takes them by default.
        self.special = {t.content: _packed([i]) for i, t in self.own.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else re.compile(r"(?!)")
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x20, 0x17F)) if _WORD.fullmatch(c) or c == " "})

    def __missing__(self, piece: str) -> bytes:
        bare = piece.rstrip(SIGNS)
        left, line, right = piece.partition("\n")
        if _WORD.fullmatch(piece):
            ids = _packed([t.id for t in self.own.model.tokenize(piece.translate(self.bytes))])
        elif bare != piece and bare[-1:].isalpha():  # a word never runs on into signs
            ids = self[bare] + self[piece[len(bare) :]]
        elif line and right[:1].isalpha() and left and not left[-1].isspace():  # nor over a line end
            ids = self[left] + self[line] + self[right]
        else:
            ids = _packed(self.own.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    held = array("I", ids)
    return (held.byteswap() or held if sys.byteorder == "big" else held).tobytes()


def known(name: str = TOKENIZER) -> Known:
    """The ids known to this worker; they outlive a task."""
    if name not in _state:
        _state[name] = Known(name)
    return _state[name]


def pieces(text: str) -> list[str]:
    """Cut a text before spaces, where the tokenizer's own pattern always starts a new word.

    So the ids of a text are those of its pieces one after the other, and most pieces are a word that was met
    before. A cut inside a run of white space would change its ids; such texts are cut only at single spaces.
    """
    if "\0" in text or _RUN.search(text):
        return _SINGLE.split(text)
    return text.replace(" ", "\0 ").split("\0")


def encode(text: str, name: str = TOKENIZER) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    own = known(name)
    if own.cut.search(text):
        parts = own.cut.split(text)  # texts and special strings in turn
        return b"".join(own.special[x] if i % 2 else b"".join(map(own.__getitem__, pieces(x))) for i, x in enumerate(parts) if x)
    return b"".join(map(own.__getitem__, pieces(text)))


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, start = TaskContext.get().partitionId(), 0
    end = np.asarray([END], "<u4").tobytes()
    for batch in text_batches(batches, 256):
        coded = [encode(t or "") + end for t in batch.column("text").to_pylist()]
        sizes = np.asarray([len(x) // 4 for x in coded], np.int64)
        starts = start + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        start += int(sizes.sum())
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes), ids], schema=ROW
        )


def write_tokens(docs: DataFrame, path: str, stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    """Encode `docs` (doc_id, text) and write ORC files in ascending doc_id order, null ids first.

    Texts are range-partitioned and sorted, then encoded in the task that writes them, so ids are never
    shuffled. Each row keeps its partition and the ids before it in that partition. Rows of one id are
    spread and ordered by a hash of the text, then the text. Null text is empty: the end id alone.
    """
    spread = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = texts.repartitionByRange(*spread).sortWithinPartitions(*spread, "text")
    rows = ordered.mapInArrow(_tokenise, "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
    (
        rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", str(stride)).option("orc.compress", "ZSTD").orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids. Stripes are read in parallel.

    `start` adds the ids of all earlier partitions, one number per partition, to the row's own. Filters on
    doc_id reach the reader, which skips files and stripes by statistics, row groups by index and Bloom filter.
    """
    rows = spark.read.schema("doc_id long, part int, part_start long, n_tokens long, ids array<int>").orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition written
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(F.broadcast(parts), "part")
    return joined.select("doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; row groups without them are skipped by their Bloom filters."""
    rows = spark.read.schema("doc_id long, part int, part_start long, n_tokens long, ids array<int>").orc(path)
    return rows.filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, at = np.asarray(ids.values, "<u4"), np.asarray(ids.offsets)
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_table(docs: DataFrame) -> DataFrame:
    """Write all `docs` as ORC in the shared folder, read them back and return a checksum per document."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
