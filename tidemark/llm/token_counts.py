"""Token counts by a map-side look-up in two tiers.

The first tier is a table of the corpus's frequent pre-tokens with their number of tokens, sent to all
workers; the second is what each worker has encoded itself. Pre-tokens are never shuffled: the frequent
ones come from one bounded summary per task, merged in groups of a fixed number of summaries.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_batches
from tidemark.session import cut

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
TABLE = 65_536  # pre-tokens of the table that goes to all workers, about 1 MB
CACHE = 800_000  # pre-tokens that a worker remembers besides, about 120 MB; it starts afresh beyond that
MERGED = 16  # summaries that one task merges
LONG = 64  # characters of a pre-token that is not remembered
SLICE = 1 << 20

#: Characters for which lower case, normal form and class are the same in every Unicode version: ASCII and composed Latin letters.
_PLAIN = r"\t-\r !-~À-ÖØ-öø-įı-ž"
_ODD = re.compile(f"[^{_PLAIN}]")
#: The tokenizer's own pattern on lower-cased plain text (fixed values).
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ž]+|[0-9]|[!-/:-@\[-`{-~]+")
_SPACE = re.compile(r"[ \t-\r]")
_PART = re.compile(r"[^ \t-\r]+")
_state: dict = {}


class Encoder:
    """A tokenizer that drops white space, so that a text's tokens are those of its white-space separated parts."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(public_tokenizers.path(name))
        special = [re.escape(t.content) for t in self.own.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else re.compile(r"(?!)")

        # A plain pre-token is in normal form already, so its bytes go straight to the merges.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        signs = [c for c in map(chr, range(0x21, 0x180)) if not _ODD.search(c)]
        self.bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in signs})

    def length(self, part: str) -> int:
        """Tokens of one part as :meth:`pre_tokens` gives it."""
        if _ODD.search(part) or self.special.search(part):
            return len(self.own.encode(part, add_special_tokens=False).ids)
        return len(self.own.model.tokenize(part.translate(self.bytes)))

    def pre_tokens(self, text: str) -> list[str]:
        """Parts of a text that are encoded independently; a part with unusual characters or special strings stays whole."""
        if not _ODD.search(text) and not self.special.search(text):
            return _PRE.findall(text.lower())
        out = []
        for part in _PART.findall(text):
            out += [part] if _ODD.search(part) or self.special.search(part) else _PRE.findall(part.lower())
        return out


def slices(text: str | None) -> Iterator[str]:
    """A text in parts of about a million characters, cut at white space."""
    text, at = text or "", 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def encoder(name: str) -> Encoder:
    if name not in _state:
        _state[name] = Encoder(name)
    return _state[name]


def _pruned(counts: dict[str, int], size: int) -> dict[str, int]:
    """The `size` largest counters, lowered by the next one: what Misra and Gries keep."""
    if len(counts) <= size:
        return counts
    top = Counter(counts).most_common(size + 1)
    return {w: c - top[-1][1] for w, c in top[:-1] if c > top[-1][1]}


def _summary(part: int, counts: dict[str, int]) -> pa.RecordBatch:
    pairs = sorted(counts.items())
    words = pa.array([[w for w, _ in pairs]], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), words, pa.array([[c for _, c in pairs]], pa.list_(pa.int64()))], names=["part", "words", "counts"])


def _summaries(batches: Iterator[pa.RecordBatch], name: str, size: int) -> Iterator[pa.RecordBatch]:
    split, counts = encoder(name).pre_tokens, Counter()
    for batch in text_batches(batches):
        for text in batch.column("text").to_pylist():
            for part in slices(text):
                counts.update([w for w in split(part) if len(w) <= LONG])
                if len(counts) > 4 * size:
                    counts = Counter(_pruned(counts, size))
    yield _summary(TaskContext.get().partitionId(), _pruned(counts, size))


def frequent(docs: DataFrame, name: str = TOKENIZER, size: int = TABLE) -> list[str]:
    """At most `size` pre-tokens of the whole corpus, among them all that make up more than 1 / size of it.

    A task counts its texts in at most 4 * size counters and writes one summary; tasks then merge `MERGED`
    summaries each until one is left. Counts only choose what the table holds, never a result.
    """
    schema = "part long, words array<string>, counts array<long>"

    def merge(rows: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for words, n in zip(rows["words"].to_pylist(), rows["counts"].to_pylist(), strict=True):
            counts.update(dict(zip(words, n, strict=True)))
            counts = Counter(_pruned(counts, size))
        return pa.Table.from_batches([_summary(rows["part"][0].as_py() // MERGED, counts)])

    held = cut(docs.mapInArrow(lambda b: _summaries(b, name, size), schema))
    while held.count() > 1:
        held = cut(held.groupBy(F.expr(f"part div {MERGED}")).applyInArrow(merge, schema))
    row = held.select("words", "counts").first()
    return [] if row is None else [w for w, _ in sorted(zip(row.words, row.counts, strict=True), key=lambda x: (-x[1], x[0]))]


class Lengths(dict):
    """Tokens of pre-tokens: the broadcast table, and at most `room` others that this worker has encoded."""

    def __init__(self, packed: bytes, name: str, room: int = CACHE):
        words, sizes = packed.split(b"\xff", 1)
        first = dict(zip(words.decode().split("\n"), np.frombuffer(sizes, "<u2").tolist(), strict=True)) if sizes else {}
        super().__init__(first)
        self.table, self.limit, self.own = first, len(first) + room, encoder(name)

    def __missing__(self, part: str) -> int:
        n = self.own.length(part)
        if len(part) <= LONG:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.table)
            self[part] = n
        return n

    def total(self, parts: list[str]) -> int:
        """Tokens of the parts; one that neither tier holds is encoded."""
        return sum(map(self.__getitem__, parts))


def pack(words: list[str], name: str) -> bytes:
    """The table in compact form: words by line, a byte that no text has, and 16 bits per length."""
    words = [w for w in words if len(w) <= LONG]
    return "\n".join(words).encode() + b"\xff" + np.asarray([encoder(name).length(w) for w in words], "<u2").tobytes()


def _known(mark: str, packed: Broadcast, name: str) -> Lengths:
    """The worker's two tiers for one table; they outlive a task."""
    if _state.get("mark") != mark:
        _state["mark"], _state["lengths"] = mark, Lengths(packed.value, name)
    return _state["lengths"]


def token_counts(docs: DataFrame, keys: list[str], text: str = "text", name: str = TOKENIZER, size: int = TABLE) -> DataFrame:
    """The `keys` columns and n_tokens of every text, without begin, end or added special tokens.

    Special strings inside a text count as the tokenizer takes them by default: as one token each. Null and
    empty texts have none; repeated rows each get their own row, empty tables give none. Very long texts are
    counted in slices that end at white space, which no token crosses. Texts are read twice and never shuffled.
    """
    slim = docs.select(F.struct(*keys).alias("key"), F.col(text).alias("text"))
    mark, packed = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(pack(frequent(slim.select("text"), name, size), name))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(mark, packed, name)
        split = known.own.pre_tokens
        for batch in text_batches(batches):
            got = [sum(known.total(split(part)) for part in slices(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(got, pa.int64())], names=["key", "n_tokens"])

    return slim.mapInArrow(count, T.StructType([slim.schema["key"], T.StructField("n_tokens", T.LongType())])).select("key.*", "n_tokens")


def count_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether they exceed the limit; null text is empty."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts(sized, ["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)
