"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches
from tidemark.session import cut

TOKENIZER = "byte_bpe_50k.json"
LOSS_ROLE = "assistant"
PIECE_CHARS = 1 << 20  # a conversation longer than this is encoded in pieces that end with a turn
START, MIDDLE, STOP = "### ", ": ", "</turn>\n"
#: What a text may not say plainly: the escape sign, the marks, and in a role the colon.
_MARKS = re.compile(r"\\|### |</turn>")
_ROLE_MARKS = re.compile(r"\\|### |</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_state: dict = {}


def escape(text: str) -> str:
    """A backslash before every backslash and every mark."""
    return _MARKS.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the character spans of its loss texts, ascending."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head = START + _ROLE_MARKS.sub(r"\\\g<0>", role) + MIDDLE
        body = escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, STOP]
        at += len(head) + len(body) + len(STOP)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def encode(formatted: str, name: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the character at which each token ends.

    Offsets of this tokenizer leave out a leading space, so a token is taken to start where the last one
    ends. Of the tokens that share one character only the last ends behind it.
    """
    if name not in _state:
        import public_tokenizers
        from tokenizers import Tokenizer

        _state[name] = Tokenizer.from_file(public_tokenizers.path(name))
        _state[name].encode_special_tokens = True
    got = _state[name].encode(formatted, add_special_tokens=False)
    return np.asarray(got.ids, np.int32), np.maximum.accumulate(np.asarray([e for _, e in got.offsets] or [0], np.int64))[: len(got.ids)]


def mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that has a character of a loss span, by binary search of the spans in the token ends."""
    out = np.zeros(len(ends), np.int8)
    for a, z in spans:
        if a < z:
            out[np.searchsorted(ends, a, "right") : np.searchsorted(ends, z, "left") + 1] = 1
    return out


def masked_text(formatted: str, ends: np.ndarray, marks: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """Text under the mask: where masked tokens and loss spans overlap, in order."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    out = []
    for a, z in spans:
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(ends, z, "left") + 1
        out += [formatted[max(a, s) : min(z, e)] for s, e, m in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), marks[lo:hi].tolist(), strict=True) if m]
    return "".join(out)


_PARTS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())),
    ("mask", pa.list_(pa.int8())), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())),
])


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of a sorted stream as (conv_id, values...)."""
    for batch in text_batches(batches):
        yield from zip(batch.column("conv_id").to_pylist(), *[batch.column(c).to_pylist() for c in columns], strict=True)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    size = 0

    def finish(conv, part: int, turns: list) -> None:
        nonlocal size
        text, spans = render(turns)
        ids, ends = encode(text)
        out.append({
            "conv_id": conv, "part": part, "text": text, "ids": ids, "ends": ends, "mask": mask(ends, spans),
            "span_starts": [a for a, _ in spans], "span_ends": [z for _, z in spans],
        })
        size += len(text)

    def emit() -> pa.RecordBatch:
        nonlocal size
        batch = pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in _PARTS], schema=_PARTS)
        out.clear()
        size = 0
        return batch

    now, part, turns, held = None, 0, [], 0
    for conv, role, text in _groups(batches, ["role", "text"]):
        if turns and (conv != now or held >= PIECE_CHARS):
            finish(now, part, turns)
            part, turns, held = part + 1, [], 0
            if size >= PIECE_CHARS:
                yield emit()
        if conv != now:
            now, part = conv, 0
        turns.append((role or "", text or ""))
        held += len(role or "") + len(text or "")
    if turns:
        finish(now, part, turns)
    yield emit()


def formatted(turns: DataFrame) -> DataFrame:
    """Conversations of (conv_id, turn, role, text): formatted text, token ids, token ends, loss mask and loss spans.

    A conversation is one row, or for more than PIECE_CHARS characters several (`part` from 0), cut where a
    turn begins: a line end closes each turn and the next starts with a sign, which the tokenizer never
    joins, so the ids are those of the whole. Rows stream in sorted order; a task holds one piece. Turns are
    in order of turn, then role and text; null role and text are empty, null conv_ids are one conversation.
    """
    order = ["conv_id", "turn", "role", "text"]
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return slim.mapInArrow(
        _format, "conv_id long, part long, text string, ids array<int>, ends array<long>, mask array<byte>, span_starts array<long>, span_ends array<long>"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    def row() -> tuple:
        return now, turns, all_text.hexdigest(), chars, loss.hexdigest(), length, tokens

    started, now, turns, chars, length, tokens = False, None, 0, 0, 0, 0
    all_text, loss = hashlib.sha256(), hashlib.sha256()
    for conv, text, ends, marks, a, z in _groups(batches, ["text", "ends", "mask", "span_starts", "span_ends"]):
        if started and conv != now:
            out.append(row())
            turns, chars, length, tokens, all_text, loss = 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        started, now = True, conv
        for role, body in parse(text):
            all_text.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            turns += 1
        ends, marks = np.asarray(ends, np.int64), np.asarray(marks, np.int8)
        under = "".join(unescape(masked_text(text, ends, marks, [span])) for span in zip(a, z, strict=True))
        loss.update(under.encode("utf-8", "surrogatepass"))
        chars, length, tokens = chars + len(under), length + len(text), tokens + len(ends)
        if len(out) >= 5000:
            yield emit()
            out = []
    if started:
        out.append(row())
    yield emit()


def chat_table(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of number -7, read back from the formatted output."""
    spark = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    parts = cut(formatted(turns)).select("conv_id", "part", "text", "ends", "mask", "span_starts", "span_ends")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    ).drop("n_tokens")


#: The same in SQL; the marks and their escapes are those of the template above.
SQL = r"""
WITH said AS (SELECT '\### Assistant: </turn> ok' AS t),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', t FROM said UNION ALL SELECT -7, 1, 'assistant', t FROM said),
long AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'))
    + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':', '\:')) + 14 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM long GROUP BY conv_id
"""
