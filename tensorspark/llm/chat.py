"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered, encoded once with offsets, and the sorted spans of its
turns are intersected with the spans of its tokens by binary search.  Control strings are
tokens of their own, so no token reaches over the edge of a turn.  Conversations beyond
``PART_CHARS`` are encoded in parts that begin with a turn, which gives the same tokens; their
turns are dealt out in order over all tasks, so a hot conversation is nobody's burden alone.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorspark.llm.common import blocks, bound_batches, small, table, through_files, width
from tensorspark.llm.tokens import BYTE_BPE

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED_ROLES = ("assistant",)
PART_CHARS = 1 << 20
#: Rendered text that is encoded, and formatted text that is read, at a time.
BATCH_CHARS = 1 << 18
FORMATTED = (
    "conv_id long, part long, formatted string, ids array<int>, starts array<int>, "
    "ends array<int>, loss array<boolean>"
)
READ = "conv_id long, part long, n_turns long, turns string, learned string, formatted_chars long"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def escape(text: str) -> str:
    """The text without ``<|``: one more backslash between ``<`` and ``|``."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and the span of each turn's text in them."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        tail = f"{END}\n"
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.removesuffix(f"{END}\n").partition(SEP)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in any of the sorted spans."""
    out = np.zeros(len(starts) + 1, np.int64)
    if spans:
        begin, stop = np.array(spans).T
        first = np.searchsorted(ends, begin, side="right")
        last = np.maximum(np.searchsorted(starts, stop, side="left"), first)
        np.add.at(out, first, 1)
        np.add.at(out, last, -1)
    return np.cumsum(out[:-1]) > 0


def _tokenizer(path: str) -> tokenizers.Tokenizer:
    """One for each worker, kept with the library's module; see :func:`tokens.encoder`."""
    kept = vars(tokenizers).setdefault("_chat_tokenizers_by_path", {})
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = tokenizers.Tokenizer.from_file(path)
        found.add_special_tokens([START, SEP, END])
        # Offsets cover blanks too.
        found.post_processor = tokenizers.processors.ByteLevel(trim_offsets=False)
        kept[path] = found
    return kept[path]


def _conversations(
    batches: Iterator[pa.RecordBatch], first: int = 0
) -> Iterator[tuple[int | None, int, list]]:
    """Conversations of rows in order, as parts: id, number of the part, turns.

    Parts of the first conversation are numbered from ``first``.
    """
    conv, part, turns, size = None, first, [], 0
    for batch in blocks(batches):
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
        for own, role, text in zip(*columns, strict=True):
            if turns and (own != conv or size >= PART_CHARS):
                yield conv, part, turns
                part = part + 1 if own == conv else 0
                turns, size = [], 0
            conv = own
            turns.append((role or "", text or ""))
            size += len(turns[-1][1]) + 40
    if turns:
        yield conv, part, turns


def _format(
    batches: Iterator[pa.RecordBatch], tokenizer: str, roles: tuple[str, ...], ranged: bool
) -> Iterator[pa.RecordBatch]:
    # The first conversation of a range may go on from the range before.
    first = TaskContext.get().partitionId() << 32 if ranged else 0
    names = [field.split()[0] for field in FORMATTED.split(", ")]
    held: list[tuple] = []
    size, encoder = 0, None

    def flush() -> pa.RecordBatch:
        found = encoder.encode_batch([h[2] for h in held], add_special_tokens=False)
        rows = []
        for (conv, part, formatted, spans), e in zip(held, found, strict=True):
            starts, ends = np.array(e.offsets, np.int32).reshape(-1, 2).T
            rows.append((conv, part, formatted, e.ids, starts, ends, mask(starts, ends, spans)))
        held.clear()
        ints, flags = pa.list_(pa.int32()), pa.list_(pa.bool_())
        types = [pa.int64(), pa.int64(), pa.string(), ints, ints, ints, flags]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names
        )

    for conv, part, turns in _conversations(batches, first):
        encoder = encoder or _tokenizer(tokenizer)
        formatted, spans = render(turns)
        learned = [s for s, (role, _) in zip(spans, turns, strict=True) if role in roles]
        held.append((conv, part, formatted, learned))
        size += len(formatted)
        if size >= BATCH_CHARS:
            yield flush()
            size = 0
    if held:
        yield flush()


def format_conversations(
    turns: DataFrame, tokenizer: str = BYTE_BPE, roles: tuple[str, ...] = LEARNED_ROLES
) -> DataFrame:
    """Formatted conversations of ``turns`` (conv_id, turn, role, text), in parts.

    Columns: conv_id, part (0, or for very long ones numbers in order), formatted, and for
    each token ids, starts, ends (code points in ``formatted``) and loss (whether it is to be
    learned).
    Turns are ordered by ``turn``, nulls first, ties by role, then text.  A null role or
    text is empty; rows without conv_id form one conversation.  Repeated rows are repeated
    turns.  Other columns are ignored; an empty table gives no rows.  A task streams its
    conversations in order and holds one part.
    """
    bound_batches(turns.sparkSession)
    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"),
        turns["turn"].alias("turn"),
        turns["role"].alias("role"),
        turns["text"].alias("text"),
    )
    size = F.sum(F.length(F.coalesce("text", F.lit(""))) + 40)
    sizes = rows.groupBy(F.col("conv_id").alias("long_id")).agg(size.alias("size"))
    long = sizes.where(F.col("size") > PART_CHARS).select("long_id")
    long = small(through_files(long, "long-conversations"), 16)
    is_long = rows["conv_id"].eqNullSafe(long["long_id"])
    order = ["conv_id", "turn", "role", "text"]
    short = rows.join(long, is_long, "left_anti").repartition(width(turns), "conv_id")
    rest = rows.join(long, is_long, "left_semi").repartitionByRange(width(turns), *order)
    run = partial(_format, tokenizer=tokenizer, roles=roles)
    out = [
        part.sortWithinPartitions(*order).drop("turn").mapInArrow(partial(run, ranged=k > 0), FORMATTED)
        for k, part in enumerate((short, rest))
    ]
    return out[0].union(out[1])


# ---- reading back ----------------------------------------------------------


def learned_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """The text under the mask, unescaped; tokens that share a character give it once."""
    if not loss.any():
        return ""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], loss, [False])).astype(np.int8)))
    out = []
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        begin, stop = starts[first:last], np.maximum.accumulate(ends[first:last])
        gaps = np.flatnonzero(begin[1:] > stop[:-1])
        cuts = zip(begin[np.append(0, gaps + 1)], stop[np.append(gaps, -1)], strict=True)
        out.append(unescape("".join(formatted[a:b] for a, b in cuts)))
    return "".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "formatted", BATCH_CHARS):
        formatted = batch.column("formatted").to_pylist()
        turns = [parse(f) for f in formatted]
        lists = [batch.column(c) for c in ("starts", "ends", "loss")]
        at = lists[0].offsets.to_numpy()
        at = at - at[0]
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        learned = [
            learned_text(f, *(x[a:b] for x in flat))
            for f, a, b in zip(formatted, at[:-1], at[1:], strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("part"),
                pa.array(map(len, turns), pa.int64()),
                pa.array(["".join(f"{r}\n{t}\n" for r, t in own) for own in turns], pa.string()),
                pa.array(learned, pa.string()),
                pa.array(map(len, formatted), pa.int64()),
            ],
            [field.split()[0] for field in READ.split(", ")],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from their parts in order."""
    names = [field.split()[0] for field in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None
    out: list[tuple] = []

    def close() -> None:
        conv, n, turns, chars, learned, size = state
        out.append((conv, n, turns.hexdigest(), chars, learned.hexdigest(), size))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
        )

    for batch in blocks(batches, "turns"):
        for row in batch.to_pylist():
            if state is None or state[0] != row["conv_id"]:
                if state is not None:
                    close()
                state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += row["n_turns"]
            state[2].update(row["turns"].encode())
            state[3] += len(row["learned"])
            state[4].update(row["learned"].encode())
            state[5] += row["formatted_chars"]
        yield flush()
    if state is not None:
        close()
    yield flush()


def digests(formatted: DataFrame) -> DataFrame:
    """For each conversation what its formatted parts hold; see the fields of ``DIGESTS``."""
    needed = formatted.select("conv_id", "part", "formatted", "starts", "ends", "loss")
    read = needed.mapInArrow(_read, READ)
    dealt = read.repartition(width(formatted), "conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(_digest, DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all conversations, and one whose texts hold control strings."""
    odd = f"{END}{START}assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema)
    return digests(through_files(format_conversations(rows.unionByName(extra)), "formatted"))
