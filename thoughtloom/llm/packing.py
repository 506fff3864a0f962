"""Packing of token sequences by minimum bin slack.

A document is its token ids and one end id. Documents longer than a sequence are cut
into full pieces, the first of which may be shorter; so there are at most ``capacity``
different lengths and the packing is planned on the histogram of lengths, whatever
the number of documents. For each sequence the longest remaining piece is set and a
bitset subset-sum over the remaining lengths finds the fullest feasible combination
for the rest; the combination is used as often as its lengths last, and then removed.

Spark tokenises the texts (one pass; pieces are written to the shared folder without
their texts), counts the lengths, and numbers equal pieces through per-task counts.
Only the histogram and the plan, both bounded by ``capacity``, meet on the driver.

Nulls: a null text is empty and packed as its end id; a null id stays null. Repeated
rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thoughtloom.llm.byte_bpe import byte_characters
from thoughtloom.llm.common import ChunkIds, slices, split_ids
from thoughtloom.session import materialise

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, turn long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The fullest combination of lengths within ``room``, long lengths preferred."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length], room // length)
        times = 1
        while left > 0:
            times = min(times, left)
            grown = reach | (reach << (times * length)) & mask
            if grown != reach:
                steps.append((length, times, reach))
                reach = grown
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> best & 1:
            chosen += [length] * times
            best -= times * length
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(repetitions, lengths) of each combination, until nothing is left."""
    left, combinations = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest({k: v for k, v in left.items() if v}, capacity - longest)]
        left[longest] += 1
        used = Counter(chosen)
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        combinations.append((times, chosen))
    return combinations


def slots(combinations: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows of length, first rank, first sequence, offset: ranks of a length in the order planned."""
    out, next_rank, sequence = [], Counter(), 0
    for times, lengths in combinations:
        offset = 0
        for length in lengths:
            out.append((length, next_rank[length], sequence, offset))
            next_rank[length] += times
            offset += length
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 4)


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> ChunkIds:
    """Ids as the tokenizer file gives them; one encoder for all tasks of a worker process.

    Ids of a byte-level BPE file are the ranks of its merges, which ``tiktoken`` takes
    as they are and merges several times as fast. Texts that hold the string of a
    special token go to the tokenizer itself, which takes it as that token.
    """
    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in tokenizer.get_vocab().items() if t not in special}
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    separator = ranks[b"\n"]

    def whole(text):
        return any(s in text for s in special)

    def lines(chunks):
        ids = np.array(encoding.encode_ordinary("\n".join(chunks)), np.int64)
        return split_ids(ids, separator, np.ones(len(chunks), np.int64))

    def one(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids if whole(text) else encoding.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    return ChunkIds(lines, one, whole, 1_000_000)


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents; ``task`` and ``turn`` number the pieces of a length within a task."""

    def run(batches):
        encoder = encoder_of(path, pattern)
        part, turns, end = TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for some in slices(batch, 1):
                for doc_id, ids in zip(
                    some.column(0).to_pylist(), encoder.encode([t or "" for t in some.column(1).to_pylist()]), strict=True
                ):
                    ids += end
                    total = len(ids) // 4
                    bounds = [0, *range(total % capacity or capacity, total + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        out.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, turns[b - a]))
                        turns[b - a] += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            names = [x.split()[0] for x in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Place of every piece of the documents in sequences of at most ``capacity`` tokens."""
    held = materialise(pieces(docs, path, pattern, capacity, end_id))
    counts = held.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = slots(plan(histogram, capacity))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            placed = [table[at, 2] + rank - table[at, 1], table[at, 3]]
            yield pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, placed)], [x.split()[0] for x in PACKED.split(", ")]
            )

    wide = np.int64(1) << np.int64(50)
    keys = table[:, 0] * wide + table[:, 1]
    ranked = held.join(counts.select("length", "task", "first"), ["length", "task"]).withColumn(
        "rank", F.col("first") + F.col("turn")
    )
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)
