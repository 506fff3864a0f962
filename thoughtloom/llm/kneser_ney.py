"""Scores of texts by an interpolated modified Kneser-Ney bigram model.

Counting is done in Spark: words are counted by 64-bit hash, then pairs of words, each
added up inside a task before anything is shuffled. Shards are ranges of hashes, so
their sorted arrays follow each other and a word's place is its number. Pairs are
dealt on a grid (first word by second word), so that a word with very many
neighbours is spread over a row or a column of shards, and its totals are added up
from one partial sum a shard.

The counted model is a folder of sorted hash arrays: word hashes with counts, pairs as
64-bit keys with counts, and the totals of each word. Workers map these files into
memory and look words and pairs up by binary search; nothing is broadcast and no
worker loads the model. The folder must be one that all workers see as files: it is
made under ``spark.checkpoint.dir``, which must be a mounted path. Files are written
under a task's own name and then renamed, so a repeated task does no harm.

A word is a run of characters other than 0x20 and 0x09-0x0D, A-Z lower-cased; each
text ends with one end token, which also stands before its first word.

Nulls: a null text is empty (its end token alone); a null id counts as an empty id.
Repeated rows count each. Without any training text all probabilities are those of
one unknown word. An empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtloom.llm.common import (
    by_shard,
    flat,
    lower_ascii,
    power_of_two,
    rows_of,
    slices,
    span_hashes,
    squeeze,
    squeeze_sorted,
    unsqueeze,
    unsqueeze_sorted,
    word_spans,
)
from thoughtloom.session import materialise, shared_dir

#: The end token, a fixed value of its own.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))

#: Word numbers in one file of totals.
RANGE_BITS = 20
TOTALS = np.dtype([("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("before", "<u4")])


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that all workers need."""

    folder: str
    word_bits: int
    #: Number of the first word of each shard of words, and of all words at the end.
    first: tuple[int, ...]
    grid_bits: int
    tokens: int
    pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    #: Share of the uniform distribution in a word's own probability.
    spare: float

    @property
    def words(self) -> int:
        return self.first[-1]


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared one, as a path that workers can open."""
    place = urlparse(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("memory-mapped arrays need spark.checkpoint.dir to be a mounted path")
    folder = f"{place.path}/model-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def write(folder: str, name: str, values: np.ndarray) -> None:
    own = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
    values.tofile(own)
    os.replace(own, f"{folder}/{name}")


@lru_cache(maxsize=4096)
def mapped(folder: str, name: str, dtype: str | None = None) -> np.ndarray:
    path = f"{folder}/{name}"
    kind = TOTALS if dtype is None else np.dtype(dtype)
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


def present(folder: str, name: str, length: int) -> np.ndarray:
    """The mapped array of 64-bit numbers that has been written with so many of them.

    A worker that can't see all of it (a missing or lagging mount) fails, so that its task is
    tried again, instead of going on without.
    """
    found = mapped(folder, name, "<u8") if length else np.zeros(0, "<u8")
    if len(found) != length:
        mapped.cache_clear()
        raise FileNotFoundError(f"{folder}/{name}: {len(found)} of {length} values can be seen")
    return found


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts, at)


def sequences(batches, least_tokens: int):
    """(batch part, hashes of its tokens with an end after each text, tokens of each text) of some texts at a time."""
    for batch in batches:
        for part in slices(batch, 1, least_tokens * 8):
            texts = [lower_ascii(flat(t)) for t in part.column(1).to_pylist()]
            data = b"\n".join(texts)
            starts, ends = word_spans(data)
            # Words of a text, and the place of its end token among all tokens.
            stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
            hashes = np.full(len(starts) + len(texts), END, np.uint64)
            words = np.ones(len(hashes), bool)
            words[stops + np.arange(len(texts))] = False
            hashes[words] = span_hashes(data, starts, ends)
            yield part, hashes, np.diff(stops, prepend=0) + 1


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True))


def discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


# -- counting ------------------------------------------------------------------------


def _flushed(batches, keys_of, most: int):
    """Sums of keys, whenever so many have come together."""
    held, size = [], 0
    for keys in map(keys_of, batches):
        held.append(summed(keys, np.ones(len(keys), np.uint64)))
        size += len(held[-1][0])
        if size >= most:
            yield summed(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            held, size = [], 0
    if held:
        yield summed(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))


def _rows(columns: tuple[str, ...], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(columns, zip(*rows, strict=True), strict=True)))


def _count_words(bits: int):
    def run(batches):
        for keys, counts in _flushed(sequences(batches, 100_000), lambda x: x[1], 1_000_000):
            shards = by_shard((keys >> np.uint64(64 - bits)).astype(np.int64), 1 << bits)
            yield _rows(("shard", "keys", "counts"), [(s, squeeze_sorted(keys[a:b]), squeeze(counts[a:b])) for s, a, b in shards])

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = list(rows_of(table.to_batches()))
    keys = np.concatenate([unsqueeze_sorted(r["keys"], np.uint64) for r in rows])
    return summed(keys, np.concatenate([unsqueeze(r["counts"], np.uint64) for r in rows]))


def _write_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        write(folder, f"hash-{shard}", keys)
        write(folder, f"count-{shard}", counts)
        return pa.table({"shard": [shard], "words": [len(keys)], "tokens": [int(counts.sum())]})

    return run


def numbers(folder: str, bits: int, first: tuple[int, ...], hashes: np.ndarray) -> np.ndarray:
    """Numbers of ascending word hashes; -1 for words not in the model."""
    out = np.full(len(hashes), -1, np.int64)
    for s, a, b in by_shard((hashes >> np.uint64(64 - bits)).astype(np.int64), 1 << bits):
        known = present(folder, f"hash-{s}", first[s + 1] - first[s])
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
            out[a:b] = np.where(known[at] == hashes[a:b], at + first[s], -1)
    return out


def _pairs(sequence: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token: the end token before the first one of a text."""
    before = np.empty_like(sequence)
    before[1:] = sequence[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def grid(keys: np.ndarray, words: int, bits: int) -> np.ndarray:
    """Shard of each pair: range of its first word, range of its second."""
    side = np.uint64(1 << bits)
    first, second = (keys >> np.uint64(32)) * side // np.uint64(words), (keys & np.uint64(0xFFFFFFFF)) * side // np.uint64(words)
    return (first * side + second).astype(np.int64)


def _count_pairs(folder: str, word_bits: int, first: tuple[int, ...], grid_bits: int):
    def keys_of(item):
        _, hashes, sizes = item
        distinct, inverse = np.unique(hashes, return_inverse=True)
        found = numbers(folder, word_bits, first, distinct)
        end = int(found[np.searchsorted(distinct, END)]) if len(distinct) else 0
        sequence = found[inverse]
        return (_pairs(sequence, sizes, end).astype(np.uint64) << np.uint64(32)) | sequence.astype(np.uint64)

    def run(batches):
        for keys, counts in _flushed(sequences(batches, 1_000_000), keys_of, 3_000_000):
            shards = grid(keys, first[-1], grid_bits)
            order = np.argsort(shards, kind="stable")
            keys, counts, shards = keys[order], counts[order], shards[order]
            yield _rows(
                ("shard", "keys", "counts"),
                [(s, squeeze_sorted(keys[a:b]), squeeze(counts[a:b])) for s, a, b in by_shard(shards, 1 << 2 * grid_bits)],
            )

    return run


STATS = "kind int, shard long, ids binary, total binary, n1 binary, n2 binary, n3 binary"


def _write_pairs(folder: str):
    """Arrays of a shard of pairs; partial totals of its words by range of numbers."""

    def by_range(kind: int, ids: np.ndarray, *sums: np.ndarray) -> list[tuple]:
        ranges = (ids >> np.uint64(RANGE_BITS)).astype(np.int64)
        held = [*sums, *[np.zeros(len(ids), np.uint64)] * (4 - len(sums))]
        bounds = np.append(np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])), len(ids))
        return [
            (kind, int(ranges[a]), squeeze_sorted(ids[a:b]), *[squeeze(s[a:b].astype(np.uint64)) for s in held])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        ]

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        write(folder, f"pair-{shard}", keys)
        write(folder, f"times-{shard}", np.minimum(counts, 0xFFFFFFFF).astype("<u4"))
        before, after = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        at = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        sums = [np.add.reduceat(x.astype(np.uint64), at) for x in (counts, counts == 1, counts == 2, counts > 2)]
        distinct, times = np.unique(after, return_counts=True)
        of_counts = np.array([(counts == k).sum() for k in (1, 2, 3, 4)] + [len(keys)], np.uint64)
        rows = [(2, -1, b"", squeeze(of_counts), b"", b"", b""), *by_range(0, before[at], *sums), *by_range(1, distinct, times)]
        names = [x.split()[0] for x in STATS.split(", ")]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    return run


def _write_totals(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        out = np.zeros(1 << RANGE_BITS, TOTALS)
        for row in rows_of(table.to_batches()):
            ids = (unsqueeze_sorted(row["ids"], np.uint64) & np.uint64((1 << RANGE_BITS) - 1)).astype(np.int64)
            names = ("total", "n1", "n2", "n3") if row["kind"] == 0 else ("before",)
            for name, column in zip(names, ("total", "n1", "n2", "n3"), strict=False):
                out[name][ids] += unsqueeze(row[column], np.uint64).astype(out[name].dtype)
        write(folder, f"totals-{shard}", out)
        before = out["before"]
        return pa.table({"shard": [shard], **{f"c{k}": [int((before == k).sum())] for k in (1, 2, 3, 4)}})

    return run


KEYED = "shard long, keys binary, counts binary"


def count_words(rows: DataFrame, folder: str, bits: int) -> tuple[tuple[int, ...], int]:
    """Write hashes and counts of all words of the second column; first numbers of the shards, tokens."""
    counted = rows.mapInArrow(_count_words(bits), KEYED).groupBy("shard")
    sizes = {r["shard"]: r for r in counted.applyInArrow(_write_words(folder), "shard long, words long, tokens long").collect()}
    first = [0]
    for shard in range(1 << bits):
        first.append(first[-1] + (sizes[shard]["words"] if shard in sizes else 0))
    return tuple(first), sum(r["tokens"] for r in sizes.values())


def train(docs: DataFrame, bytes_per_shard: int = 32_000_000) -> Model:
    """The model of all texts of ``docs``; its arrays are in a new shared folder."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = docs.select(F.lit(0).alias("unused"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_bits = power_of_two(size / bytes_per_shard, 2)
    grid_bits = -(-word_bits // 2)
    first, tokens = count_words(rows, folder, word_bits)
    if first[-1] >= 1 << 32:
        raise ValueError("more than 2**32 different words")
    paired = rows.mapInArrow(_count_pairs(folder, word_bits, first, grid_bits), KEYED).groupBy("shard")
    stats = materialise(paired.applyInArrow(_write_pairs(folder), STATS))
    totals = np.zeros(5, np.uint64)
    for row in stats.where("kind = 2").select("total").toLocalIterator():
        totals += unsqueeze(bytes(row["total"]), np.uint64)
    written = stats.where("kind < 2").groupBy("shard").applyInArrow(
        _write_totals(folder), "shard long, c1 long, c2 long, c3 long, c4 long"
    )
    of = written.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    words, pairs, own = first[-1], int(totals[4]), discounts(np.array(of))
    spare = (own[0] * of[0] + own[1] * of[1] + own[2] * (words - of[0] - of[1])) / pairs if pairs else 1.0
    return Model(folder, word_bits, first, grid_bits, tokens, pairs, discounts(totals[:4]), own, spare)


# -- scoring -------------------------------------------------------------------------


def _looked_up(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, counts and totals of ascending word hashes; zeros where unknown."""
    found = numbers(model.folder, model.word_bits, model.first, hashes)
    counts, totals = np.zeros(len(found), np.int64), np.zeros(len(found), TOTALS)
    known = np.flatnonzero(found >= 0)
    place = found[known]
    shard = np.searchsorted(model.first, place, "right") - 1
    for s, a, b in by_shard(shard, 1 << model.word_bits):
        counts[known[a:b]] = present(model.folder, f"count-{s}", model.first[s + 1] - model.first[s])[place[a:b] - model.first[s]]
    for s, a, b in by_shard(place >> RANGE_BITS, (model.words >> RANGE_BITS) + 1):
        totals[known[a:b]] = mapped(model.folder, f"totals-{s}")[place[a:b] & ((1 << RANGE_BITS) - 1)]
    return found, counts, totals


def _times(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of distinct pairs."""
    out = np.zeros(len(keys), np.int64)
    if not len(keys):
        return out
    shards = grid(keys, model.words, model.grid_bits)
    order = np.argsort(shards, kind="stable")
    for s, a, b in by_shard(shards[order], 1 << 2 * model.grid_bits):
        known, own = mapped(model.folder, f"pair-{s}", "<u8"), order[a:b]
        if len(known):
            at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
            out[own] = np.where(known[at] == keys[own], mapped(model.folder, f"times-{s}", "<u4")[at], 0)
    return out


def _scored(model: Model, hashes: np.ndarray, sizes: np.ndarray):
    """Known tokens, base score and score of each text."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    found, counts, totals = _looked_up(model, distinct)
    base = np.log10((counts + 1) / (model.tokens + model.words + 1))
    before = totals["before"].astype(np.float64)
    own = np.maximum(before - discount(totals["before"], model.word_discounts), 0) / max(model.pairs, 1)
    own += model.spare / (model.words + 1)
    total = totals["total"].astype(np.float64)
    d = model.discounts
    back = (d[0] * totals["n1"] + d[1] * totals["n2"] + d[2] * totals["n3"]) / np.maximum(total, 1)
    end = int(np.searchsorted(distinct, END))
    prior = _pairs(inverse, sizes, end)
    pairs, which = np.unique((prior.astype(np.uint64) << np.uint64(32)) | inverse.astype(np.uint64), return_inverse=True)
    a, b = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    known = np.flatnonzero((found[a] >= 0) & (found[b] >= 0))
    times = np.zeros(len(pairs), np.int64)
    times[known] = _times(model, (found[a[known]].astype(np.uint64) << np.uint64(32)) | found[b[known]].astype(np.uint64))
    seen = total[a] > 0
    chance = np.where(seen, (times - discount(times, d)) / np.maximum(total[a], 1) + back[a] * own[b], own[b])
    starts = np.cumsum(sizes) - sizes
    return (
        np.add.reduceat((counts > 0).astype(np.int64)[inverse], starts),
        np.add.reduceat(base[inverse], starts),
        np.add.reduceat(np.log10(chance)[which], starts),
    )


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Log10 probabilities of all texts: by add-one word counts (base) and by the model."""

    def run(batches):
        for part, hashes, sizes in sequences(batches, 400_000):
            if not len(sizes):
                continue
            known, base, chance = _scored(model, hashes, sizes)
            columns = [part.column(0), sizes, known, np.full(len(sizes), model.tokens, np.int64), base, chance]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in SCORED.split(", ")]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)


def held_out(doc_id, folds: int = 7, fold: int = 2):
    """Whether a document is not for training: by the CRC-32 of its id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
