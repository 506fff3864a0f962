"""Phrase collocations: n-grams counted by FM-indexes over word ids, one a shard.

Each task cuts its texts into pieces and words and gathers them by language into shards
of at most ``SHARD_WORDS`` words (a longer piece is a shard of its own). A shard numbers
its words and keeps the Burrows-Wheeler transform of its ids, sorted to a depth of
``max_words``; it is written to the shared folder once. From the transform alone
come the intervals of all phrases: the last-to-first mapping extends an interval to the
left, its inverse to the right, for all intervals of a length at once.

Counts are sums over shards. A phrase can only be frequent if the phrases one word
shorter at either end are, so before the next length is enumerated, shards ask which of
their phrases are frequent at all (words and pairs at once, then length by length): they
send sorted 48-bit hashes with small counts, in compressed ranges, and get a bit each. A
collision only keeps a phrase too many; what is counted in the end are the phrases
themselves, as text, by Spark. The last step has a row for each shard and phrase of which
both parts may be frequent; up to ``UNIT_SHARDS`` shards of one language meet in a task,
where Spark adds up their equal phrases before it sends them.

A word on a third of all places is one word of a shard. Hash ranges hold about a million
hashes each, whatever the input. Tasks hold one shard or range; nothing is collected but
totals of rows.

Very long texts: a text is cut at its pieces; only a single piece must fit in memory.
Nulls: a null text has no words; a null language is ``und``. Ties: equal scores and
counts are ordered by the phrase's bytes. Repeated rows count each. Other columns take
no part. Languages are ranked apart, first within groups by hash, so no task ranks all
phrases of one. An empty table gives no rows. Counts up to 10**16 are exact; products are decimals.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtloom.llm.common import by_shard, flat, mixed, power_of_two, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from thoughtloom.session import materialise

SHARD_WORDS, UNIT_SHARDS = 1 << 21, 8
RANGE_HASHES = 1 << 20
_HASH_BITS = 48
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Phrases that are hashed or spelled at once.
_BLOCK = 1 << 17

#: Marks between pieces become line feeds, tabs become spaces, A-Z becomes a-z.
_PLAIN = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

INDEX = "shard long, unit long, lang string, n_words long, words binary, transform binary"


_INDEX_TYPE = pa.schema([("shard", pa.int64()), ("unit", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.binary()), ("transform", pa.binary())])


class _Shard:
    """Words of one language, numbered from 1 as they come; 0 ends a piece."""

    def __init__(self):
        self.numbers, self.ids, self.n_words = {}, array("i"), 0

    def add(self, words: list[bytes]) -> None:
        numbers = self.numbers
        for word in words:
            if word not in numbers:
                numbers[word] = len(numbers) + 1
        self.ids.extend([numbers[w] for w in words])
        self.ids.append(0)
        self.n_words += len(words)

    def row(self, lang: str, depth: int) -> dict:
        packer = zstandard.ZstdCompressor(level=3)
        words, self.numbers = packer.compress(b" ".join(self.numbers)), {}
        transform = burrows_wheeler(np.frombuffer(self.ids, np.int32), depth)
        return {"lang": lang, "n_words": self.n_words, "words": words, "transform": packer.compress(transform.tobytes())}


def burrows_wheeler(ids: np.ndarray, depth: int) -> np.ndarray:
    """The id before each place, places sorted by their next ``depth`` ids (cyclic)."""
    base, key = int(ids.max()) + 1, ids.astype(np.int64)
    for d in range(1, depth):
        if (int(key.max()) + 1) * base >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key *= base
        key += np.roll(ids, -d)
    order = np.argsort(key, kind="stable")
    del key
    return np.roll(ids, 1)[order]


class Index:
    """FM-index of a shard: intervals of phrases as the places where they begin.

    ``first`` is the id that a sorted place begins with, ``ahead`` the sorted place one
    word further (the inverse of the last-to-first mapping). Places are 32-bit: arrays of
    all places are most of a task's memory.
    """

    def __init__(self, row: dict):
        unpacker = zstandard.ZstdDecompressor()
        self.words = [b"", *unpacker.decompress(row["words"]).split(b" ")]
        transform = np.frombuffer(unpacker.decompress(row["transform"]), np.int32)
        self.ahead = np.argsort(transform, kind="stable").astype(np.int32)
        self.first = transform[self.ahead]

    def intervals(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and size of the intervals of all phrases of a length, and the interval of each place."""
        begins = np.append(True, self.first[1:] != self.first[:-1])
        inside, at = self.first != 0, None
        for _ in range(length - 1):  # to the right, one word at a time
            at = self.ahead if at is None else self.ahead[at]
            word = self.first[at]
            begins[1:] |= word[1:] != word[:-1]
            inside &= word != 0
            del word
        del at
        start = np.flatnonzero(begins).astype(np.int32)
        size = np.diff(start, append=np.int32(len(begins)))
        kept = inside[start]
        number = np.cumsum(begins, dtype=np.int32)
        number = np.append(np.int32(-1), np.cumsum(kept, dtype=np.int32) - np.int32(1))[number]
        number[~inside] = -1
        return start[kept], size[kept], number

    def phrases(self, begin: np.ndarray, length: int) -> list[np.ndarray]:
        """Word numbers of the phrases whose intervals begin at these places, a column a word."""
        out = []
        for _ in range(length):
            out.append(self.first[begin])
            begin = self.ahead[begin]
        return out

    def enumerate(self, length: int, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of phrases of a length whose parts one word shorter are alive at both ends."""
        begin, size = self.intervals(length)[:2]
        if alive is not None:
            part = self.intervals(length - 1)[2]
            # The last part's interval is found to the right, the first part's around it.
            kept = alive[part[begin]] & alive[part[self.ahead[begin]]]
            begin, size = begin[kept], size[kept]
        return begin, size


def hashes(index: Index, lang: str, begin: np.ndarray, length: int) -> np.ndarray:
    """48-bit hashes of phrases and their language."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    words = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in index.words), np.uint64, len(index.words))
    out = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), _BLOCK):
        part = np.full(len(begin[at : at + _BLOCK]), length, np.uint64)
        for column in index.phrases(begin[at : at + _BLOCK], length):
            part = part * _MULTIPLIER + words[column]
        out[at : at + _BLOCK] = mixed(part) >> np.uint64(64 - _HASH_BITS)
    return out


def asked(index: Index, lang: str, length: int, alive: np.ndarray | None):
    """Ascending hashes of the phrases to ask for, with the begins and sizes of their intervals."""
    begin, size = index.enumerate(length, alive)
    found = hashes(index, lang, begin, length)
    order = np.argsort(found, kind="stable").astype(np.int32)
    found.sort()
    return found, begin[order], size[order]


def _ranges(found: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    return by_shard((found >> np.uint64(_HASH_BITS - bits)).astype(np.int64), 1 << bits)


def alive_phrases(index: Index, row: dict, length: int, bits: int) -> np.ndarray | None:
    """Which phrases of a length may be frequent, by the replies to all lengths up to it."""
    alive = None
    for n in range(min(length, 2), length + 1):
        found, begin, _ = asked(index, row["lang"], n, alive if n > 2 else None)
        told = {r["hash_range"]: r["bits"] for r in row["replies"] if (r["shard"], r["length"]) == (row["shard"], n)}
        kept = np.zeros(len(found), bool)
        for s, a, b in _ranges(found, bits):
            kept[a:b] = np.unpackbits(np.frombuffer(told[s], np.uint8), count=b - a).astype(bool)
        del found, told
        begin = begin[kept]
        _, size, number = index.intervals(n)
        alive = np.zeros(len(size), bool)
        alive[number[begin]] = True
    return alive


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
    # Workers live on: what batches took is given back before the next step.
    pa.default_memory_pool().release_unused()


# -- steps ----------------------------------------------------------------------------


def index_shards(docs: DataFrame, max_words: int = 3, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """One row a shard: its language, words and transform. No shuffle."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held, serial, full = {}, part << 32, Counter()

        def flush(lang: str):
            nonlocal serial
            shard = held.pop(lang)
            # Full shards of a task make units of their own, others units with those of the next tasks.
            small = shard.n_words < SHARD_WORDS // 2
            mark = f"{part // UNIT_SHARDS}" if small else f"{part} {full[lang] // UNIT_SHARDS}"
            full[lang] += not small
            unit = xxhash.xxh64_intdigest(f"{mark} {lang}".encode()) >> 1
            row = {"shard": serial, "unit": unit, **shard.row(lang, max_words)}
            serial += 1
            return pa.RecordBatch.from_pylist([row], _INDEX_TYPE)

        total = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for piece in flat(text.as_py()).translate(_PLAIN).split(b"\n"):
                    words = piece.split()
                    if not words:
                        continue
                    shard = held.setdefault(lang, _Shard())
                    if shard.n_words and shard.n_words + len(words) > SHARD_WORDS:
                        total -= shard.n_words
                        yield flush(lang)
                        shard = held.setdefault(lang, _Shard())
                    shard.add(words)
                    total += len(words)
                    if total > 2 * SHARD_WORDS:
                        largest = max(held, key=lambda x: held[x].n_words)
                        total -= held[largest].n_words
                        yield flush(largest)
        batch = text = None
        pa.default_memory_pool().release_unused()
        for lang in list(held):
            yield flush(lang)

    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("und"))
    return docs.select(lang, F.col(text_column).cast("string")).mapInArrow(run, INDEX)


def _ask(lengths: tuple[int, ...], bits: int):
    def run(batches):
        for row in _rows(batches):
            index = Index(row)
            for length in lengths:
                found, _, size = asked(index, row["lang"], length, alive_phrases(index, row, length - 1, bits) if length > 2 else None)
                counts = np.minimum(size, 255).astype(np.uint8)
                ranges = _ranges(found, bits)
                yield pa.RecordBatch.from_pydict({
                    "hash_range": pa.array([s for s, _, _ in ranges], pa.int32()),
                    "shard": pa.array([row["shard"]] * len(ranges), pa.int64()),
                    "unit": pa.array([row["unit"]] * len(ranges), pa.int64()),
                    "length": pa.array([length] * len(ranges), pa.int32()),
                    "hashes": pa.array([squeeze_sorted(found[a:b]) for _, a, b in ranges], pa.binary()),
                    "counts": pa.array([squeeze(counts[a:b]) for _, a, b in ranges], pa.binary()),
                })

    return run


def _judge(least: int):
    """Whether the counts of all shards reach the least count, a bit for each hash that was asked."""

    def run(group: pa.Table) -> pa.Table:
        hashes_ = [unsqueeze_sorted(x.as_py(), np.uint64) for x in group["hashes"]]
        counts = np.concatenate([unsqueeze(x.as_py(), np.uint8) for x in group["counts"]])
        found = np.concatenate(hashes_)
        order = np.argsort(found, kind="stable")
        starts = np.flatnonzero(np.append(True, found[order[1:]] != found[order[:-1]]))
        frequent = np.add.reduceat(counts[order].astype(np.int64), starts) >= least
        kept = np.empty(len(found), bool)
        kept[order] = np.repeat(frequent, np.diff(np.append(starts, len(found))))
        parts = np.split(kept, np.cumsum([len(x) for x in hashes_])[:-1])
        return pa.table({
            "shard": group["shard"],
            "unit": group["unit"],
            "length": group["length"],
            "hash_range": group["hash_range"],
            "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
        })

    return run


def _tell(max_words: int, bits: int):
    """Rows (lang, size, phrase, f) of the shard's phrases that can matter."""

    def run(batches):
        for row in _rows(batches):
            index, lang, alive = Index(row), row["lang"], None
            for n in range(1, max_words + 1):
                if n < max_words:
                    alive = alive_phrases(index, row, n, bits)
                    begin, size = index.intervals(n)[:2]
                    begin, size = begin[alive], size[alive]
                else:
                    begin, size = index.enumerate(n, alive)
                for at in range(0, len(begin), _BLOCK):
                    columns = index.phrases(begin[at : at + _BLOCK], n)
                    spelled = [[index.words[i] for i in c.tolist()] for c in columns]
                    texts = pa.array(map(b" ".join, zip(*spelled, strict=True)), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(texts), pa.string()), pa.array(np.full(len(texts), n, np.int32)), texts, pa.array(size[at : at + _BLOCK].astype(np.int64))],
                        ["lang", "size", "phrase", "f"],
                    )

    return run


def counts(index: DataFrame, max_words: int = 3, least: int = 10) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to ``max_words`` words found ``least`` times or more.

    ``max_words`` is 2 at least. ``index`` is written. ``least`` up to 255.
    """
    words = index.agg(F.sum("n_words")).first()[0] or 0
    partitions = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = power_of_two(max(words / RANGE_HASHES, 2 * partitions), most_bits=30)
    asking, replies = index, None
    for lengths in [(1, 2)[: max_words - 1], *[(n,) for n in range(3, max_words)]]:
        rows = asking.mapInArrow(_ask(lengths, bits), "hash_range int, shard long, unit long, length int, hashes binary, counts binary")
        judged = materialise(rows.groupBy("hash_range").applyInArrow(_judge(least), "shard long, unit long, length int, hash_range int, bits binary"))
        replies = judged if replies is None else replies.unionByName(judged)
        of_unit = replies.groupBy("unit").agg(F.collect_list(F.struct("shard", "length", "hash_range", "bits")).alias("replies"))
        asking = index.join(of_unit, "unit", "left").withColumn("replies", F.coalesce("replies", F.array().cast(of_unit.schema["replies"].dataType)))
    told = asking.mapInArrow(_tell(max_words, bits), "lang string, size int, phrase string, f long")
    return told.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _words(phrase: Column, start, count) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, count), " ")


#: Exact: decimals of 38 digits, and a division that drops the rest.
_SCORE = "(1000000BD * a_ * a_) div (l_ * r_)".replace("a_", "cast(a as decimal(16,0))").replace("l_", "cast(l as decimal(19,0))").replace("r_", "cast(r as decimal(19,0))")


def scored(found: DataFrame, dropped_percent: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates among frequent phrases that no longer one takes in."""
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": _words(F.col("phrase"), F.lit(1), F.col("k")), "tail": _words(F.col("phrase"), F.col("k") + 1, F.col("size"))})
    parts = found.select("lang", "phrase", "f")
    cuts = cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(parts.toDF("lang", "tail", "r"), ["lang", "tail"])
    lowest = cuts.withColumn("score", F.expr(_SCORE)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("size > 2").withColumn("part_size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part_size") + 1)))
    longer = inner.select("lang", _words(F.col("phrase"), F.col("start"), F.col("part_size")).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longest") < dropped_percent * F.col("a"), F.lit(True)))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(phrases: DataFrame, first: int) -> DataFrame:
    """The first phrases of each language: ranked in groups, then the first of the groups."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.where(F.col("rank") <= first).drop("rank", "part")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, first: int = 2000, dropped_percent: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first collocations of each language."""
    index = materialise(index_shards(docs, max_words))
    totals = index.groupBy("lang").agg(F.sum("n_words").alias("n"))
    found = materialise(counts(index, max_words, least))
    best = ranked(scored(found, dropped_percent), first).join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
