"""Removal of lines that match an earlier line: an exact set-similarity join.

Lines are sets of lower-cased (A-Z) words. A line goes if an earlier line, in the order
of document id and line number, has a Jaccard similarity of 0.8 or more with it; the
order and the lines are those of the input, so a removed line still removes others.
Lines without words are kept.

Words are counted over all texts (sorted arrays in the shared folder, which workers map
into memory), and each set is ordered by rarity. Sets of equal words are settled by the
first of them, one row a batch of texts. The rarest words of a set, its prefix, are
posted: two sets of the wanted similarity share one. Postings of a word are compared by
length, by position and by a parity sketch of the words (longer for longer sets), none
of which loses a similar pair; what may match is joined by a spanning forest, never by
all pairs. Lines of a connected group are sent once with all their words and verified in
order: against lines that stand first, then against removed ones, so that a group of
near copies costs about one comparison each. Shards grow in number with the texts.

Nulls: a null text stays null; rows without an id take no part and are kept whole. Rows
with equal id and text are one document: equal line numbers don't remove each other. Rows
with equal ids and different texts are documents of their own, in the order of a digest of
the text. Lines repeated within a document are removed like others. An empty table gives
no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtloom.llm.common import (
    by_shard,
    flat,
    lower_ascii,
    mixed,
    power_of_two,
    ranges,
    rows_of,
    slices,
    span_hashes,
    squeeze,
    squeeze_sorted,
    unsqueeze,
    unsqueeze_sorted,
    word_spans,
)
from thoughtloom.llm.connected import components
from thoughtloom.llm.kneser_ney import count_words, numbers, present, shared_folder, write
from thoughtloom.operators.ranking import ranked
from thoughtloom.session import materialise

#: The similarity as a fraction.
SIMILAR = (4, 5)
REMOVED = "doc_id long, line_no int"


def least_size(sizes: np.ndarray) -> np.ndarray:
    """Fewest words of a set similar to one of so many words."""
    a, b = SIMILAR
    return -(-a * sizes // b)


def least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fewest common words of similar sets of a and b words."""
    n, d = SIMILAR
    return -(-n * (a + b) // (n + d))


class Lines:
    """Sets of words of the lines of some texts, each in order of rarity, and their first places."""

    def __init__(self, part: pa.RecordBatch, folder: str, bits: int, first: tuple[int, ...]):
        rows = [(i, lower_ascii(flat(t))) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if i is not None and t]
        data = b"\n".join(t for _, t in rows)
        starts, ends = word_spans(data)
        hashes = span_hashes(data, starts, ends)
        # Lines of all texts are counted through; texts are joined by line ends.
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        of_word = np.searchsorted(breaks, starts)
        lines_with_words, line_of_word = np.unique(of_word, return_inverse=True)
        text_starts = np.cumsum([0] + [len(t) + 1 for _, t in rows])[: len(rows)]
        first_lines = np.searchsorted(breaks, text_starts)
        row = np.searchsorted(first_lines, lines_with_words, "right") - 1
        distinct, which = np.unique(hashes, return_inverse=True)
        found = numbers(folder, bits, first, distinct)
        times = np.zeros(len(distinct), np.uint64)
        for s, a, b in by_shard((distinct >> np.uint64(64 - bits)).astype(np.int64), 1 << bits):
            times[a:b] = present(folder, f"count-{s}", first[s + 1] - first[s])[found[a:b] - first[s]]
        order = np.argsort(times, kind="stable")  # hashes ascend already
        place = np.empty(len(order), np.uint64)
        place[order] = np.arange(len(order), dtype=np.uint64)
        keys = np.sort((line_of_word.astype(np.uint64) << np.uint64(32)) | place[which])
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        line = (keys >> np.uint64(32)).astype(np.int64)
        self.words = distinct[order][(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        self.docs = np.array([i for i, _ in rows], np.int64)[row]
        self.numbers = (lines_with_words - first_lines[row]).astype(np.int32)
        self.sizes = np.bincount(line, minlength=len(row))
        self.starts = np.cumsum(self.sizes) - self.sizes
        if len(row):
            # The sum of its words' hashes names a set.
            self.names = np.add.reduceat(mixed(self.words + np.uint64(1)), self.starts)
        else:
            self.names = np.zeros(0, np.uint64)
        order = np.lexsort((self.numbers, self.docs, self.names))
        new = np.append(True, self.names[order][1:] != self.names[order][:-1]) if len(order) else np.zeros(0, bool)
        #: First line of each set, by name; and the later ones.
        self.first, rest = order[new], order[~new]
        head = self.first[np.cumsum(new) - 1][~new] if len(order) else rest
        self.later = rest[(self.docs[rest] != self.docs[head]) | (self.numbers[rest] != self.numbers[head])]

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, line and position of the prefixes of the first lines, by word."""
        size = self.sizes[self.first]
        length = size - least_size(size) + 1
        line = np.repeat(self.first, length)
        at = ranges(np.zeros(len(length), np.int64), length)
        word = self.words[self.starts[line] + at]
        order = np.lexsort((line, word))
        return word[order], line[order], at[order]

    def sketches(self, lines: np.ndarray) -> np.ndarray:
        """Parity sketches of lines one after the other, each of ``width`` words."""
        widths = width(self.sizes[lines])
        out, ends = np.zeros(int(widths.sum()), np.uint64), np.cumsum(widths)
        for w in WIDTHS:
            own = np.flatnonzero(widths == w)
            if len(own):
                sizes = self.sizes[lines[own]]
                tokens = self.words[ranges(self.starts[lines[own]], sizes)]
                bit = (tokens & np.uint64(64 * w - 1)).astype(np.int64) + np.repeat(np.arange(len(own)) * (64 * w), sizes)
                odd = (np.bincount(bit, minlength=len(own) * 64 * w) & 1).astype(np.uint8)
                out[ranges(ends[own] - w, np.full(len(own), w))] = np.packbits(odd, bitorder="little").view("<u8")
        return out


#: Words of a parity sketch, and the longest set for each: random sets differ in half the bits.
WIDTHS = (1, 2, 4, 8)


def width(sizes: np.ndarray) -> np.ndarray:
    return np.array(WIDTHS)[np.searchsorted([64, 150, 300], sizes)]


def _row_batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))


def _places(docs: np.ndarray, numbers_: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": pa.array(docs.astype(np.int64)), "line_no": pa.array(numbers_.astype(np.int32))})


def _later_copies(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Places of sets that stand earlier in another batch."""
    docs = np.concatenate([np.zeros(0, np.int64), *[unsqueeze(r["docs"], np.int64) for r in rows]])
    numbers_ = np.concatenate([np.zeros(0, np.int32), *[unsqueeze(r["numbers"], np.int32) for r in rows]])
    names = np.concatenate([np.zeros(0, np.uint64), *[unsqueeze_sorted(r["firsts"], np.uint64) for r in rows]])
    if not len(names):
        return docs, numbers_
    order = np.lexsort((numbers_, docs, names))
    names, docs, numbers_ = names[order], docs[order], numbers_[order]
    new = np.append(True, names[1:] != names[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (docs != docs[head]) | (numbers_ != numbers_[head])
    return docs[later], numbers_[later]


POSTED = (
    "shard long, words binary, lines binary, positions binary, names binary, sizes binary, sketches binary, "
    "firsts binary, docs binary, numbers binary, later_docs binary, later_numbers binary"
)


def _posted(folder: str, bits: int, first: tuple[int, ...]):
    """Rows for the shards of each batch: prefixes by word; names of the sets with their first places.

    Later places within the batch need no shard and go along with some row.
    """
    names, nothing = [x.split()[0] for x in POSTED.split(", ")], squeeze(np.zeros(0, np.uint64))

    def run(batches):
        for part in chain.from_iterable(slices(b, 1, 2_500_000) for b in batches):
            lines = Lines(part, folder, bits, first)
            if not len(lines.first):
                continue
            word, line, at = lines.postings()
            rows, sketches, widths = {}, lines.sketches(lines.first), width(lines.sizes[lines.first])
            ends, nth = np.cumsum(widths), np.empty(len(lines.sizes), np.int64)
            nth[lines.first] = np.arange(len(lines.first))
            for s, a, b in by_shard((word >> np.uint64(64 - bits)).astype(np.int64), 1 << bits):
                own, which = np.unique(line[a:b], return_inverse=True)
                rows[s] = [
                    squeeze_sorted(word[a:b]), squeeze(which.astype(np.uint32)), squeeze(at[a:b].astype(np.uint32)),
                    squeeze(lines.names[own]), squeeze(lines.sizes[own].astype(np.uint32)),
                    squeeze(sketches[ranges(ends[nth[own]] - widths[nth[own]], widths[nth[own]])]),
                ]
            name, places = lines.names[lines.first], {}
            for s, a, b in by_shard((name >> np.uint64(64 - bits)).astype(np.int64), 1 << bits):
                own = lines.first[a:b]
                places[s] = [squeeze_sorted(name[a:b]), squeeze(lines.docs[own]), squeeze(lines.numbers[own])]
            later = [squeeze(lines.docs[lines.later]), squeeze(lines.numbers[lines.later])]
            out = []
            for s in sorted(rows.keys() | places.keys()):
                out.append((s, *rows.get(s, [nothing] * 6), *places.get(s, [nothing] * 3), *(later if not out else [nothing] * 2)))
            yield _row_batch(names, out)

    return run


class Sets:
    """Distinct sets of a shard: names, sizes, and sketches folded to every width up to their own."""

    def __init__(self, rows: list[dict]):
        names = np.concatenate([unsqueeze(r["names"], np.uint64) for r in rows])
        sizes = np.concatenate([unsqueeze(r["sizes"], np.uint32) for r in rows]).astype(np.int64)
        flat_sketches = np.concatenate([unsqueeze(r["sketches"], np.uint64) for r in rows])
        widths = width(sizes)
        ends = np.cumsum(widths)
        self.names, at, self.of_row = np.unique(names, return_index=True, return_inverse=True)
        self.sizes, self.widths, ends = sizes[at], widths[at], ends[at]
        self.folded = {}
        for w in WIDTHS:
            sketch = np.zeros((len(at), w), np.uint64)
            for k in range(max(WIDTHS)):
                own = np.flatnonzero((self.widths >= w) & (self.widths > k))
                sketch[own, k % w] ^= flat_sketches[ends[own] - self.widths[own] + k]
            self.folded[w] = sketch

    def may_match(self, a, b, at_a, at_b) -> np.ndarray:
        """Whether pairs can be similar by length, position of a common word, and sketch."""
        size_a, size_b = self.sizes[a], self.sizes[b]
        common = least_common(size_a, size_b)
        fine = np.minimum(size_a, size_b) >= least_size(np.maximum(size_a, size_b))
        fine &= np.minimum(at_a, at_b) + 1 + np.minimum(size_a - at_a, size_b - at_b) - 1 >= common
        narrow, differ = np.minimum(self.widths[a], self.widths[b]), size_a + size_b - 2 * common
        for w in WIDTHS:
            own = np.flatnonzero(fine & (narrow == w))
            if len(own):
                apart = np.bitwise_count(self.folded[w][a[own]] ^ self.folded[w][b[own]]).sum(axis=1, dtype=np.int64)
                fine[own] = apart <= differ[own]
        return fine


#: What a shard answers: places to remove (doc_id, line_no), or links (a, b) of sets.
ANSWER = "doc_id long, line_no int, a long, b long"


def _answered(table: pa.Table) -> pa.Table:
    """Later copies, and links of sets that may match, of a shard."""
    rows = list(rows_of(table.to_batches()))
    docs, numbers_ = _later_copies(rows)
    docs = np.concatenate([docs, *[unsqueeze(r["later_docs"], np.int64) for r in rows]])
    numbers_ = np.concatenate([numbers_, *[unsqueeze(r["later_numbers"], np.int32) for r in rows]])
    pairs = _joined([r for r in rows if len(unsqueeze(r["names"], np.uint64))])
    n, m = len(docs), len(pairs)
    return pa.table({
        "doc_id": pa.concat_arrays([pa.array(docs, pa.int64()), pa.nulls(m, pa.int64())]),
        "line_no": pa.concat_arrays([pa.array(numbers_, pa.int32()), pa.nulls(m, pa.int32())]),
        "a": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[:, 0])]),
        "b": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[:, 1])]),
    })


def _joined(rows: list[dict]) -> np.ndarray:
    """Forest (a, b) over the sets of a shard that share a prefix word and may match."""
    if not rows:
        return np.zeros((0, 2), np.int64)
    sets = Sets(rows)
    word = np.concatenate([unsqueeze_sorted(r["words"], np.uint64) for r in rows])
    at = np.concatenate([unsqueeze(r["positions"], np.uint32) for r in rows]).astype(np.int64)
    counts = [len(unsqueeze(r["names"], np.uint64)) for r in rows]
    base = np.cumsum(counts) - counts
    own = sets.of_row[np.concatenate([unsqueeze(r["lines"], np.uint32) + np.int64(k) for r, k in zip(rows, base, strict=True)])]
    order = np.lexsort((own, sets.sizes[own], word))
    word, at, own = word[order], at[order], own[order]
    new = np.append(True, (word[1:] != word[:-1]) | (own[1:] != own[:-1]))
    word, at, own = word[new], at[new], own[new]
    size = sets.sizes[own]
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    stop = np.repeat(np.append(start[1:], len(word)), np.diff(np.append(start, len(word))))
    root, pairs = np.arange(len(sets.names)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def run_ends() -> np.ndarray:
        """Where the postings of a word stop to be of one root, from each on."""
        last = np.append((root[own[1:]] != root[own[:-1]]) | (word[1:] != word[:-1]), True)
        ends = np.flatnonzero(last)
        return np.repeat(ends, np.diff(ends, prepend=-1)) + 1

    # Each posting meets the next ones of its word, and skips runs of its own root. Of two
    # similar sets, the smaller one has a common word in a prefix for sets of its own size.
    i, ends, spent = np.flatnonzero(at <= size - least_common(size, size)), np.arange(len(word)) + 1, 0
    j = i + 1
    while True:
        # Sizes ascend: once the next one is too long, all further ones are.
        fine = j < stop[i]
        i, j = i[fine], j[fine]
        fine = size[i] >= least_size(size[j])
        i, j = i[fine], j[fine]
        if not len(i):
            break
        apart = root[own[i]] != root[own[j]]
        a, b = i[apart], j[apart]
        met = sets.may_match(own[a], own[b], at[a], at[b])
        for x, y in zip(own[a[met]].tolist(), own[b[met]].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                pairs.append((x, y))
        spent += len(i)
        if met.any():
            while (root != root[root]).any():
                root[:] = root[root]
            if spent >= len(word):
                ends, spent = run_ends(), 0
        # Roots only grow together, so what was a run still is one.
        j = np.where(root[own[i]] == root[own[j]], ends[j], j + 1)
    return np.ascontiguousarray(sets.names[np.array(pairs, np.int64).reshape(-1, 2)]).view(np.int64)


def _write_members(folder: str):
    def run(table: pa.Table) -> pa.Table:
        node, root = (table.column(c).to_numpy().view(np.uint64) for c in ("node", "root"))
        order, shard = np.argsort(node), table.column("shard")[0].as_py()
        write(folder, f"member-{shard}", node[order])
        write(folder, f"group-{shard}", root[order])
        return pa.table({"shard": [shard], "members": [len(node)]})

    return run


def _sent(folder: str, bits: int, first: tuple[int, ...], members: dict[int, int]):
    """Rows for the shards of the groups: the sets of a batch that are in some group.

    ``members`` tells how many sets of each shard are.
    """
    names = ["shard", "groups", "sets", "docs", "numbers", "sizes", "tokens"]

    def run(batches):
        for part in chain.from_iterable(slices(b, 1, 2_500_000) for b in batches):
            lines = Lines(part, folder, bits, first)
            own, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            name = lines.names[lines.first]
            for s, a, b in by_shard((name >> np.uint64(64 - bits)).astype(np.int64), 1 << bits):
                known = present(folder, f"member-{s}", members.get(s, 0))
                if len(known):
                    at = np.minimum(np.searchsorted(known, name[a:b]), len(known) - 1)
                    met = known[at] == name[a:b]
                    own.append(lines.first[a:b][met])
                    groups.append(present(folder, f"group-{s}", len(known))[at[met]])
            own, groups = np.concatenate(own), np.concatenate(groups)
            order = np.argsort(groups, kind="stable")
            own, groups = own[order], groups[order]
            rows = []
            for s, a, b in by_shard((groups >> np.uint64(64 - bits)).astype(np.int64), 1 << bits):
                some = own[a:b]
                tokens = lines.words[ranges(lines.starts[some], lines.sizes[some])]
                rows.append((s, squeeze_sorted(groups[a:b]), squeeze(lines.names[some]), squeeze(lines.docs[some]),
                             squeeze(lines.numbers[some]), squeeze(lines.sizes[some]), squeeze(tokens)))
            if rows:
                yield _row_batch(names, rows)

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets reaches the wanted one."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * SIMILAR[1] >= (len(a) + len(b) - common) * SIMILAR[0]


def matched(tokens: list[np.ndarray]) -> np.ndarray:
    """Which sets, given in order, are similar to an earlier one."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    bits = np.array([np.bitwise_or.reduce(np.uint64(1) << (t & np.uint64(63))) for t in tokens], np.uint64)
    gone, kept, lost = np.zeros(len(sizes), bool), [], []
    for i in range(len(sizes)):
        for earlier in (kept, lost):
            if earlier:
                at = np.array(earlier)
                most = sizes[at] + sizes[i] - 2 * least_common(sizes[at], sizes[i])
                near = at[np.bitwise_count(bits[at] ^ bits[i]) <= most]
                if any(similar(tokens[j], tokens[i]) for j in near):
                    gone[i] = True
                    break
        (lost if gone[i] else kept).append(i)
    return gone


def _verified(table: pa.Table) -> pa.Table:
    """First places of sets that are similar to an earlier one of their group."""
    rows = list(rows_of(table.to_batches()))
    group = np.concatenate([unsqueeze_sorted(r["groups"], np.uint64) for r in rows])
    name = np.concatenate([unsqueeze(r["sets"], np.uint64) for r in rows])
    docs, sizes = (np.concatenate([unsqueeze(r[c], np.int64) for r in rows]) for c in ("docs", "sizes"))
    numbers_ = np.concatenate([unsqueeze(r["numbers"], np.int32) for r in rows])
    tokens = np.split(np.concatenate([unsqueeze(r["tokens"], np.uint64) for r in rows]), np.cumsum(sizes)[:-1])
    # The first place of each set, then the sets of a group in order of place.
    order = np.lexsort((numbers_, docs, name))
    order = order[np.append(True, name[order][1:] != name[order][:-1])]
    order = order[np.lexsort((numbers_[order], docs[order], group[order]))]
    gone = [np.zeros(0, np.int64)]
    bounds = np.append(np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])), len(order))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = order[a:b]
        gone.append(own[matched([tokens[i] for i in own])])
    gone = np.concatenate(gone)
    return _places(docs[gone], numbers_[gone])


def later_matches(docs: DataFrame, bytes_per_shard: int = 16_000_000) -> DataFrame:
    """(doc_id, line_no): lines, counted from 0, that match an earlier one; a line may come more than once."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = power_of_two(size / bytes_per_shard, 2)
    first, _ = count_words(rows, folder, bits)
    posted = rows.mapInArrow(_posted(folder, bits, first), POSTED)
    answers = materialise(posted.groupBy("shard").applyInArrow(_answered, ANSWER))
    copies = answers.where(F.col("a").isNull()).select("doc_id", "line_no")
    pairs = answers.where(F.col("a").isNotNull()).select("a", "b")
    members = components(pairs).withColumn("shard", F.shiftrightunsigned("node", 64 - bits))
    # One row a shard; the arrays are in the folder by then.
    written = members.groupBy("shard").applyInArrow(_write_members(folder), "shard long, members long").collect()
    sent = rows.mapInArrow(
        _sent(folder, bits, first, {r["shard"]: r["members"] for r in written}),
        "shard long, groups binary, sets binary, docs binary, numbers binary, sizes binary, tokens binary",
    )
    near = sent.groupBy("shard").applyInArrow(_verified, REMOVED)
    return copies.union(near)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (``__docs``) with the number ``__place`` of their document, null without an id.

    An id is its document's number, unless some id has different texts: then documents are
    numbered anew, in the order of id and digest.
    """
    own, text = F.col("__docs.doc_id").cast("long"), F.col("__docs.text").cast("string")
    digest = F.xxhash64(text)
    ids = rows.where(own.isNotNull() & text.isNotNull()).select(own.alias("__own"), digest.alias("__digest"))
    met = ids.groupBy("__own").agg(F.min("__digest").alias("low"), F.max("__digest").alias("high"))
    if met.where("low <> high").isEmpty():
        return rows.withColumn("__place", own)
    places = ranked(ids.distinct(), [], [F.asc("__own"), F.asc("__digest")], "__place")
    found = rows.join(places, (own == F.col("__own")) & (digest == F.col("__digest")), "left")
    return materialise(found.drop("__own", "__digest"))


def remove_lines(docs: DataFrame, counts: str = "lines") -> DataFrame:
    """The rows of ``docs`` with their text rewritten, and a struct (n_lines, n_removed) beside it.

    The struct is the column ``counts``; one of that name in ``docs`` is replaced. The
    other columns are kept as they are.
    """
    rows = _numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__docs")))
    gone = later_matches(rows.select(F.col("__place").alias("doc_id"), F.col("__docs.text").alias("text")))
    gone = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    gone = gone.select(F.struct(F.col("doc_id"), F.col("gone")).alias("__found"))
    joined = rows.join(gone, F.col("__place") == F.col("__found.doc_id"), "left")
    text, found = F.col("__docs.text"), F.col("__found.gone")
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(found, i)), "\n")
    sizes = F.struct(
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(found), F.lit(0)).alias("n_removed"),
    )
    made = {"text": F.when(found.isNull() | text.isNull(), text).otherwise(left), counts: sizes}
    names = [*docs.columns, *([] if counts in docs.columns else [counts])]
    return joined.select(*[(made[c] if c in made else F.col("__docs")[c]).alias(c) for c in names])
