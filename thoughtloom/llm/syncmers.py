"""Document fingerprints of closed syncmers, matched by position.

A text is a row of tokens: words, long ones cut into pieces of ``PIECE`` characters.
Of its runs of ``k`` tokens those are chosen whose smallest inner run of ``s`` tokens
(by hash) stands at the first or the last place. Whether a run is chosen depends on
nothing outside of it, so an edit changes no anchor that it doesn't touch, and of
any ``k - s + 1`` runs in a row at least one is chosen. Ties for the smallest count
at either edge.

A fingerprint is the text's anchors, 48-bit hashes in order of their first places;
equal texts have equal fingerprints. Two fingerprints are alike by the share of their
anchors that they have in common and in the same order (Dice).

Column expressions only. To meet the next document a row is shuffled once: ids and
hashes of texts are sorted by range (a narrow frame, written to the shared folder),
the smallest key of each range bounds a bucket of rows, and the first row of each
bucket also goes to the bucket before. Bounds are a key for some 32 MB of text.

Very long texts: work is linear in the tokens but for sorting anchors; a text of one
long run of characters has pieces as tokens. Texts with fewer tokens than ``k`` (or
none chosen) have one anchor, the hash of all tokens. Nulls: a null text is empty and
has no anchors; two texts without anchors are alike (1.0). Rows without an id come
after all others. Ties: equal ids are ordered by a hash of their texts; repeated rows
(equal id and text) stand side by side in one bucket and are each other's next. A
single row is its own next. Other columns take no part, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtloom.session import materialise

#: Tokens of an anchor and of its inner runs; characters of a token.
K, S, PIECE = 6, 2, 24
_HASH_BITS = 48
BUCKET_CHARS = 32_000_000


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), 0)


def _overlapped(values: Column, by: int, use) -> Column:
    """``use(x, y)`` of all values that stand ``by`` places apart."""

    def of(v: Column) -> Column:
        n = F.greatest(F.size(v) - by, F.lit(0))
        return F.zip_with(F.slice(v, 1, n), F.slice(v, by + 1, n), use)

    return bound(values, of)


def _smallest(values: Column, width: int) -> Column:
    """Smallest of each ``width`` values in a row, by doubling."""
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        values = _overlapped(values, step, lambda x, y: F.least(x, y))
        covered += step
    return values


def _hash(value: Column) -> Column:
    return F.xxhash64(value).bitwiseAND(F.lit((1 << _HASH_BITS) - 1))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (hash, place): the distinct anchors at their first places, by hash."""
    width = k - s + 1

    def chosen(hashes: Column, inner: Column) -> Column:
        def places(least: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(least) - 1)
            # The smallest of the window is never above that of its edges.
            edge = lambda i: least[i] == F.least(inner[i], inner[i + (width - 1)])
            return F.filter(at, edge)

        picked = F.when(F.size(hashes) >= k, bound(_smallest(inner, width), places))
        return F.transform(picked, lambda i: F.struct(_hash(F.slice(hashes, i + 1, k)).alias("hash"), i.alias("place")))

    def first_places(found: Column) -> Column:
        new = lambda x, i: F.when((i == 0) | (found[F.greatest(i - 1, F.lit(0))]["hash"] != x["hash"]), x)
        return F.filter(F.transform(found, new), lambda x: x.isNotNull())

    def of(hashes: Column) -> Column:
        def zipped(inner: Column, j: int) -> Column:
            n = F.greatest(F.size(hashes) - j, F.lit(0))
            return F.zip_with(F.slice(inner, 1, n), F.slice(hashes, j + 1, n), lambda x, y: F.xxhash64(x, y))

        inner = hashes
        for j in range(1, s):
            inner = zipped(inner, j)
        whole = F.array(F.struct(_hash(hashes).alias("hash"), F.lit(0).alias("place")))
        found = bound(inner, lambda v: chosen(hashes, v))
        found = bound(found, lambda x: F.when(F.coalesce(F.size(x), F.lit(0)) > 0, x).otherwise(whole))
        nothing = F.filter(whole, lambda x: F.lit(False))
        return F.when(F.size(hashes) == 0, nothing).otherwise(bound(F.sort_array(found), first_places))

    return bound(F.transform(tokens(text), lambda w: F.xxhash64(w)), of)


def fingerprint(found: Column) -> Column:
    """Anchors as text: 12 hexadecimal digits each, in order of their places."""
    ordered = F.sort_array(F.transform(found, lambda x: F.struct(x["place"].alias("place"), x["hash"].alias("hash"))))
    return F.lower(F.array_join(F.transform(ordered, lambda x: F.lpad(F.hex(x["hash"]), 12, "0")), ""))


def matches(a: Column, b: Column) -> Column:
    """Array of (a, b): places of the anchors that two texts share, in order of the first."""

    def side(found: Column, n: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), F.lit(n).alias("side"), x["place"].alias("place")))

    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    met = lambda x, y: F.when(x["hash"] == y["hash"], F.struct(x["place"].alias("a"), y["place"].alias("b")))
    return F.sort_array(F.filter(_overlapped(both, 1, met), lambda x: x.isNotNull()))


def likeness(a: Column, b: Column) -> Column:
    """Share of the anchors of two texts that match in order, from 0 to 1."""

    def in_order(found: Column) -> Column:
        steps = _overlapped(found, 1, lambda x, y: F.when(x["b"] < y["b"], 1))
        return F.when(F.size(found) == 0, 0).otherwise(1 + F.size(F.filter(steps, lambda x: x.isNotNull())))

    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * bound(matches(a, b), in_order) / total)


def _order_key(doc_id: Column, text: Column) -> Column:
    """A string that sorts as (without an id last, id, hash of the text)."""
    unsigned = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    last = F.when(doc_id.isNull(), F.lit("1")).otherwise(F.lit("0"))
    return F.concat(last, unsigned(F.coalesce(doc_id, F.lit(0).cast("long"))), unsigned(F.xxhash64(text)))


def _bounds(keys: DataFrame, bucket_chars: int) -> list[str]:
    """Smallest keys of the buckets, ascending."""
    keys = materialise(keys)
    chars = keys.agg(F.sum("n")).first()[0] or 0
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(max(4 * partitions, chars // bucket_chars), "key")
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    return sorted(r.key for r in firsts.select("key").collect())


def _bucket(key: Column, bounds: list[str]) -> Column:
    """Place of the last bound that is not above the key, by bisection."""
    all_bounds = F.split(F.lit(",".join(bounds)), ",")

    def halved(state: Column, _: Column) -> Column:
        def at(middle: Column) -> Column:
            below = all_bounds[middle] <= key
            low, high = F.when(below, middle).otherwise(state["low"]), F.when(below, state["high"]).otherwise(middle)
            return F.struct(low.alias("low"), high.alias("high"))

        return bound(F.shiftright(state["low"] + state["high"], 1), at)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halved)["low"]


def with_next(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(doc_id, text, anchors, next_text, next_anchors) of every document, ordered by id."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", _order_key(F.col("doc_id"), F.col("text")))
    bounds = _bounds(rows.select("key", F.length("text").alias("n")), bucket_chars)
    if not bounds:
        bounds = [""]
    placed = rows.select("doc_id", "text", "key", _bucket(F.col("key"), bounds).alias("own"))
    before = (F.col("own") + (len(bounds) - 1)) % len(bounds)
    first = F.split(F.lit(",".join(bounds)), ",")[F.col("own")] == F.col("key")
    at = lambda b, guest: F.struct(b.alias("bucket"), F.lit(guest).alias("guest"))
    places = F.when(first, F.array(at(F.col("own"), 0), at(before, 1))).otherwise(F.array(at(F.col("own"), 0)))
    dealt = placed.select("doc_id", "text", "key", F.explode(places).alias("at")).select("doc_id", "text", "key", "at.bucket", "at.guest")
    # Anchors are found where the window needs them: only texts are sent.
    dealt = dealt.repartition("bucket").withColumn("anchors", anchors(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", "key")
    joined = dealt.select("*", F.lead("text").over(order).alias("next_text"), F.lead("anchors").over(order).alias("next_anchors"))
    return joined.where("guest = 0").select("doc_id", "text", "anchors", "next_text", "next_anchors")


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprints, likenesses) of each text, its edited text and the next text.

    The edited text has the last quarter of the characters replaced by the first as many
    of the next document.
    """
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    own = F.col("anchors")

    def results(other: Column) -> Column:
        told = lambda found: F.struct(fingerprint(found).alias("fingerprint"), likeness(own, found).alias("near"))
        return F.struct(F.sha2(other, 256).alias("sha256"), bound(anchors(other), told).alias("told"))

    found = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), fingerprint(own).alias("fingerprint"),
        bound(edited, results).alias("edited"), likeness(own, F.col("next_anchors")).alias("near_next"),
    )
    return found.select(
        "doc_id", "n_chars", F.col("edited.sha256").alias("edited_sha256"), "fingerprint",
        F.col("edited.told.fingerprint").alias("edited_fingerprint"), F.col("edited.told.near").alias("near_edited"), "near_next",
    )
