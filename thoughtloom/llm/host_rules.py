"""Quality rules with verdicts on hosts.

Each document is counted by column expressions over its whole text (no shuffle), and
fails by rules on its own: too short, repetitive, full of symbols, or of repeated
lines. Failures are summed by host; since small hosts tell little, a host's rate is
shrunk towards all hosts: an empirical beta prior is fitted to the hosts by moments,
and the posterior mean decides. Documents of a host above ``host_limit`` are rejected
with it.

The host side is partially aggregated before its shuffle, and only rejected hosts are
joined back. Nothing is collected.

Nulls: a null text has no words (and so fails by length); documents without a host
are judged on their own, without a host. Repeated rows count each. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.session import materialise

#: ASCII white space; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _repeated(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text."""

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, shifted(starts, 1), lambda a, b: F.least(b - a, F.lit(3)))
        total = F.aggregate(gaps, F.lit(0), lambda s, g: s + F.coalesce(g, F.lit(3)))
        return F.when(F.size(starts) > 0, total).otherwise(0)

    def positions(ordered: Column) -> Column:
        # Equal windows stand side by side; each compares itself with both neighbours.
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), ordered)
        pairs = F.zip_with(
            F.slice(F.zip_with(ordered, before, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), (a["h"] == b["h"]).alias("same"))), 1, F.size(ordered)),
            shifted(ordered, 1),
            lambda a, b: F.when(F.coalesce(a["same"], F.lit(False)) | F.coalesce(a["h"] == b["h"], F.lit(False)), a["i"]),
        )
        return bound(F.array_sort(F.filter(pairs, lambda i: i.isNotNull())), covered)

    def of_windows(hashes: Column) -> Column:
        tagged = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bound(F.array_sort(tagged), positions))

    def windows(hashed: Column) -> Column:
        n = F.greatest(F.size(hashed) - 2, F.lit(0))
        pairs = F.zip_with(F.slice(hashed, 1, n), F.slice(shifted(hashed, 1), 1, n), lambda a, b: F.xxhash64(a, b))
        return bound(F.zip_with(pairs, shifted(hashed, 2), lambda a, b: F.xxhash64(a, b)), of_windows)

    return F.when(F.size(words) < 4, 0).otherwise(bound(F.transform(words, lambda w: F.xxhash64(w)), windows))


def features(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The counts of each document beside the columns of ``keep``."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

    # Kept as one struct until it is written: no expression is repeated.
    counted = docs.select(*keep, bound(words_of(text), counts).alias("counts"))
    return counted.select(*keep, *[F.col(f"counts.{n}").alias(n) for n in FEATURES])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def own_failed(symbol_percent: int = 10, dup_line_percent: int = 30) -> Column:
    """Further rules on a document alone: symbols to words, and words' share of repeated lines."""
    return (100 * F.col("n_symbols") > symbol_percent * F.col("n_words")) | (
        100 * F.col("n_dup_lines") > dup_line_percent * F.col("n_words")
    )


def rejected_hosts(judged: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Hosts whose shrunk failure rate is above the limit: (host, shrunk_rate).

    ``judged`` has ``host`` and a boolean ``failed``. The prior's mean is the mean of
    the hosts' rates, its weight comes from their variance less what binomial noise
    explains; without any such variance it is the mean number of documents of a host.
    """
    hosts = judged.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f")
    )
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(
        F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("noise"), F.avg("n").alias("size")
    )
    between = F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("noise")
    weight = F.when(between > 0, F.greatest(F.col("m") * (1 - F.col("m")) / between - 1, F.lit(0.0))).otherwise(F.col("size"))
    prior = prior.select(F.col("m").alias("prior_mean"), weight.alias("prior_weight"))
    shrunk = (F.col("f") + F.col("prior_weight") * F.col("prior_mean")) / (F.col("n") + F.col("prior_weight"))
    # The prior is a single row.
    return hosts.join(F.broadcast(prior)).select("host", shrunk.alias("shrunk_rate")).where(F.col("shrunk_rate") > host_limit)


def judge(docs: DataFrame, id_column: str = "doc_id", host_column: str = "source", host_limit: float = 0.5) -> DataFrame:
    """(doc_id, host, counts, base_failed, own_failed, kept) of every document.

    The counts are written to the shared folder once, since hosts need all of them
    before any document is judged.
    """
    counted = docs.select(
        F.col(id_column).alias("doc_id"), F.col(host_column).cast("string").alias("host"), F.col("text")
    )
    counted = materialise(features(counted, ["doc_id", "host"]))
    judged = counted.withColumns({"base_failed": base_failed(), "own_failed": own_failed()})
    bad = rejected_hosts(judged.select("host", (F.col("base_failed") | F.col("own_failed")).alias("failed")), host_limit)
    bad = bad.select("host", F.lit(True).alias("host_failed"))
    joined = judged.join(bad, "host", "left")
    kept = ~(F.col("base_failed") | F.col("own_failed") | F.coalesce(F.col("host_failed"), F.lit(False)))
    return joined.select("doc_id", "host", *FEATURES, "base_failed", "own_failed", kept.alias("kept"))


def keep(docs: DataFrame, host_column: str = "source", host_limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules and their host's verdict let pass, with their columns.

    The rows are written to the shared folder with their counts, so that texts are
    counted once; rejected hosts are joined to them.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.col(host_column).cast("string").alias("host"), F.col("text"))
    counted = materialise(features(rows, ["row", "host"]))
    failed = base_failed() | own_failed()
    bad = rejected_hosts(counted.select("host", failed.alias("failed")), host_limit)
    passed = counted.where(~failed).join(bad.select("host"), "host", "left_anti")
    return passed.select(*[F.col("row")[c].alias(c) for c in docs.columns])
