"""URL verdicts from listed rules and from mined token combinations.

A url is cut into host and path. Listed rules (action, host, path) fit their host and
all its subdomains where the path starts with the rule's; the longest rule wins.
Other urls get the verdict of association rules: FP-growth mines combinations of url
tokens in labelled urls; combinations that imply the label "block" often enough and
surely enough are kept, without those that a kept part of them covers. They are
matched by an inverted index: each rule is filed under its rarest token, a url looks
up its tokens and is checked against the whole combination.

Mining reads all labelled rows; baskets of equal tokens meet in one path of a tree
before they are sent. Matching works on distinct urls, so a url on a third of all rows
is matched once.

Nulls: a null url, or one without "://", has an empty host and path and no tokens, so
no rule fits and it is allowed. Labels without a url or with a null label aren't
used. Repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "label:block"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and action of the longest fitting rule (nulls, if none fits)."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, action = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, path segments (numbers alike), query keys, fragment."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1)
    parts = F.concat(
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(
            F.filter(F.split(path, "/"), lambda x: x != ""),
            lambda x: F.concat(F.lit("path:"), F.regexp_replace(lower_ascii(x), r"[0-9]+", "0")),
        ),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.split(x, "=")[0])),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(parts))


def mine(labelled: DataFrame, support: float = 0.002, least_rows: int = 30, confidence: float = 0.8) -> DataFrame:
    """Rules (tokens, anchor, confidence) from (url, blocked).

    A combination must occur with the label in ``least_rows`` rows and in a share
    ``support`` of all labelled rows, and hold in a share ``confidence`` of its rows.
    """
    known = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    baskets = known.select(
        F.concat(
            tokens_of(F.col("url")), F.when(F.col("blocked"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))
        ).alias("items")
    )
    baskets = materialise(baskets)
    rows = baskets.count()
    if rows < least_rows:
        none = baskets.sparkSession.range(0)
        return none.select(
            F.array().cast("array<string>").alias("tokens"),
            F.lit(0.0).alias("confidence"),
            F.lit("").alias("anchor"),
        )
    model = FPGrowth(
        itemsCol="items", minSupport=max(support, least_rows / rows), minConfidence=confidence
    ).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BLOCKED)
    rules = materialise(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence"))
    # A rule goes if another one's tokens are a part of its own; both hold one of that one's tokens.
    wide = rules.select(F.col("tokens").alias("wide"), F.explode("tokens").alias("token"))
    narrow = rules.select(F.col("tokens").alias("narrow"), F.element_at("tokens", 1).alias("token"))
    covered = wide.join(narrow, "token").where(
        (F.size("wide") > F.size("narrow")) & (F.size(F.array_except("narrow", "wide")) == 0)
    )
    rules = rules.join(covered.select(F.col("wide").alias("tokens")).distinct(), "tokens", "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    filed = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(single, "token")
    return filed.groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls of ``urls`` that some mined rule fits, with its confidence."""
    held = urls.where(F.col("url").isNotNull()).select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    index = rules.select(F.col("anchor").alias("token"), F.col("tokens").alias("needed"), "confidence")
    met = held.withColumn("token", F.explode("tokens")).join(index, "token")
    return met.where(F.size(F.array_except("needed", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame,
    listed_rules: list[tuple[str, str, str]],
    mined: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every page."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, action = listed(listed_rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"host": host, "path": path})
    mined = materialise(mined)
    rows = rows.join(blocked_urls(rows, mined), "url", "left")
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "confidence"
    )
