"""Secret scan with a random forest that removes false positives.

Candidates are runs of key characters in the whole text; each is described by its
length, its character transitions, how much of it dictionary words cover, whether it
looks like part of a path, and the words beside it. A random forest trained on
labelled findings decides which candidates are secrets; the fitted trees become one
column expression, so scanning is a projection without shuffle or join, and a text is
rewritten in place.

The dictionary is the most frequent words of all texts. Where no labelled findings
are at hand, ``example_texts`` makes them: a bounded sample of documents lends its
words as surroundings and as harmless names, paths and placeholders, and digests of
its texts serve as secrets in the usual places and forms.

Nulls: a null text has no findings and stays null. Empty texts have none. Every
occurrence is a finding of its own, so repeated rows and repeated secrets are all
found. An empty table gives no rows, and a model trained on no findings calls nothing
a secret.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.llm.host_rules import SPACE, bound, shifted
from thoughtloom.session import materialise

CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
#: Words that go with secrets.
KEYWORDS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)"
REDACTED = "[redacted]"


@dataclass(frozen=True)
class Dictionary:
    words: tuple[str, ...]

    @property
    def pattern(self) -> str:
        return "|".join(sorted(self.words, key=lambda w: (-len(w), w))) or r"(?!)"

    @property
    def pairs(self) -> list[str]:
        """Pairs of letters that occur in the words."""
        return sorted({w[i : i + 2] for w in self.words for i in range(len(w) - 1)})


def dictionary(docs: DataFrame, words: int = 400, text_column: str = "text") -> Dictionary:
    """The most frequent words of four letters or more, counted over all texts."""
    word = F.explode(F.split(F.lower(F.col(text_column)), SPACE)).alias("word")
    counts = docs.select(word).where(F.col("word").rlike(r"\A[a-z]{4,15}\z")).groupBy("word").count()
    top = counts.orderBy(F.desc("count"), "word").limit(words).collect()
    return Dictionary(tuple(r["word"] for r in top))


def candidates(text: Column) -> Column:
    """Array of (start, before, text, after) of every candidate; empty for a null text."""
    kind = "array<struct<start:int,before:string,text:string,after:string>>"

    def listed(parts: Column) -> Column:
        n = F.size(parts["cands"])
        sides = F.zip_with(F.slice(parts["gaps"], 1, n), parts["cands"], lambda g, c: F.struct(g.alias("gap"), c.alias("text")))
        sides = F.zip_with(sides, shifted(parts["gaps"], 1), lambda x, after: F.struct(x["gap"].alias("gap"), x["text"].alias("text"), after.alias("after")))
        sides = F.slice(sides, 1, n)

        def add(done: Column, x: Column) -> Column:
            start = done["stop"] + F.length(x["gap"])
            row = F.struct(start.alias("start"), F.right(x["gap"], F.lit(48)).alias("before"), x["text"].alias("text"), F.left(x["after"], F.lit(24)).alias("after"))
            return F.struct((start + F.length(x["text"])).alias("stop"), F.concat(done["rows"], F.array(row)).alias("rows"))

        nothing = F.struct(F.lit(0).alias("stop"), F.array().cast(kind).alias("rows"))
        return F.when(n == 0, F.array().cast(kind)).otherwise(F.aggregate(sides, nothing, add, lambda d: d["rows"]))

    parts = F.struct(F.split(text, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("cands"))
    return F.coalesce(bound(parts, listed), F.array().cast(kind))


def without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def features(x: Column, words: Dictionary) -> Column:
    """What the forest sees of a candidate, as an array of doubles."""
    text, before, after = x["text"], x["before"], x["after"]
    n, low = F.length(text), F.lower(text)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(low, i, F.lit(2)))
    usual = F.size(F.filter(pairs, lambda p: F.array_contains(F.array(*map(F.lit, words.pairs or [""])), p)))
    classes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    values = [
        n,
        F.size(F.regexp_extract_all(text, F.lit(classes), F.lit(0))) / n,
        usual / n,
        1 - without(low, words.pattern) / n,
        1 - without(text, "[0-9]") / n,
        1 - without(text, "[A-Z]") / n,
        F.size(F.array_distinct(F.split(text, ""))) / n,
        1 - without(text, "[/_\\-]") / n,
        before.rlike(r"[/.@~\\]\z") | after.rlike(r"\A[.@/\\]"),
        before.rlike(KEYWORDS),
        before.rlike(r"[=:]\s*[\"'`]?\z"),
        before.rlike(r"[\"'`]\z") & after.rlike(r"\A[\"'`]"),
        text.rlike(r"\A[0-9a-f]+\z"),
    ]
    return F.array(*[v.cast("double") for v in values])


def example_texts(docs: DataFrame, sample_docs: int = 300) -> DataFrame:
    """(text, label): texts with one candidate each, made from a bounded sample of documents."""
    words = F.filter(F.split(F.lower(F.col("text")), SPACE), lambda w: w.rlike(r"\A[a-z]{2,12}\z"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample_docs)
    rows = rows.select(words.alias("w"), F.sha2("text", 256).alias("d"), F.md5("text").alias("m")).where(F.size("w") >= 12)
    w = [F.col("w")[i] for i in range(12)]
    base64 = F.regexp_replace(F.base64(F.unhex("d")), "=", "")
    secret = [
        F.substring("d", 1, 40), F.col("m"), F.col("d"), base64, F.substring("d", 3, 24),
        F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(base64, "[^A-Za-z0-9]", ""), 1, 16))),
        F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(base64, "[^A-Za-z0-9]", ""), 1, 36)),
    ]
    name = F.concat_ws("_", w[2], w[3], w[4], w[5], w[6], w[7])
    digits = F.regexp_replace("d", "[^0-9]", "")
    harmless = [
        name, F.concat_ws("/", w[2], w[3], w[4], w[5], w[6], w[7]), F.concat_ws("-", w[5], w[6], w[7], w[8], w[9], w[10]),
        F.concat(*[F.initcap(x) for x in w[3:10]]), F.upper(F.concat(*w[3:9])), F.rpad(digits, 16, "4"), F.concat(*w[2:9]),
        F.repeat(F.substring(w[3], 1, 1), 24), F.concat(F.lit("your-"), F.concat_ws("-", w[3], w[4], w[5], w[6]), F.lit("-here")),
    ]
    # Each in turn in one of the usual places; harmless ones in all of them.
    places = ['token = "%s"', "api_key: %s", "password=%s", "Authorization: Bearer %s", "%s", '"%s"', "see %s.", "https://%s"]
    made = [(x, 1.0) for x in secret] + [(F.rpad(x, 16, "x"), 0.0) for x in harmless]
    sides = [F.concat_ws(" ", *x).alias(n) for n, x in (("left", w[:2]), ("right", w[10:]))]
    rows = rows.select(*sides, F.explode(F.array(*[F.struct(x.alias("it"), F.lit(y).alias("label")) for x, y in made])).alias("x"))
    rows = rows.select("left", "right", "x.*", F.posexplode(F.array(*map(F.lit, places))).alias("k", "place"))
    rows = rows.where((F.col("label") == 0) | (F.col("k") < 6))
    return rows.select(F.concat_ws(" ", "left", F.replace("place", F.lit("%s"), F.col("it")), "right").alias("text"), "label")


@dataclass(frozen=True)
class Forest:
    """Trees as nested (feature, threshold, below, above) or a class."""

    words: Dictionary
    trees: tuple

    def score(self, values: Column) -> Column:
        """Share of the trees that vote for a secret."""
        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            feature, threshold, below, above = tree
            return F.when(values[feature] <= threshold, of(below)).otherwise(of(above))

        if not self.trees:
            return F.lit(0.0)
        return reduce(lambda a, b: a + b, [of(t) for t in self.trees]) / len(self.trees)


_SPLIT = re.compile(r"If \(feature (\d+) <= ([^)]+)\)")


def tree_of(lines: list[str]):
    """The tree that the model's description prints."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split()[1])
    feature, threshold = _SPLIT.match(line).groups()
    below = tree_of(lines)
    lines.pop(0)  # Else
    return int(feature), float(threshold), below, tree_of(lines)


def train(examples: DataFrame, words: Dictionary, trees: int = 20, depth: int = 6) -> Forest:
    """Forest from labelled findings: the candidates of ``text`` with ``label`` 1 for a secret, else 0.

    The examples are a bounded table; they are put in order, so that the same rows
    give the same forest.
    """
    found = examples.select("text", "label", F.explode(candidates(F.col("text"))).alias("x")).repartition(12, "text")
    found = materialise(found.select("text", "label", features(F.col("x"), words).alias("values")))
    found = materialise(found.orderBy("label", "text", "values").coalesce(1))
    if found.select("label").distinct().count() < 2:
        return Forest(words, ())
    rows = found.select("label", array_to_vector("values").alias("features"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(rows)
    return Forest(words, tuple(tree_of(t.toDebugString.splitlines()[1:]) for t in model.trees))


def findings(text: Column, forest: Forest, threshold: float = 0.5) -> Column:
    """Array of (start, length, text, score, secret) of every candidate of a text."""

    def judged(x: Column) -> Column:
        return bound(
            features(x, forest.words),
            lambda values: bound(
                forest.score(values),
                lambda s: F.struct(
                    x["start"].cast("long").alias("start"), F.length(x["text"]).cast("long").alias("length"),
                    x["text"].alias("text"), s.alias("score"), (s > threshold).alias("secret"),
                ),
            ),
        )

    return F.transform(candidates(text), judged)


def redacted(text: Column, found: Column, mask: str = REDACTED) -> Column:
    """The text with its secrets replaced; a text without secrets is left as it is."""
    secrets = F.filter(found, lambda x: x["secret"])

    def cut(done: Column, x: Column) -> Column:
        piece = F.substring(text, done["at"] + 1, x["start"].cast("int") - done["at"])
        return F.struct((x["start"] + x["length"]).cast("int").alias("at"), F.concat(done["out"], piece, F.lit(mask)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rewritten = F.aggregate(secrets, start, cut, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, rewritten).otherwise(text)


def forest_for(docs: DataFrame, sample_docs: int = 300) -> Forest:
    """Dictionary of all texts, and a forest on examples made from a sample of them."""
    return train(example_texts(docs, sample_docs), dictionary(docs))


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, start, length, text, score, secret) of every candidate of all texts."""
    found = docs.select("doc_id", F.explode(findings(F.col("text"), forest)).alias("x"))
    return found.select("doc_id", "x.*")
