"""Registry, derived inputs and SQL fragments shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtloom.functions import text
from thoughtloom.operators.fragments import clean_fragments, rules_atoms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The driver tables hold invented words that no default rule matches, so the
# catalog labels them with its own lexicon.
DEMO_KIND_RULES = (
    ("objection", ("eaux", "ando")),
    ("decision", ("tionth",)),
    ("question", ("sche", "ción")),
    ("idea", ("ent ",)),
    ("analogy", ("lich",)),
    ("preference", ("under",)),
)
DEMO_TAG_RULES = (
    ("thermal", ("tion",)),
    ("river", ("eau",)),
    ("heart", ("hea",)),
    ("stone", ("est",)),
    ("ring", ("ing ",)),
    ("sch", ("sch",)),
    ("under", ("ung",)),
)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


#: Session setting for small inputs in single pieces, as in the benchmark; unset on a cluster.
INPUT_PARTITIONS = "spark.thoughtloom.inputPartitions"
_TEXT_TABLES = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, dealt anew if the session asks for it (files of one row group can't be split)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(wanted)) if wanted and name in _TEXT_TABLES else rows


def place(file, major, minor):
    return F.struct(
        file.alias("file"), major.cast("bigint").alias("major"), minor.cast("bigint").alias("minor")
    ).alias("scan_order")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream, be it one file or a folder of files.

    The path is a pattern of this one name: a stream takes a plain path as a base folder,
    which a file can't be.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def conversation_columns(rows: DataFrame) -> DataFrame:
    source = F.concat(
        F.lit("conversation["), F.col("conv_id").cast("string"), F.lit("]:message["), F.col("turn").cast("string"), F.lit("]")
    )
    return rows.select(
        F.lit("conversations").alias("source_file"),
        source.alias("source"),
        "role",
        "text",
        F.lit(None).cast("string").alias("timestamp"),
        place(F.lit("conversations"), F.col("conv_id"), F.col("turn")),
        "conv_id",
        "turn",
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_columns(table(spark, sf_dir, "conversations"))


def conversation_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_fragments(conversation_turns(spark, sf_dir))


def conversation_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_atoms(
        conversation_fragments(spark, sf_dir), kind_rules=DEMO_KIND_RULES, tag_rules=DEMO_TAG_RULES
    )


def document_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.col("source").alias("source_file"),
        F.concat(F.lit("document["), F.col("doc_id").cast("string"), F.lit("]")).alias("source"),
        F.when(F.col("lang") == "en", F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        "text",
        F.lit(None).cast("string").alias("timestamp"),
        place(F.lit("documents"), F.col("doc_id"), F.lit(0)),
        "doc_id",
    )


def document_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document atoms whose tags form several components of a few atoms each."""
    labelled = rules_atoms(
        clean_fragments(document_turns(spark, sf_dir)), kind_rules=DEMO_KIND_RULES, tag_rules=DEMO_TAG_RULES
    )
    a = F.concat(F.lit("a"), (F.col("doc_id") % 397).cast("string"))
    b = F.concat(F.lit("b"), (F.col("doc_id") * 31 % 409).cast("string"))
    tags = (
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("uncategorized")))
        .when(F.col("doc_id") % 2 == 1, F.array(a, b))
        .otherwise(F.array(a))
    )
    return labelled.withColumn("tags", tags)


# --- SQL fragments -----------------------------------------------------------

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def sql_clean(x: str) -> str:
    return sql_collapse(f"regexp_replace({x}, '(?is)<system-reminder>.*?</system-reminder>', ' ', 'g')")


def sql_fold(x: str) -> str:
    return f"replace(translate(lower({x}), 'ςſ', 'σs'), 'ß', 'ss')"


def sql_normal(x: str) -> str:
    inner = f"replace({sql_fold(x)}, '(disable recaps in /config)', ' ')"
    return sql_collapse(f"regexp_replace({inner}, 'https?://[^\\s\\x{{85}}\\x{{a0}}]+', ' ', 'g')")


def sql_tokens(x: str) -> str:
    found = f"regexp_extract_all({x}, '[a-z0-9_./:-]+|[\\x{{4e00}}-\\x{{9fff}}]+')"
    return f"list_distinct(list_filter({found}, lambda t: length(t) >= 2))"


def sql_words(x: str) -> str:
    return f"list_distinct(regexp_extract_all({sql_fold(x)}, '[a-zA-Z0-9]{{3,}}'))"


def sql_id(*parts: str) -> str:
    joined = " || chr(10) || ".join(parts)
    return f"substring(sha1({joined}), 1, 16)"


def sql_tool_noise(x: str) -> str:
    folded = sql_fold(sql_strip(x))
    prefixes = ("<task-notification", "<tool-use", "<command-output", "<local-command")
    return "(" + " OR ".join(f"starts_with({folded}, '{p}')" for p in prefixes) + ")"


def sql_round(x: str, digits: int = 3) -> str:
    """Half-even rounding of the exact binary value, as the operators do."""
    s = f"1e{digits}"
    high = f"(({x})*134217729e0 - (({x})*134217729e0 - ({x})))"
    side = (
        f"((({x})*{s} - floor(({x})*{s}) - 0.5e0) + (({high}*{s} - ({x})*{s}) + (({x}) - {high})*{s}))"
    )
    whole = f"floor(({x})*{s})"
    return (
        f"(CASE WHEN {side} > 0 THEN {whole} + 1 WHEN {side} < 0 THEN {whole} "
        f"ELSE {whole} + ({whole}::BIGINT % 2) END / {s})"
    )


def _sql_hit(folded: str, needles) -> str:
    return "(" + " OR ".join(f"contains({folded}, '{n}')" for n in needles) + ")"


def sql_kind(folded: str) -> str:
    cases = " ".join(f"WHEN {_sql_hit(folded, needles)} THEN '{kind}'" for kind, needles in DEMO_KIND_RULES)
    return f"CASE {cases} ELSE 'note' END"


def sql_tags(folded: str) -> str:
    items = ", ".join(f"CASE WHEN {_sql_hit(folded, needles)} THEN '{tag}' END" for tag, needles in DEMO_TAG_RULES)
    kept = f"list_filter([{items}], lambda t: t IS NOT NULL)"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE ['uncategorized'] END"


def sql_summary(x: str) -> str:
    head = f"trim(regexp_extract({x}, '^[^\\n。！？!?]*', 0))"
    return f"CASE WHEN length({head}) <= 96 THEN {head} ELSE rtrim(left({head}, 95)) || '...' END"


def sql_importance(role: str, x: str, kind: str, tags: str) -> str:
    score = (
        f"(0.2e0 + CASE WHEN {role} = 'user' THEN 0.15e0 ELSE 0e0 END "
        f"+ CASE WHEN {kind} IN ('idea','decision','question') THEN 0.2e0 "
        f"WHEN {kind} IN ('objection','analogy') THEN 0.15e0 ELSE 0e0 END "
        f"+ least(0.15e0, len({tags}) * 0.03e0) + CASE WHEN length({x}) > 120 THEN 0.08e0 ELSE 0e0 END)"
    )
    return f"(floor(least(0.95e0, greatest(0.05e0, {score})) * 1e3 + 0.5e0) / 1e3)"


def _atom_ctes(prefix: str, turns: str, tags: str) -> str:
    """CTEs <prefix>_frags and <prefix>_atoms over a turns query."""
    return f"""{prefix}_turns AS ({turns}),
{prefix}_frags AS (
  SELECT *, {sql_id('source', 'text')} AS id FROM {prefix}_turns
  WHERE NOT {sql_tool_noise('text')} AND length(text) >= 12),
{prefix}_lab AS (
  SELECT *, {sql_summary('text')} AS summary, {sql_kind(sql_fold('text'))} AS kind,
    {sql_tags(sql_fold('text'))} AS rule_tags FROM {prefix}_frags),
{prefix}_imp AS (
  SELECT *, {tags} AS tags, {sql_importance('role', 'text', 'kind', 'rule_tags')} AS importance FROM {prefix}_lab),
{prefix}_atoms AS (
  SELECT *, least(0.65e0, greatest(0.1e0, importance * 0.65e0)) AS activation FROM {prefix}_imp)"""


CONV_CTES = _atom_ctes(
    "conv",
    "SELECT conv_id, turn, 'conversation[' || conv_id || ']:message[' || turn || ']' AS source, role, "
    f"{sql_clean('text')} AS text FROM conversations",
    "rule_tags",
)
DOC_CTES = _atom_ctes(
    "doc",
    "SELECT doc_id, 'document[' || doc_id || ']' AS source, source AS source_file, "
    f"CASE WHEN lang = 'en' THEN 'user' ELSE 'assistant' END AS role, {sql_clean('text')} AS text FROM documents",
    "CASE WHEN doc_id % 5 = 0 THEN ['uncategorized'] "
    "WHEN doc_id % 2 = 1 THEN ['a' || (doc_id % 397), 'b' || (doc_id * 31 % 409)] ELSE ['a' || (doc_id % 397)] END",
)

# Distinct token sets of the documents, and the similar pairs among them.
DEDUPE_CTES = f"""n AS (SELECT doc_id, {sql_normal('text')} AS t FROM documents),
f AS (SELECT doc_id, substring(sha1(t), 1, 16) AS fp, list_sort({sql_tokens('t')}) AS toks FROM n),
reps AS (SELECT min(doc_id) AS doc_id, fp, any_value(toks) AS toks FROM f GROUP BY fp),
sets AS (SELECT min(doc_id) AS doc_id, toks, len(toks) AS n FROM reps WHERE len(toks) > 0 GROUP BY toks),
u AS (SELECT doc_id, n, unnest(toks) AS tok FROM sets),
p AS (SELECT a.doc_id AS first_rid, b.doc_id AS later_rid FROM u a JOIN u b
  ON a.tok = b.tok AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 92 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= 92 * (a.n + b.n - count(*)))"""
