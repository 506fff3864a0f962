"""Evaluation sheets, scoring and extraction validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from thoughtloom.catalog.common import (
    CONV_CTES,
    DEMO_KIND_RULES,
    DEMO_TAG_RULES,
    DOC_CTES,
    conversation_turns,
    document_atoms,
    document_turns,
    query,
    sql_normal,
    sql_round,
    table,
)
from thoughtloom.functions import text
from thoughtloom.functions.rules import KIND_ROUTES
from thoughtloom.operators import evaluation as ev
from thoughtloom.operators.validation import validate_scout

_ROUTE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in KIND_ROUTES.items()) + " ELSE 'other' END"
_FLAT = (
    "id, source_file, source, role, 'rules' AS extractor, {route} AS route, kind, summary, "
    "array_to_string(rule_tags, ',') AS signals, importance AS confidence"
)


def _flat(sheet):
    p = "prediction."
    return sheet.select(
        "id", "source_file", "source", "role", "extractor",
        F.col(p + "route").alias("route"), F.col(p + "kind").alias("kind"), F.col(p + "summary").alias("summary"),
        F.array_join(p + "signals", ",").alias("signals"), F.col(p + "confidence").alias("confidence"),
    )


@query(
    "eval_sample",
    f"""WITH {DOC_CTES},
ok AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY doc_id) AS rn FROM doc_lab WHERE length(text) >= 40 AND length(text) <= 1600),
s AS (SELECT o.*, i.importance FROM ok o JOIN doc_imp i USING (doc_id) WHERE rn <= 3 ORDER BY doc_id LIMIT 35)
SELECT {_FLAT.format(route=_ROUTE)} FROM s""",
)
def eval_sample(spark, sf_dir):
    sheet = ev.build_eval(
        document_turns(spark, sf_dir), limit=35, per_file_limit=3, kind_rules=DEMO_KIND_RULES, tag_rules=DEMO_TAG_RULES
    )
    return _flat(sheet)


@query(
    "eval_sample_contains",
    f"""WITH {CONV_CTES}
SELECT id, 'conversations' AS source_file, source, role, 'rules' AS extractor, {_ROUTE} AS route, kind, summary,
  array_to_string(rule_tags, ',') AS signals, importance AS confidence
FROM conv_imp WHERE length(text) >= 40 AND (contains(lower(text), 'tionth') OR contains(lower(text), 'sche')) ORDER BY conv_id, turn LIMIT 20""",
)
def eval_sample_contains(spark, sf_dir):
    sheet = ev.build_eval(
        conversation_turns(spark, sf_dir), max_chars=None, contains=["TIONTH", " ", "sche"],
        kind_rules=DEMO_KIND_RULES, tag_rules=DEMO_TAG_RULES,
    )
    return _flat(sheet)


@query("rules_prediction", f"WITH {DOC_CTES} SELECT {_FLAT.format(route=_ROUTE)} FROM doc_imp")
def rules_prediction_query(spark, sf_dir):
    from thoughtloom.operators.extraction import rules_prediction
    from thoughtloom.operators.fragments import clean_fragments

    fragments = clean_fragments(document_turns(spark, sf_dir))
    predicted = rules_prediction(fragments, kind_rules=DEMO_KIND_RULES, tag_rules=DEMO_TAG_RULES)
    return _flat(predicted.withColumn("extractor", F.lit("rules")))


# Review sheet: every document, labelled ones reviewed. Fields are filled by id
# so that both the scout branch and the legacy branch of the pass rule occur.
def review_sheet(spark, sf_dir):
    docs = document_atoms(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d, good = F.col("doc_id"), F.col("quality") == 1
    known = F.col("quality").isNotNull()
    scout = known & (d % 3 != 0)
    legacy = known & (d % 3 == 0)
    error = d % 50 == 7
    prediction = F.struct(
        ((F.length("text") > 200) & ~error).alias("keep"),
        text.route_from_kind(F.col("kind")).alias("route"),
        F.when(error, F.array(F.lit("extractor-error"))).otherwise(F.col("tags")).alias("tags"),
    )
    human = F.struct(
        F.when(known & (d % 11 != 0), good).alias("keep"),
        F.when(known & (d % 4 == 0), F.lit(" other ")).otherwise(F.lit("")).alias("route"),
        F.when(scout, good).alias("signal_found"),
        F.when(scout & (d % 5 != 0), F.col("toxic") == 0).alias("noise_marked"),
        F.when(scout, good | (d % 2 == 0)).alias("handoff_sufficient"),
        F.when(known, good & (F.col("toxic") == 0)).alias("useful"),
        F.when(legacy, F.col("toxic") == 1).alias("noise"),
        F.when(legacy & (d % 2 == 0), (F.col("quality") * 3 + 1).cast("double")).alias("summary_quality"),
        F.when(legacy & (d % 7 != 0), (d % 5 + 1).cast("double")).alias("structure_quality"),
    )
    return docs.join(labels, "doc_id", "left").select("id", "text", prediction.alias("prediction"), human.alias("human"))


_SHEET = f"""{DOC_CTES},
j AS (SELECT a.*, quality, toxic, quality IS NOT NULL AS known, quality = 1 AS good FROM doc_atoms a LEFT JOIN labels l USING (doc_id)),
sh AS (SELECT id, text, length(text) > 200 AND doc_id % 50 <> 7 AS p_keep, {_ROUTE} AS p_route, doc_id % 50 = 7 AS p_err,
  CASE WHEN known AND doc_id % 11 <> 0 THEN good END AS keep, CASE WHEN known AND doc_id % 4 = 0 THEN 'other' ELSE '' END AS route,
  CASE WHEN known AND doc_id % 3 <> 0 THEN good END AS found,
  CASE WHEN known AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN toxic = 0 END AS marked,
  CASE WHEN known AND doc_id % 3 <> 0 THEN good OR doc_id % 2 = 0 END AS handoff,
  CASE WHEN known THEN good AND toxic = 0 END AS useful,
  CASE WHEN known AND doc_id % 3 = 0 THEN toxic = 1 END AS noise,
  CASE WHEN known AND doc_id % 3 = 0 AND doc_id % 2 = 0 THEN (quality * 3 + 1)::DOUBLE END AS sq,
  CASE WHEN known AND doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN (doc_id % 5 + 1)::DOUBLE END AS tq, known FROM j),
scored AS (SELECT *, CASE WHEN found IS NOT NULL OR marked IS NOT NULL OR handoff IS NOT NULL
    THEN useful AND found AND handoff AND coalesce(marked, true)
    ELSE useful AND NOT coalesce(noise, false) AND coalesce(sq >= 3, true) AND coalesce(tq >= 3, true) END AS passed FROM sh WHERE known),
sc AS (SELECT (SELECT count(*) FROM sh) AS total_cases, count(*) AS scored_cases,
  count(*) FILTER (WHERE passed)::DOUBLE / count(*) AS pass_rate,
  count(*) FILTER (WHERE noise)::DOUBLE / count(noise) AS noise_rate,
  count(*) FILTER (WHERE keep = p_keep)::DOUBLE / count(keep) AS keep_agreement,
  count(*) FILTER (WHERE route <> '' AND route = p_route)::DOUBLE / count(*) FILTER (WHERE route <> '') AS route_agreement,
  count(*) FILTER (WHERE found)::DOUBLE / count(found) AS signal_found_rate,
  count(*) FILTER (WHERE marked)::DOUBLE / count(marked) AS noise_marked_rate,
  count(*) FILTER (WHERE handoff)::DOUBLE / count(handoff) AS handoff_sufficient_rate,
  sum(sq) / count(sq) AS avg_summary_quality, sum(tq) / count(tq) AS avg_structure_quality FROM scored)"""


@query("eval_score", f"WITH {_SHEET} SELECT * FROM sc")
def eval_score(spark, sf_dir):
    return ev.score_eval(review_sheet(spark, sf_dir))


@query("agreement_rows", f"WITH {_SHEET} SELECT id, keep = p_keep AS keep_agrees FROM sh")
def agreement_rows(spark, sf_dir):
    sheet = review_sheet(spark, sf_dir)
    return sheet.select("id", ev.agreement(F.col("human.keep"), F.col("prediction.keep")).alias("keep_agrees"))


@query("duplicate_surplus", f"SELECT (count(*) - count(DISTINCT substring(sha1({sql_normal('text')}), 1, 16)))::BIGINT AS surplus FROM documents")
def duplicate_surplus_query(spark, sf_dir):
    from thoughtloom.operators.validation import duplicate_surplus

    return duplicate_surplus(table(spark, sf_dir, "documents"), text.fingerprint(F.col("text")))


def _r(n: str, d: str) -> str:
    return sql_round(f"{n}::DOUBLE / {d}", 4)


@query(
    "scout_validation",
    f"""WITH {_SHEET},
v AS (SELECT sc.*, (SELECT count(*) FROM sh WHERE p_err) AS pe,
  (SELECT count(*) - count(DISTINCT substring(sha1({sql_normal('text')}), 1, 16)) FROM sh)::BIGINT AS dup,
  (SELECT count(*) FROM sh WHERE keep AND NOT p_keep) AS fn, (SELECT count(*) FROM sh WHERE NOT keep AND p_keep) AS fp FROM sc),
m AS (SELECT total_cases, scored_cases, 30 AS minimum_scored_cases, pass_rate, keep_agreement, route_agreement, handoff_sufficient_rate,
  pe AS parse_error_count, {_r('pe', 'total_cases')} AS parse_error_rate, dup AS duplicate_count, {_r('dup', 'total_cases')} AS duplicate_rate,
  0::BIGINT AS tool_noise_retained_count, 0e0 AS tool_noise_retained_rate, fn AS false_negative_count,
  {_r('fn', 'scored_cases')} AS false_negative_rate, fp AS false_positive_count, {_r('fp', 'scored_cases')} AS false_positive_rate FROM v)
SELECT *, CASE WHEN total_cases = 0 OR scored_cases < 30 THEN 'needs_data'
  WHEN parse_error_rate <= 0.03 AND duplicate_rate <= 0.10 AND false_negative_rate <= 0.15 AND false_positive_rate <= 0.15
    AND handoff_sufficient_rate >= 0.75 THEN 'pass' ELSE 'fail' END AS verdict FROM m""",
)
def scout_validation(spark, sf_dir):
    return validate_scout(review_sheet(spark, sf_dir))
