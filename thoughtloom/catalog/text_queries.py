"""Cleaning, noise, fingerprints, tokens, near-duplicates, atom building."""

from __future__ import annotations

from pyspark.sql import functions as F

from thoughtloom.catalog.common import (
    CONV_CTES,
    DEDUPE_CTES,
    DOC_CTES,
    conversation_atoms,
    conversation_fragments,
    document_atoms,
    query,
    sql_fold,
    sql_id,
    sql_normal,
    sql_strip,
    sql_tokens,
    table,
)
from thoughtloom.functions import scoring, text
from thoughtloom.functions.rules import KIND_ROUTES
from thoughtloom.operators.dedupe import near_duplicate_filter, near_duplicate_pairs
from thoughtloom.operators.fragments import upsert
from thoughtloom.operators.notes import note_type


@query("fragments_clean", f"WITH {CONV_CTES} SELECT id, source, role, text FROM conv_frags")
def fragments_clean(spark, sf_dir):
    return conversation_fragments(spark, sf_dir).select("id", "source", "role", "text")


@query(
    "fragment_fingerprint_groups",
    f"""SELECT substring(sha1({sql_normal('text')}), 1, 16) AS fingerprint, count(*) AS copies,
    count(*) - 1 AS surplus FROM documents GROUP BY 1""",
)
def fragment_fingerprint_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return (
        docs.groupBy(text.fingerprint(F.col("text")).alias("fingerprint"))
        .agg(F.count("*").alias("copies"))
        .withColumn("surplus", F.col("copies") - 1)
    )


@query(
    "token_set_sizes",
    f"SELECT doc_id, len({sql_tokens(sql_normal('text'))})::BIGINT AS n_tokens FROM documents",
)
def token_set_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(text.token_set(F.col("text"))).cast("bigint").alias("n_tokens"))


# Every document is wrapped in one of the noise forms, chosen by its id.
_NOISE_FORMS = (
    ("", ""),
    ("  <Command-Name>run</command-name> ", ""),
    ("/remote-control is active: ", ""),
    ("me@host.local:~/dir$ ", ""),
    ("see cat > notes <<'EOF' ", ""),
    ("Add a flag, we'll likely add more; keep ", " run python3 -m pytest -q until green"),
    ("result is ready, next: ", " waiting (disable recaps in /config)"),
    ("<tool-use> ", ""),
    ("text <command-message> ", ""),
)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_FORM = "doc_id % 9"
_SQL_WRAPPED = (
    "CASE " + _FORM + " " + " ".join(f"WHEN {i} THEN {_sql_text(a)} || text || {_sql_text(b)}" for i, (a, b) in enumerate(_NOISE_FORMS)) + " END"
)


@query(
    "disposable_flags",
    f"""WITH w AS (SELECT doc_id, {_SQL_WRAPPED} AS t FROM documents),
f AS (SELECT doc_id, {sql_fold(sql_strip('t'))} AS f FROM w)
SELECT doc_id,
  (f = '' OR starts_with(f, '<command-name') OR starts_with(f, '<command-message')
   OR (contains(f, '<command-name') AND contains(f, '<command-args'))
   OR (contains(f, '<command-message') AND contains(f, '</command-message>'))
   OR starts_with(f, '/remote-control is active')
   OR regexp_matches(f, '^[\\w.-]+@[\\w.-]+:[^$#]+[$#]\\s+')
   OR (contains(f, ' cat > ') AND contains(f, ' <<''eof'''))
   OR (starts_with(f, 'add ') AND contains(f, 'we''ll likely add more') AND contains(f, 'keep ')
       AND contains(f, 'python3 -m pytest -q') AND contains(f, ' green'))
   OR (contains(f, 'disable recaps in /config') AND contains(f, 'result is') AND contains(f, 'next:') AND contains(f, 'waiting'))
  ) AS disposable,
  starts_with(f, '<tool-use') AS tool_noise FROM f""",
)
def disposable_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wrapped = None
    for i, (before, after) in enumerate(_NOISE_FORMS):
        form = F.concat(F.lit(before), F.col("text"), F.lit(after))
        wrapped = (F if wrapped is None else wrapped).when(F.col("doc_id") % 9 == i, form)
    shown = docs.select("doc_id", wrapped.alias("t"))
    return shown.select(
        "doc_id", text.is_disposable(F.col("t")).alias("disposable"), text.is_tool_noise(F.col("t")).alias("tool_noise")
    )


@query("near_duplicate_pairs", f"WITH {DEDUPE_CTES} SELECT first_rid, later_rid FROM p")
def near_duplicate_pairs_query(spark, sf_dir):
    return near_duplicate_pairs(table(spark, sf_dir, "documents"), "text", "doc_id")


# The pair graph of these documents has no chains, so dropping every row with
# an earlier neighbour equals the greedy rule (chains are covered by tests).
@query(
    "near_duplicate_filter",
    f"""WITH {DEDUPE_CTES},
kept AS (SELECT doc_id FROM reps WHERE len(toks) = 0
  UNION ALL SELECT doc_id FROM sets WHERE doc_id NOT IN (SELECT later_rid FROM p))
SELECT f.doc_id, f.fp AS fingerprint, k.doc_id IS NOT NULL AS keep,
  CASE WHEN k.doc_id IS NOT NULL THEN 'keep' ELSE 'near-duplicate' END AS reason
FROM f LEFT JOIN kept k USING (doc_id)""",
)
def near_duplicate_filter_query(spark, sf_dir):
    decided = near_duplicate_filter(table(spark, sf_dir, "documents"), "text", "doc_id")
    return decided.select("doc_id", "fingerprint", "keep", "reason")


@query(
    "clean_summary",
    f"""WITH {DEDUPE_CTES},
kept AS (SELECT doc_id FROM reps WHERE len(toks) = 0
  UNION ALL SELECT doc_id FROM sets WHERE doc_id NOT IN (SELECT later_rid FROM p))
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN doc_id IN (SELECT doc_id FROM kept) THEN 'keep' ELSE 'near-duplicate' END AS reason FROM f)
GROUP BY reason""",
)
def clean_summary_query(spark, sf_dir):
    decided = near_duplicate_filter(table(spark, sf_dir, "documents"), "text", "doc_id")
    return decided.groupBy("reason").agg(F.count("*").alias("n"))


_ATOM_COLS = "id, source, role, summary, kind, array_to_string(tags, ',') AS tags, importance, activation"


@query("atoms_rules", f"WITH {CONV_CTES} SELECT {_ATOM_COLS} FROM conv_atoms")
def atoms_rules(spark, sf_dir):
    return conversation_atoms(spark, sf_dir).select(
        "id", "source", "role", "summary", "kind", F.array_join("tags", ",").alias("tags"), "importance", "activation"
    )


_ROUTES = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in KIND_ROUTES.items())


@query(
    "atom_labels",
    f"""WITH {DOC_CTES} SELECT id, CASE kind {_ROUTES} ELSE 'other' END AS route,
  CASE WHEN activation >= 0.55e0 THEN 'focus' WHEN activation <= 0.35e0 THEN 'latent' ELSE 'active' END AS graph_state,
  CASE WHEN activation >= 0.65e0 THEN 'focus' WHEN activation <= 0.25e0 THEN 'latent' ELSE 'active' END AS note_state,
  CASE WHEN kind = 'objection' THEN 'friction_note' WHEN kind IN ('decision','question') THEN 'decision_note'
    ELSE 'concept_note' END AS note_type,
  trim(left(CASE WHEN trim(regexp_replace({sql_fold('summary')}, '[^a-zA-Z0-9]+', '-', 'g'), '-') = '' THEN 'digested-note'
    ELSE trim(regexp_replace({sql_fold('summary')}, '[^a-zA-Z0-9]+', '-', 'g'), '-') END, 72), '-')
    || '-' || left(id, 7) || '.md' AS file_name
FROM doc_atoms""",
)
def atom_labels(spark, sf_dir):
    return document_atoms(spark, sf_dir).select(
        "id",
        text.route_from_kind(F.col("kind")).alias("route"),
        scoring.activation_state(F.col("activation")).alias("graph_state"),
        scoring.activation_state(F.col("activation"), scoring.NOTE_STATE).alias("note_state"),
        note_type(F.col("kind"), F.col("tags")).alias("note_type"),
        text.note_file_name(F.col("summary"), F.col("id")).alias("file_name"),
    )


# Old table: every conversation atom, cooled. Batch: two versions of each atom,
# odd turns under their old id, even turns under a new one.
@query(
    "atom_upsert",
    f"""WITH {CONV_CTES},
old AS (SELECT id, summary, activation * 0.9e0 AS activation, 100 AS created_at, 100 AS updated_at FROM conv_atoms),
batch AS (SELECT CASE WHEN turn % 2 = 1 THEN id ELSE {sql_id("'next'", 'id')} END AS id,
    summary || ' v' || v AS summary, activation * v * 0.4e0 AS activation, v FROM conv_atoms, (VALUES (1), (2)) AS t(v)),
latest AS (SELECT id, max_by(summary, v) AS summary, max(activation) AS activation FROM batch GROUP BY id)
SELECT coalesce(o.id, l.id) AS id, coalesce(l.summary, o.summary) AS summary,
  CASE WHEN o.id IS NULL THEN l.activation WHEN l.id IS NULL THEN o.activation ELSE greatest(o.activation, l.activation) END AS activation,
  (CASE WHEN o.id IS NULL THEN 200 ELSE o.created_at END)::BIGINT AS created_at,
  (CASE WHEN l.id IS NULL THEN o.updated_at ELSE 200 END)::BIGINT AS updated_at
FROM old o FULL OUTER JOIN latest l ON o.id = l.id""",
)
def atom_upsert(spark, sf_dir):
    atoms = conversation_atoms(spark, sf_dir).select("id", "summary", "activation", "turn")
    old = atoms.select(
        "id",
        "summary",
        (F.col("activation") * F.lit(0.9)).alias("activation"),
        F.lit(100).cast("bigint").alias("created_at"),
        F.lit(100).cast("bigint").alias("updated_at"),
    )
    versions = atoms.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    batch = versions.select(
        F.when(F.col("turn") % 2 == 1, F.col("id")).otherwise(text.short_id(F.lit("next"), F.col("id"))).alias("id"),
        F.concat(F.col("summary"), F.lit(" v"), F.col("v").cast("string")).alias("summary"),
        (F.col("activation") * F.col("v") * F.lit(0.4)).alias("activation"),
        "v",
    )
    return upsert(old, batch, ["id"], order="v", now=F.lit(200).cast("bigint"))
