"""Scans, transcripts, note chunks, listings and model-output parsing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from thoughtloom.catalog.common import CONV_CTES, conversation_turns, query, sql_clean, sql_id, sql_strip, sql_tool_noise, table
from thoughtloom.operators.extraction import extraction_requests, normalise_signals, outcomes
from thoughtloom.operators.suggestions import extract_suggestions
from thoughtloom.plans import memory as jobs
from thoughtloom.schemas import ATOM
from thoughtloom.session import shared_dir
from thoughtloom.sources.chat import read_json_documents, read_json_lines
from thoughtloom.sources.listings import select_source_files, snapshot_diff
from thoughtloom.sources.notes_inbox import chunk_notes
from thoughtloom.sources.transcripts import join_transcripts, split_transcripts

# --- chat files --------------------------------------------------------------


def _written(df, spark, name):
    """Write derived lines to a fresh folder of the shared directory."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def _line(rows):
    """One JSON value per turn; its content shape depends on the turn number."""
    text = F.col("text")
    part = F.struct(text.alias("text"))
    epoch = F.col("conv_id") * 1000 + F.col("turn")
    shapes = [
        F.to_json(F.struct("role", text.alias("content"), epoch.alias("create_time"))),
        F.to_json(F.struct("role", F.array(text, F.lit("tail")).alias("content"), epoch.alias("timestamp"))),
        F.to_json(F.struct("role", F.array(part, F.struct(F.lit("").alias("text"))).alias("content"), epoch.cast("string").alias("timestamp"))),
        F.to_json(F.struct(F.col("role").alias("author"), F.struct(F.array(text).alias("parts")).alias("content"), epoch.alias("create_time"))),
        F.to_json(F.struct("role", F.struct(text.alias("text")).alias("content"), (epoch + 0.5).alias("create_time"))),
        F.to_json(F.struct(text.alias("text"), F.lit(True).alias("timestamp"))),
        F.to_json(F.struct("role", text.alias("message"))),
        F.concat(F.lit('{"role": "user", "content": '), F.to_json(F.struct("text"))),
    ]
    result = None
    for i, shape in enumerate(shapes):
        result = (F if result is None else result).when(F.col("turn") == i, shape)
    return result


_STAMP = "strftime(to_timestamp(conv_id * 1000 + turn) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S')"
_SCANNED = f"""SELECT CASE WHEN turn = 5 THEN 'unknown' ELSE role END AS role,
  CASE turn WHEN 1 THEN text || chr(10) || 'tail' ELSE text END AS text,
  CASE turn WHEN 2 THEN (conv_id * 1000 + turn)::VARCHAR WHEN 4 THEN {_STAMP} || '.500000+00:00'
    WHEN 5 THEN '1970-01-01T00:00:01+00:00' WHEN 6 THEN NULL ELSE {_STAMP} || '+00:00' END AS timestamp
FROM conversations WHERE turn <> 7"""


@query("chat_lines_scan", _SCANNED)
def chat_lines_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    path = _written(rows.select(_line(rows)), spark, "lines")
    return read_json_lines(spark, [path], glob="*.txt").select("role", "text", "timestamp")


# Every conversation becomes one line whose messages sit at their turn's place.
@query("chat_message_lists", "SELECT role, text, turn FROM conversations")
def chat_message_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    message = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("ms"))
    path = _written(talks.select(F.to_json(F.struct(F.col("ms.m").alias("messages")))), spark, "talks")
    scanned = read_json_lines(spark, [path], glob="*.txt")
    return scanned.select("role", "text", F.col("scan_order.minor").alias("turn"))


# --- transcripts -------------------------------------------------------------


def _chats(rows):
    marker = F.when(F.col("role") == "user", F.lit("[User]: ")).otherwise(F.lit("[Assistant]:\n"))
    spoken = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.concat(marker, "text").alias("said")))).alias("turns")
    )
    c = F.col("conv_id")
    return spoken.select(
        F.concat(F.lit("s"), c.cast("string")).alias("sessionId"),
        # Text before the first marker is lost and empty turns do not count.
        F.concat(F.lit("  preface\n[User]:  \n"), F.array_join("turns.said", "\n")).alias("rawText"),
        F.when(c % 4 != 0, F.size("turns")).alias("messageCount"),
        F.when(c % 3 == 0, F.lit("")).when(c % 3 == 1, F.lit("web")).alias("platform"),
        F.when(c % 5 != 0, F.concat(F.lit("2024-01-"), F.lpad((c % 28 + 1).cast("string"), 2, "0"))).alias("createdAt"),
    )


def _sessions(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct().where(F.col("conv_id") % 6 != 5)
    c = F.col("conv_id")
    return ids.select(
        F.concat(F.lit("s"), c.cast("string")).alias("id"),
        F.when(c % 2 == 0, F.concat(F.lit("p"), (c % 7).cast("string"))).otherwise(F.lit("")).alias("projectName"),
        F.when(c % 9 != 0, F.lit("desk")).alias("platform"),
        F.when(c % 10 != 0, F.lit("2023-12-01")).alias("createdAt"),
        F.lit("2023-12-31").alias("updatedAt"),
    )


_CHATS = """ch AS (SELECT conv_id AS c, 's' || conv_id AS session_id, count(*) AS n,
  CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'web' END AS cp,
  CASE WHEN conv_id % 5 <> 0 THEN '2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') END AS cc FROM conversations GROUP BY conv_id),
se AS (SELECT DISTINCT 's' || conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'p' || (conv_id % 7) ELSE '' END AS pn,
  CASE WHEN conv_id % 9 <> 0 THEN 'desk' END AS sp, CASE WHEN conv_id % 10 <> 0 THEN '2023-12-01' END AS sc, '2023-12-31' AS su
  FROM conversations WHERE conv_id % 6 <> 5),
jn AS (SELECT session_id, (CASE WHEN c % 4 <> 0 THEN n ELSE 0 END)::INTEGER AS message_count,
  coalesce(nullif(cp, ''), nullif(sp, ''), 'unknown') AS platform, coalesce(nullif(pn, ''), session_id) AS project,
  coalesce(nullif(cc, ''), nullif(sc, ''), su) AS timestamp, coalesce(cc, sc, su, session_id) AS sort_time, pn
  FROM ch LEFT JOIN se ON se.id = session_id)"""
_JOINED = "session_id, message_count, platform, project, timestamp, sort_time"


@query("transcript_join", f"WITH {_CHATS} SELECT {_JOINED} FROM jn")
def transcript_join(spark, sf_dir):
    return join_transcripts(_chats(table(spark, sf_dir, "conversations")), _sessions(spark, sf_dir)).drop("raw_text")


@query("transcript_join_project", f"WITH {_CHATS} SELECT {_JOINED} FROM jn WHERE pn = 'p4' OR session_id = 'p4'")
def transcript_join_project(spark, sf_dir):
    return join_transcripts(_chats(table(spark, sf_dir, "conversations")), _sessions(spark, sf_dir), project="p4").drop("raw_text")


@query(
    "transcripts_split",
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, {sql_strip('text')} AS text FROM conversations)
SELECT 'transcript:s' || conv_id || ':turn[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']' AS source, role, text
FROM t WHERE text <> ''""",
)
def transcripts_split(spark, sf_dir):
    joined = join_transcripts(_chats(table(spark, sf_dir, "conversations")), _sessions(spark, sf_dir))
    return split_transcripts(joined).select("source", "role", "text")


# An earlier version lacks some conversations and the ends of others, and words some openings otherwise.
_EARLIER = (
    "SELECT conv_id, turn, role, CASE WHEN conv_id % 11 = 3 AND turn = 0 THEN 'draft ' || text ELSE text END AS text "
    "FROM conversations WHERE conv_id % 5 <> 0 AND (conv_id % 4 <> 1 OR turn < 2)"
)


def _turn_ctes(prefix, rows):
    turns = f"""SELECT conv_id AS c, 'transcript:s' || conv_id || ':turn[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']' AS source,
  role, {sql_clean('text')} AS text FROM (SELECT * REPLACE ({sql_strip('text')} AS text) FROM ({rows})) WHERE text <> ''"""
    return f"{prefix}_t AS ({turns}), {prefix} AS (SELECT c, {sql_id('source', 'text')} AS id FROM {prefix}_t WHERE NOT {sql_tool_noise('text')} AND length(text) >= 12)"


@query(
    "incremental_transcripts",
    f"""WITH {_CHATS}, {_turn_ctes('v1', _EARLIER)}, {_turn_ctes('v2', 'SELECT * FROM conversations')},
moved AS (SELECT conv_id AS c FROM conversations GROUP BY conv_id
  HAVING bool_or(conv_id % 5 = 0 OR (conv_id % 4 = 1 AND turn >= 2) OR (conv_id % 11 = 3 AND turn = 0))),
k AS (SELECT c, id FROM v1 UNION SELECT c, id FROM v2)
SELECT k.id, project, CASE WHEN EXISTS (FROM v1 WHERE v1.id = k.id) THEN 1 ELSE 2 END::BIGINT AS created_run,
  CASE WHEN k.c IN (SELECT c FROM moved) AND EXISTS (FROM v2 WHERE v2.id = k.id) THEN 2 ELSE 1 END::BIGINT AS updated_run
FROM k JOIN jn ON session_id = 's' || k.c""",
)
def incremental_transcripts(spark, sf_dir):
    """Atoms after three runs: an earlier version, the current one, and the current one again."""
    now_rows = table(spark, sf_dir, "conversations")
    c, turn = F.col("conv_id"), F.col("turn")
    worded = F.when((c % 11 == 3) & (turn == 0), F.concat(F.lit("draft "), "text")).otherwise(F.col("text"))
    earlier = now_rows.where((c % 5 != 0) & ((c % 4 != 1) | (turn < 2))).withColumn("text", worded)
    sessions = _sessions(spark, sf_dir)
    memory, seen = jobs.Memory(atoms=spark.createDataFrame([], f"{ATOM}, created_at timestamp, updated_at timestamp")), None
    for run, rows in enumerate((earlier, now_rows, now_rows), 1):
        version = join_transcripts(_chats(rows), sessions)
        memory, _, seen = jobs.incremental_transcripts(memory, version, "chats", F.timestamp_seconds(F.lit(run)), seen)
    return memory.atoms.select(
        "id",
        F.col("metadata")["project"].alias("project"),
        F.unix_timestamp("created_at").alias("created_run"),
        F.unix_timestamp("updated_at").alias("updated_run"),
    )


# --- notes -------------------------------------------------------------------


@query(
    "note_chunks",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
b AS (SELECT doc_id, k, {sql_strip('s')} AS s FROM l),
c AS (SELECT doc_id, k, CASE WHEN k = 1 THEN s ELSE 'Doc ' || doc_id || chr(10) || chr(10) || s END AS text FROM b WHERE s <> '')
SELECT 'note-inbox:d' || doc_id || '.md:chunk[' || (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1) || ']' AS source, text FROM c""",
)
def note_chunks_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    heading = F.concat(F.lit("##  Doc "), F.col("doc_id").cast("string"), F.lit("  "))
    # Front matter, the first line as its own block, a heading, then one block
    # per remaining line; a closing heading without body yields no chunk.
    content = F.concat(
        F.lit("---\ntitle: x\n---\n"),
        F.element_at(lines, 1),
        F.lit("\n"),
        heading,
        F.lit("\n\n"),
        F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "  \n \n"),
        F.lit("\n# End\n"),
    )
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))
    notes = docs.select(
        F.concat(F.lit("/notes/"), name).alias("path"), name.alias("rel_path"), F.lit("2024-01-01").alias("timestamp"), content.alias("content")
    )
    return chunk_notes(notes).select("source", "text")


# --- listings ----------------------------------------------------------------

_PATHS = """CASE doc_id % 5 WHEN 0 THEN '/data/chat/' || source || '/' || doc_id || '.jsonl' WHEN 1 THEN '/data/Chat/' || doc_id || '.JSON'
  WHEN 2 THEN '/data/' || source || '/Auth/' || doc_id || '.json' WHEN 3 THEN '/data/blog/' || doc_id || '.jsonl' ELSE '/data/chat/' || doc_id || '.md' END"""


def _paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/data/chat/"), "source", F.lit("/"), d, F.lit(".jsonl")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("/data/Chat/"), d, F.lit(".JSON")))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("/data/"), "source", F.lit("/Auth/"), d, F.lit(".json")))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit("/data/blog/"), d, F.lit(".jsonl")))
        .otherwise(F.concat(F.lit("/data/chat/"), d, F.lit(".md")))
    )
    return docs.select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("modified"))


@query("source_files", f"SELECT {_PATHS} AS path, n_chars AS size FROM documents WHERE doc_id % 5 IN (0, 1)")
def source_files(spark, sf_dir):
    listing = _paths(spark, sf_dir)
    return select_source_files(listing.unionByName(listing)).select("path", "size")


@query(
    "snapshot_diff",
    f"""SELECT {_PATHS} AS path, CASE doc_id % 7 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'modified' END AS change
FROM documents WHERE doc_id % 7 < 4""",
)
def snapshot_diff_query(spark, sf_dir):
    listing, k = _paths(spark, sf_dir), F.col("doc_id") % 7
    new = listing.where(k != 0).select(
        "path",
        F.when(k == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(k == 3, F.col("modified") + 1).otherwise(F.col("modified")).alias("modified"),
    )
    return snapshot_diff(listing.where(k != 1), new)


# --- model output ------------------------------------------------------------


def _raw_outputs(spark, sf_dir):
    rows = conversation_turns(spark, sf_dir)
    conf = (F.col("conv_id") % 10) / F.lit(10.0)
    body = F.to_json(
        F.struct(
            F.lit(True).alias("keep"),
            F.when(F.col("turn") % 2 == 0, F.lit("idea")).otherwise(F.lit("weird")).alias("kind"),
            F.when(F.col("turn") == 2, F.lit(" Debug ")).otherwise(F.lit("none such")).alias("route"),
            F.col("text").alias("summary"),
            F.array(F.lit("a"), F.lit(" "), F.lit("b "), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f")).alias("signals"),
            F.lit("None, x, 無, uh").alias("noise"),
            F.lit("t1, t2,,t3").alias("tags"),
            conf.alias("confidence"),
            F.lit(" r ").alias("reason"),
            F.lit("later").alias("handoff"),
        )
    )
    raw = (
        F.when(F.col("turn") % 6 == 0, body)
        .when(F.col("turn") % 6 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nbye")))
        .when(F.col("turn") % 6 == 2, F.concat(F.lit("I think { maybe } "), body, F.lit(' and {"keep": false}')))
        .when(F.col("turn") % 6 == 3, F.lit(" 77777777777 "))
        .when(F.col("turn") % 6 == 4, F.lit("no object here"))
        .otherwise(F.lit('{"keep": "no", "tags": 5, "confidence": "0.9", "signals": null}'))
    )
    return rows.select("source", "conv_id", "turn", raw.alias("raw"))


_SIGNALS = f"""WITH r AS (SELECT 'conversation[' || conv_id || ']:message[' || turn || ']' AS source, conv_id, turn, turn % 6 AS k,
  (conv_id % 10) / 10e0 AS conf, {sql_strip('text')} AS text FROM conversations)
SELECT source, CASE k WHEN 3 THEN 'degenerate model output' WHEN 4 THEN 'no JSON object in model output' END AS error,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 5 THEN true ELSE conf >= 0.55e0 END AS keep,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 5 OR turn % 2 = 1 THEN 'note' ELSE 'idea' END AS kind,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 5 OR turn % 2 = 1 THEN 'other' WHEN turn = 2 THEN 'debug' ELSE 'idea' END AS route,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 5 THEN '' ELSE text END AS summary,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 5 THEN '' ELSE 'a|b|c|d|e' END AS signals,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 5 THEN '' ELSE 'x|uh' END AS noise,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 5 THEN 'uncategorized' ELSE 't1|t2|t3' END AS tags,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 5 THEN 0.9e0 ELSE conf END AS confidence,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 5 THEN '' WHEN conf < 0.55e0 THEN 'below min_confidence: r' ELSE 'r' END AS reason FROM r"""


@query("signals_normalised", _SIGNALS)
def signals_normalised(spark, sf_dir):
    s = "signal."
    parsed = normalise_signals(_raw_outputs(spark, sf_dir), "raw")
    return parsed.select(
        "source", "error",
        *[F.col(s + name).alias(name) for name in ("keep", "kind", "route", "summary", "confidence", "reason")],
        *[F.array_join(s + name, "|").alias(name) for name in ("signals", "noise", "tags")],
    )


@query(
    "extraction_outcomes",
    f"""WITH s AS ({_SIGNALS}) SELECT source AS id, CASE WHEN error IS NOT NULL THEN 'error' WHEN keep THEN 'done' ELSE 'skipped' END AS outcome,
  CASE WHEN error IS NOT NULL THEN error WHEN keep THEN '' ELSE reason END AS error, CASE WHEN keep THEN source END AS atom_id FROM s""",
)
def extraction_outcomes(spark, sf_dir):
    parsed = normalise_signals(_raw_outputs(spark, sf_dir), "raw")
    return outcomes(parsed.withColumnRenamed("source", "id"))


@query(
    "extraction_requests",
    f"WITH t AS (SELECT conv_id, turn, role, {sql_clean('text')} AS text FROM conversations) "
    "SELECT 'c' || conv_id || '-' || turn AS id, 'Role: ' || role || chr(10) || 'Fragment (JSON string): ' || to_json({'text': text}) AS request FROM t",
)
def extraction_requests_query(spark, sf_dir):
    from thoughtloom.functions.text import clean_text

    rows = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        "role",
        clean_text(F.col("text")).alias("text"),
    )
    return extraction_requests(rows).withColumn("request", F.substring_index("request", "\n\nAnswer with", 1))


def _runs(spark, sf_dir):
    """One answer per conversation: a block per turn, citing known and unknown ids."""
    rows = table(spark, sf_dir, "conversations")
    c = F.col("conv_id").cast("string")
    t = F.col("turn").cast("string")
    me = F.concat(F.lit("c"), c, F.lit("-m"), t)
    cited = F.when(F.col("turn") == 3, F.lit("[nobody]")).otherwise(
        F.concat(F.lit("["), me, F.lit(", x"), me, F.lit(", c"), c, F.lit("-m0 ]"))
    )
    block = F.concat(
        F.lit("\n Suggestion_ID : S"), t, F.lit("  \ntitle: "), F.regexp_replace("text", "\n", " "),
        F.lit("\ncited_atom_ids: "), cited, F.lit("\ncited_atom_ids: [c0-m1]\n\n"),
    )
    return (
        rows.select("conv_id", "turn", block.alias("block"), me.alias("me"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "block", "me"))).alias("b"))
        .select(
            F.col("conv_id").alias("run_id"),
            F.concat(F.lit("Here you are.\n"), F.array_join("b.block", "")).alias("output_text"),
            F.slice("b.me", 1, 2).alias("focus_atom_ids"),
            F.slice(F.col("b.me"), F.lit(3), F.size("b")).alias("latent_atom_ids"),
        )
    )


_SUGGESTED = """WITH b AS (SELECT conv_id AS run_id, turn, 'S' || turn AS suggestion_id, 'c' || conv_id || '-m' || turn AS me, 'c' || conv_id || '-m0' AS zero,
  (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS position FROM conversations)"""


@query(
    "suggestions_parsed",
    f"{_SUGGESTED} SELECT run_id, position, suggestion_id, CASE WHEN turn = 0 THEN me ELSE me || '|' || zero END AS cited FROM b WHERE turn <> 3",
)
def suggestions_parsed(spark, sf_dir):
    parsed = extract_suggestions(_runs(spark, sf_dir))
    return parsed.select("run_id", "position", "suggestion_id", F.array_join("cited_atom_ids", "|").alias("cited"))


@query(
    "suggestions_unchecked",
    f"""{_SUGGESTED} SELECT run_id, position, suggestion_id,
  CASE WHEN turn = 3 THEN 'nobody' ELSE me || '|x' || me || '|' || zero END AS cited FROM b""",
)
def suggestions_unchecked(spark, sf_dir):
    parsed = extract_suggestions(_runs(spark, sf_dir), known_ids=False)
    return parsed.select("run_id", "position", "suggestion_id", F.array_join("cited_atom_ids", "|").alias("cited"))


EXPORT_TURNS = 2048


# Conversation-tree exports: JSON documents of some hundred conversations each;
# node times repeat so that document order settles ties.
@query(
    "chat_export_scan",
    "SELECT role, text, row_number() OVER (PARTITION BY conv_id ORDER BY -(turn // 2), turn) - 1 AS place FROM conversations",
)
def chat_export_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    node = F.struct(
        F.struct(
            F.struct("role").alias("author"),
            F.struct(F.array("text").alias("parts")).alias("content"),
            (F.lit(10) - F.floor(F.col("turn") / 2)).alias("create_time"),
        ).alias("message")
    )
    entry = F.struct("turn", F.concat(F.lit("n"), F.col("turn").cast("string")).alias("k"), node.alias("v"))
    talks = rows.groupBy("conv_id").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["k"], e["v"]))).alias("mapping"))
    # Documents of about EXPORT_TURNS turns: small whatever the table size, and few enough to list and open.
    deal = F.pmod(F.xxhash64("conv_id"), F.lit(-(-rows.count() // EXPORT_TURNS) or 1))
    documents = talks.groupBy(deal).agg(F.to_json(F.collect_list(F.struct("mapping"))).alias("value")).select("value")
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    documents.write.option("maxRecordsPerFile", 1).text(path)
    scanned = read_json_documents(spark, [path], glob="*.txt")
    return scanned.select("role", "text", F.col("scan_order.minor").alias("place"))
