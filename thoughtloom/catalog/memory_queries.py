"""Activation, retrieval, feedback and queue queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from thoughtloom.catalog.common import (
    CONV_CTES,
    DEDUPE_CTES,
    DOC_CTES,
    conversation_atoms,
    conversation_columns,
    conversation_fragments,
    document_turns,
    query,
    sql_fold,
    sql_id,
    sql_round,
    sql_words,
    table,
    table_stream,
)
from thoughtloom.catalog.graph_queries import SQL_BRIDGES, turn_bridges
from thoughtloom.functions import text
from thoughtloom.operators import activation as act
from thoughtloom.operators import feedback as fb
from thoughtloom.operators import queue as qu
from thoughtloom.operators import retrieval as rt
from thoughtloom.operators import runs as rn
from thoughtloom.operators.fragments import clean_fragments, group_counts, table_counts
from thoughtloom.operators.suggestions import upsert_suggestions
from thoughtloom.operators.validation import validate_feedback
from thoughtloom.plans import memory as jobs
from thoughtloom.session import materialise, shared_dir
from thoughtloom.streaming import activation_stream, queue_stream

# --- activation --------------------------------------------------------------

_STEPS = {"purchase": 0.28, "signup": 0.18, "click": 0.14}
START = 0.5


def event_steps(events):
    """Events as activation steps per user: three touches, the rest decay ticks."""
    kind = F.col("event_type")
    amount = F.lit(0.0)
    for name, value in _STEPS.items():
        amount = F.when(kind == name, F.lit(value)).otherwise(amount)
    step = F.when(kind.isin(*_STEPS), act.touch_map(amount)).otherwise(
        act.decay_map(F.lit(act.DECAY_FACTOR), F.lit(act.DECAY_FLOOR))
    )
    return events.select(F.col("user_id").alias("key"), "ts", "event_id", step.alias("step"))


_REPLAY_SQL = """WITH h AS (SELECT user_id, list(struct_pack(t := event_type) ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)
SELECT user_id AS key, list_reduce(list_transform(l, lambda e: CASE e.t WHEN 'purchase' THEN 0.28e0 WHEN 'signup' THEN 0.18e0
  WHEN 'click' THEN 0.14e0 ELSE -1e0 END), lambda x, d: CASE WHEN d >= 0 THEN least(1e0, x + d)
  ELSE greatest(0.05e0, x * 0.92e0) END, 0.5e0) AS activation FROM h"""


def start_values(events):
    return events.select(F.col("user_id").alias("key")).distinct().withColumn("activation", F.lit(START))


@query("activation_replay", _REPLAY_SQL)
def activation_replay(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    replayed = act.replay(start_values(events), event_steps(events), ["ts", "event_id"])
    return replayed.select("key", "activation")


@query("stream_activation", _REPLAY_SQL)
def stream_activation(spark, sf_dir):
    stream = table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    base = f"{shared_dir(spark)}/activation-{uuid.uuid4().hex}"
    query = activation_stream.start_activation(
        event_steps(stream), f"{base}/state", f"{base}/checkpoint", ["ts", "event_id"], start=START
    )
    query.awaitTermination()
    return activation_stream.latest_state(spark, f"{base}/state").select("key", "activation")


@query("decay_step", f"WITH {CONV_CTES} SELECT id, greatest(0.05e0, activation * 0.92e0) AS activation FROM conv_atoms")
def decay_step(spark, sf_dir):
    return act.decay(conversation_atoms(spark, sf_dir)).select("id", "activation")


# Atoms are touched turn % 4 times, so some are named repeatedly in the list.
@query(
    "touch_step",
    f"""WITH {CONV_CTES}
SELECT id, CASE turn % 4 WHEN 0 THEN activation WHEN 1 THEN least(1e0, activation + 0.2e0)
  WHEN 2 THEN least(1e0, least(1e0, activation + 0.2e0) + 0.2e0)
  ELSE least(1e0, least(1e0, least(1e0, activation + 0.2e0) + 0.2e0) + 0.2e0) END AS activation FROM conv_atoms""",
)
def touch_step(spark, sf_dir):
    atoms = conversation_atoms(spark, sf_dir)
    repeats = F.expr("sequence(1, cast(turn % 4 as int))")
    named = atoms.where(F.col("turn") % 4 > 0).select("id", F.explode(repeats).alias("n")).select("id")
    return act.touch(atoms, named).select("id", "activation")


# --- retrieval ---------------------------------------------------------------

_FOCUS = "foc AS (SELECT id FROM conv_atoms ORDER BY activation DESC, importance DESC, id LIMIT 6)"
_BOOSTS = """boosts AS (SELECT id, max(b) AS boost FROM (
  SELECT to_id AS id, least(1e0, weight) * 1.2e0 AS b FROM bridges WHERE from_id IN (SELECT id FROM foc)
  UNION ALL SELECT from_id, least(1e0, weight) * 1.2e0 FROM bridges WHERE to_id IN (SELECT id FROM foc))
  WHERE id NOT IN (SELECT id FROM foc) GROUP BY id)"""
_LATENT = f"""{_FOCUS}, {SQL_BRIDGES}, {_BOOSTS},
q AS (SELECT item_id AS question_id, text AS question, {sql_fold('text')} AS qf, {sql_words('text')} AS qw FROM benchmark),
pool AS (SELECT a.*, coalesce(boost, 0e0) AS boost, {sql_words("summary || ' ' || text")} AS aw FROM conv_atoms a LEFT JOIN boosts USING (id)
  WHERE a.activation <= 0.45e0 AND a.id NOT IN (SELECT id FROM foc)),
sc AS (SELECT q.question_id, a.id, len(list_filter(a.tags, lambda t: contains(q.qf, lower(t)))) AS th,
    len(list_intersect(q.qw, a.aw)) AS wh, len(q.qw) AS qn, a.importance, a.activation, a.boost FROM q, pool a),
s2 AS (SELECT question_id, id,
    ((importance * 0.55e0) + ((1e0 - least(1e0, activation)) * 0.35e0) + (th * 0.1e0)) + boost AS reliable,
    (((1e0 - least(1e0, activation)) * 0.55e0) + (greatest(CASE WHEN th > 0 THEN 1e0 ELSE 0e0 END,
       CASE WHEN qn > 0 THEN wh::DOUBLE / qn ELSE 0e0 END) * 0.3e0) + ((1e0 - least(1e0, importance)) * 0.15e0)) + boost AS weird FROM sc),
rk AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY reliable DESC, id) AS r1,
    row_number() OVER (PARTITION BY question_id ORDER BY weird DESC, id) AS r2 FROM s2),
pl AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY least(2 * r1 - 2, 2 * r2 - 1)) AS rank FROM rk),
lat AS (SELECT question_id, rank::INTEGER AS rank, id FROM pl WHERE rank <= 12)"""


def _retrieval(spark, sf_dir):
    atoms = materialise(conversation_atoms(spark, sf_dir))
    questions = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )
    warm = rt.focus(atoms, rt.RETRIEVAL_FOCUS_LIMIT)
    boosts = rt.bridge_boosts(turn_bridges(atoms), warm)
    return atoms, questions, warm, rt.latent(atoms, questions, warm, boosts)


@query("latent_candidates", f"WITH {CONV_CTES}, {_LATENT} SELECT question_id, rank, id FROM lat")
def latent_candidates(spark, sf_dir):
    return _retrieval(spark, sf_dir)[-1].select("question_id", "rank", "id")


@query("bridge_boosts", f"WITH {CONV_CTES}, {_FOCUS}, {SQL_BRIDGES}, {_BOOSTS} SELECT id, boost FROM boosts")
def bridge_boosts(spark, sf_dir):
    atoms = conversation_atoms(spark, sf_dir)
    return rt.bridge_boosts(turn_bridges(atoms), rt.focus(atoms, rt.RETRIEVAL_FOCUS_LIMIT))


_LINE = (
    "'* [' || a.id || '] ' || kind || ', warmth ' || format('{:.2f}', activation) || ', tags ' || "
    "array_to_string(tags, '/') || ', from ' || source || ': ' || summary"
)


@query(
    "retrieval_requests",
    f"""WITH {CONV_CTES}, {_LATENT},
cold AS (SELECT question_id, string_agg({_LINE}, chr(10) ORDER BY rank) AS txt, string_agg(a.id, ',' ORDER BY rank) AS ids
  FROM lat l JOIN conv_atoms a ON a.id = l.id GROUP BY question_id),
warm AS (SELECT string_agg({_LINE}, chr(10) ORDER BY activation DESC, importance DESC, a.id) AS txt
  FROM foc JOIN conv_atoms a ON a.id = foc.id)
SELECT q.question_id, ids AS latent_atom_ids, 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Warm memory:' || chr(10)
  || warm.txt || chr(10) || chr(10) || 'Cold memory worth another look:' || chr(10) || cold.txt AS request
FROM q JOIN cold USING (question_id), warm""",
)
def retrieval_requests(spark, sf_dir):
    requests = rt.retrieval_requests(*_retrieval(spark, sf_dir))
    return requests.select(
        "question_id",
        F.array_join("latent_atom_ids", ",").alias("latent_atom_ids"),
        F.substring_index("request", "\n\nPropose three", 1).alias("request"),
    )


_BASE = 1704067200


def at_minute(minute):
    return F.timestamp_seconds(F.lit(_BASE) + minute * 60)


# --- feedback ----------------------------------------------------------------

# Every event is one feedback on the run of its user; cited atoms follow from
# the event's columns.
_STATUS = {"purchase": "Applied ", "signup": "useful", "click": "SELECTED", "view": "ignored", "error": "wrong"}


def _k(events):
    return F.try_variant_get(F.try_parse_json(events["props"]), "$.k", "bigint")


def event_feedback(events):
    status = None
    for kind, name in _STATUS.items():
        status = (F if status is None else status).when(F.col("event_type") == kind, F.lit(name))
    cited = F.array(
        F.concat(F.lit("m"), _k(events).cast("string")),
        F.concat(F.lit("m"), (F.col("user_id") % 50).cast("string")),
        F.concat(F.lit("m"), (F.col("event_id") * 13 % 97).cast("string")),
    )
    return events.select(
        F.col("event_id").alias("feedback_id"),
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
        status.alias("status"),
        cited.alias("atom_ids"),
        F.lit("").alias("note"),
        F.lit(None).cast("string").alias("suggestion_id"),
        _k(events).cast("string").alias("k"),
    )


def _resolved(spark, sf_dir):
    return fb.resolve_feedback(event_feedback(table(spark, sf_dir, "events")))


_FB = """ev AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
fbk AS (SELECT event_id AS feedback_id, 'run' || user_id AS run_id,
  CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'useful' WHEN 'click' THEN 'selected' WHEN 'view' THEN 'ignored' ELSE 'wrong' END AS status,
  CASE event_type WHEN 'purchase' THEN 0.28e0 WHEN 'signup' THEN 0.18e0 WHEN 'click' THEN 0.14e0 ELSE 0e0 END AS amount,
  list_sort(list_distinct(['m' || k, 'm' || (user_id % 50), 'm' || (event_id * 13 % 97)])) AS ids FROM ev),
one AS (SELECT feedback_id, run_id, status, amount, unnest(ids) AS id FROM fbk),
prs AS (SELECT a.feedback_id, a.id AS from_id, b.id AS to_id, a.amount, a.status FROM one a JOIN one b
  ON a.feedback_id = b.feedback_id AND a.id < b.id WHERE a.amount > 0)"""


@query("feedback_resolved", f"WITH {_FB} SELECT feedback_id, run_id, status, amount, array_to_string(ids, ',') AS atom_ids FROM fbk")
def feedback_resolved(spark, sf_dir):
    return _resolved(spark, sf_dir).select("feedback_id", "run_id", "status", "amount", F.array_join("atom_ids", ",").alias("atom_ids"))


@query("feedback_pairs", f"WITH {_FB} SELECT feedback_id, from_id, to_id, amount FROM prs")
def feedback_pairs(spark, sf_dir):
    return fb.feedback_pairs(_resolved(spark, sf_dir)).select("feedback_id", "from_id", "to_id", "amount")


_CONF = sql_round("least(0.95e0, 0.55e0 + amount)")
# The stored edge table holds the bridges whose left id ends in an even digit.
_EVEN = "right({c}, 1) IN ('0','2','4','6','8')"


@query(
    "feedback_edges",
    f"""WITH {_FB},
d AS (SELECT from_id, to_id, sum(least(1e0, amount)::DECIMAL(20,9))::DOUBLE AS gain, min_by({_CONF}, feedback_id) AS fc,
  sum(({_CONF})::DECIMAL(20,9))::DOUBLE AS cs, count(*) AS n FROM prs GROUP BY 1, 2),
s AS (SELECT *, {_EVEN.format(c='from_id')} AS stored FROM d)
SELECT from_id, to_id, 'inspire_feedback' AS relation, least(1e0, CASE WHEN stored THEN 0.1e0 ELSE 0e0 END + gain) AS weight,
  CASE WHEN NOT stored AND n = 1 THEN fc ELSE least(0.95e0, CASE WHEN stored THEN 0.3e0 ELSE fc END
    + (CASE WHEN stored THEN cs ELSE cs - fc END) * 0.25e0) END AS confidence, n AS events FROM s""",
)
def feedback_edges(spark, sf_dir):
    pairs = fb.feedback_pairs(_resolved(spark, sf_dir))
    stored = (
        pairs.where(F.right("from_id", F.lit(1)).isin("0", "2", "4", "6", "8"))
        .select("from_id", "to_id")
        .distinct()
        .select("from_id", "to_id", F.lit(fb.RELATION).alias("relation"), F.lit(0.1).alias("weight"), F.lit(0.3).alias("confidence"))
    )
    return fb.merge_feedback_edges(stored, pairs, "feedback_id").drop("last_used", "evidence")


@query(
    "feedback_touch",
    f"""WITH {_FB}, a AS (SELECT DISTINCT id FROM one),
g AS (SELECT id, sum(amount::DECIMAL(20,9))::DOUBLE AS gain FROM one WHERE amount > 0 GROUP BY id)
SELECT a.id, least(1e0, 0.01e0 + coalesce(gain, 0e0)) AS activation FROM a LEFT JOIN g USING (id)""",
)
def feedback_touch(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    atoms = resolved.select(F.explode("atom_ids").alias("id")).distinct().withColumn("activation", F.lit(0.01))
    return fb.touch_by_feedback(atoms, resolved)


@query("unknown_citations", f"WITH {_FB} SELECT feedback_id, id AS atom_id FROM one WHERE NOT {_EVEN.format(c='id')}")
def unknown_citations(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    known = resolved.select(F.explode("atom_ids").alias("id")).distinct()
    return fb.unknown_citations(resolved, known.where(F.right("id", F.lit(1)).isin("0", "2", "4", "6", "8")))


def _user_runs(spark, sf_dir):
    """A run per user of the events."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("question "), (F.col("user_id") % 7).cast("string")).alias("question"),
        F.array(F.concat(F.lit("m"), (F.col("user_id") % 50).cast("string"))).alias("focus_atom_ids"),
        F.array().cast("array<string>").alias("latent_atom_ids"),
        F.lit("").alias("output_text"),
        "user_id",
    )


def _fed_memory(spark, sf_dir):
    """Even users' runs are stored already; all runs are recorded, then the feedback is applied."""
    answered = _user_runs(spark, sf_dir)
    before = rn.run_rows(answered.where("user_id % 2 = 0"), at_minute(F.lit(0)))
    given = event_feedback(table(spark, sf_dir, "events"))
    atoms = given.select(F.explode("atom_ids").alias("id")).distinct().select("id", F.lit(0.01).alias("activation"))
    empty = fb.feedback_pairs(fb.resolve_feedback(given.limit(0))).select(
        "from_id", "to_id", F.lit(fb.RELATION).alias("relation"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("confidence")
    )
    memory = jobs.Memory(atoms=materialise(atoms), feedback_edges=empty, runs=before, usage=rn.run_events(before, at_minute(F.lit(0))))
    memory, _ = jobs.record_runs(memory, answered, at_minute(F.lit(1)))
    return jobs.apply_feedback(memory, given, at_minute(F.lit(2)))[0]


_RUNS = """us AS (SELECT DISTINCT user_id, 'run' || user_id AS id, 'question ' || (user_id % 7) AS question FROM events)"""


@query(
    "run_append",
    f"""WITH {_RUNS} SELECT id, question, 'm' || (user_id % 50) AS focus_atom_ids,
  ({_BASE} + CASE WHEN user_id % 2 = 0 THEN 0 ELSE 60 END)::BIGINT AS created_at, ({_BASE} + 120)::BIGINT AS updated_at FROM us""",
)
def run_append(spark, sf_dir):
    runs = _fed_memory(spark, sf_dir).runs
    return runs.select(
        "id", "question", F.array_join("focus_atom_ids", ",").alias("focus_atom_ids"),
        F.unix_timestamp("created_at").alias("created_at"), F.unix_timestamp("updated_at").alias("updated_at"),
    )


@query(
    "usage_append",
    f"""WITH {_FB}, {_RUNS},
ev2 AS (SELECT 'inspire_run' AS event, id AS target_id, id AS run, '' AS k, question, '' AS status, '' AS atom_ids, '' AS bridges,
    ({_BASE} + CASE WHEN user_id % 2 = 0 THEN 0 ELSE 60 END)::BIGINT AS created_at FROM us
  UNION ALL SELECT 'inspire_feedback', run_id, run_id, feedback_id::VARCHAR, NULL, status, array_to_string(ids, ','),
    (CASE WHEN amount > 0 THEN len(ids) * (len(ids) - 1) // 2 ELSE 0 END)::VARCHAR, ({_BASE} + 120)::BIGINT FROM fbk)
SELECT {sql_id('event', 'run', 'k')} AS id, event, 'inspire_run' AS target_type, target_id, question,
  nullif(status, '') AS status, nullif(atom_ids, '') AS atom_ids, nullif(bridges, '') AS bridges, created_at FROM ev2""",
)
def usage_append(spark, sf_dir):
    usage = _fed_memory(spark, sf_dir).usage
    detail = lambda name: F.col("metadata")[name]
    return usage.select(
        "id", "event", "target_type", "target_id", detail("question").alias("question"), detail("status").alias("status"),
        detail("atom_ids").alias("atom_ids"), detail("bridges_strengthened").alias("bridges"), F.unix_timestamp("created_at").alias("created_at"),
    )


@query(
    "feedback_applied",
    f"""WITH {_FB}, {_RUNS},
g AS (SELECT id, sum(amount::DECIMAL(20,9))::DOUBLE AS gain FROM one WHERE amount > 0 GROUP BY id),
shown AS (SELECT DISTINCT 'm' || (user_id % 50) AS id FROM us),
a AS (SELECT DISTINCT id FROM one),
d AS (SELECT from_id, to_id, sum(least(1e0, amount)::DECIMAL(20,9))::DOUBLE AS gain, min_by({_CONF}, feedback_id) AS fc,
  sum(({_CONF})::DECIMAL(20,9))::DOUBLE AS cs, count(*) AS n, max(feedback_id) AS last FROM prs GROUP BY 1, 2)
SELECT 'atom' AS target, a.id, NULL AS to_id, least(1e0, least(1e0, 0.01e0 + CASE WHEN s.id IS NULL THEN 0e0 ELSE 0.08e0 END) + coalesce(gain, 0e0)) AS value,
  NULL::DOUBLE AS confidence, NULL AS evidence FROM a LEFT JOIN g USING (id) LEFT JOIN shown s ON s.id = a.id
UNION ALL SELECT 'edge', from_id, to_id, least(1e0, gain), CASE WHEN n = 1 THEN fc ELSE least(0.95e0, fc + (cs - fc) * 0.25e0) END,
  concat_ws('|', 'inspire_feedback', run_id, f.feedback_id::VARCHAR, f.status, array_to_string(ids, ',')) FROM d JOIN fbk f ON f.feedback_id = d.last""",
)
def feedback_applied(spark, sf_dir):
    memory = _fed_memory(spark, sf_dir)
    e = "evidence."
    told = F.concat_ws("|", e + "type", e + "run_id", e + "feedback_id", e + "status", F.array_join(e + "atom_ids", ","))
    nothing = F.lit(None).cast("string")
    warmed = memory.atoms.select(
        F.lit("atom").alias("target"), "id", nothing.alias("to_id"), F.col("activation").alias("value"),
        F.lit(None).cast("double").alias("confidence"), nothing.alias("evidence"),
    )
    return warmed.unionByName(
        memory.feedback_edges.select(
            F.lit("edge").alias("target"), F.col("from_id").alias("id"), "to_id", F.col("weight").alias("value"), "confidence", told.alias("evidence")
        )
    )


@query("usage_event_counts", "SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def usage_event_counts(spark, sf_dir):
    return group_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "event"), "event")


@query("table_counts", "SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts_query(spark, sf_dir):
    return table_counts(events=table(spark, sf_dir, "events"), documents=table(spark, sf_dir, "documents"))


@query("latest_run", "SELECT event_id AS id FROM events ORDER BY date_trunc('second', ts) DESC, event_id DESC LIMIT 1")
def latest_run(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    runs = events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return fb.latest_run(runs)


# Suggestions: one per event (run = user, suggestion = k); a later event of the
# same key replaces the earlier one. Ratings follow the event's parity.
def event_suggestions(events):
    return event_feedback(events).select(
        "run_id",
        F.col("k").alias("suggestion_id"),
        F.concat(F.lit("s"), F.col("feedback_id").cast("string")).alias("text"),
        F.col("atom_ids").alias("cited_atom_ids"),
        F.col("feedback_id").alias("seq"),
    )


@query(
    "suggestion_upsert",
    f"""WITH {_FB} SELECT 'run' || user_id AS run_id, k::VARCHAR AS suggestion_id,
  coalesce(max_by('s' || event_id, event_id) FILTER (WHERE event_id % 2 = 1), max_by('s' || event_id, event_id)) AS text
FROM ev GROUP BY 1, 2""",
)
def suggestion_upsert(spark, sf_dir):
    rows = event_suggestions(table(spark, sf_dir, "events"))
    empty = rows.where(F.lit(False))
    stored = upsert_suggestions(empty, rows.where(F.col("seq") % 2 == 0), "seq")
    return upsert_suggestions(stored, rows.where(F.col("seq") % 2 == 1), "seq").select("run_id", "suggestion_id", "text")


@query(
    "rating_statuses",
    f"""WITH {_FB}, s AS (SELECT 'run' || user_id AS run_id, k::VARCHAR AS suggestion_id, max(event_id) AS e FROM ev GROUP BY 1, 2)
SELECT run_id, suggestion_id, CASE e % 3 WHEN 0 THEN 'useful' WHEN 1 THEN 'wrong' ELSE 'ignored' END AS status FROM s""",
)
def rating_statuses(spark, sf_dir):
    rows = event_suggestions(table(spark, sf_dir, "events"))
    last = rows.groupBy("run_id", "suggestion_id").agg(F.max("seq").alias("seq"))
    ratings = last.where(F.col("seq") % 3 != 2).select(
        "run_id", "suggestion_id", F.when(F.col("seq") % 3 == 0, F.lit("up")).otherwise(F.lit("down")).alias("rating")
    )
    return fb.rating_statuses(last, ratings)


@query(
    "feedback_validation",
    f"""WITH {_FB},
runs AS (SELECT DISTINCT 'run' || user_id AS id, 'm' || (user_id % 50) AS lat FROM events UNION SELECT 'idle', 'none'),
sug AS (SELECT run_id, ids FROM fbk),
c AS (SELECT (SELECT count(*) FROM runs) AS r, (SELECT count(*) FROM sug) AS s, (SELECT count(*) FROM fbk) AS f,
  (SELECT count(*) FROM fbk WHERE amount > 0) AS pos, (SELECT count(*) FROM fbk WHERE status = 'wrong') AS neg,
  (SELECT count(*) FROM fbk WHERE status = 'ignored') AS ign,
  (SELECT count(*) FROM runs WHERE id IN (SELECT run_id FROM fbk)) AS rf,
  (SELECT count(*) FROM sug JOIN runs ON runs.id = sug.run_id WHERE list_contains(ids, lat)) AS lc)
SELECT r AS runs_count, s AS suggestions_count, f AS feedback_count, pos AS positive_feedback_count, neg AS negative_feedback_count,
  ign AS ignored_feedback_count, rf AS runs_with_feedback, {sql_round('rf::DOUBLE / r', 4)} AS runs_with_feedback_rate,
  {sql_round('pos::DOUBLE / r', 4)} AS positive_feedback_per_run, {sql_round('s::DOUBLE / r', 4)} AS suggestions_per_run,
  lc AS latent_citation_count, {sql_round('lc::DOUBLE / s', 4)} AS latent_citation_rate, f AS usage_events_count,
  0::BIGINT AS inspire_run_event_count, f AS inspire_feedback_event_count,
  CASE WHEN pos::DOUBLE / r >= 0.25 THEN 'pass' ELSE 'fail' END AS verdict FROM c""",
)
def feedback_validation(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    feedback = _resolved(spark, sf_dir)
    runs = (
        events.select("user_id")
        .distinct()
        .select(
            F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("id"),
            F.array(F.concat(F.lit("m"), (F.col("user_id") % 50).cast("string"))).alias("latent_atom_ids"),
        )
        .unionByName(spark.sql("SELECT 'idle' AS id, array('none') AS latent_atom_ids"))
    )
    suggestions = feedback.select("run_id", F.col("atom_ids").alias("cited_atom_ids"))
    usage = events.select(F.lit("inspire_feedback").alias("event"))
    return validate_feedback(runs, suggestions, feedback, usage)


# --- queue -------------------------------------------------------------------

_MINUTE = "(conv_id * 8 + turn)"
_ST = "CASE (conv_id + turn) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'skipped' ELSE 'error' END"


def stored_queue(fragments):
    """Queue rows for every conversation fragment with a status by position."""
    spot = (F.col("conv_id") + F.col("turn")) % 4
    status = F.when(spot == 0, F.lit("pending")).when(spot == 1, F.lit("done")).when(spot == 2, F.lit("skipped")).otherwise(F.lit("error"))
    made = at_minute(F.col("conv_id") * 8 + F.col("turn"))
    return fragments.select(
        "id", "source_file", "source", "role", "text", "timestamp",
        status.alias("status"),
        F.col("turn").cast("int").alias("attempts"),
        F.when(spot == 3, F.lit("boom")).otherwise(F.lit("")).alias("last_error"),
        F.when(spot == 1, F.col("id")).alias("atom_id"),
        made.alias("created_at"),
        (made + F.expr("interval 1 minute") * (F.col("turn") % 3)).alias("updated_at"),
    )


_QUEUE = f"""{CONV_CTES},
que AS (SELECT id, text, {_ST} AS status, turn::INTEGER AS attempts, CASE WHEN (conv_id + turn) % 4 = 3 THEN 'boom' ELSE '' END AS last_error,
  {_BASE} + {_MINUTE} * 60 AS created_at, {_BASE} + {_MINUTE} * 60 + (turn % 3) * 60 AS updated_at FROM conv_frags)"""


def _queue(spark, sf_dir):
    return stored_queue(conversation_fragments(spark, sf_dir))


_NOW_S = 1800000000


def _now():
    return F.timestamp_seconds(F.lit(_NOW_S))


# The batch offers each conversation fragment again plus every document, twice.
@query(
    "queue_enqueue",
    f"""WITH {_QUEUE}, {DOC_CTES}
SELECT id, status, attempts, created_at::BIGINT AS created_at FROM que
UNION ALL SELECT DISTINCT id, 'pending', 0, {_NOW_S}::BIGINT FROM doc_frags""",
)
def queue_enqueue(spark, sf_dir):
    talk = conversation_fragments(spark, sf_dir)
    docs = clean_fragments(document_turns(spark, sf_dir))
    offered = qu.union_collectors(
        files=talk.drop("conv_id", "turn"), notes=docs.drop("doc_id"), again=docs.drop("doc_id")
    )
    grown = qu.enqueue(stored_queue(talk), offered, _now())
    return grown.select("id", "status", "attempts", F.unix_timestamp("created_at").alias("created_at"))


@query(
    "stream_queue",
    f"""WITH {CONV_CTES} SELECT id, 'pending' AS status, 0 AS attempts FROM conv_frags""",
)
def stream_queue(spark, sf_dir):
    fragments = clean_fragments(conversation_columns(table_stream(spark, sf_dir, "conversations")))
    base = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    queue_stream.start_queue(fragments, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return queue_stream.read_queue(spark, f"{base}/table").select("id", "status", "attempts")


# Documents arrive in three deliveries, each a micro-batch of a stream started anew; what
# is queued is what the duplicate filter keeps of the whole table.
@query(
    "queue_tick",
    f"""WITH {DEDUPE_CTES},
kept AS (SELECT doc_id FROM reps WHERE len(toks) = 0
  UNION ALL SELECT doc_id FROM sets WHERE doc_id NOT IN (SELECT later_rid FROM p))
SELECT doc_id::VARCHAR AS id, 'pending' AS status, 0 AS attempts FROM kept""",
)
def queue_tick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_file"), F.col("lang").alias("source"),
        F.lit("user").alias("role"), "text", F.lit(None).cast("string").alias("timestamp"), F.col("doc_id").alias("scan_order"),
    )
    base = f"{shared_dir(spark)}/tick-{uuid.uuid4().hex}"
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    for k in range(3):
        part = (F.col("scan_order") * 3 / (last + 1)).cast("int")
        rows.where(part == k).write.parquet(f"{base}/in/delivery={k}")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{base}/in/*")
        stream = queue_stream.start_queue(arrived, f"{base}/table", f"{base}/checkpoint", index=f"{base}/index")
        stream.awaitTermination()
    return queue_stream.read_queue(spark, f"{base}/table").select("id", "status", "attempts")


@query("queue_next", f"WITH {_QUEUE} SELECT id, created_at::BIGINT AS created_at FROM que WHERE status = 'pending' ORDER BY created_at, id LIMIT 10")
def queue_next(spark, sf_dir):
    return qu.queue_next(_queue(spark, sf_dir)).select("id", F.unix_timestamp("created_at").alias("created_at"))


@query("queue_errors", f"WITH {_QUEUE} SELECT id, updated_at::BIGINT AS updated_at, last_error FROM que WHERE status = 'error' ORDER BY updated_at DESC, id LIMIT 20")
def queue_errors(spark, sf_dir):
    return qu.queue_errors(_queue(spark, sf_dir)).select("id", F.unix_timestamp("updated_at").alias("updated_at"), "last_error")


@query("queue_stats", f"WITH {_QUEUE} SELECT status, count(*) AS n FROM que GROUP BY 1")
def queue_stats(spark, sf_dir):
    return group_counts(_queue(spark, sf_dir), "status")


_RETRIED = """SELECT id, CASE WHEN {hit} THEN 'pending' ELSE status END AS status, attempts,
  CASE WHEN {hit} THEN '' ELSE last_error END AS last_error, CASE WHEN {hit} THEN """ + str(_NOW_S) + """ ELSE updated_at END::BIGINT AS updated_at FROM que"""


def _queue_view(queue):
    return queue.select("id", "status", "attempts", "last_error", F.unix_timestamp("updated_at").alias("updated_at"))


@query("queue_retry", f"WITH {_QUEUE} " + _RETRIED.format(hit="status = 'error'"))
def queue_retry(spark, sf_dir):
    return _queue_view(qu.retry(_queue(spark, sf_dir), _now()))


@query("queue_retry_listed", f"WITH {_QUEUE} " + _RETRIED.format(hit="(status = 'error' AND id < '8')"))
def queue_retry_listed(spark, sf_dir):
    queue = _queue(spark, sf_dir)
    return _queue_view(qu.retry(queue, _now(), queue.where(F.col("id") < "8").select("id")))


# A whole-queue run: pending rows finish as done, skipped or error by their id.
_OUT = "CASE WHEN id < '6' THEN 'done' WHEN id < 'b' THEN 'skipped' ELSE 'error' END"


def _outcomes(queue):
    outcome = F.when(F.col("id") < "6", F.lit("done")).when(F.col("id") < "b", F.lit("skipped")).otherwise(F.lit("error"))
    return queue.where(F.col("status") == "pending").select(
        "id",
        outcome.alias("outcome"),
        F.when(outcome == "done", F.lit("")).otherwise(F.lit("why")).alias("error"),
        F.when(outcome == "done", F.col("id")).alias("atom_id"),
    )


@query(
    "queue_outcomes",
    f"""WITH {_QUEUE} SELECT id, CASE WHEN status = 'pending' THEN {_OUT} ELSE status END AS status,
  (CASE WHEN status = 'pending' THEN attempts + 1 ELSE attempts END)::INTEGER AS attempts,
  CASE WHEN status <> 'pending' THEN last_error WHEN id < '6' THEN '' ELSE 'why' END AS last_error,
  (CASE WHEN status = 'pending' THEN {_NOW_S} ELSE updated_at END)::BIGINT AS updated_at FROM que""",
)
def queue_outcomes(spark, sf_dir):
    queue = _queue(spark, sf_dir)
    return _queue_view(qu.record_outcomes(queue, _outcomes(queue), _now()))


@query(
    "queue_run_summary",
    f"""WITH {_QUEUE}, o AS (SELECT {_OUT} AS o FROM que WHERE status = 'pending')
SELECT count(*) AS processed, count(*) FILTER (WHERE o = 'done') AS atoms_created,
  count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'error') AS errors FROM o""",
)
def queue_run_summary(spark, sf_dir):
    return qu.run_summary(_outcomes(_queue(spark, sf_dir)))


@query(
    "off_peak_events",
    """SELECT event_id, hour(ts) < 7 AS night, (hour(ts) >= 22 OR hour(ts) * 60 + minute(ts) < 390) AS late, true AS always FROM events""",
)
def off_peak_events(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.off_peak(ts, "00:00-07:00").alias("night"),
        text.off_peak(ts, "22:00-06:30").alias("late"),
        text.off_peak(ts, "05:00-05:00").alias("always"),
    )
