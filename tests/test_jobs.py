import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from thoughtloom.functions.rules import FEEDBACK_STATUSES
from thoughtloom.operators import activation as act
from thoughtloom.operators import evaluation as ev
from thoughtloom.operators.fragments import clean_fragments
from thoughtloom.operators.queue import queue_next
from thoughtloom.operators.validation import combined_verdict
from thoughtloom.plans import memory as jobs
from thoughtloom.schemas import ATOM, QUEUE
from thoughtloom.sources.chat import read_chat
from thoughtloom.sources.transcripts import join_transcripts
from thoughtloom.streaming import activation_stream, queue_stream



def now():
    return F.to_timestamp(F.lit("2024-05-01 00:00:00"))


def later():
    return F.to_timestamp(F.lit("2024-05-02 00:00:00"))


TEXTS = [
    "I think a local privacy idea could work", "there is a risk with local memory and privacy",
    "what if the embedding memory is local?", "plain remark about nothing special here",
    "another plain remark about nothing else", "the slime mold idea of memory decay",
]


def empty_memory(spark):
    atoms = spark.createDataFrame([], f"{ATOM}, created_at timestamp, updated_at timestamp")
    bridges = spark.createDataFrame([], "from_id string, to_id string, relation string, weight double, confidence double, last struct<status string>, events bigint")
    return jobs.Memory(atoms=atoms, feedback_edges=bridges.withColumn("evidence", F.col("last")))


def chat_turns(spark, tmp_path, texts=TEXTS, name="c.jsonl"):
    tmp_path.mkdir(parents=True, exist_ok=True)
    (tmp_path / name).write_text("\n".join(json.dumps({"role": "user", "content": t}) for t in texts))
    return read_chat(spark, lines=[str(tmp_path)])


def test_import_digest_retrieve_feedback(spark, tmp_path):
    start = empty_memory(spark)
    grown = jobs.ingest(start, chat_turns(spark, tmp_path / "in"), now())
    assert grown.atoms.count() == 6
    rebuilt = jobs.refresh(grown)
    counts = {r["table_name"]: r["n"] for r in jobs.refresh_summary(start, rebuilt).collect()}
    assert counts["atoms_after"] == 6 and counts["notes"] == 2 and counts["edges"] == 5
    vault = tmp_path / "vault"
    documents, manifest = jobs.export_notes(rebuilt, str(vault))
    assert documents.select("id").distinct().count() == manifest.count() == 2
    nodes, listed, stats = jobs.export_graph(rebuilt, 160)
    assert (nodes.count(), stats.first()["edges"]) == (6, listed.count())

    def warmed():
        synced = jobs.sync_notes(rebuilt, manifest, str(vault))
        atoms = synced.atoms.join(rebuilt.atoms.select("id", F.col("activation").alias("a0")), "id").where("activation > a0")
        notes = synced.notes.join(rebuilt.notes.select("id", F.col("activation").alias("a0")), "id").where("activation > a0")
        return {r["id"] for r in atoms.collect()}, {r["id"] for r in notes.collect()}

    assert warmed() == (set(), set())  # nothing was edited
    edited = manifest.orderBy("id").first()
    files = [f for f in vault.rglob("part-*") if edited["path"].split("/")[-1] in str(f.parent)]
    whole = "".join(f.read_text() for f in sorted(files))
    assert len(whole.encode()) == edited["size"] and f'note_id: "{edited["id"]}"' in whole
    with files[-1].open("a") as file:
        file.write("an edit\n")
    of_note = {r["atom_id"] for r in rebuilt.note_sources.where(F.col("note_id") == edited["id"]).collect()}
    assert warmed() == (of_note, {edited["id"]})

    questions = spark.createDataFrame([(1, "how to keep memory local?")], "question_id int, question string")
    request = jobs.retrieve(rebuilt, questions, focus_limit=2, latent_limit=4).first()
    assert len(request["focus_atom_ids"]) == 2 and not set(request["focus_atom_ids"]) & set(request["latent_atom_ids"])
    first, second = request["focus_atom_ids"]
    answer = f"suggestion_id: 1\ncited_atom_ids: [{first}, {second}]\ntitle: t"
    runs = spark.createDataFrame(
        [("r1", answer, request["focus_atom_ids"], request["latent_atom_ids"])],
        "run_id string, output_text string, focus_atom_ids array<string>, latent_atom_ids array<string>",
    )
    used, suggestions = jobs.record_runs(rebuilt, runs, now())
    again, _ = jobs.record_runs(used, runs, later())
    assert again.runs.count() == again.usage.count() == 1 and again.runs.first()["output_text"] == answer
    rows = spark.createDataFrame([(1, "r1", "useful", [], "", "1")], "feedback_id int, run_id string, status string, atom_ids array<string>, note string, suggestion_id string")
    final, resolved = jobs.apply_feedback(used, rows, later(), suggestions)
    assert resolved.first()["amount"] == 0.18
    assert final.runs.where(F.col("updated_at") == later()).count() == 1
    event = final.usage.where("event = 'inspire_feedback'").first()
    assert (event["target_type"], event["target_id"]) == ("inspire_run", "r1")
    assert event["metadata"]["bridges_strengthened"] == "1" and event["metadata"]["suggestion_id"] == "1"
    edge = final.feedback_edges.first()
    assert {edge["from_id"], edge["to_id"]} == {first, second} and edge["weight"] == 0.18
    before = {r["id"]: r["activation"] for r in rebuilt.atoms.collect()}
    after = {r["id"]: r["activation"] for r in final.atoms.collect()}
    assert abs(after[first] - min(1.0, before[first] + 0.08 + 0.18)) < 1e-9
    assert set(FEEDBACK_STATUSES) >= {"useful", "boring"}


def test_reingest_keeps_warm_atoms_and_creation_time(spark, tmp_path):
    turns = chat_turns(spark, tmp_path / "in")
    grown = jobs.ingest(empty_memory(spark), turns, now())
    warm = jobs.Memory(atoms=grown.atoms.withColumn("activation", F.lit(0.9)))
    again = jobs.ingest(warm, turns, later(), max_turns_per_file=3).atoms
    assert again.where("activation = 0.9").count() == 6
    assert again.where(F.col("created_at") == now()).count() == 6
    assert again.where(F.col("updated_at") == later()).count() == 3


def test_model_content_can_take_precedence(spark, tmp_path):
    turns = chat_turns(spark, tmp_path / "in")
    model = jobs.ingest(empty_memory(spark), turns, now(), extractor=lambda t, r: {"keep": True, "kind": "taste", "confidence": 0.9, "tags": ["m"]})
    assert {r["kind"] for r in jobs.ingest(model, turns, later(), precedence="model").atoms.collect()} == {"taste"}
    assert "taste" not in {r["kind"] for r in jobs.ingest(model, turns, later()).atoms.collect()}


def test_transcript_import_falls_back_to_rules(spark):
    chats = spark.createDataFrame([("s1", "[User]: maybe a local idea here\n[Assistant]: short\n[User]: this one is rejected ok", 3, "web", "2024")],
                                  "sessionId string, rawText string, messageCount int, platform string, createdAt string")
    sessions = spark.createDataFrame([("s1", "proj", None, None, None)], "id string, projectName string, platform string, createdAt string, updatedAt string")

    def fn(text, role):
        if "rejected" in text:
            raise RuntimeError("no")
        return {"keep": True, "kind": "framework", "confidence": 1.0, "tags": ["m"]}

    got = jobs.import_transcripts(empty_memory(spark), join_transcripts(chats, sessions), "db", now(), extractor=fn).atoms.collect()
    by_kind = {r["kind"]: r for r in got}
    assert set(by_kind) == {"framework", "note"}
    assert by_kind["note"]["metadata"]["project"] == "proj" and by_kind["framework"]["metadata"]["extractor"] == "model"


def test_incremental_transcripts(spark):
    sessions = spark.createDataFrame([], "id string, projectName string, platform string, createdAt string, updatedAt string")

    def version(*rows):
        chats = [(s, f"[User]: {t}", 1, "web", "2024") for s, t in rows]
        schema = "sessionId string, rawText string, messageCount int, platform string, createdAt string"
        return join_transcripts(spark.createDataFrame(chats, schema), sessions)

    def changes(feed):
        return {r["session_id"]: r["change"] for r in feed.collect()}

    def rows(memory):
        return sorted(map(tuple, memory.atoms.select("id", "text", "created_at", "updated_at").collect()))

    first = version(("a", "the first idea of memory"), ("b", "a decision about tags"), ("c", "this session goes away"), (None, "said without a session"))
    memory, feed, seen = jobs.incremental_transcripts(empty_memory(spark), first, "db", now())
    assert changes(feed) == {"a": "added", "b": "added", "c": "added", None: "added"}
    assert rows(memory) == rows(jobs.import_transcripts(empty_memory(spark), first, "db", now()))

    # b is repeated by a row of its own, a is worded otherwise, d is new; c stays in the memory.
    second = version((None, "said without a session"), ("b", "a decision about tags"), ("b", "a decision about tags"), ("a", "the first idea of forgetting"), ("d", "a session that is new"))
    again, feed, seen_2 = jobs.incremental_transcripts(memory, second, "db", later(), seen)
    assert changes(feed) == {"a": "modified", "b": "modified", "c": "removed", "d": "added"}
    texts = {r["text"]: (r["created_at"].day, r["updated_at"].day) for r in again.atoms.collect()}
    assert texts["a decision about tags"] == (1, 2) and texts["a session that is new"] == (2, 2)
    assert texts["the first idea of memory"] == texts["this session goes away"] == (1, 1)
    # A run that is repeated because its digests were lost gives the same rows; one on the same version none.
    assert rows(jobs.incremental_transcripts(again, second, "db", later(), seen)[0]) == rows(again)
    same, feed, _ = jobs.incremental_transcripts(again, second, "db", now(), seen_2)
    assert feed.isEmpty() and same is again
    with pytest.raises(ValueError):
        jobs.incremental_transcripts(again, second, "db", now(), seen, max_atoms=3)


def test_queue_jobs(spark, tmp_path):
    one = clean_fragments(chat_turns(spark, tmp_path / "a", TEXTS[:3] + TEXTS[:1] + ["<command-name> x <command-args>"]))
    two = clean_fragments(chat_turns(spark, tmp_path / "b", TEXTS[:2], "d.jsonl"))
    table = spark.createDataFrame([], QUEUE)
    queued = jobs.build_queue(table, {"files": one, "notes": two}, now())
    assert queued.count() == 5  # duplicates are judged inside one collector
    assert jobs.build_queue(queued, {"files": one}, later()).count() == 5

    def fn(text, role):
        if "risk" in text:
            raise RuntimeError("model down")
        return {"keep": "what if" not in text, "reason": "dull", "kind": "idea", "confidence": 0.9, "tags": ["q"]}

    done, memory, summary = jobs.run_queue(queued, empty_memory(spark), later(), n=10, extractor=fn)
    assert summary.first().asDict() == {"processed": 5, "atoms_created": 2, "skipped": 1, "errors": 2}
    assert {r["status"]: r["last_error"] for r in done.collect()} == {"done": "", "skipped": "dull", "error": "model down"}
    assert memory.atoms.first()["metadata"]["queue_status"] == "done"
    assert queue_next(done).isEmpty()
    ruled, _, small = jobs.run_queue(queued, empty_memory(spark), later(), n=2)
    assert small.first()["processed"] == 2 and ruled.where("status = 'done' AND attempts = 1").count() == 2


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_queue_stream_equals_batch(spark, tmp_path):
    schema = "id string, source_file string, source string, role string, text string, timestamp string, scan_order int"
    rows = [(str(i % 7), "f", f"s{i}", "user", f"t{i}", None, i) for i in range(10)]
    data, table, marks = tmp_path / "data", str(tmp_path / "table"), str(tmp_path / "marks")
    for part in (rows[:5], rows[5:]):
        _write(spark, part, schema, data)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(data))
        queue_stream.start_queue(stream, table, marks).awaitTermination()
    got = {r["id"]: r["text"] for r in queue_stream.read_queue(spark, table).collect()}
    assert got == {str(i): f"t{i}" for i in range(7)}


def test_activation_stream_equals_batch(spark, tmp_path):
    schema = "key string, ts timestamp, event_id int, up boolean"
    base = [(f"k{i % 3}", i) for i in range(30)]
    rows = spark.createDataFrame([(k, 1704067200 + i * 60, i, i % 4 != 0) for k, i in base], "key string, s long, event_id int, up boolean")
    events = rows.select("key", F.timestamp_seconds("s").alias("ts"), "event_id", "up")

    def steps(df):
        step = F.when(F.col("up"), act.touch_map(F.lit(0.14))).otherwise(act.decay_map(F.lit(0.92), F.lit(0.05)))
        return df.select("key", "ts", "event_id", step.alias("step"))

    data, state, marks = tmp_path / "data", str(tmp_path / "state"), str(tmp_path / "marks")
    for low, high in ((0, 12), (10, 30)):  # events 10 and 11 are delivered twice
        events.where(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(data))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(data)).withWatermark("ts", "1 hour")
        activation_stream.start_activation(steps(stream), state, marks, ["ts", "event_id"], start=0.5).awaitTermination()
    start = events.select("key").distinct().withColumn("activation", F.lit(0.5))
    batch = {r["key"]: r["activation"] for r in act.replay(start, steps(events), ["ts", "event_id"]).collect()}
    streamed = {r["key"]: r["activation"] for r in activation_stream.latest_state(spark, state).collect()}
    assert streamed == batch


def test_eval_build_and_clean(spark, tmp_path):
    turns = chat_turns(spark, tmp_path / "a", [t + " and some more words to pass the limit" for t in TEXTS])
    sheet = ev.build_eval(turns, limit=4, per_file_limit=5)
    rows = sheet.orderBy("scan_order").collect()
    assert [r["text"].split(" and some")[0] for r in rows] == TEXTS[:4]
    assert rows[0]["prediction"]["reason"] == "rules baseline" and rows[0]["human"]["keep"] is None
    doubled = sheet.unionByName(sheet.withColumn("scan_order", F.struct(F.lit("z").alias("file"), F.col("scan_order.major"), F.col("scan_order.minor"))))
    summary = ev.clean_summary(ev.clean_eval(doubled, "scan_order")).first()
    assert (summary["total_cases"], summary["kept_cases"], summary["dropped_duplicates"]) == (8, 4, 4)
    assert ev.score_eval(sheet).first()["pass_rate"] == 0.0


def test_combined_verdict(spark):
    def section(verdict):
        return spark.range(1).select(F.lit(verdict).alias("verdict"))

    def combine(*names):
        return combined_verdict(*[section(n) for n in names]).first()["verdict"]

    assert combine("pass", "needs_data", "fail") == "fail"
    assert combine("pass", "needs_data") == "needs_data"
    assert combine("pass", "pass") == "pass"


def test_feedback_reaches_the_graph_and_unknown_ids_fail(spark, tmp_path):
    memory = jobs.ingest(empty_memory(spark), chat_turns(spark, tmp_path / "in"), now())
    ids = [r["id"] for r in memory.atoms.orderBy("id").limit(2).collect()]
    schema = "feedback_id int, run_id string, status string, atom_ids array<string>, note string"
    give = lambda k, atoms: spark.createDataFrame([(k, "r1", "useful", atoms, f"n{k}")], schema)
    with pytest.raises(ValueError, match="unknown run"):
        jobs.apply_feedback(memory, give(1, ids), now())
    runs = spark.createDataFrame([("r1", "q")], "id string, question string")
    memory = replace(memory, runs=runs)
    once, resolved = jobs.apply_feedback(memory, give(1, ids), now())
    _, edges, _ = jobs.export_graph(once)
    assert [r["status"] for r in edges.where("relation = 'inspire_feedback'").collect()] == ["useful"]
    twice, _ = jobs.apply_feedback(once, give(2, ids), now())
    edge = twice.feedback_edges.first()
    assert edge["evidence"]["note"] == "n2" and edge["evidence"]["atom_ids"] == sorted(ids)
    kept, _ = jobs.apply_feedback(twice, give(3, ids[:1]), now())
    assert kept.feedback_edges.first()["evidence"]["note"] == "n2"
    for rows, known in ((give(4, ["ghost"]), runs), (give(5, ids), runs.where("false"))):
        with pytest.raises(ValueError, match="unknown"):
            jobs.apply_feedback(replace(memory, runs=known), rows, now())
    assert kept.usage.count() == 3 and kept.usage.select("id").distinct().count() == 3
