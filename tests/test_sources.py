import json
import os

import pytest
from pyspark.sql import functions as F

from thoughtloom.catalog import source_queries
from thoughtloom.operators.extraction import atoms_with_policy, extract, normalise_signals, outcomes
from thoughtloom.operators.fragments import clean_fragments
from thoughtloom.sources import chat, listings, notes_inbox, sheets, transcripts
from thoughtloom.streaming.watch import changed_files, incremental_turns, sources_changed


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def turns(df):
    return [(r["source"], r["role"], r["text"], r["timestamp"]) for r in df.orderBy("scan_order").collect()]


def test_json_lines_shapes(spark, tmp_path):
    rows = [
        json.dumps({"role": "user", "content": "plain", "timestamp": "T1"}),
        "",
        '{"role": "user", "content": "broken',
        '["not", "an object"]',
        json.dumps({"author": "ann", "content": [{"text": "a"}, "b", {"content": "c"}, {"x": 1}, 5], "create_time": 1700000000}),
        json.dumps({"role": "", "content": {"parts": ["p", {"text": "q"}]}, "create_time": 1700000000.25}),
        json.dumps({"content": {"text": "inner"}}),
        json.dumps({"content": {"parts": "no list", "other": 1}, "message": "via message"}),
        json.dumps({"content": 7, "text": "via text"}),
        json.dumps({"role": "user", "content": ""}),
        json.dumps({"messages": [{"role": "user", "content": "m0"}, "skip", {"role": "assistant", "text": "m2"}]}),
    ]
    path = write(tmp_path / "chat" / "a.jsonl", "\n".join(rows))
    write(tmp_path / "chat" / "ignored.txt", rows[0])
    assert turns(chat.read_chat(spark, lines=[os.path.dirname(path)])) == [
        ("a.jsonl:line[0]", "user", "plain", "T1"),
        ("a.jsonl:line[4]", "ann", "a\nb\nc", "2023-11-14T22:13:20+00:00"),
        ("a.jsonl:line[5]", "unknown", "p\nq", "2023-11-14T22:13:20.250000+00:00"),
        ("a.jsonl:line[6]", "unknown", "inner", None),
        ("a.jsonl:line[7]", "unknown", "via message", None),
        ("a.jsonl:line[8]", "unknown", "via text", None),
        ("a.jsonl:line[10]:message[0]", "user", "m0", None),
        ("a.jsonl:line[10]:message[2]", "assistant", "m2", None),
    ]


def test_line_numbers_hold_when_a_file_is_split(spark, tmp_path):
    lines = [json.dumps({"content": f"text {i} " + "x" * (i % 50)}) if i % 7 else "" for i in range(2000)]
    write(tmp_path / "big.jsonl", "\n".join(lines))
    write(tmp_path / "small.jsonl", json.dumps({"content": "only"}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = chat.read_json_lines(spark, [str(tmp_path)])
        got = {r["source"]: r["text"] for r in df.collect()}
        assert spark.read.text(str(tmp_path / "big.jsonl")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = {f"big.jsonl:line[{i}]": json.loads(line)["content"] for i, line in enumerate(lines) if line}
    assert got == {**expected, "small.jsonl:line[0]": "only"}


def node(text, time=None, role="user"):
    message = {"author": {"role": role}, "content": {"parts": [text]}}
    if time is not None:
        message["create_time"] = time
    return {"message": message}


def test_json_documents(spark, tmp_path):
    export = [
        {"mapping": {"root": {"message": None}, "z": node("second", 5), "a": node("third", 5), "m": node("first", "bad"), "k": node("zero", None, "assistant")}},
        {"title": "no mapping"},
    ]
    write(tmp_path / "export.json", json.dumps({"conversations": export}))
    write(tmp_path / "one.json", json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "user"}]}))
    write(tmp_path / "rows.json", json.dumps([{"text": "r0"}, 3, {"messages": [{"text": "c0"}]}, {"role": "x"}]))
    got = turns(chat.read_chat(spark, documents=[str(tmp_path)]))
    assert [(s, t) for s, _, t, _ in got] == [
        ("export.json:conversation[0]/m", "first"),
        ("export.json:conversation[0]/k", "zero"),
        ("export.json:conversation[0]/z", "second"),
        ("export.json:conversation[0]/a", "third"),
        ("one.json:message[0]", "hi"),
        ("rows.json:row[0]", "r0"),
        ("rows.json:conversation[2]:message[0]", "c0"),
    ]
    assert got[1][1] == "assistant" and got[2][3] == "1970-01-01T00:00:05+00:00"
    capped = chat.read_chat(spark, documents=[str(tmp_path)], max_turns_per_file=1)
    assert sorted(t for _, _, t, _ in turns(capped)) == ["first", "hi", "r0"]


def test_broken_document_fails(spark, tmp_path):
    write(tmp_path / "x.json", "{")
    with pytest.raises(Exception):
        chat.read_json_documents(spark, [str(tmp_path)]).collect()


def test_transcripts(spark):
    raw = "lost\n[User]: hello\nmore\n[Assistant]:\n\n  hi [User]: inline\n[User]:   \n[Assistant]: bye "
    chats = spark.createDataFrame(
        [("s1", raw, None, "", None), ("s2", " no markers ", 3, "web", "2024"), ("s3", None, 1, None, None)],
        "sessionId string, rawText string, messageCount int, platform string, createdAt string",
    )
    sessions = spark.createDataFrame([("s1", "", None, None, "2022")], "id string, projectName string, platform string, createdAt string, updatedAt string")
    joined = transcripts.join_transcripts(chats, sessions)
    info = {r["session_id"]: (r["message_count"], r["platform"], r["project"], r["timestamp"], r["sort_time"]) for r in joined.collect()}
    assert info == {"s1": (0, "unknown", "s1", "2022", "2022"), "s2": (3, "web", "s2", "2024", "2024"), "s3": (1, "unknown", "s3", None, "s3")}
    split = [(r["source"], r["role"], r["text"]) for r in transcripts.split_transcripts(joined).orderBy("source").collect()]
    assert split == [
        ("transcript:s1:turn[0]", "user", "hello\nmore"),
        ("transcript:s1:turn[1]", "assistant", "hi [User]: inline"),
        ("transcript:s1:turn[2]", "assistant", "bye"),
        ("transcript:s2:turn[0]", "unknown", "no markers"),
    ]


def test_notes_inbox(spark, tmp_path):
    root = tmp_path / "inbox"
    write(root / "a.md", "---\ntags: x\n---\nintro line  \nsecond\n\n# Head One #\n\n\nbody a\n\n   \nbody b\n## Empty\n### Next\nlast")
    write(root / "sub" / "b.TXT", "---\nnot closed\ntext")
    write(root / "c.md", '---\nnote_id: "1"\nsource_atoms:\n---\nbody')
    write(root / ".hidden" / "d.md", "secret")
    write(root / "e.pdf", "no")
    scanned = notes_inbox.read_notes(spark, [str(root)])
    assert all(r["timestamp"].endswith("+00:00") for r in scanned.collect())
    chunks = {r["source"]: r["text"] for r in notes_inbox.chunk_notes(scanned).collect()}
    assert chunks == {
        "note-inbox:a.md:chunk[0]": "intro line\nsecond",
        "note-inbox:a.md:chunk[1]": "Head One #\n\nbody a",
        "note-inbox:a.md:chunk[2]": "Head One #\n\nbody b",
        "note-inbox:a.md:chunk[3]": "Next\n\nlast",
        "note-inbox:sub/b.TXT:chunk[0]": "---\nnot closed\ntext",
    }


def test_source_selection_and_watch(spark, tmp_path):
    base = "/d/chats"
    rows = [(f"{base}/a.jsonl",), (f"{base}/a.jsonl",), (f"{base}/B.JSON",), (f"{base}/Secrets/x.json",), (f"{base}/catalog.json",), (f"{base}/n.md",)]
    listing = spark.createDataFrame(rows, "path string").withColumns({"size": F.lit(1), "modified": F.lit(1)})
    assert sorted(r["path"] for r in listings.select_source_files(listing).collect()) == [f"{base}/B.JSON", f"{base}/a.jsonl"]
    folder = tmp_path.parent / "w"
    first = write(folder / "one.jsonl", json.dumps({"content": "line one"}))
    old = spark.createDataFrame(listings.read_listing(spark, [str(folder)]).collect())
    with open(first, "a", encoding="utf-8") as handle:
        handle.write("\n" + json.dumps({"content": "appended"}))
    write(folder / "two.jsonl", json.dumps({"content": "new file"}))
    new = listings.read_listing(spark, [str(folder)])
    diff = {r["path"].rsplit("/", 1)[1]: r["change"] for r in listings.snapshot_diff(old, new).collect()}
    assert diff == {"one.jsonl": "modified", "two.jsonl": "added"}
    if changed_files(old, new).isEmpty():
        pytest.skip("the scratch path itself matches a denied name")
    assert sources_changed(old, new) and not sources_changed(new, new)
    texts = [r["text"] for batch in incremental_turns(spark, old, new) for r in batch.collect()]
    assert sorted(texts) == ["appended", "line one", "new file"]


RAW = [
    ("fenced", 'x ```json\n{"keep": true, "kind": "idea", "confidence": 0.9, "tags": ["a", 1, null], "summary": null}\n``` y'),
    ("prefixed", 'well {"keep": 1, "kind": "zzz", "route": "OPS ", "confidence": 2, "tags": "x, ,y"} {"keep": false}'),
    ("nested", '{"a": {"keep": true, "confidence": "0.7"}'),
    ("digits", " 3333333333 "),
    ("none", "nothing"),
    ("noise", '{"confidence": 0.1, "noise": ["無", "N/A", "該丟掉的字 a", "real"], "keep": true, "reason": "weak", "tags": {}}'),
]


def test_signal_parsing(spark):
    df = spark.createDataFrame(RAW, "id string, raw string")
    rows = {r["id"]: r for r in normalise_signals(df, "raw").collect()}
    fenced = rows["fenced"]["signal"]
    assert (fenced["keep"], fenced["kind"], fenced["route"], fenced["tags"], fenced["summary"]) == (True, "idea", "idea", ["a", "1", "None"], "None")
    prefixed = rows["prefixed"]["signal"]
    assert (prefixed["keep"], prefixed["kind"], prefixed["route"], prefixed["confidence"], prefixed["tags"]) == (True, "note", "ops", 1.0, ["x", "y"])
    assert rows["nested"]["signal"]["confidence"] == 0.7 and rows["nested"]["signal"]["tags"] == ["uncategorized"]
    assert rows["digits"]["error"] == "degenerate model output" and rows["digits"]["signal"] is None
    assert rows["none"]["error"] is not None
    noise = rows["noise"]["signal"]
    assert (noise["keep"], noise["noise"], noise["reason"]) == (False, ["real"], "below min_confidence: weak")


def test_extractor_outcomes_and_policies(spark):
    df = spark.createDataFrame(
        [("1", "f", "s1", "user", "good text"), ("2", "f", "s2", "user", "bad text"), ("3", "f", "s3", "user", "dull maybe")],
        "id string, source_file string, source string, role string, text string",
    )

    def fn(text, role):
        if text.startswith("bad"):
            raise ValueError("broken")
        return {"keep": text.startswith("good"), "kind": "idea", "confidence": 0.8, "tags": ["t"], "summary": "S", "handoff": ""}

    extracted = extract(df, fn)
    got = {r["id"]: (r["outcome"], r["error"], r["atom_id"]) for r in outcomes(extracted).collect()}
    assert got == {"1": ("done", "", "1"), "2": ("error", "broken", None), "3": ("skipped", "extractor returned keep=false", None)}
    dropped = atoms_with_policy(extracted, "drop").collect()
    assert [(a["id"], a["summary"], a["importance"]) for a in dropped] == [("1", "S", round(0.25 + 0.8 * 0.55, 3))]
    assert dropped[0]["activation"] == min(0.65, max(0.08, dropped[0]["importance"] * 0.55))
    ruled = {a["id"]: a["kind"] for a in atoms_with_policy(extracted, "rules").collect()}
    assert ruled == {"1": "idea", "2": "note", "3": "idea"}


def test_eval_sheet_file(spark, tmp_path):
    from thoughtloom.operators.evaluation import score_eval
    from thoughtloom.operators.validation import validate_scout

    rows = [
        {"id": "1", "text": "one fragment", "prediction": {"keep": True, "route": "ops", "tags": ["x"]}, "human": {"keep": "yes", "route": "ops", "useful": 1, "signal_found": True, "handoff_sufficient": "y"}},
        {"id": "2", "text": "One  fragment", "prediction": {"keep": False, "tags": ["extractor-error"]}, "human": {"keep": True, "useful": True, "summary_quality": "2"}},
        {"id": "3", "text": "<command-name>", "prediction": {"keep": True}, "human": {"keep": False, "useful": "maybe", "noise": 0}},
        {"id": "4", "text": "four", "prediction": {"keep": True}, "human": {"keep": None, "route": ""}},
    ]
    path = write(tmp_path / "sheet.jsonl", "\n".join(json.dumps(r) for r in rows))
    sheet = sheets.read_eval_sheet(spark, path)
    score = score_eval(sheet).first().asDict()
    assert (score["total_cases"], score["scored_cases"]) == (4, 3)
    assert score["pass_rate"] == 1 / 3 and score["keep_agreement"] == 1 / 3
    assert score["route_agreement"] == 1.0 and score["avg_summary_quality"] == 2.0
    verdict = validate_scout(sheet).first()
    assert (verdict["duplicate_count"], verdict["tool_noise_retained_count"], verdict["parse_error_count"]) == (1, 1, 1)
    assert (verdict["false_negative_count"], verdict["false_positive_count"], verdict["verdict"]) == (1, 1, "needs_data")
    broken = write(tmp_path / "bad.jsonl", "{")
    with pytest.raises(Exception):
        sheets.read_eval_sheet(spark, broken).collect()


def test_clean_fragments_ids(spark):
    import hashlib

    df = spark.createDataFrame([("f", "src", "user", " some  clean text "), ("f", "s2", "user", "short")], "source_file string, source string, role string, text string")
    row = clean_fragments(df).collect()
    assert [r["id"] for r in row] == [hashlib.sha1(b"src\nsome clean text").hexdigest()[:16]]


def test_falsy_values_by_their_type(spark, tmp_path):
    """Text like "0" or "false" is a value; zero, false and empty text are not; true is the first second."""
    rows = [
        {"role": "false", "content": "a", "timestamp": "0", "create_time": 5},
        {"role": False, "author": "ann", "content": "b", "timestamp": 0, "create_time": 5},
        {"role": 0, "author": "bob", "content": "c", "timestamp": True},
        {"role": "", "author": "", "content": "d", "timestamp": False, "create_time": 0.0},
    ]
    path = write(tmp_path / "chat" / "a.jsonl", "\n".join(map(json.dumps, rows)))
    assert [t[1:] for t in turns(chat.read_chat(spark, lines=[path]))] == [
        ("false", "a", "0"),
        ("ann", "b", "1970-01-01T00:00:05+00:00"),
        ("bob", "c", "1970-01-01T00:00:01+00:00"),
        ("unknown", "d", "1970-01-01T00:00:00+00:00"),
    ]


def test_export_documents_hold_many_conversations(spark, tmp_path, monkeypatch):
    """Files follow the turns, not the conversations; each turn keeps its place in its own conversation."""
    monkeypatch.setattr(source_queries, "shared_dir", lambda _: str(tmp_path / "shared"))
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c}") for c in range(300) for t in range(c % 5 + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(source_queries, "EXPORT_TURNS", 250, raising=False)
    got = sorted((r["text"], r["role"], r["place"]) for r in source_queries.chat_export_scan(spark, str(tmp_path)).collect())
    expected = []
    for c in range(300):
        talk = sorted((r for r in rows if r[0] == c), key=lambda r: (-(r[1] // 2), r[1]))
        expected += [(text, role, place) for place, (_, _, role, text) in enumerate(talk)]
    assert got == sorted(expected)
    assert 1 < len(list((tmp_path / "shared").glob("export-*/part-*"))) <= 4
