import random
import re

import pytest
from pyspark.sql import functions as F

from thoughtloom.operators import activation as act
from thoughtloom.operators import feedback as fb
from thoughtloom.operators import queue as qu
from thoughtloom.operators import retrieval as rt
from thoughtloom.operators.fragments import cap_per_group, upsert
from thoughtloom.operators.suggestions import extract_suggestions


def test_touch_repeats_and_caps(spark):
    atoms = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "id string, activation double")
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("nobody",)], "id string")
    got = {r["id"]: r["activation"] for r in act.touch(atoms, ids, 0.2).collect()}
    assert got == {"a": 0.1 + 0.2 + 0.2, "b": 1.0, "c": 0.5}
    many = spark.range(500).select(F.lit("a").alias("id"))
    assert act.touch(atoms, many, 0.01).where("id = 'a'").first()["activation"] == 1.0


def test_decay_lifts_values_below_the_floor(spark):
    atoms = spark.createDataFrame([(0.01,), (0.5,)], "activation double")
    assert [r[0] for r in act.decay(atoms).collect()] == [0.05, 0.5 * 0.92]


def _history(n_hot):
    rng = random.Random(11)
    rows = []
    for i in range(n_hot + 300):
        key = "hot" if i < n_hot else f"k{i % 20}"
        rows.append((key, rng.randrange(40), i, rng.choice(["touch", "decay"]), rng.choice([0.05, 0.14, 0.2])))
    return rows


def _steps(df):
    return df.select(
        "key", "t", "n",
        F.when(F.col("op") == "touch", act.touch_map(F.col("x"))).otherwise(act.decay_map(F.lit(0.92), F.lit(0.05))).alias("step"),
    )


def _fold(rows, start):
    state = dict(start)
    for key, _, _, op, x in sorted(rows, key=lambda r: (r[1], r[2])):
        state[key] = min(1.0, state[key] + x) if op == "touch" else max(0.05, state[key] * 0.92)
    return state


def test_replay_equals_sequential_fold(spark):
    rows = _history(2000)
    start = {"hot": 0.3, **{f"k{i}": 0.02 * i for i in range(20)}, "quiet": 0.77}
    initial = spark.createDataFrame(list(start.items()), "key string, activation double")
    events = _steps(spark.createDataFrame(rows, "key string, t int, n int, op string, x double").repartition(5))
    got = {r["key"]: r["activation"] for r in act.replay(initial, events, ["t", "n"]).collect()}
    expected = _fold(rows, start)
    assert set(got) == set(expected)
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    assert got["quiet"] == 0.77


def test_upsert_keeps_maximum_and_last_row(spark):
    old = spark.createDataFrame([("a", "old", 0.9, 1, 1), ("z", "z", 0.1, 1, 1)], "id string, text string, activation double, created_at int, updated_at int")
    batch = spark.createDataFrame([("a", "one", 0.95, 1), ("a", "two", 0.2, 2), ("b", "new", 0.3, 3)], "id string, text string, activation double, seq int")
    got = {r["id"]: tuple(r)[1:] for r in upsert(old, batch, ["id"], order="seq", now=F.lit(5)).collect()}
    assert got == {"a": ("two", 0.95, 1, 5), "b": ("new", 0.3, 5, 5), "z": ("z", 0.1, 1, 1)}
    kept = upsert(old, batch, ["id"], order="seq", now=F.lit(5), precedence=F.col("old_text") == "old")
    assert {r["id"]: r["text"] for r in kept.collect()} == {"a": "old", "b": "new", "z": "z"}


def test_caps(spark):
    df = spark.createDataFrame([("f", 3), ("f", 1), ("g", 2), ("f", 2)], "file string, n int")
    assert sorted(map(tuple, cap_per_group(df, 2, [F.asc("n")], group="file").collect())) == [("f", 1), ("f", 2), ("g", 2)]
    assert [r["n"] for r in cap_per_group(df, 3, [F.asc("n")]).collect()] in ([1, 2, 2],)


def _interleave(pools, limit):
    result, index = [], 0
    while len(result) < limit and any(index < len(p) for p in pools):
        for pool in pools:
            if index < len(pool) and pool[index] not in result and len(result) < limit:
                result.append(pool[index])
        index += 1
    return result


def _brute_latent(atoms, question, focus, boosts, k, ceiling):
    pool = [a for a in atoms if a["activation"] <= ceiling and a["id"] not in focus]
    pool = pool or [a for a in atoms if a["id"] not in focus] or atoms
    q = question.casefold()
    qt = set(re.findall("[a-zA-Z0-9]{3,}", q))

    def reliable(a):
        return a["importance"] * 0.55 + (1.0 - min(1.0, a["activation"])) * 0.35 + sum(t.casefold() in q for t in a["tags"]) * 0.1 + boosts.get(a["id"], 0.0)

    def weird(a):
        words = set(re.findall("[a-zA-Z0-9]{3,}", f"{a['summary']} {a['text']}".casefold()))
        text = len(qt & words) / len(qt) if qt and words else 0.0
        tag = 1.0 if any(t.casefold() in q for t in a["tags"]) else 0.0
        return (1.0 - min(1.0, a["activation"])) * 0.55 + max(tag, text) * 0.3 + (1.0 - min(1.0, a["importance"])) * 0.15 + boosts.get(a["id"], 0.0)

    ordered = sorted(pool, key=lambda a: a["id"])
    return _interleave([[a["id"] for a in sorted(ordered, key=f, reverse=True)] for f in (reliable, weird)], k)


@pytest.mark.parametrize("low, high, focus", [(0.0, 1.0, ["a03", "a07"]), (0.5, 1.0, ["a01"]), (0.5, 1.0, None)])
def test_latent_equals_brute_force(spark, low, high, focus):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "go", "Ring", "x1y"]
    atoms = [
        {
            "id": f"a{i:02d}", "summary": rng.choice(words), "text": " ".join(rng.choices(words, k=4)),
            "tags": rng.choices(["ring", "RIN", "delta", "absent", "go"], k=rng.randrange(4)),
            "importance": rng.randrange(1, 20) / 20, "activation": low + (high - low) * rng.randrange(1, 20) / 20,
            "kind": "note", "source": "s", "timestamp": None,
        }
        for i in range(40)
    ]
    # Without a focus argument every atom is in focus: the last fallback.
    focus = focus if focus is not None else [a["id"] for a in atoms]
    boosts = {"a05": 0.36, "a09": 1.2}
    questions = {1: "What about the ring and delta?", 2: "nothing known", 3: "go", 4: ""}
    schema = "id string, summary string, text string, tags array<string>, importance double, activation double, kind string, source string, timestamp string"
    got = rt.latent(
        spark.createDataFrame(atoms, schema),
        spark.createDataFrame(list(questions.items()), "question_id int, question string"),
        spark.createDataFrame([(f,) for f in focus], "id string"),
        spark.createDataFrame(list(boosts.items()), "id string, boost double"),
        k=7,
    )
    lists = {}
    for r in got.orderBy("question_id", "rank").collect():
        lists.setdefault(r["question_id"], []).append(r["id"])
    assert lists == {i: _brute_latent(atoms, q, focus, boosts, 7, 0.45) for i, q in questions.items()}


def test_candidates_are_counted_in_bounded_parts(spark, monkeypatch):
    """Parts grow with the matches, none holds many more than its share, and blocks of questions change nothing."""
    atoms = spark.range(400).selectExpr(
        "format_string('a%03d', id) id", "'alpha beta' summary", "concat('gamma w', id % 7) text", "array('ring') tags",
        "id % 19 / 20D importance", "id % 23 / 24D activation",
    )
    questions = spark.range(12).selectExpr("id question_id", "concat('alpha gamma ring w', id % 5) question")
    none = spark.createDataFrame([], "id string")
    boosts = none.withColumn("boost", F.lit(0.0))
    whole = sorted(rt.latent(atoms, questions, none, boosts).collect())
    monkeypatch.setattr(rt, "PART_MATCHES", 600)
    monkeypatch.setattr(rt, "BLOCK_KEYS", 20)
    assert sorted(rt.latent(atoms, questions, none, boosts).collect()) == whole
    pairs = rt._candidates(atoms.withColumn("boost", F.lit(0.0)), questions, 12, ["id"])
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 * 12 and max(sizes) <= 600


def test_latent_limit_larger_than_pool(spark):
    schema = "id string, summary string, text string, tags array<string>, importance double, activation double"
    atoms = spark.createDataFrame([("a", "s", "t", ["x"], 0.5, 0.1), ("b", "s", "t", [], 0.4, 0.1)], schema)
    questions = spark.createDataFrame([(1, "x marks")], "question_id int, question string")
    none = spark.createDataFrame([], "id string")
    got = rt.latent(atoms, questions, none, none.withColumn("boost", F.lit(0.0)))
    assert sorted(r["id"] for r in got.collect()) == ["a", "b"]


def test_bridge_boosts_ignore_links_inside_focus(spark):
    rows = [("f1", "x", "inspire_feedback", 0.5), ("y", "f1", "inspire_feedback", 3.0), ("f1", "f2", "inspire_feedback", 0.9),
            ("f2", "x", "inspire_feedback", 0.7), ("f1", "z", "shared_tags:a", 0.9), ("p", "q", "inspire_feedback", 0.9)]
    edges = spark.createDataFrame(rows, "from_id string, to_id string, relation string, weight double")
    focus = spark.createDataFrame([("f1",), ("f2",)], "id string")
    assert {r["id"]: r["boost"] for r in rt.bridge_boosts(edges, focus).collect()} == {"x": 0.7 * 1.2, "y": 1.2}


FEEDBACK = "feedback_id int, run_id string, status string, atom_ids array<string>, note string, suggestion_id string, amount double"


def test_feedback_updates_edges_and_atoms(spark):
    rows = [
        (1, "r", " Useful", ["b", "a", "a"], "n1", None, None), (2, "r", "applied", ["a"], "", "s1", None),
        (3, "r", "wrong", ["a", "b"], "", None, None), (4, "r", "selected", ["c"], "", None, 0.9), (5, "r", "selected", ["a", "b"], "last", None, 0.0),
    ]
    suggestions = spark.createDataFrame([("r", "s1", ["b", "c"])], "run_id string, suggestion_id string, cited_atom_ids array<string>")
    resolved = fb.resolve_feedback(spark.createDataFrame(rows, FEEDBACK), suggestions)
    pairs = fb.feedback_pairs(resolved)
    assert sorted((r["feedback_id"], r["from_id"], r["to_id"]) for r in pairs.collect()) == [
        (1, "a", "b"), (2, "a", "b"), (2, "a", "c"), (2, "b", "c"),
    ]
    stored = spark.createDataFrame([("a", "c", "inspire_feedback", 0.9, 0.94)], "from_id string, to_id string, relation string, weight double, confidence double")
    merged = {(r["from_id"], r["to_id"]): r for r in fb.merge_feedback_edges(stored, pairs, "feedback_id").collect()}
    assert merged[("a", "b")]["weight"] == pytest.approx(0.46)
    assert merged[("a", "b")]["confidence"] == pytest.approx(0.73 + 0.83 * 0.25)
    assert merged[("a", "b")]["evidence"]["feedback_id"] == "2"
    assert (merged[("a", "c")]["weight"], merged[("a", "c")]["confidence"]) == (1.0, 0.95)
    assert merged[("b", "c")]["confidence"] == 0.83
    atoms = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.3), ("d", 0.2)], "id string, activation double")
    got = {r["id"]: r["activation"] for r in fb.touch_by_feedback(atoms, resolved).collect()}
    assert got == pytest.approx({"a": 0.96, "b": 0.56, "c": 1.0, "d": 0.2})


@pytest.mark.parametrize("row", [(1, "r", "great", ["a"], "", None, None), (1, "r", "useful", [], "", None, None), (1, "r", "useful", [], "", "nope", None)])
def test_bad_feedback_fails(spark, row):
    suggestions = spark.createDataFrame([], "run_id string, suggestion_id string, cited_atom_ids array<string>")
    with pytest.raises(Exception):
        fb.resolve_feedback(spark.createDataFrame([row], FEEDBACK), suggestions).collect()


def test_latest_run_compares_seconds_first(spark):
    runs = spark.sql("""SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:05.900', 1), ('b', timestamp'2024-01-01 00:00:05.100', 2),
        ('c', timestamp'2024-01-01 00:00:04', 3) AS t(id, created_at, seq)""")
    assert fb.latest_run(runs).first()["id"] == "b"


def test_queue_ignores_known_and_repeated_ids(spark):
    fragments = spark.createDataFrame(
        [("1", "f", "s", "user", "first", None, 1), ("1", "f", "s", "user", "second", None, 2), ("2", "f", "s", "user", "x", None, 3)],
        "id string, source_file string, source string, role string, text string, timestamp string, scan_order int",
    )
    now = F.to_timestamp(F.lit("2024-01-01"))
    empty = spark.createDataFrame([], "id string")
    first = qu.new_entries(empty, fragments, now, "scan_order")
    assert {r["id"]: r["text"] for r in first.collect()} == {"1": "first", "2": "x"}
    assert qu.new_entries(first, fragments, now, "scan_order").isEmpty()


def test_suggestions(spark):
    answer = (
        "intro\nsuggestion_id: 1\ncited_atom_ids:\ncited_atom_ids: [b2, a1.x, a1]\nbody  \n\n\n"
        "Suggestion_Id: two\ncited_atom_ids: zzz\n  suggestion_id:3\ntext, no citation\nsuggestion_id: 4 extra\nsuggestion_id: 5\ncited_atom_ids: 'a1' `b2`"
    )
    runs = spark.createDataFrame([(7, answer, ["a1"], ["b2", "c3"])], "run_id int, output_text string, focus_atom_ids array<string>, latent_atom_ids array<string>")
    got = [(r["suggestion_id"], r["cited_atom_ids"], r["text"]) for r in extract_suggestions(runs).orderBy("position").collect()]
    assert got[0] == ("1", ["b2", "a1"], "suggestion_id: 1\ncited_atom_ids:\ncited_atom_ids: [b2, a1.x, a1]\nbody")
    assert [(s, ids) for s, ids, _ in got[1:]] == [("5", ["a1", "b2"])]
    loose = [(r["suggestion_id"], r["cited_atom_ids"]) for r in extract_suggestions(runs, known_ids=False).orderBy("position").collect()]
    assert loose == [("1", ["b2", "a1.x", "a1"]), ("two", ["zzz"]), ("5", ["a1", "b2"])]
