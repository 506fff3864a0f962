import random
from pathlib import Path

import corpus_pipeline
from test_tokens import packed_rightly


def test_stages(spark, documents):
    folder, rows = documents
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns and out.schema["lines"].dataType.simpleString() == "string"
        path = f"{folder}/{name}.parquet"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        before[name] = docs.collect()
        assert all(r.text is None or r.n_chars == len(r.text) for r in before[name])
    kept = {r.doc_id for r in before["quality rules"]}
    assert 3001 in kept and not kept & {3002, 3003, 3005, 3008}
    # No line of what is left matches an earlier one exactly; clean lines stay.
    texts = [r.text for r in sorted(before["line dedup"], key=lambda r: (r.doc_id is not None, r.doc_id)) if r.doc_id is not None]
    lines = [x for t in texts for x in t.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    groups = [r.doc_id for r in before["simhash near-dedup"] if r.doc_id is not None]
    assert len(groups) == len(set(groups)) and set(groups) <= kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    packed_rightly(packed, [(r.doc_id, r.text) for r in before["secret scan"]])


def test_secrets_are_gone_and_near_copies_too(spark, tmp_path):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = [r.text for r in base.where("n_chars between 1500 and 4000").orderBy("doc_id").limit(30).collect()]
    words = clean[0].split(" ")
    rows = list(enumerate(clean)) + [(100, " ".join([*words[:50], "altered", *words[51:]])), (101, f'{clean[1][:-1]} token = "{secret}" end')]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert 0 in left and 100 not in left
    out = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    assert secret not in out[101] and all(out[k] == t for k, t in enumerate(clean) if "token = " not in t)


def test_no_documents(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_library_does_not_import_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent / "thoughtloom"
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "thoughtloom.llm" in p.read_text()]


def test_near_copies_are_those_of_five_word_shingles(spark):
    """Pairs from 0.7 to 0.99 and a large group, against plain sets."""
    r, texts = random.Random(3), []
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    for k in range(60):
        words = fresh(200)
        texts.append(words)
        changed = list(words)
        for at in r.sample(range(200), 1 + k % 7):
            changed[at] = "altered"
        texts.append(changed)
    hot = fresh(150)
    texts += [[*hot[:i], f"x{i}", *hot[i + 1 :]] for i in range(0, 150, 2)]
    rows = list(enumerate(" ".join(t) for t in texts)) + [(0, " ".join(fresh(60))), (7, " ".join(texts[6]).upper())]
    sets = [set(zip(*[t.lower().split()[i:] for i in range(5)])) for _, t in rows]  # noqa: B905
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    want = sorted(min(g) for g in groups.values())
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = [x.doc_id for x in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert None in got and sorted(x for x in got if x is not None) == want


def test_fingerprints_alone_link_close_copies(spark, monkeypatch):
    """With no key of minimum hashes, copies within the radius of SimHash still meet and are verified."""
    from thoughtloom.llm import near_copies, simhash

    def no_keys(batches):
        for batch in batches:
            yield batch.slice(0, 0).select(["name", "name", "size"]).rename_columns(["key", "name", "size"])

    monkeypatch.setattr(near_copies, "_keyed", no_keys)
    r, rows = random.Random(4), []
    for k in range(30):
        words = [f"w{r.randrange(10**6)}" for _ in range(600)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:300], "altered", *words[301:]]))]
    rows += [(100, "a b c d e f"), (101, "b a c d e f")]
    bits = lambda k: (simhash.fingerprint(rows[k][1], 5) ^ simhash.fingerprint(rows[k + 1][1], 5)).bit_count()
    close = [k for k in range(0, 60, 2) if bits(k) <= near_copies.RADIUS]
    assert len(close) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {k for k, _ in rows} - {k + 1 for k in close}
