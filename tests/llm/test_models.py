import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from llm_words import WORD, lowered

from thoughtloom.llm import host_rules, kneser_ney, secret_scan
from thoughtloom.llm.catalog import QUERIES

END = "\n"


def tokens(text):
    return [*re.findall(WORD, lowered(text or "")), END]


class PlainModel:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            t = tokens(text)
            self.words.update(t)
            self.pairs.update(zip([END, *t], t))  # noqa: B905
        self.before = Counter(b for _, b in self.pairs)
        self.of_pairs, self.of_words = self.discounts(self.pairs), self.discounts(self.before)
        self.total, self.back = Counter(), Counter()
        for (a, _), n in self.pairs.items():
            self.total[a] += n
            self.back[a] += self.of_pairs[min(n, 3)]
        self.spare = sum(self.of_words[min(n, 3)] for n in self.before.values()) / len(self.pairs) if self.pairs else 1

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        return [0, *kneser_ney.discounts([n[k] for k in (1, 2, 3, 4)])]

    def own(self, w):
        n = self.before[w]
        return max(n - self.of_words[min(n, 3)], 0) / max(len(self.pairs), 1) + self.spare / (len(self.words) + 1)

    def chance(self, a, w):
        if not self.total[a]:
            return self.own(w)
        n = self.pairs[a, w]
        return max(n - self.of_pairs[min(n, 3)], 0) / self.total[a] + self.back[a] / self.total[a] * self.own(w)


def test_kneser_ney(spark, documents):
    folder, rows = documents
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    model = PlainModel([t for i, t in rows if not out(i)])
    n, v = sum(model.words.values()), len(model.words)
    got = sorted(QUERIES["op3_kneser_ney"](spark, folder).collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.n_tokens))
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0], len(tokens(x[1]))))
    assert len(got) == len(want)
    for r, (i, text) in zip(got, want, strict=True):
        t = tokens(text)
        assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (i, out(i), len(t), n)
        assert r.n_known == sum(w in model.words for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((model.words[w] + 1) / (n + v + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(model.chance(a, w)) for a, w in zip([END, *t], t)))  # noqa: B905
    # The probabilities after a word add up to one, the unknown word included.
    for a in [END, *list(model.words)[:5], "never seen"]:
        assert sum(model.chance(a, w) for w in [*model.words, "never seen"]) == pytest.approx(1)


def test_held_out_texts_are_better_than_by_counts_of_words(spark):
    rows = QUERIES["op3_kneser_ney"](spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = kneser_ney.train(docs.where("doc_id > 5"))
    assert sorted((r.doc_id, r.n_known, r.score) for r in kneser_ney.score(docs, model).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_host_rules(spark, documents):
    folder, rows = documents
    got = Counter(tuple(r)[:7] for r in QUERIES["op7_host_rules"](spark, folder).collect())
    want = Counter()
    for i, text in rows:
        w = re.findall(WORD, text or "")
        windows = list(zip(w, w[1:], w[2:]))  # noqa: B905
        times, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if times[x] > 1:
                covered |= {k, k + 1, k + 2}
        own = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), symbols, len(own) - len(set(own)), len(covered), failed)] += 1
    assert got == want


def test_hosts_are_judged_by_shrunk_rates(spark):
    """A bad host takes its good documents with it; one bad document of a small host doesn't."""
    rows = [("bad", k < 95) for k in range(100)] + [("small", True)] + [(f"good{h}", k == 0) for h in range(40) for k in range(50)]
    rows += [(None, True)] * 30
    found = {r.host: r.shrunk_rate for r in host_rules.rejected_hosts(spark.createDataFrame(rows, "host string, failed boolean"), 0.8).collect()}
    assert list(found) == ["bad"] and 0.8 < found["bad"] < 0.95
    every = {r.host: r.shrunk_rate for r in host_rules.rejected_hosts(spark.createDataFrame(rows, "host string, failed boolean"), -1).collect()}
    n = {h: [f for x, f in rows if x == h] for h in {x for x, _ in rows} - {None}}
    rates = [sum(f) / len(f) for f in n.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates) - m * (1 - m) * sum(1 / len(f) for f in n.values()) / len(n)
    weight = max(m * (1 - m) / v - 1, 0) if v > 0 else sum(map(len, n.values())) / len(n)
    for h, f in n.items():
        assert every[h] == pytest.approx((sum(f) + weight * m) / (len(f) + weight))


def test_bad_host_in_documents(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(k, good if k % 10 == 0 else "#x " * 80, "spam") for k in range(200)] + [(1000 + k, good, f"h{k % 4}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in host_rules.keep(docs).collect()} == set(range(1000, 1200))
    assert {r.doc_id for r in host_rules.judge(docs).where("kept").collect()} == set(range(1000, 1200))


@pytest.fixture(scope="module")
def forest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return secret_scan.forest_for(docs, 100)


def test_candidates_of_all_texts(spark, documents, forest):
    folder, rows = documents
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = Counter((r.doc_id, r.start, r.text) for r in secret_scan.scan(docs, forest).collect())
    want = Counter((i, m.start(), m.group()) for i, t in rows for m in re.finditer(r"[A-Za-z0-9+/_=\-]{16,}", t or ""))
    assert got == want


def test_unseen_findings_are_told_apart(spark, forest):
    """Held-out accuracy: other documents' words and digests than those of the training."""
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 500")
    examples = secret_scan.example_texts(held, 40).collect()
    frame = spark.createDataFrame([(k, r.text) for k, r in enumerate(examples)], "doc_id long, text string")
    found = {}
    for r in secret_scan.scan(frame, forest).collect():
        found[r.doc_id] = found.get(r.doc_id, False) or r.secret
    right = [found.get(k, False) == (r.label == 1) for k, r in enumerate(examples)]
    assert sum(right) > 0.93 * len(right)


def test_redaction_changes_secrets_alone(spark, forest):
    from pyspark.sql import functions as F

    key = hashlib.sha1(b"x").hexdigest()
    texts = [f'the key is token = "{key}" and so on token = "{key}".', "some_long_name_of_a_thing stays", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    text = F.col("text")
    out = docs.select("doc_id", secret_scan.redacted(text, secret_scan.findings(text, forest)).alias("text")).collect()
    assert [r.text for r in sorted(out)] == [texts[0].replace(key, secret_scan.REDACTED), *texts[1:]]


def test_forest_is_the_trees_of_the_model():
    lines = ["If (feature 3 <= 0.5)", " If (feature 0 <= 17.0)", "  Predict: 0.0", " Else (feature 0 > 17.0)", "  Predict: 1.0", "Else (feature 3 > 0.5)", " Predict: 0.0"]
    assert secret_scan.tree_of(lines) == (3, 0.5, (0, 17.0, 0.0, 1.0), 0.0)


def test_no_findings_no_secrets(spark):
    none = spark.createDataFrame([], "text string, label double")
    forest = secret_scan.train(none, secret_scan.Dictionary(()))
    docs = spark.createDataFrame([(1, "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff")], "doc_id long, text string")
    assert [(r.score, r.secret) for r in secret_scan.scan(docs, forest).collect()] == [(0.0, False)]


def test_nothing(spark, nothing):
    for name in ("op3_kneser_ney", "op4_secret_scan", "op7_host_rules"):
        assert QUERIES[name](spark, nothing).count() == 0
