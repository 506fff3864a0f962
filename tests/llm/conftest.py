import random

import pytest

#: Columns that operators use inside; inputs may have them too.
CLASHING = ("piece", "n_words", "length", "kept", "fp", "shard", "lines", "host", "row", "gone", "rank", "score", "__first")


def corpus(n=60, seed=5):
    """(doc_id, text) with copies, near copies, shared passages, repeated lines and awkward texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(400)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k)).capitalize()
    passage, common = line(30), line(6)
    out = []
    for i in range(n):
        lines = [line(r.randint(1, 40)) for _ in range(r.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(0, f"x{i} {passage} y{i}")
        if i % 3 == 0:
            lines.append(common)
        out.append((i * 3, "\n".join(lines)))
    for i in range(0, n, 5):  # exact copies, and copies with one word changed
        text = out[i][1]
        out.append((1000 + i, text))
        changed = text.split(" ")
        changed[len(changed) // 2] = "changed"
        out.append((2000 + i, " ".join(changed)))
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    out += [
        (3000, f'{line(20)} token = "{secret}" {line(5)}'), (3001, f"{line(60)}\nsome_long_name_of_a_thing {line(3)}"),
        (3002, ""), (3003, None), (3004, " \n\t \n"), (3005, "one"), (3006, "one two"), (3007, "ÄÖ  ß x y\r\nz 中文 😀"),
        (3008, "ab " * 3000), (3009, "a" * 20_000), (3010, f"{secret} {secret}"), (None, out[0][1]), (None, None),
        (3011, "<|endoftext|> a|b # c"), (3011, "<|endoftext|> a|b # c"), (3012, "the same\nthe same\nThe Same"),
    ]
    for k in range(6):  # long near copies, larger id first for some
        long = [r.choice(words) for _ in range(1500)]
        out.append((4000 + 10 * k, " ".join(long)))
        long[700 + k] = "altered"
        out.append((4001 + 10 * k if k % 2 else 3999 - k, " ".join(long)))
    return out


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Folder of tables whose documents are the corpus, with extra columns; and the corpus."""
    rows = corpus()
    folder = tmp_path_factory.mktemp("llm")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    table = [(i, t, None, None if k % 11 == 0 else f"s{k % 3}", len(t or ""), *CLASHING) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(table, schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """Folder of empty tables."""
    folder = tmp_path_factory.mktemp("none")
    for name, schema in {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "pages": "page_id long, url string, html string",
        "labels": "doc_id long, quality int, toxic int",
        "embeddings": "vec_id long, embedding array<float>, label int",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
