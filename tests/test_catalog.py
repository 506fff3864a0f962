"""Registered queries on tables laid out as the driver lays out larger ones."""

import pytest

from thoughtloom.catalog import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """Writer of a table as a folder of several files."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_streamed_tables_may_be_folders(spark, tables):
    turns = [(k // 3, k % 3, "user", f"a turn of some length {k}") for k in range(12)]
    path = tables("conversations", turns, "conv_id long, turn int, role string, text string")
    want = {r["id"] for r in QUERIES["fragments_clean"](spark, path).collect()}
    got = QUERIES["stream_queue"](spark, path).collect()
    assert len(got) == 12 and {r["id"] for r in got} == want


def _documents(tables):
    text = "Eine Notiz mit genug Text für ein Atom, Nummer"
    rows = [(k, f"{text} {k}", "en", "file", 50) for k in range(0, 1200, 2)]
    return tables("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_notes_list_their_sources(spark, tables):
    path = _documents(tables)
    listed = {r["id"]: r for r in QUERIES["digest_notes"](spark, path).collect()}
    sources = {}
    for r in sorted(QUERIES["note_sources"](spark, path).collect(), key=lambda r: (r["note_id"], r["rank"])):
        sources.setdefault(r["note_id"], []).append((r["atom_id"], r["source"]))
    assert listed and listed.keys() == sources.keys()
    manifest = {r["id"]: r["source_atom_ids"] for r in QUERIES["note_manifest"](spark, path).collect()}
    assert manifest == {note: row["source_atom_ids"] for note, row in listed.items()}
    for note, row in listed.items():
        ids, spans = (",".join(x) for x in zip(*sources[note], strict=True))
        assert (row["source_atom_ids"], row["source_spans"]) == (ids, spans) and row["tags"]
