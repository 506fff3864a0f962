"""Edges, graph view, components, notes, documents and their validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from thoughtloom.catalog.common import CONV_CTES, DOC_CTES, conversation_atoms, document_atoms, query, sql_fold, sql_id, sql_round
from thoughtloom.operators import components as comp
from thoughtloom.operators import edges as eg
from thoughtloom.operators import notes as nt
from thoughtloom.operators.feedback import RELATION
from thoughtloom.operators.retrieval import focus
from thoughtloom.operators.validation import combined_verdict, dangling_sources, validate_notes
from thoughtloom.session import materialise, shared_dir
from thoughtloom.sources.listings import manifest_diff, read_listing

_WEIGHT = "least(1e0, len(shared)::DOUBLE / sqrt(greatest(ln, 1)::DOUBLE * greatest(rn, 1)))"


def _pairs(atoms: str) -> str:
    return f"""t AS (SELECT id, list_sort(list_distinct(tags)) AS tags FROM {atoms}),
pairs AS (SELECT a.id AS from_id, b.id AS to_id, len(a.tags) AS ln, len(b.tags) AS rn,
    list_sort(list_intersect(a.tags, b.tags)) AS shared
  FROM t a JOIN t b ON a.id < b.id WHERE len(list_intersect(a.tags, b.tags)) > 0),
e AS (SELECT *, 'shared_tags:' || array_to_string(shared, ',') AS relation, {sql_round(_WEIGHT)} AS weight,
    {sql_round(f"least(0.95e0, 0.45e0 + {_WEIGHT} * 0.4e0)")} AS confidence
  FROM pairs WHERE shared <> ['uncategorized'])"""


def _edge_counts_sql(minimum: int) -> str:
    return f"""WITH {CONV_CTES}, {_pairs('conv_atoms')}
SELECT relation, least(ln, rn)::INTEGER AS low_size, greatest(ln, rn)::INTEGER AS high_size, weight, confidence,
  count(*)::DECIMAL(38,0) AS edges
FROM e WHERE len(shared) >= {minimum} GROUP BY 1, 2, 3, 4, 5"""


@query("edge_counts", _edge_counts_sql(1))
def edge_counts(spark, sf_dir):
    return eg.edge_counts(conversation_atoms(spark, sf_dir))


@query("edge_counts_two_shared", _edge_counts_sql(2))
def edge_counts_two_shared(spark, sf_dir):
    return eg.edge_counts(conversation_atoms(spark, sf_dir), min_shared=2)


_TOP = "top AS (SELECT * FROM conv_atoms ORDER BY activation DESC, importance DESC, id LIMIT 160)"


@query("focus_top_k", f"WITH {CONV_CTES} SELECT id, activation, importance FROM conv_atoms ORDER BY activation DESC, importance DESC, id LIMIT 8")
def focus_top_k(spark, sf_dir):
    return focus(conversation_atoms(spark, sf_dir)).select("id", "activation", "importance")


@query(
    "graph_nodes",
    f"""WITH {CONV_CTES}, {_TOP}
SELECT id, kind, array_to_string(tags, ',') AS tags, importance, activation,
  CASE WHEN activation >= 0.55e0 THEN 'focus' WHEN activation <= 0.35e0 THEN 'latent' ELSE 'active' END AS state FROM top""",
)
def graph_nodes(spark, sf_dir):
    return eg.graph_nodes(conversation_atoms(spark, sf_dir)).select(
        "id", "kind", F.array_join("tags", ",").alias("tags"), "importance", "activation", "state"
    )


def turn_bridges(atoms):
    """Feedback edges between the first two turns of every conversation."""
    first = atoms.where(F.col("turn") == 0).select("conv_id", F.col("id").alias("a"))
    second = atoms.where(F.col("turn") == 1).select("conv_id", F.col("id").alias("b"))
    return first.join(second, "conv_id").select(
        F.least("a", "b").alias("from_id"),
        F.greatest("a", "b").alias("to_id"),
        F.lit(RELATION).alias("relation"),
        ((F.col("conv_id") % 10) / F.lit(8.0)).alias("weight"),
        F.lit(0.9).alias("confidence"),
        F.struct(F.lit(RELATION).alias("type"), F.lit("useful").alias("status")).alias("evidence"),
    )


SQL_BRIDGES = """bridges AS (SELECT least(a.id, b.id) AS from_id, greatest(a.id, b.id) AS to_id,
  (a.conv_id % 10) / 8e0 AS weight FROM conv_atoms a JOIN conv_atoms b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1)"""

_GRAPH_EDGES = f"""{_TOP}, {SQL_BRIDGES}, {_pairs('top')},
ge AS (SELECT from_id, to_id, relation, 'shared_tags' AS type, weight, confidence, '' AS status FROM e
  UNION ALL SELECT from_id, to_id, 'inspire_feedback', 'inspire_feedback', weight, 0.9e0, 'useful' FROM bridges
  WHERE from_id IN (SELECT id FROM top) AND to_id IN (SELECT id FROM top))"""


def _graph(spark, sf_dir):
    atoms = materialise(conversation_atoms(spark, sf_dir))
    nodes = materialise(eg.graph_nodes(atoms))
    return nodes, eg.graph_edges(nodes, turn_bridges(atoms))


@query("graph_edges", f"WITH {CONV_CTES}, {_GRAPH_EDGES} SELECT * FROM ge")
def graph_edges(spark, sf_dir):
    _, edges = _graph(spark, sf_dir)
    return edges.select("from_id", "to_id", "relation", "type", "weight", "confidence", "status")


@query(
    "graph_stats",
    f"""WITH {CONV_CTES}, {_GRAPH_EDGES}
SELECT count(*) AS nodes, (SELECT count(*) FROM ge) AS edges, count(*) FILTER (WHERE activation >= 0.55e0) AS focus,
  count(*) FILTER (WHERE activation <= 0.35e0) AS latent FROM top""",
)
def graph_stats(spark, sf_dir):
    return eg.graph_stats(*_graph(spark, sf_dir))


# K4 on the whole table, edges kept factored: stale kinds of shared edges go, bridges stay.
@query(
    "edges_replaced",
    f"""WITH {CONV_CTES}, {SQL_BRIDGES}, {_pairs('conv_atoms')}
SELECT relation, weight, confidence, count(*)::DECIMAL(38,0) AS edges FROM e GROUP BY 1, 2, 3
UNION ALL SELECT 'inspire_feedback', weight, 0.9e0, count(*)::DECIMAL(38,0) FROM bridges GROUP BY 2""",
)
def edges_replaced(spark, sf_dir):
    atoms = materialise(conversation_atoms(spark, sf_dir))
    kinds = ("relation", "weight", "confidence")
    total = F.sum("edges").cast("decimal(38,0)").alias("edges")
    stored = turn_bridges(atoms).withColumn("edges", F.lit(1)).groupBy(*kinds).agg(total)
    stale = stored.withColumn("relation", F.lit("shared_tags:old"))
    fresh = eg.edge_counts(atoms).groupBy(*kinds).agg(total)
    return eg.replace_shared_edges(stored.unionByName(stale), fresh)


_COMPONENTS = """g AS (SELECT *, CASE WHEN len(list_filter(tags, lambda t: t <> 'uncategorized')) > 0
    THEN list_sort(list_distinct(list_filter(tags, lambda t: t <> 'uncategorized'))) ELSE [kind] END AS gt FROM doc_atoms),
link AS (SELECT DISTINCT gt[1] AS x, unnest(gt) AS y FROM g),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
r AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x),
comp AS (SELECT x AS tag, min(y) AS component FROM r GROUP BY x)"""

_ANCHORS = """freq AS (SELECT tag, count(*) AS n FROM (SELECT unnest(gt) AS tag FROM g) GROUP BY tag),
anchors AS (SELECT component, tag AS anchor, n AS anchor_atoms FROM (
  SELECT c.component, f.tag, f.n, row_number() OVER (PARTITION BY c.component ORDER BY f.n DESC, f.tag) AS k
  FROM freq f JOIN comp c USING (tag)) WHERE k = 1)"""


@query("tag_components", f"WITH RECURSIVE {DOC_CTES}, {_COMPONENTS} SELECT tag, component FROM comp")
def tag_components(spark, sf_dir):
    return comp.tag_components(document_atoms(spark, sf_dir))


@query(
    "component_anchor",
    f"WITH RECURSIVE {DOC_CTES}, {_COMPONENTS}, {_ANCHORS} SELECT component, anchor, anchor_atoms FROM anchors",
)
def component_anchor(spark, sf_dir):
    atoms = document_atoms(spark, sf_dir)
    return comp.component_anchor(atoms, comp.tag_components(atoms))


_FIRST = "list_filter(list_distinct(list_transform({x}, lambda s: trim(s))), lambda s: s <> '')"

_NOTES = f"""{_COMPONENTS}, {_ANCHORS},
m AS (SELECT g.*, c.component, CASE WHEN kind = 'objection' THEN 'friction' WHEN kind IN ('decision', 'question')
    THEN 'decision' ELSE 'concept' END AS atype FROM g JOIN comp c ON c.tag = g.gt[1]),
pts AS (SELECT component, s, min(struct_pack(a := -activation, i := -importance, id := id)) AS o FROM
    (SELECT *, trim(summary) AS s FROM m) WHERE s <> '' GROUP BY 1, 2),
qs AS (SELECT component, s, min(struct_pack(a := -activation, i := -importance, id := id)) AS o FROM
    (SELECT *, trim(summary) AS s FROM m WHERE kind = 'question') WHERE s <> '' GROUP BY 1, 2),
kp AS (SELECT component, list(s ORDER BY o)[1:5] AS key_points FROM pts GROUP BY 1),
oq AS (SELECT component, list(s ORDER BY o)[1:5] AS open_questions FROM qs GROUP BY 1),
tg AS (SELECT component, list_sort(list(DISTINCT t)) AS tags FROM (SELECT component, unnest(tags) AS t FROM m) GROUP BY 1),
h AS (SELECT component, count(*) AS atom_count,
    CASE WHEN bool_or(atype = 'friction') THEN 'friction_note' WHEN bool_or(atype = 'concept') THEN 'concept_note'
      ELSE 'decision_note' END AS note_type,
    {sql_round("sum(activation::DECIMAL(24,12))::DOUBLE / count(*)")} AS activation,
    sum(('0x' || substr(md5(id), 1, 15))::BIGINT) AS id_sum_0, sum(('0x' || substr(md5(id), 16, 15))::BIGINT) AS id_sum_1,
    list(id ORDER BY activation DESC, importance DESC, id) AS ids,
    list(source ORDER BY activation DESC, importance DESC, id) AS spans
  FROM m GROUP BY component HAVING count(*) >= 2),
notes AS (SELECT {sql_id('note_type', 'anchor', 'atom_count', 'id_sum_0', 'id_sum_1')} AS id,
    CASE note_type WHEN 'concept_note' THEN 'Concept note' WHEN 'decision_note' THEN 'Decision note'
      ELSE 'Friction note' END || ': ' || anchor AS title,
    note_type,
    CASE WHEN key_points IS NULL THEN 'No stable summary yet.' ELSE array_to_string(key_points[1:3], '; ') ||
      CASE WHEN open_questions IS NOT NULL THEN ' Open question: ' || open_questions[1] ELSE '' END END AS summary,
    coalesce(key_points, []) AS key_points, coalesce(open_questions, []) AS open_questions, tags, ids, spans,
    h.activation, atom_count, anchor
  FROM h JOIN anchors USING (component) JOIN tg USING (component) LEFT JOIN kp USING (component) LEFT JOIN oq USING (component))"""


@query(
    "digest_notes",
    f"""WITH RECURSIVE {DOC_CTES}, {_NOTES}
SELECT id, title, note_type, summary, array_to_string(key_points, '|') AS key_points,
  array_to_string(open_questions, '|') AS open_questions, array_to_string(tags, ',') AS tags,
  array_to_string(ids, ',') AS source_atom_ids, array_to_string(spans, ',') AS source_spans, activation, atom_count FROM notes""",
)
def digest_notes(spark, sf_dir):
    tables = nt.build_notes(document_atoms(spark, sf_dir))
    notes = nt.with_lists(
        tables.headers,
        tags=nt.joined_lists(tables.ranked_tags, "tag"),
        source_atom_ids=nt.joined_lists(tables.sources, "atom_id"),
        source_spans=nt.joined_lists(tables.spans, "source"),
    )
    return notes.select(
        "id", "title", "note_type", "summary",
        F.array_join("key_points", "|").alias("key_points"), F.array_join("open_questions", "|").alias("open_questions"),
        "tags", "source_atom_ids", "source_spans", "activation", "atom_count",
    )


@query(
    "note_sources",
    f"""WITH RECURSIVE {DOC_CTES}, {_NOTES}, x AS (SELECT id AS note_id, unnest(ids) AS atom_id, unnest(range(1, len(ids) + 1)) AS rank FROM notes)
SELECT note_id, rank, atom_id, source FROM x JOIN doc_atoms a ON a.id = x.atom_id""",
)
def note_sources(spark, sf_dir):
    return nt.build_notes(document_atoms(spark, sf_dir)).sources.select("note_id", "rank", "atom_id", "source")


@query(
    "note_spans",
    f"""WITH RECURSIVE {DOC_CTES}, {_NOTES},
x AS (SELECT id AS note_id, unnest(spans) AS source, unnest(range(1, len(spans) + 1)) AS i FROM notes),
firsts AS (SELECT note_id, source, min(i) AS i FROM x GROUP BY 1, 2)
SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY i) AS rank, source FROM firsts""",
)
def note_spans(spark, sf_dir):
    return nt.build_notes(document_atoms(spark, sf_dir)).spans.select("note_id", "rank", "source")


@query("note_tags", f"WITH RECURSIVE {DOC_CTES}, {_NOTES} SELECT id AS note_id, unnest(tags) AS tag FROM notes")
def note_tags(spark, sf_dir):
    return nt.build_notes(document_atoms(spark, sf_dir)).tags.select("note_id", "tag")


# A listed note goes by the digest of its atoms in their order; its title leads to the other tables.
@query(
    "notes_listing",
    f"""WITH RECURSIVE {DOC_CTES}, {_NOTES}
SELECT {sql_id('note_type', 'anchor', "array_to_string(ids, chr(10))")} AS id, title, activation
FROM notes ORDER BY activation DESC, title LIMIT 50""",
)
def notes_listing(spark, sf_dir):
    tables = nt.build_notes(document_atoms(spark, sf_dir))
    listed = nt.with_ordered_ids(materialise(nt.list_notes(tables.headers, 50)), tables.members)
    return nt.list_notes(listed).select(F.col("ordered_id").alias("id"), "title", "activation")


def _lines(items: str, render: str, empty: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN array_to_string(list_transform({items}, lambda x: {render}), chr(10)) ELSE '{empty}' END"


_QUOTED = "'  - \"' || x || '\"'"
_N = " || chr(10) || "
_DOCUMENT = _N.join(
    [
        "'---'", "'note_id: \"' || id || '\"'", "'type: \"' || note_type || '\"'",
        "'state: \"' || CASE WHEN activation >= 0.65e0 THEN 'focus' WHEN activation <= 0.25e0 THEN 'latent' ELSE 'active' END || '\"'",
        "'activation: ' || format('{:.2f}', activation)", "'tags:'", _lines("tags", _QUOTED, "  []"),
        "'source_atoms:'", _lines("ids", _QUOTED, "  []"), "'source_spans:'", _lines("spans", _QUOTED, "  []"),
        "'---'", "''", "'# ' || title", "''", "'## Summary'", "''", "summary", "''", "'## Key Points'", "''",
        _lines("key_points", "'- ' || x", "- (none)")
        + " || CASE WHEN len(open_questions) > 0 THEN chr(10) || chr(10) || '## Open Questions' || chr(10) || chr(10) || "
        + _lines("open_questions", "'- ' || x", "- (none)") + " ELSE '' END",
        "''", "'## Sources'", "''", "'### Source Atoms'", "''", _lines("ids", "'- `' || x || '`'", "- `(none)`"),
        "''", "'### Source Spans'", "''", _lines("spans", "'- `' || x || '`'", "- `(none)`"), "''",
    ]
)
_PATH = (
    "'Digested Notes/' || trim(left(trim(regexp_replace(" + sql_fold("title") + ", '[^a-zA-Z0-9]+', '-', 'g'), '-'), 72), '-')"
    " || '-' || left(id, 7) || '.md'"
)


@query(
    "note_documents",
    f"""WITH RECURSIVE {DOC_CTES}, {_NOTES}, d AS (SELECT id, {_PATH} AS path, string_split({_DOCUMENT}, chr(10)) AS lines FROM notes)
SELECT id, path, unnest(range(1, len(lines))) AS line_no, unnest(lines[1 : -2]) AS line FROM d""",
)
def note_documents(spark, sf_dir):
    return nt.note_documents(nt.build_notes(document_atoms(spark, sf_dir)))


_EXPORTED = "2024-02-01 00:00:00"


def _manifest(spark, sf_dir):
    tables = nt.build_notes(document_atoms(spark, sf_dir))
    exported = F.lit(_EXPORTED).cast("timestamp")
    return nt.note_manifest(tables.headers, nt.note_documents(tables), exported), tables.sources


@query(
    "note_manifest",
    f"""WITH RECURSIVE {DOC_CTES}, {_NOTES}
SELECT id, title, note_type AS type, activation, {_PATH} AS path, array_to_string(ids, ',') AS source_atom_ids, atom_count,
  strlen({_DOCUMENT})::BIGINT AS size FROM notes""",
)
def note_manifest(spark, sf_dir):
    manifest, sources = _manifest(spark, sf_dir)
    listed = nt.with_lists(manifest, source_atom_ids=nt.joined_lists(sources, "atom_id"))
    return listed.select("id", "title", "type", "activation", "path", "source_atom_ids", "atom_count", "size")


# The documents are written and listed. Then notes whose id starts with 0-3 grow, 4-7
# become newer and 8-9 vanish; the others stay as they were written.
@query(
    "manifest_sync",
    f"""WITH RECURSIVE {DOC_CTES}, {_NOTES}, touched AS (SELECT * FROM notes WHERE left(id, 1) < '8')
SELECT 'note' AS target, id FROM touched
UNION ALL SELECT DISTINCT 'atom', unnest(ids) FROM touched""",
)
def manifest_sync(spark, sf_dir):
    tables = nt.build_notes(document_atoms(spark, sf_dir))
    documents = materialise(nt.note_documents(tables))
    folder = f"{shared_dir(spark)}/notes-{uuid.uuid4().hex}"
    nt.write_documents(documents, folder)
    written = materialise(nt.written_documents(read_listing(spark, [folder])))
    manifest = nt.note_manifest(tables.headers, documents, written=written)
    listing = manifest.select("id", "path", "size", "modified").where(~F.left("id", F.lit(1)).isin("8", "9"))
    head = F.left("id", F.lit(1))
    later = F.when((head >= "4") & (head < "8"), F.col("modified") + F.expr("interval 1 hour")).otherwise(F.col("modified"))
    edited = listing.select("path", (F.col("size") + F.when(head < "4", 1).otherwise(0)).alias("size"), later.alias("modified"))
    note_ids, atom_ids = manifest_diff(manifest, edited, tables.sources)
    return note_ids.select(F.lit("note").alias("target"), "id").unionByName(
        atom_ids.select(F.lit("atom").alias("target"), "id")
    )


# The checked atom table has lost the atoms of every seventh document, so some
# notes cite atoms it does not hold.
_NOTE_CHECK = f"""{_NOTES}, src AS (SELECT id AS note_id, unnest(ids) AS atom_id FROM notes),
dang AS (SELECT note_id, atom_id FROM src WHERE atom_id NOT IN (SELECT id FROM doc_atoms WHERE NOT (doc_id % 7 = 3)))"""


@query("dangling_sources", f"WITH RECURSIVE {DOC_CTES}, {_NOTE_CHECK} SELECT * FROM dang")
def dangling_sources_query(spark, sf_dir):
    atoms = document_atoms(spark, sf_dir)
    return dangling_sources(nt.build_notes(atoms).sources, atoms.where(~(F.col("doc_id") % 7 == 3)))


@query(
    "notes_validation",
    f"""WITH RECURSIVE {DOC_CTES}, {_NOTE_CHECK},
c AS (SELECT (SELECT count(*) FROM doc_atoms WHERE NOT (doc_id % 7 = 3)) AS atoms_count, count(*) AS notes_count,
  count(*) FILTER (WHERE len(ids) > 0) AS notes_with_sources,
  count(*) FILTER (WHERE summary = '' AND len(key_points) = 0) AS empty_note_count,
  (SELECT count(DISTINCT note_id) FROM dang) AS missing_source_note_count,
  (count(*) - count(DISTINCT lower(title)))::BIGINT AS duplicate_title_count FROM notes)
SELECT atoms_count, notes_count, notes_with_sources, round(notes_with_sources / notes_count::DOUBLE, 4) AS notes_with_sources_rate,
  empty_note_count, round(empty_note_count / notes_count::DOUBLE, 4) AS empty_note_rate,
  missing_source_note_count, round(missing_source_note_count / notes_count::DOUBLE, 4) AS missing_source_note_rate,
  duplicate_title_count, round(duplicate_title_count / notes_count::DOUBLE, 4) AS duplicate_title_rate,
  CASE WHEN missing_source_note_count = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM c""",
)
def notes_validation(spark, sf_dir):
    atoms = document_atoms(spark, sf_dir)
    tables = nt.build_notes(atoms)
    notes, sources = tables.headers, tables.sources
    return validate_notes(notes, sources, atoms.where(~(F.col("doc_id") % 7 == 3)))


@query("combined_verdict", f"WITH RECURSIVE {DOC_CTES}, {_NOTE_CHECK} SELECT CASE WHEN (SELECT count(*) FROM dang) > 0 THEN 'fail' ELSE 'pass' END AS verdict, 2::BIGINT AS sections")
def combined_verdict_query(spark, sf_dir):
    # Read by the notes and both checks: the texts are cleaned and labelled once.
    columns = ["id", "doc_id", "source", "summary", "kind", "tags", "importance", "activation"]
    atoms = materialise(document_atoms(spark, sf_dir).select(*columns))
    tables = nt.build_notes(atoms)
    notes, sources = tables.headers, tables.sources
    whole = validate_notes(notes, sources, atoms)
    partial = validate_notes(notes, sources, atoms.where(~(F.col("doc_id") % 7 == 3)))
    return combined_verdict(whole, partial)
