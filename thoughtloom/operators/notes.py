"""Notes: one per tag component, plus documents and the export manifest.

A component may hold a third of all atoms, so a note of any size has one shape: a
bounded header (every field a combinable aggregate or a pre-pruned top-k), and long
tables of its atoms and source labels in order of activation, and of its tags. Its id
digests the set of its atoms, in any order. A document is a long table of lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtloom.functions import scoring, text
from thoughtloom.functions.rounding import round_half_even
from thoughtloom.functions.rules import DECISION_KINDS, FRICTION_KINDS, FRICTION_TAGS, NOTE_TITLES
from thoughtloom.operators.components import component_anchor, tag_components, with_component
from thoughtloom.operators.ranking import ranked
from thoughtloom.session import materialise

# Wording of exported notes, which must match what readers of the export expect.
NOTES_FOLDER = "Digested Notes"
NO_SUMMARY = "No stable summary yet."
FIRST_QUESTION = " Open question: "
HEADINGS = {
    "summary": "## Summary", "points": "## Key Points", "questions": "## Open Questions",
    "sources": "## Sources", "atoms": "### Source Atoms", "spans": "### Source Spans",
}


def note_type(kind: Column, tags: Column) -> Column:
    structural = F.arrays_overlap(tags, F.array(*[F.lit(tag) for tag in FRICTION_TAGS]))
    return (
        F.when(kind.isin(*FRICTION_KINDS) | F.coalesce(structural, F.lit(False)), F.lit("friction_note"))
        .when(kind.isin(*DECISION_KINDS), F.lit("decision_note"))
        .otherwise(F.lit("concept_note"))
    )


def _atom_order() -> Column:
    return F.struct((-F.col("activation")).alias("a"), (-F.col("importance")).alias("i"), F.col("id").alias("id"))


def _first_summaries(members: DataFrame, k: int, name: str) -> DataFrame:
    """First k distinct summaries per component without gathering the component."""
    distinct = (
        members.select("component", text.strip(F.col("summary")).alias("point"), _atom_order().alias("place"))
        .where(F.col("point") != "")
        .groupBy("component", "point")
        .agg(F.min("place").alias("place"))
    )
    rank = F.row_number().over(Window.partitionBy("component").orderBy("place"))
    return (
        distinct.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .groupBy("component")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "point"))).alias("ranked"))
        .select("component", F.col("ranked.point").alias(name))
    )


@dataclass(frozen=True)
class NoteTables:
    """Notes of one build. ``headers`` has a row a note; the long tables are made when they are asked for."""

    headers: DataFrame
    members: DataFrame

    def _of_notes(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.headers.select("component", F.col("id").alias("note_id")), "component").drop("component")

    @cached_property
    def sources(self) -> DataFrame:
        """(note_id, rank, atom_id, source, activation, importance): all atoms of all notes, warmest first."""
        order = [F.desc("activation"), F.desc("importance"), F.asc("atom_id")]
        rows = self.members.select("component", F.col("id").alias("atom_id"), "source", "activation", "importance")
        return ranked(self._of_notes(rows), ["note_id"], order)

    @cached_property
    def spans(self) -> DataFrame:
        """(note_id, rank, source): distinct source labels in the order of their first atoms."""
        labels = self.members.select("component", text.strip(F.col("source")).alias("source"), _atom_order().alias("place"))
        firsts = labels.where(F.col("source") != "").groupBy("component", "source").agg(F.min("place").alias("place"))
        order = [F.asc("place.a"), F.asc("place.i"), F.asc("place.id"), F.asc("source")]
        return ranked(self._of_notes(firsts), ["note_id"], order).drop("place")

    @cached_property
    def ranked_tags(self) -> DataFrame:
        """(note_id, rank, tag): the tags in their order."""
        return ranked(self.tags, ["note_id"], [F.asc("tag")])

    @cached_property
    def tags(self) -> DataFrame:
        """(note_id, tag): distinct tags of each note."""
        return self._of_notes(self.members.select("component", F.explode("tags").alias("tag")).distinct())


#: Items of a long table that are joined to one string at a time.
_JOINED = 4096


def joined_lists(rows: DataFrame, item: str, mark: str = ",") -> DataFrame:
    """(note_id, items): the items of (note_id, rank) rows as one string, in order of rank.

    Stretches of ``_JOINED`` items are joined first, so the task that makes a note's string
    holds its stretches, not its rows.
    """

    def chained(grouped, place: str, of: str, name: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(place, of)))
        return grouped.agg(F.array_join(ordered[of], mark).alias(name))

    stretch = F.floor((F.col("rank") - 1) / F.lit(_JOINED)).alias("_stretch")
    stretches = chained(rows.groupBy("note_id", stretch), "rank", item, "_joined")
    return chained(stretches.groupBy("note_id"), "_stretch", "_joined", "items")


def with_lists(notes: DataFrame, **lists: DataFrame) -> DataFrame:
    """``notes`` with a string column per list of ``joined_lists``; empty where a note has no items."""
    for name, items in lists.items():
        notes = notes.join(items.select(F.col("note_id").alias("id"), F.col("items").alias(name)), "id", "left")
    return notes.withColumns({name: F.coalesce(name, F.lit("")) for name in lists})


def with_ordered_ids(notes: DataFrame, members: DataFrame) -> DataFrame:
    """``notes`` with ``ordered_id``: the digest of type, anchor and all atom ids, warmest first.

    Only the atoms of these notes are ranked; their ids are one string a note, as in ``joined_lists``.
    """
    tables = NoteTables(notes, members.join(notes.select("component"), "component", "left_semi"))
    listed = with_lists(notes, _ids=joined_lists(tables.sources, "atom_id", "\n"))
    return listed.withColumn("ordered_id", text.short_id(F.col("note_type"), F.col("anchor"), F.col("_ids"))).drop("_ids")


def build_notes(
    atoms: DataFrame, *, min_atoms: int = 2, max_points: int = 5, components: DataFrame | None = None
) -> NoteTables:
    """Notes of every component with at least ``min_atoms`` atoms."""
    # Several branches read the members, so their labels are computed only once.
    narrow = materialise(atoms.select("id", "source", "summary", "kind", "tags", "importance", "activation"))
    if components is None:
        components = tag_components(narrow)
    members = materialise(with_component(narrow, components))
    typed = members.withColumn("atom_type", note_type(F.col("kind"), F.col("tags")))
    headers = (
        typed.groupBy("component")
        .agg(
            F.count("*").alias("atom_count"),
            F.bool_or(F.col("atom_type") == "friction_note").alias("any_friction"),
            F.bool_or(F.col("atom_type") == "concept_note").alias("any_concept"),
            F.sum(F.col("activation").cast("decimal(24,12)")).alias("activation_sum"),
            *[s.alias(f"id_sum_{k}") for k, s in enumerate(text.set_digest(F.col("id")))],
        )
        .where(F.col("atom_count") >= min_atoms)
        .join(component_anchor(narrow, components).select("component", "anchor"), "component")
        .withColumn(
            "note_type",
            F.when(F.col("any_friction"), F.lit("friction_note"))
            .when(F.col("any_concept"), F.lit("concept_note"))
            .otherwise(F.lit("decision_note")),
        )
        .withColumn(
            "activation",
            round_half_even(F.col("activation_sum").cast("double") / F.col("atom_count"), 3),
        )
    )
    title_prefix = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for pair in NOTE_TITLES.items() for x in pair]), F.col("note_type")),
        F.lit("Digested note"),
    )
    empty = F.array().cast("array<string>")
    counted = [F.col(c).cast("string") for c in ("atom_count", "id_sum_0", "id_sum_1")]
    notes = (
        headers.join(_first_summaries(members, max_points, "key_points"), "component", "left")
        .join(
            _first_summaries(members.where(F.col("kind") == "question"), max_points, "open_questions"),
            "component",
            "left",
        )
        .withColumns(
            {
                "key_points": F.coalesce("key_points", empty),
                "open_questions": F.coalesce("open_questions", empty),
            }
        )
        .select(
            text.short_id(F.col("note_type"), F.col("anchor"), *counted).alias("id"),
            F.concat(title_prefix, F.lit(": "), F.col("anchor")).alias("title"),
            "note_type",
            F.when(F.size("key_points") == 0, F.lit(NO_SUMMARY))
            .otherwise(
                F.concat(
                    F.array_join(F.slice("key_points", 1, 3), "; "),
                    F.when(
                        F.size("open_questions") > 0,
                        F.concat(F.lit(FIRST_QUESTION), F.element_at("open_questions", 1)),
                    ).otherwise(F.lit("")),
                )
            )
            .alias("summary"),
            "key_points",
            "open_questions",
            "activation",
            "atom_count",
            "anchor",
            "component",
        )
    )
    return NoteTables(materialise(notes), members)


def list_notes(notes: DataFrame, limit: int | None = None) -> DataFrame:
    """Warmest notes first; the sort is for presentation only."""
    keys = [F.desc("activation")]
    if "updated_at" in notes.columns:
        keys.append(F.desc("updated_at"))
    ordered = notes.orderBy(*keys, F.asc("title"))
    return ordered if limit is None else ordered.limit(limit)


def _escaped(item: Column) -> Column:
    return F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _quoted(item: Column) -> Column:
    return F.concat(F.lit('  - "'), _escaped(item), F.lit('"'))


def _code(item: Column) -> Column:
    return F.concat(F.lit("- `"), item, F.lit("`"))


def _bullets(items: Column) -> Column:
    none = F.array(F.lit("- (none)"))
    return F.when(F.size(items) > 0, F.transform(items, lambda x: F.concat(F.lit("- "), x))).otherwise(none)


def _fixed_lines() -> dict[int, Column]:
    """Lines of a document's header and body by section; the long tables fill the sections between."""
    field = lambda name, value: F.concat(F.lit(f'{name}: "'), value, F.lit('"'))
    head = F.array(
        F.lit("---"), field("note_id", _escaped(F.col("id"))), field("type", _escaped(F.col("note_type"))),
        field("state", scoring.activation_state(F.col("activation"), scoring.NOTE_STATE)),
        F.concat(F.lit("activation: "), F.format_string("%.2f", round_half_even(F.col("activation"), 2))), F.lit("tags:"),
    )
    literal = lambda *lines: F.array(*[F.lit(x) for x in lines])
    questions = F.concat(literal("", HEADINGS["questions"], ""), _bullets(F.col("open_questions")))
    body = F.concat(
        F.array(F.lit("---"), F.lit(""), F.concat(F.lit("# "), F.col("title")), F.lit(""), F.lit(HEADINGS["summary"]), F.lit(""), F.col("summary")),
        literal("", HEADINGS["points"], ""), _bullets(F.col("key_points")),
        F.when(F.size("open_questions") > 0, questions).otherwise(F.array().cast("array<string>")),
        literal("", HEADINGS["sources"], "", HEADINGS["atoms"], ""),
    )
    return {1: head, 3: literal("source_atoms:"), 5: literal("source_spans:"), 7: body, 9: literal("", HEADINGS["spans"], "")}


def note_documents(tables: NoteTables) -> DataFrame:
    """(id, path, line_no, line): the lines of each note's Markdown document, front matter first.

    A document is its lines, each ended by a line feed. Lines of atoms, labels and tags
    come from the long tables, so a document may have any length.
    """
    notes = tables.headers

    def long(rows: DataFrame, section: int, place: Column, line: Column) -> DataFrame:
        return rows.select(F.col("note_id").alias("id"), F.lit(section).alias("section"), place.alias("place"), line.alias("line"))

    def without(rows: DataFrame, section: int, line: str) -> DataFrame:
        """A line for each note that ``rows`` has nothing of."""
        left = notes.select(F.col("id").alias("note_id")).join(rows.select("note_id").distinct(), "note_id", "left_anti")
        return long(left, section, F.struct(F.lit(0).cast("long"), F.lit("")), F.lit(line))

    ordered = F.struct(F.col("rank"), F.lit(""))
    sections = F.array(*[F.struct(F.lit(k).alias("section"), lines.alias("lines")) for k, lines in _fixed_lines().items()])
    fixed = notes.select("id", F.explode(sections).alias("s")).select("id", "s.section", F.posexplode("s.lines").alias("n", "line"))
    fixed = fixed.select("id", "section", F.struct(F.col("n").cast("long"), F.lit("")).alias("place"), "line")
    atom, source, tag = F.col("atom_id"), F.col("source"), F.col("tag")
    parts = [
        long(tables.tags, 2, F.struct(F.lit(0).cast("long"), tag), _quoted(tag)),
        long(tables.sources, 4, ordered, _quoted(atom)),
        long(tables.spans, 6, ordered, _quoted(source)),
        long(tables.sources, 8, ordered, _code(atom)),
        long(tables.spans, 10, ordered, _code(source)),
        without(tables.tags, 2, "  []"), without(tables.spans, 6, "  []"), without(tables.spans, 10, "- `(none)`"),
    ]
    lines = fixed
    for part in parts:
        lines = lines.union(part)
    numbered = ranked(lines, ["id"], [F.asc("section"), F.asc("place")], "line_no")
    path = F.concat(F.lit(NOTES_FOLDER + "/"), text.note_file_name(F.col("title"), F.col("id")))
    return numbered.join(notes.select("id", path.alias("path")), "id").select("id", "path", "line_no", "line")


def write_documents(documents: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Write documents as text: a folder per note path, whose files in name order are the document.

    Lines are dealt by range of (path, line), so a note of many lines is several files.
    """
    keys = [F.asc("path"), F.asc("line_no")]
    dealt = documents.repartitionByRange(partitions, *keys) if partitions else documents.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).select("path", "line").write.mode("overwrite").partitionBy("path").text(folder)


def written_documents(listing: DataFrame) -> DataFrame:
    """(path, size, modified) of exported documents from the listing of their folder."""
    encoded = F.regexp_extract("path", r"/path=([^/]+)/[^/]+$", 1)
    # Folder names hold the path percent-encoded, and a listing may encode it once more.
    decoded = F.url_decode(F.replace(F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), F.lit("+"), F.lit("%2B")))
    files = listing.select(decoded.alias("path"), "size", "modified").where(F.col("path") != "")
    return files.groupBy("path").agg(F.sum("size").alias("size"), F.max("modified").alias("modified"))


def note_manifest(notes: DataFrame, documents: DataFrame, exported_at: Column | None = None, written: DataFrame | None = None) -> DataFrame:
    """One manifest row per exported note; its sources are the long source table.

    Sizes and times are those of the ``written`` documents (of ``written_documents``), so
    that a later listing meets them; without, the size of the lines and ``exported_at``.
    """
    sizes = documents.groupBy("id", "path").agg(F.sum(F.octet_length("line") + 1).cast("bigint").alias("size"))
    if written is not None:
        sizes = sizes.drop("size").join(written, "path")
    else:
        sizes = sizes.withColumn("modified", exported_at)
    return notes.join(sizes, "id").select(
        "id", "title", F.col("note_type").alias("type"), "activation", "path", "atom_count", "modified", "size"
    )
