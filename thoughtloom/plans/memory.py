"""End-to-end jobs: import, digest, refresh, queue runs, retrieval, feedback.

A memory is a set of DataFrames. Jobs take the current versions and return the
next ones; where they are stored (parquet folders, a table format) is the
caller's choice. No job keeps state of its own, and ``now`` is an argument.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.operators import activation, edges, feedback, queue, retrieval, runs
from thoughtloom.operators.changes import change_feed, changed_rows, content_digests
from thoughtloom.operators.dedupe import DEFAULT_THRESHOLD, near_duplicate_filter
from thoughtloom.operators.extraction import atoms_with_policy, extract, outcomes
from thoughtloom.operators.fragments import cap_per_group, clean_fragments, rules_atoms, table_counts, upsert
from thoughtloom.operators.notes import NoteTables, build_notes, note_documents, note_manifest, write_documents, written_documents
from thoughtloom.operators.suggestions import extract_suggestions
from thoughtloom.schemas import ATOM
from thoughtloom.session import materialise
from thoughtloom.sources.listings import manifest_diff, read_listing
from thoughtloom.sources.transcripts import split_transcripts, transcript_order

_ATOM_COLUMNS = [part.split()[0] for part in ATOM.split(", ")]
Extractor = Callable[[str, str], Mapping]


@dataclass(frozen=True)
class Memory:
    """Current versions of the memory tables."""

    atoms: DataFrame
    edge_counts: DataFrame | None = None
    feedback_edges: DataFrame | None = None
    notes: DataFrame | None = None
    note_tables: NoteTables | None = None
    runs: DataFrame | None = None
    usage: DataFrame | None = None

    @property
    def note_sources(self) -> DataFrame | None:
        """All atoms of all notes, in order."""
        return self.note_tables.sources if self.note_tables else None


def _label(fragments: DataFrame, extractor: Extractor | None, on_reject: str, rules: Mapping) -> DataFrame:
    if extractor is None:
        return rules_atoms(fragments, **rules)
    return atoms_with_policy(materialise(extract(fragments, extractor)), on_reject, **rules)


def _merged(atoms: DataFrame, batch: DataFrame, order: str, now: Column, precedence: str) -> DataFrame:
    """Upsert; ``precedence='model'`` keeps model-built content over rule-built rows."""
    keep = None
    if precedence == "model":
        keep = F.col("old_metadata")["extractor"].isNotNull() & F.col("_new.metadata")["extractor"].isNull()
    return upsert(atoms, batch.select(*_ATOM_COLUMNS, order), ["id"], order=order, now=now, precedence=keep)


def ingest(
    memory: Memory,
    turns: DataFrame,
    now: Column,
    *,
    min_chars: int = 12,
    max_turns_per_file: int | None = None,
    extractor: Extractor | None = None,
    precedence: str = "last",
    **rules,
) -> Memory:
    """Turns of chat files -> atoms; rejected or failing fragments are dropped."""
    capped = cap_per_group(turns, max_turns_per_file, [F.asc("scan_order")], group="source_file")
    batch = _label(clean_fragments(capped, min_chars=min_chars), extractor, "drop", rules)
    return replace(memory, atoms=_merged(memory.atoms, batch, "scan_order", now, precedence))


def transcript_fragments(
    transcripts: DataFrame, source_file: str, *, min_chars: int = 12, max_turns: int | None = None
) -> DataFrame:
    """Joined transcripts -> cleaned fragments with ``scan_order``."""
    turns = split_transcripts(transcripts).withColumns(
        {"scan_order": transcript_order(), "source_file": F.lit(source_file)}
    )
    return clean_fragments(cap_per_group(turns, max_turns, [F.asc("scan_order")]), min_chars=min_chars)


def import_transcripts(
    memory: Memory,
    transcripts: DataFrame,
    source_file: str,
    now: Column,
    *,
    min_chars: int = 12,
    max_atoms: int | None = None,
    extractor: Extractor | None = None,
    **rules,
) -> Memory:
    """Transcripts -> atoms; fragments a model rejects fall back to the rules."""
    fragments = transcript_fragments(transcripts, source_file, min_chars=min_chars)
    fragments = cap_per_group(fragments, max_atoms, [F.asc("scan_order")])
    context = F.create_map(
        F.lit("source_file"), F.col("source_file"),
        F.lit("source_system"), F.lit("transcript"),
        F.lit("session_id"), F.col("session_id"),
        F.lit("project"), F.col("project"),
        F.lit("platform"), F.col("platform"),
        F.lit("message_count"), F.col("message_count").cast("string"),
    )
    batch = _label(fragments, extractor, "rules", rules)
    batch = batch.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: k != "source_file"), context))
    return replace(memory, atoms=_merged(memory.atoms, batch, "scan_order", now, "last"))


def incremental_transcripts(
    memory: Memory,
    transcripts: DataFrame,
    source_file: str,
    now: Column,
    seen: DataFrame | None = None,
    **options,
) -> tuple[Memory, DataFrame, DataFrame]:
    """(memory, changes, seen) after importing only the sessions that changed.

    ``seen`` is what the last run returned for the version it read, a digest per session;
    without it everything is new, as on a forced tick. A changed session is imported as a
    whole, so its atoms are upserted like those of a full import; those of other sessions
    are left alone, and removed sessions keep theirs. Store the memory before ``seen``: a
    run lost between the two is repeated with the same rows. Changes are empty where
    nothing has to be rebuilt. ``options`` are those of ``import_transcripts``, but for
    ``max_atoms``, which is a place in the whole scan.
    """
    if options.get("max_atoms") is not None:
        raise ValueError("max_atoms counts over all sessions and can't be kept in an incremental import")
    current = materialise(content_digests(transcripts, ["session_id"]))
    feed = materialise(change_feed(current.limit(0) if seen is None else seen, current, ["session_id"]))
    if feed.where(F.col("change") != "removed").isEmpty():
        return memory, feed, current
    fresh = changed_rows(transcripts, feed, ["session_id"])
    return import_transcripts(memory, fresh, source_file, now, **options), feed, current


def digest(memory: Memory, *, min_atoms: int = 2, max_points: int = 5) -> Memory:
    """Rebuild the notes from the atoms (replaces the note tables)."""
    tables = build_notes(memory.atoms, min_atoms=min_atoms, max_points=max_points)
    return replace(memory, notes=tables.headers, note_tables=tables)


def refresh(memory: Memory, *, min_shared_tags: int = 1, min_atoms: int = 2, max_points: int = 5) -> Memory:
    """Rebuild everything derived from the atoms: edge kinds and notes.

    Transcript imports use ``min_atoms=1``.
    """
    rebuilt = replace(memory, edge_counts=edges.edge_counts(memory.atoms, min_shared_tags))
    return digest(rebuilt, min_atoms=min_atoms, max_points=max_points)


def refresh_summary(before: Memory, after: Memory) -> DataFrame:
    """(table_name, n): atoms before and after, notes, and listed edge total."""
    counts = table_counts(atoms_before=before.atoms, atoms_after=after.atoms, notes=after.notes)
    total = after.edge_counts.agg(F.coalesce(F.sum("edges"), F.lit(0)).cast("bigint").alias("n"))
    return counts.unionByName(total.select(F.lit("edges").alias("table_name"), "n"))


def export_notes(memory: Memory, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, manifest) of the current notes, written below ``folder``.

    The documents are written, then listed, so the manifest holds the sizes and times
    that a later listing finds; ``sync_notes`` touches nothing until one changes.
    """
    documents = materialise(note_documents(memory.note_tables))
    write_documents(documents, folder)
    written = written_documents(read_listing(documents.sparkSession, [folder]))
    return documents, materialise(note_manifest(memory.notes, documents, written=written))


def export_graph(memory: Memory, limit: int = 160) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stats) of the warmest part of the graph."""
    nodes = materialise(edges.graph_nodes(memory.atoms, limit))
    listed = edges.graph_edges(nodes, memory.feedback_edges)
    return nodes, listed, edges.graph_stats(nodes, listed)


def sync_notes(memory: Memory, manifest: DataFrame, folder: str, amount: float = activation.EDIT_TOUCH) -> Memory:
    """Warm up the notes edited below ``folder`` since the export, and their atoms."""
    listing = written_documents(read_listing(manifest.sparkSession, [folder]))
    note_ids, atom_ids = manifest_diff(manifest, listing, memory.note_sources)
    return replace(
        memory,
        notes=activation.touch(memory.notes, note_ids, amount),
        atoms=activation.touch(memory.atoms, atom_ids, amount),
    )


def build_queue(
    table: DataFrame,
    collectors: Mapping[str, DataFrame],
    now: Column,
    *,
    dedupe: bool = True,
    conservative: bool = True,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Next queue version: filtered fragments of every collector, queued once.

    Duplicate filters work inside one collector, so ``scan_order`` is made
    unique by the collector name.
    """
    columns = ["id", "source_file", "source", "role", "text", "timestamp"]
    offered = queue.union_collectors(
        **{
            name: df.select(*columns, F.struct(F.lit(name).alias("collector"), "scan_order").alias("order_key"))
            for name, df in collectors.items()
        }
    )
    kept = near_duplicate_filter(
        offered, "text", "order_key", threshold, scope="collector", dedupe=dedupe, conservative=conservative
    ).where("keep")
    return queue.enqueue(table, kept, now, order="order_key")


def run_queue(
    table: DataFrame,
    memory: Memory,
    now: Column,
    *,
    n: int = 10,
    extractor: Extractor | None = None,
    **rules,
) -> tuple[DataFrame, Memory, DataFrame]:
    """(queue, memory, summary) after processing the next ``n`` pending rows.

    The batch is written once, so its outcome and its atoms cannot disagree.
    """
    batch = queue.queue_next(table, n)
    if extractor is None:
        done = materialise(batch)
        atoms = rules_atoms(done, **rules)
        results = done.select("id", F.lit("done").alias("outcome"), F.lit("").alias("error"), F.col("id").alias("atom_id"))
    else:
        extracted = materialise(extract(batch, extractor))
        atoms = atoms_with_policy(extracted, "drop")
        results = outcomes(extracted)
    marks = F.create_map(F.lit("queue_id"), F.col("id"), F.lit("queue_status"), F.lit("done"))
    stamped = atoms.withColumn("metadata", F.map_concat("metadata", marks)).withColumn("_seq", F.lit(0))
    merged = upsert(memory.atoms, stamped.select(*_ATOM_COLUMNS, "_seq"), ["id"], order="_seq", now=now)
    return queue.record_outcomes(table, results, now), replace(memory, atoms=merged), queue.run_summary(results)


def retrieve(
    memory: Memory,
    questions: DataFrame,
    *,
    focus_limit: int = retrieval.RETRIEVAL_FOCUS_LIMIT,
    latent_limit: int = retrieval.LATENT_LIMIT,
    tie: Sequence[str] = ("id",),
) -> DataFrame:
    """One request per question with the focus and latent ids it may cite."""
    warm = materialise(retrieval.focus(memory.atoms, focus_limit, tie))
    boosts = (
        retrieval.bridge_boosts(memory.feedback_edges, warm)
        if memory.feedback_edges is not None
        else warm.select("id", F.lit(0.0).alias("boost")).limit(0)
    )
    cold = retrieval.latent(memory.atoms, questions, warm, boosts, k=latent_limit, tie=tie)
    return retrieval.retrieval_requests(memory.atoms, questions, warm, cold)


def record_runs(memory: Memory, answered: DataFrame, now: Column) -> tuple[Memory, DataFrame]:
    """(memory, suggestions) after answered runs.

    The memory's runs and usage events get a row each. Atoms shown to a run - its focus
    and first three latent ones - are touched; suggestions are the answer's blocks that
    cite ids the run had seen. Recording a run again appends nothing.
    """
    rows = materialise(runs.run_rows(answered, now))
    shown = answered.select(F.explode(F.concat("focus_atom_ids", F.slice("latent_atom_ids", 1, 3))).alias("id"))
    recorded = replace(
        memory,
        atoms=activation.touch(memory.atoms, shown, activation.RETRIEVAL_TOUCH),
        runs=runs.append_new(memory.runs, rows),
        usage=runs.append_new(memory.usage, runs.run_events(rows, now)),
    )
    return recorded, extract_suggestions(answered.withColumn("run_id", runs.run_id(answered)))


def apply_feedback(memory: Memory, rows: DataFrame, now: Column, suggestions: DataFrame | None = None) -> tuple[Memory, DataFrame]:
    """(memory, resolved feedback) after a batch of feedback rows.

    Positive feedback warms the cited atoms and strengthens bridges between
    them; the other statuses are only recorded. Each row is a usage event and the last
    update of its run. A row that cites an unknown atom or run is an error.
    """
    resolved = materialise(feedback.resolve_feedback(rows, suggestions))
    if not feedback.unknown_citations(resolved, memory.atoms).isEmpty():
        raise ValueError("feedback cites an unknown atom")
    if not resolved.isEmpty() and (memory.runs is None or not runs.unknown_runs(resolved, memory.runs).isEmpty()):
        raise ValueError("feedback on an unknown run")
    merged = feedback.merge_feedback_edges(
        memory.feedback_edges, feedback.feedback_pairs(resolved), "feedback_id"
    )
    return (
        replace(
            memory,
            atoms=feedback.touch_by_feedback(memory.atoms, resolved),
            feedback_edges=merged,
            runs=runs.touch_runs(memory.runs, resolved, now) if memory.runs is not None else None,
            usage=runs.append_new(memory.usage, runs.feedback_events(resolved, now)),
        ),
        resolved,
    )
