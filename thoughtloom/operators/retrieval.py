"""Focus and latent retrieval for a batch of questions.

A latent score is a question-independent base plus a gain from shared words
and tags. Per question only two kinds of atoms can be returned: the best by
base (one list for all questions) and atoms sharing at least one word or tag
(an inverted-index equi-join), so questions are never crossed with atoms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtloom.functions import scoring, text
from thoughtloom.session import materialise

FOCUS_LIMIT = 8
RETRIEVAL_FOCUS_LIMIT = 6
LATENT_LIMIT = 12
ACTIVE_CEILING = 0.45
BRIDGE_GAIN = 1.2
#: Matches of atoms and questions that a task counts; keys of questions sent to all tasks at once.
PART_MATCHES, BLOCK_KEYS = 1 << 19, 1 << 20


def focus(atoms: DataFrame, k: int = FOCUS_LIMIT, tie: Sequence[str] = ("id",)) -> DataFrame:
    """The k warmest atoms (activation, importance, timestamp; then ``tie``)."""
    return atoms.orderBy(
        F.desc("activation"),
        F.desc("importance"),
        F.desc(F.coalesce("timestamp", F.lit(""))),
        *[F.asc(c) for c in tie],
    ).limit(k)


def bridge_boosts(edges: DataFrame, focus_ids: DataFrame) -> DataFrame:
    """(id, boost) of atoms bridged by feedback to the focus set, itself excluded."""
    feedback = edges.where(F.col("relation") == "inspire_feedback")
    gain = F.least(F.lit(1.0), F.col("weight")) * F.lit(BRIDGE_GAIN)
    ends = feedback.select(F.col("from_id").alias("near"), F.col("to_id").alias("id"), gain.alias("boost")).unionByName(
        feedback.select(F.col("to_id").alias("near"), F.col("from_id").alias("id"), gain.alias("boost"))
    )
    return (
        ends.join(focus_ids.select(F.col("id").alias("near")), "near", "left_semi")
        .join(focus_ids.select("id"), "id", "left_anti")
        .groupBy("id")
        .agg(F.max("boost").alias("boost"))
    )


def _pool(atoms: DataFrame, focus_ids: DataFrame, ceiling: float) -> DataFrame:
    """Cold atoms outside the focus; else any outside it; else everything."""
    marked = atoms.join(focus_ids.select("id", F.lit(True).alias("_focus")), "id", "left")
    level = (
        F.when(F.col("_focus").isNotNull(), F.lit(2))
        .when(F.col("activation") <= ceiling, F.lit(0))
        .otherwise(F.lit(1))
    )
    levelled = marked.withColumn("_level", level)
    return levelled.where(F.col("_level") <= levelled.select(F.min("_level")).scalar()).drop("_focus", "_level")


def _question_tags(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """(tag, question_id) where the folded tag is a substring of the question.

    Questions are expanded to their substrings of the tag lengths in use, so
    the substring test becomes an equi-join.
    """
    tags = pool.select(F.explode("tags").alias("tag")).distinct().withColumn("piece", text.casefold(F.col("tag")))
    folded = questions.select("question_id", text.casefold(F.col("question")).alias("q"))
    longest = folded.select(F.max(F.length("q"))).scalar()
    lengths = (
        tags.where((F.length("piece") > 0) & (F.length("piece") <= longest))
        .select(F.collect_set(F.length("piece")))
        .scalar()
    )
    pieces = (
        folded.withColumn("n", F.explode(lengths))
        .where(F.col("n") <= F.length("q"))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("q") - F.col("n") + 1)))
        .select("question_id", F.substring("q", F.col("at"), F.col("n")).alias("piece"))
        .distinct()
    )
    return tags.join(pieces, "piece").select("tag", "question_id")


def _asked_keys(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """(key, words, tag_hits, question_id, q_words): what an atom can share with a question.

    Keys are words, tags, and one of the best by base, which every question lists.
    """
    tokens = text.word_tokens(F.col("question"))
    sizes = questions.select("question_id", F.size(tokens).alias("q_words"))
    by_word = questions.select("question_id", F.size(tokens).alias("q_words"), F.explode(tokens).alias("token"))
    by_word = by_word.withColumn("key", F.concat(F.lit("w"), "token"))
    by_tag = _question_tags(pool, questions).join(sizes, "question_id").select("question_id", "q_words", F.concat(F.lit("t"), F.col("tag")).alias("key"))
    seeds = sizes.withColumn("key", F.lit("s"))

    def keyed(df: DataFrame, words: int, tags: int) -> DataFrame:
        return df.select("key", F.lit(words).alias("words"), F.lit(tags).alias("tag_hits"), "question_id", "q_words")

    return keyed(by_word, 1, 0).unionByName(keyed(by_tag, 0, 1)).unionByName(keyed(seeds, 0, 0))


def _atom_keys(pool: DataFrame, k: int, tie: Sequence[str]) -> DataFrame:
    """The pool's scored columns and the keys of each atom."""
    carried = ["id", "importance", "activation", "boost", *[c for c in tie if c != "id"]]
    seeds = []
    for score in (scoring.reliable_score, scoring.weird_score):
        base = score(F.col("importance"), F.col("activation"), F.lit(0.0)) + F.col("boost")
        best = pool.select(*carried).orderBy(base.desc(), *[F.asc(c) for c in tie]).limit(k)
        seeds.append(best.select(F.collect_list("id")).scalar())
    none = F.array().cast("array<string>")
    words = F.transform(text.word_tokens(F.concat_ws(" ", "summary", "text")), lambda w: F.concat(F.lit("w"), w))
    tags = F.transform("tags", lambda t: F.concat(F.lit("t"), t))
    seed = F.when(F.array_contains(F.concat(*seeds), F.col("id")), F.array(F.lit("s")))
    return pool.select(*carried, F.concat(*[F.coalesce(keys, none) for keys in (words, tags, seed)]).alias("keys"))


def _candidates(pool: DataFrame, questions: DataFrame, k: int, tie: Sequence[str]) -> DataFrame:
    """A row for each atom and question that share a key, with their numbers of words and tags.

    Atoms are dealt by id into as many parts as their matches with the questions fill, so
    a part's pairs are counted where it is and a task's memory doesn't follow the input.
    Keys of the questions meet all parts; blocks of questions bound what is sent to them.
    """
    atoms = materialise(_atom_keys(pool, k, tie))
    asked = materialise(_asked_keys(pool, questions))
    n_keys = asked.count()
    held = atoms.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("atoms"))
    matches = asked.groupBy("key").agg(F.count("*").alias("asked")).join(held, "key").agg(F.sum(F.col("asked") * F.col("atoms"))).first()[0] or 0
    blocks = max(1, -(-n_keys // BLOCK_KEYS))
    dealt = atoms.repartition(max(1, -(-matches // (PART_MATCHES * blocks))), "id")
    pairs = None
    for block in range(blocks):
        of_block = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block)
        by_key = of_block.groupBy("key", "words", "tag_hits").agg(F.collect_list(F.struct("question_id", "q_words")).alias("asked"))
        met = dealt.withColumn("key", F.explode("keys")).join(F.broadcast(by_key), "key").select("*", F.inline("asked"))
        # An atom's attributes depend on its id, so max() only carries them along.
        counted = met.groupBy("id", "question_id").agg(
            *[F.max(c).alias(c) for c in (*[c for c in atoms.columns if c not in ("id", "keys")], "q_words")],
            F.sum("words").alias("words"),
            F.sum("tag_hits").alias("tag_hits"),
        )
        pairs = counted if pairs is None else pairs.unionByName(counted)
    return pairs


def latent(
    atoms: DataFrame,
    questions: DataFrame,
    focus_ids: DataFrame,
    boosts: DataFrame,
    *,
    k: int = LATENT_LIMIT,
    ceiling: float = ACTIVE_CEILING,
    tie: Sequence[str] = ("id",),
) -> DataFrame:
    """(question_id, rank, id, reliable_rank, weird_rank): interleaved top-k per question.

    The words of both sides are written to the shared folder once.
    """
    pool = _pool(atoms, focus_ids, ceiling).join(boosts, "id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    scored = _candidates(pool, questions, k, tie)
    word_overlap = F.when(F.col("q_words") > 0, F.col("words") / F.col("q_words")).otherwise(F.lit(0.0))
    tag_overlap = F.when(F.col("tag_hits") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    scored = scored.withColumns(
        {
            "reliable": scoring.reliable_score(F.col("importance"), F.col("activation"), F.col("tag_hits").cast("double"))
            + F.col("boost"),
            "weird": scoring.weird_score(F.col("importance"), F.col("activation"), F.greatest(tag_overlap, word_overlap))
            + F.col("boost"),
        }
    )

    # Both rankings share one pass: each row is offered to either list, and the
    # rank filter is applied inside every map task before the shuffle.
    offers = scored.select(
        "question_id",
        "id",
        *[c for c in tie if c != "id"],
        F.inline(
            F.array(
                *[F.struct(F.lit(name).alias("ranking"), F.col(name).alias("score")) for name in ("reliable", "weird")]
            )
        ),
    )
    best = Window.partitionBy("question_id", "ranking").orderBy(F.desc("score"), *[F.asc(c) for c in tie])
    listed = offers.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    ranks = listed.groupBy("question_id", "id").agg(
        F.min(F.when(F.col("ranking") == "reliable", F.col("place"))).alias("reliable_rank"),
        F.min(F.when(F.col("ranking") == "weird", F.col("place"))).alias("weird_rank"),
    )
    turn = F.least(2 * F.col("reliable_rank") - 2, 2 * F.col("weird_rank") - 1)
    final = Window.partitionBy("question_id").orderBy(turn)
    return (
        ranks.withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("question_id", "rank", "id", "reliable_rank", "weird_rank")
    )


def _atom_line(atom: Column) -> Column:
    return F.concat(
        F.lit("* ["),
        atom["id"],
        F.lit("] "),
        atom["kind"],
        F.lit(", warmth "),
        F.format_string("%.2f", atom["activation"]),
        F.lit(", tags "),
        F.array_join(atom["tags"], "/"),
        F.lit(", from "),
        atom["source"],
        F.lit(": "),
        atom["summary"],
    )


def retrieval_requests(atoms: DataFrame, questions: DataFrame, focus_atoms: DataFrame, latent_ranks: DataFrame) -> DataFrame:
    """One request row per question for the caller's model, with the ids it may cite."""
    shown = F.struct("id", "kind", "activation", "tags", "source", "summary")
    # At most k rows, in the order of the focus whatever order they are read in.
    place = F.struct(
        (-F.col("activation")).alias("a"), (-F.col("importance")).alias("i"), F.col("id"), _atom_line(shown).alias("line")
    )
    warm = focus_atoms.select(F.sort_array(F.collect_list(place)).alias("rows")).select(
        F.col("rows.line").alias("lines"), F.col("rows.id").alias("ids")
    )
    cold = (
        latent_ranks.join(atoms, "id")
        .groupBy("question_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id"), _atom_line(shown).alias("line")))).alias("rows"))
        .select("question_id", F.col("rows.id").alias("latent_atom_ids"), F.col("rows.line").alias("lines"))
    )
    focus_lines = warm.select("lines").scalar()
    none = F.lit("(none)")

    def block(lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(none)

    request = F.concat(
        F.lit("Question:\n"),
        F.col("question"),
        F.lit("\n\nWarm memory:\n"),
        block(focus_lines),
        F.lit("\n\nCold memory worth another look:\n"),
        F.coalesce(block(F.col("lines")), none),
        F.lit(
            "\n\nPropose three concrete next moves. Start each with the lines\n"
            "suggestion_id: <number>\ncited_atom_ids: [<ids from above>]\n"
            "and explain the link to the cited memory."
        ),
    )
    return questions.join(cold, "question_id", "left").select(
        "question_id",
        "question",
        warm.select("ids").scalar().alias("focus_atom_ids"),
        F.coalesce("latent_atom_ids", F.array().cast("array<string>")).alias("latent_atom_ids"),
        request.alias("request"),
    )
