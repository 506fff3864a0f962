"""Transcript tables: chats joined to sessions, raw text split into turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.functions.text import strip

# Fixed value: speaker marker at the start of a line.
MARKER_PATTERN = r"(?mdU)^\[(User|Assistant)\]:\s*"
_CUT, _ROLE_END = "\u0001", "\u0002"


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def join_transcripts(chats: DataFrame, sessions: DataFrame, project: str | None = None) -> DataFrame:
    """Chats with session attributes; empty text counts as missing in fallbacks.

    ``project`` matches a project name or a session id. ``sort_time`` is the
    first non-null time and gives the scan order together with the session id.
    """
    c = chats.select(
        F.col("sessionId"),
        "rawText",
        "messageCount",
        F.col("platform").alias("chat_platform"),
        F.col("createdAt").alias("chat_created"),
    )
    s = sessions.select(
        F.col("id").alias("sessionId"),
        F.col("projectName").alias("project_name"),
        F.col("platform").alias("session_platform"),
        F.col("createdAt").alias("session_created"),
        F.col("updatedAt").alias("session_updated"),
    )
    joined = c.join(s, "sessionId", "left")
    if project is not None:
        joined = joined.where((F.col("project_name") == project) | (F.col("sessionId") == project))
    return joined.select(
        F.col("sessionId").alias("session_id"),
        F.coalesce("rawText", F.lit("")).alias("raw_text"),
        F.coalesce("messageCount", F.lit(0)).alias("message_count"),
        F.coalesce(_filled("chat_platform"), _filled("session_platform"), F.lit("unknown")).alias("platform"),
        F.coalesce(_filled("project_name"), F.col("sessionId")).alias("project"),
        F.coalesce(_filled("chat_created"), _filled("session_created"), F.col("session_updated")).alias("timestamp"),
        F.coalesce("chat_created", "session_created", "session_updated", "sessionId").alias("sort_time"),
    )


def transcript_turns(raw: Column) -> Column:
    """array<struct<role, text>> of a raw transcript, empty turns removed."""
    body = strip(raw)
    marked = F.regexp_replace(body, MARKER_PATTERN, f"{_CUT}$1{_ROLE_END}")
    pieces = F.split(marked, _CUT)
    turns = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda piece: F.struct(
            F.lower(F.substring_index(piece, _ROLE_END, 1)).alias("role"),
            strip(F.substring_index(piece, _ROLE_END, -1)).alias("text"),
        ),
    )
    whole = F.array(F.struct(F.lit("unknown").alias("role"), body.alias("text")))
    return F.filter(F.when(F.size(pieces) > 1, turns).otherwise(whole), lambda turn: turn["text"] != "")


def split_transcripts(transcripts: DataFrame, text_col: str = "raw_text", prefix: str = "transcript") -> DataFrame:
    """One row per non-empty turn, numbered inside its session; no shuffle."""
    carried = [c for c in transcripts.columns if c != text_col]
    return transcripts.select(
        *carried, F.posexplode(transcript_turns(F.col(text_col))).alias("turn_index", "turn")
    ).select(
        *carried,
        F.concat(
            F.lit(prefix + ":"), F.col("session_id"), F.lit(":turn["), F.col("turn_index").cast("string"), F.lit("]")
        ).alias("source"),
        "turn_index",
        F.col("turn.role").alias("role"),
        F.col("turn.text").alias("text"),
    )


def transcript_order() -> Column:
    """Scan order of split transcripts, unique per turn, in the shape of file turns."""
    return F.struct(
        F.concat_ws("\u0000", "sort_time", "session_id").alias("file"),
        F.col("turn_index").cast("bigint").alias("major"),
        F.lit(0).cast("bigint").alias("minor"),
    )
