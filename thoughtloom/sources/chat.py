"""Chat scans: JSON lines, conversation exports, message lists -> turns.

JSON-lines files stay splittable: the line number that names a turn is the
row's place inside its file split plus the number of lines in earlier splits,
so a single huge log is read by many tasks. Plain JSON documents have no line
boundaries and are read one file per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thoughtloom.operators.fragments import cap_per_group

_VARIANTS = "array<variant>"
_MAPPINGS = "array<struct<mapping:map<string,variant>>>"


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _is_array(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _string(value: Column) -> Column:
    return F.when(_is_string(value), _get(value, "$", "string"))


def _part_text(part: Column) -> Column:
    inner = F.coalesce(_string(_get(part, "$.text")), _string(_get(part, "$.content")))
    return F.coalesce(_string(part), F.when(_is_object(part), inner), F.lit(""))


def _joined_parts(parts: Column) -> Column:
    texts = F.transform(_get(parts, "$", _VARIANTS), _part_text)
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def message_text(message: Column) -> Column:
    """Text of a message: content string, part list or object, else text / message."""
    content = _get(message, "$.content")
    parts = _get(content, "$.parts")
    return F.coalesce(
        _string(content),
        F.when(_is_array(content), _joined_parts(content)),
        F.when(_is_object(content) & F.coalesce(_is_array(parts), F.lit(False)), _joined_parts(parts)),
        F.when(_is_object(content), _string(_get(content, "$.text"))),
        _string(_get(message, "$.text")),
        _string(_get(message, "$.message")),
        F.lit(""),
    )


def _present(value: Column) -> Column:
    """The value unless it is absent, null, empty text, zero or false; text like "0" is a value."""
    kind, plain = F.schema_of_variant(value), _get(value, "$", "string")
    empty = F.when(kind == "STRING", plain == "").when(kind == "BOOLEAN", plain == "false")
    empty = F.coalesce(empty, F.coalesce(_get(value, "$", "double") == 0, F.lit(False)))
    return F.when(plain.isNotNull() & ~empty, value)


def normalize_timestamp(value: Column) -> Column:
    """Epoch numbers become UTC ISO text (true is 1), text stays, anything else is null."""
    kind = F.schema_of_variant(value)
    number = F.when(kind == "BOOLEAN", _get(value, "$", "boolean").cast("double")).otherwise(_get(value, "$", "double"))
    micros = F.rint(number * F.lit(1e6)).cast("bigint")
    instant = F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone())
    fraction = F.when(F.pmod(micros, F.lit(1000000)) == 0, F.lit("")).otherwise(
        F.date_format(instant, ".SSSSSS")
    )
    iso = F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(kind == "STRING", _get(value, "$", "string")).when(numeric, iso)


def _message_columns(message: Column) -> dict[str, Column]:
    role = F.coalesce(_present(_get(message, "$.role")), _present(_get(message, "$.author")))
    when = F.coalesce(_present(_get(message, "$.timestamp")), _get(message, "$.create_time"))
    return {
        "role": F.coalesce(_get(role, "$", "string"), F.lit("unknown")),
        "text": message_text(message),
        "timestamp": normalize_timestamp(when),
    }


def _turns(df: DataFrame, source: Column, columns: dict[str, Column]) -> DataFrame:
    """Final turn columns; ``major`` / ``minor`` give the place inside the file."""
    return df.select(
        F.col("path").alias("source_file"),
        source.alias("source"),
        *[column.alias(name) for name, column in columns.items()],
        F.struct(
            F.lower("path").alias("file"),
            F.col("major").cast("bigint").alias("major"),
            F.col("minor").cast("bigint").alias("minor"),
        ).alias("scan_order"),
    ).where(F.col("text") != "")


def numbered_lines(spark: SparkSession, paths: Sequence[str], glob: str) -> DataFrame:
    """(path, name, line, value) for every line, blank ones included in the count."""
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(list(paths))
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .withColumn("at", F.monotonically_increasing_id())
    )
    blocks = raw.groupBy("path", "block").agg(F.min("at").alias("first_at"), F.count("*").alias("lines"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("skipped", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    return raw.join(offsets, ["path", "block"]).select(
        "path", "name", (F.col("skipped") + F.col("at") - F.col("first_at")).alias("line"), "value"
    )


def _line_turns(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("row", F.try_parse_json("value")).where(_is_object(F.col("row")))
    listed = _get(F.col("row"), "$.messages")
    single = rows.where(listed.isNull()).withColumns({"major": F.col("line"), "minor": F.lit(0)})
    label = F.concat(F.col("name"), F.lit(":line["), F.col("line").cast("string"), F.lit("]"))
    plain = _turns(single, label, _message_columns(F.col("row")))
    fanned = rows.where(listed.isNotNull()).select(
        "path",
        "name",
        "line",
        F.col("line").alias("major"),
        F.posexplode(_get(listed, "$", _VARIANTS)).alias("minor", "message"),
    ).where(_is_object(F.col("message")))
    nested = F.concat(label, F.lit(":message["), F.col("minor").cast("string"), F.lit("]"))
    return plain.unionByName(_turns(fanned, nested, _message_columns(F.col("message"))))


def _documents(spark: SparkSession, paths: Sequence[str], glob: str) -> DataFrame:
    """One row per JSON document: the unwrapped root and its item list."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(list(paths), wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    )
    parsed = files.withColumn("doc", F.parse_json("value"))
    wrapped = _get(F.col("doc"), "$.conversations")
    return parsed.withColumns(
        {"wrapped": wrapped.isNotNull(), "root": F.coalesce(wrapped, F.col("doc"))}
    ).withColumn("items", F.when(_is_array(F.col("root")), _get(F.col("root"), "$", _VARIANTS)))


def _export_turns(documents: DataFrame) -> DataFrame:
    """Conversation-tree exports: nodes of a conversation by (create_time, document order)."""
    # Typed parsing keeps the document order of nodes, which settles equal times.
    conversations = F.when(
        F.col("wrapped"), F.from_json("value", f"struct<conversations:{_MAPPINGS}>")["conversations"]
    ).otherwise(F.from_json("value", _MAPPINGS))
    nodes = documents.select(
        "path", "name", F.posexplode(conversations).alias("major", "conversation")
    ).withColumn("entries", F.map_entries("conversation.mapping"))
    places = F.sort_array(
        F.transform(
            "entries",
            lambda entry, i: F.struct(
                F.coalesce(_get(entry["value"], "$.message.create_time", "double"), F.lit(0.0)).alias("t"), i.alias("i")
            ),
        )
    )
    ordered = nodes.select("path", "name", "major", "entries", F.posexplode(places).alias("minor", "place")).withColumn(
        "entry", F.element_at("entries", F.col("place.i") + 1)
    )
    message = _get(F.col("entry.value"), "$.message")
    shown = ordered.withColumn("message", message).where(_is_object(F.col("message")))
    source = F.concat(
        F.col("name"), F.lit(":conversation["), F.col("major").cast("string"), F.lit("]/"), F.col("entry.key")
    )
    return _turns(
        shown,
        source,
        {
            "role": F.coalesce(_get(F.col("message"), "$.author.role", "string"), F.lit("unknown")),
            "text": message_text(F.col("message")),
            "timestamp": normalize_timestamp(_get(F.col("message"), "$.create_time")),
        },
    )


def _list_turns(documents: DataFrame) -> DataFrame:
    """Lists of rows or conversations, and single objects with ``messages``."""
    items = documents.where(F.col("items").isNotNull()).select(
        "path", "name", F.posexplode("items").alias("major", "item")
    ).where(_is_object(F.col("item")))
    listed = _get(F.col("item"), "$.messages")
    rows = items.where(listed.isNull()).withColumn("minor", F.lit(0))
    plain = _turns(
        rows,
        F.concat(F.col("name"), F.lit(":row["), F.col("major").cast("string"), F.lit("]")),
        _message_columns(F.col("item")),
    )
    talks = items.where(listed.isNotNull()).select(
        "path",
        "name",
        "major",
        F.concat(F.col("name"), F.lit(":conversation["), F.col("major").cast("string"), F.lit("]")).alias("prefix"),
        F.posexplode(_get(listed, "$", _VARIANTS)).alias("minor", "message"),
    )
    single = documents.where(_is_object(F.col("root"))).select(
        "path",
        "name",
        F.lit(0).alias("major"),
        F.col("name").alias("prefix"),
        F.posexplode(_get(F.col("root"), "$.messages", _VARIANTS)).alias("minor", "message"),
    )
    messages = talks.unionByName(single).where(_is_object(F.col("message")))
    source = F.concat(F.col("prefix"), F.lit(":message["), F.col("minor").cast("string"), F.lit("]"))
    return plain.unionByName(_turns(messages, source, _message_columns(F.col("message"))))


def read_json_lines(spark: SparkSession, paths: Sequence[str], glob: str = "*.jsonl") -> DataFrame:
    return _line_turns(numbered_lines(spark, paths, glob))


def read_json_documents(spark: SparkSession, paths: Sequence[str], glob: str = "*.json") -> DataFrame:
    documents = _documents(spark, paths, glob)
    is_export = F.coalesce(
        F.exists("items", lambda item: _get(item, "$.mapping").isNotNull()), F.lit(False)
    )
    return _export_turns(documents.where(is_export)).unionByName(_list_turns(documents.where(~is_export)))


def read_chat(
    spark: SparkSession,
    *,
    lines: Sequence[str] = (),
    documents: Sequence[str] = (),
    max_turns_per_file: int | None = None,
) -> DataFrame:
    """Turns of JSON-lines paths and JSON-document paths (files or folders)."""
    parts = []
    if lines:
        parts.append(read_json_lines(spark, lines))
    if documents:
        parts.append(read_json_documents(spark, documents))
    if not parts:
        raise ValueError("no input paths")
    turns = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return cap_per_group(turns, max_turns_per_file, [F.asc("scan_order")], group="source_file")
