"""Inputs derived, in Spark, from the driver's tables (see FIXTURES.md).

The driver's tables hold no chat exports, so these builders turn the
``conversations`` and ``events`` tables into the shapes the operators read:
export lines, JSONL turn records, transcripts, generated text and chat
datasets.  Everything is a DataFrame expression over the whole table, so
the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordinals import running_before
from .functions.timestamps import iso_string

# Conversation ids per block when numbering lines of one synthetic file.
CONV_BLOCK = 4096

PREAMBLE = "preamble without header"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic chat message per conversation row, with its whole text
    (turn 2k), and after some of them an injected system, media or blank
    message (turn 2k + 1); edit markers, and timestamp ties across files."""
    c = table(spark, sf_dir, "conversations")
    sel = (F.col("conv_id") * 7 + F.col("turn")) % 23
    body = F.when(sel == 3, F.concat(F.col("text"), F.lit(" <This message was edited>"))).otherwise(F.col("text"))
    more = (F.when(sel == 1, F.lit("image omitted")).when(sel == 2, F.lit("Sam left"))
            .when(sel == 4, F.lit("This message was deleted.")).when(sel == 5, F.lit("   ")))
    rows = F.array(F.struct((F.col("turn") * 2).alias("turn"), body.alias("body")),
                   F.struct((F.col("turn") * 2 + 1).alias("turn"), more.alias("body")))
    c = c.select("conv_id", "role", F.inline(rows)).where("turn % 2 = 0 or body is not null")
    minutes = F.expr("((conv_id div 4) * 20 + turn) div 2 * 37")
    return c.select(
        "conv_id", "turn",
        F.concat(F.lit("chat_"), (F.col("conv_id") % 4).cast("string"), F.lit(".txt")).alias("source_file"),
        F.timestamp_add("MINUTE", minutes, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.when((F.col("conv_id") + F.col("turn")) % 17 == 0, F.lit("Meta AI"))
         .otherwise(F.concat(F.col("role"), F.lit("_"), (F.col("conv_id") % 5).cast("string"))).alias("speaker"),
        "body",
    )


def fx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export lines ``(source_path, line_no, value)``: a preamble line per
    file, then each row's header line and continuation lines."""
    rows = fx_rows(spark, sf_dir)
    header = F.concat(F.lit("["), F.date_format("ts", "M/d/yy, HH:mm:ss"), F.lit("] "),
                      F.col("speaker"), F.lit(": "), F.col("body"))
    rows = rows.withColumn("parts", F.split(header, "\n", -1)).withColumn("nl", F.size("parts"))
    numbered = running_before(rows, ["source_file"], F.floor(F.col("conv_id") / F.lit(CONV_BLOCK)),
                              [F.col("conv_id"), F.col("turn")], F.col("nl"), "before", how="sum")
    # The first row of a file (nothing before it) also emits the preamble.
    first = F.col("before") == 0
    parts = F.when(first, F.concat(F.array(F.lit(PREAMBLE)), F.col("parts"))).otherwise(F.col("parts"))
    start = F.when(first, F.lit(1)).otherwise(F.col("before") + 2)
    return numbered.select(
        F.col("source_file").alias("source_path"),
        F.posexplode(parts).alias("pos", "value"),
        start.alias("line_start"),
    ).select("source_path", (F.col("line_start") + F.col("pos")).cast("long").alias("line_no"), "value")


def fx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole export files ``(source_path, content)``, one per conversation
    row: a preamble line, then the row's header line and body lines, with
    CRLF line ends on odd turns."""
    rows = fx_rows(spark, sf_dir)
    header = F.concat(F.lit("["), F.date_format("ts", "M/d/yy, HH:mm:ss"), F.lit("] "),
                      F.col("speaker"), F.lit(": "), F.col("body"))
    text = F.concat(F.lit(PREAMBLE + "\n"), header, F.lit("\n"))
    text = F.when(F.col("turn") % 2 == 1, F.regexp_replace(text, "\n", "\r\n")).otherwise(text)
    path = F.concat(F.lit("exports/conv_"), F.col("conv_id").cast("string"), F.lit("/turn_"),
                    F.col("turn").cast("string"), F.lit(".txt"))
    return rows.select(path.alias("source_path"), text.alias("content"))


def fx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a timeline of turns (100,000 rows at sf0.1)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        iso_string(F.col("ts")).alias("timestamp"),
        F.col("ts").alias("ts"),
        F.col("event_type").alias("speaker"),
        F.col("props").alias("text"),
        F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string"), F.lit(".txt")).alias("source_file"),
        F.col("event_id").alias("line_start"),
    )


def fx_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSONL line per fx row ``(line_no, value)`` covering the type and
    presence cases of the turn reader, by ``(conv_id + turn) % 11``:
    0 text is a number, 1 no timestamp, 2 blank text, 3 line_start is a
    digit string, 4 no line_start, 5 no source_file, 6 source_file is null,
    7 padded speaker, else regular.  ``to_json`` omits NULL fields; two
    sentinels become a JSON null and a JSON number afterwards."""
    r = fx_rows(spark, sf_dir)
    sel = (F.col("conv_id") + F.col("turn")) % 11
    null_tok, num_tok = "@@null@@", "@@number@@"
    rec = F.struct(
        F.when(sel != 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.when(sel == 7, F.concat(F.lit("  "), F.col("speaker"), F.lit(" "))).otherwise(F.col("speaker")).alias("speaker"),
        F.when(sel == 0, F.lit(num_tok)).when(sel == 2, F.lit(" \t ")).otherwise(F.col("body")).alias("text"),
        F.when(sel == 6, F.lit(null_tok)).when(sel != 5, F.col("source_file")).alias("source_file"),
        F.when(sel != 4, F.col("turn").cast("string")).alias("line_start"),
    )
    js = F.to_json(rec)
    js = F.regexp_replace(js, '"' + null_tok + '"', "null")
    js = F.regexp_replace(js, '"' + num_tok + '"', "123")
    js = F.when(sel == 3, js).otherwise(F.regexp_replace(js, '"line_start":"([0-9]+)"', '"line_start":$1'))
    return r.select((F.col("conv_id") * 16 + F.col("turn") + 1).alias("line_no"), js.alias("value"))


def fx_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_files`` with a month that does not exist in the header of every
    file whose ``conv_id + turn`` is divisible by 29."""
    r = fx_files(spark, sf_dir)
    number = lambda p: F.regexp_extract("source_path", p, 1).cast("long")
    spoiled = (number(r"conv_(\d+)/") + number(r"turn_(\d+)\.")) % 29 == 0
    bad = F.regexp_replace("content", r"(?s)^(.*?\[)\d{1,2}/", "$113/")
    return r.withColumn("content", F.when(spoiled, bad).otherwise(F.col("content")))


def fx_bad_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_json`` and, by ``(conv_id * 3 + turn) % 13``, lines that cannot
    be read: 0 no JSON, 1 no object, 2 a nested ``source_file``, 3 and 4
    integers over 64 bits."""
    start = '{"timestamp": "2023-01-01T00:00:00", "speaker": "A", "text": "x", '
    lines = ['{"timestamp": "2023-', '[{"text": "x"}]', start + '"source_file": {"name": "f"}}',
             start + '"line_start": 12345678901234567890123}', start + '"line_start": "98765432109876543210"}']
    c = table(spark, sf_dir, "conversations").select(
        (F.lit(1_000_000_000) + F.col("conv_id") * 8 + F.col("turn")).cast("long").alias("line_no"),
        F.get(F.array(*map(F.lit, lines)), ((F.col("conv_id") * 3 + F.col("turn")) % 13).cast("int")).alias("value"))
    return fx_json(spark, sf_dir).select(F.col("line_no").cast("long").alias("line_no"), "value") \
        .unionByName(c.where(F.col("value").isNotNull()))


def fx_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript pieces ``(transcript_id, seq, text)``: each conversation is
    a transcript, each row's body a piece in turn order."""
    r = fx_rows(spark, sf_dir)
    return r.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("seq"), F.col("body").alias("text"))


def fx_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transcript ids, and one more that has no line at all."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transcript_id"))
    return c.distinct().unionByName(c.agg((F.max("transcript_id") + 1).alias("transcript_id")))


def fx_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's text padded with blank lines and surrounding spaces, as
    a model's answer of that round."""
    c = table(spark, sf_dir, "conversations")
    gen = F.concat(F.lit("  "), F.regexp_replace("text", "\n", "\n  \n "), F.lit("\n\n   \n"))
    return c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("round"), gen.alias("generated"))


def fx_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat dataset rows: per conversation, ``messages`` in turn order."""
    c = table(spark, sf_dir, "conversations")
    grouped = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return grouped.select(
        "conv_id",
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def fx_key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_events`` with their user; every 50th user has blank texts only."""
    user = table(spark, sf_dir, "events").select("event_id", "user_id")
    ev = fx_events(spark, sf_dir).drop("ts").join(user, "event_id")
    return ev.withColumn("text", F.when(F.col("user_id") % 50 == 0, F.lit(" \t")).otherwise(F.col("text")))


def fx_iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, value)``: event times written in the forms that ISO 8601
    allows, by ``event_id % 12``; the last three are no such form."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    day = F.col("ts").cast("date")
    thursday = F.date_add(day, 3 - F.weekday(day))
    week = F.concat(F.date_format(thursday, "yyyy"), F.lit("{}W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    in_week = lambda dash: F.regexp_replace(week, r"\{\}", dash)
    number = (F.weekday(day) + 1).cast("string")
    form = lambda pattern: F.date_format("ts", pattern)
    forms = [form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), form("yyyyMMdd'T'HHmmss"),
             F.concat(in_week("-"), F.lit("-"), number, form("'T'HH:mm")),
             F.concat(in_week(""), number, form(" HHmmss.SSSSSS"), F.lit("789")), form("yyyy-MM-dd"), in_week("-"),
             form("yyyy-MM-dd HH:mm:ss'Z'"), form("yyyyMMdd'x'HHmmss'+02:00'"), form("yyyy-MM-dd'T'HH:mm:ss,SSS'-0530'"),
             form("yyyy-MM"), F.concat(in_week("-"), F.lit("-8")), form("yyyy-MM-dd'T'25:mm")]
    return e.select("event_id", F.get(F.array(*forms), (F.col("event_id") % 12).cast("int")).alias("value"))


CONVS_PER_FILE = 8


def fx_route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export files ``(file, content)`` of several messages each, those of
    ``CONVS_PER_FILE`` conversations, by ``file % 6``: 0 line feeds, 1 CRLF, 2 CR,
    3 a byte order mark, 4 a byte order mark and a direction mark (the first
    header has two marks, so it is none), 5 a byte that is no UTF-8 after the
    first message.  0, 1, 2 and 5 begin with a preamble line."""
    r = fx_rows(spark, sf_dir).withColumn("file", F.expr(f"conv_id div {CONVS_PER_FILE}"))
    header = F.concat(F.lit("["), F.date_format("ts", "M/d/yy, HH:mm:ss"), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("body"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", header.alias("m")))), lambda x: x["m"])
    files = r.groupBy("file").agg(parts.alias("m")).withColumn("kind", F.col("file") % 6)
    text = F.array_join("m", "\n")
    bad = F.expr("cast(x'ff' as string)")
    spoiled = F.concat(F.get("m", F.lit(0)), bad, F.when(F.size("m") > 1, F.lit("\n")).otherwise(F.lit("")),
                       F.array_join(F.slice("m", 2, F.greatest(F.size("m"), F.lit(1))), "\n"))
    content = (F.when(F.col("kind") == 3, F.concat(F.lit("\ufeff"), text)).when(F.col("kind") == 4, F.concat(F.lit("\ufeff\u200e"), text))
               .otherwise(F.concat(F.lit(PREAMBLE + "\n"), F.when(F.col("kind") == 5, spoiled).otherwise(text))))
    end = F.when(F.col("kind") == 1, F.lit("\r\n")).when(F.col("kind") == 2, F.lit("\r")).otherwise(F.lit("\n"))
    return files.select("file", F.replace(content, F.lit("\n"), end).alias("content"))
