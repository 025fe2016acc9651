"""

Queries read the driver's tables through the Spark-derived fixtures of
``turnframe.fixtures`` (whole tables, no sampling) and return flat scalar
columns so that the DuckDB oracles can be compared value by value.  Flags
follow the reference README (drop system, drop media, strip edit marker;
speaker control and metadata on where the README turns them on).
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from turnframe import fixtures as fx  # noqa: E402
from turnframe import oracles as O  # noqa: E402
from turnframe.functions import constants as C  # noqa: E402
from turnframe.functions.text import is_media_placeholder, is_system_text, strip  # noqa: E402
from turnframe.operators.assemble import assemble_messages, parse_export_text  # noqa: E402
from turnframe.operators.clean import README_FLAGS, clean_turns, parse_counters, with_drop_reason  # noqa: E402
from turnframe.operators.examples import build_examples, format_turn, split_stats  # noqa: E402
from turnframe.operators.headers import checked_timestamps, with_header  # noqa: E402
from turnframe.operators.turns import json_rejects, turn_index, turn_index_with_count, turns_from_json  # noqa: E402
from turnframe.operators.windows import count_windows, window_members  # noqa: E402
from turnframe.plans.dataset import build_dataset, export_turns, path_order  # noqa: E402
from turnframe.operators.chat import context_lines, generated_lines, inference_prompts, line_counts, tag_lines  # noqa: E402
from turnframe.operators.render import TOKEN_REGEX, render_chat, text_tokens  # noqa: E402
from turnframe.functions.timestamps import is_aware, iso_sort_key  # noqa: E402
from turnframe.plans.exports import header_rejects, parse_exports, write_parsed  # noqa: E402
from turnframe.session import checkpoint_root  # noqa: E402
from turnframe.sources import sinks  # noqa: E402
from turnframe.sources.exports import explode_lines, read_chat_dataset, read_jsonl_lines  # noqa: E402

# The corpus operators are an optional part: without them the rest works.
try:
    from corpus_pipeline import QUERIES as CORPUS_QUERIES, ORACLES as CORPUS_ORACLES
except ImportError as e:
    if (e.name or "").split(".")[:2] not in (["corpus_pipeline"], ["turnframe", "llm"], ["turnframe"]):
        raise
    CORPUS_QUERIES, CORPUS_ORACLES = {}, {}

SMOKE_DIR = "/root/testdata/sf0.001"
# Tokens kept of a rendered chat; most are longer, so the cut shows.
TOKEN_LIMIT = 150
# What a transcript without a line starts from in the speaker prompts.
SEED_LINE = " user_1: hello "


# ---------------------------------------------------------------- helpers

def _messages(spark, d):
    return assemble_messages(fx.fx_lines(spark, d))


def _turns(spark, d):
    return export_turns(fx.fx_lines(spark, d))


def _indexed_turns(spark, d):
    """(indexed turns, number of turns)."""
    turns = _turns(spark, d)
    turns = turns.where(F.length(strip(F.col("text"))) > 0)
    return turn_index_with_count(turns, tiebreak=[path_order()])


def _dataset(spark, d, chunk=C.DEFAULT_CHUNK_TURNS, prompt=C.DEFAULT_PROMPT_TURNS, stride=C.DEFAULT_STRIDE,
             min_turns=C.DEFAULT_MIN_TURNS, speaker_control=True, include_metadata=True):
    return build_dataset(_turns(spark, d), chunk, prompt, stride, min_turns,
                         speaker_control=speaker_control, include_metadata=include_metadata)


def _flat_examples(ds_examples: DataFrame, with_split: bool) -> DataFrame:
    cols = [
        "chunk_index",
        F.col("messages")[0]["content"].alias("system_content"),
        F.col("messages")[1]["content"].alias("user_content"),
        F.col("messages")[2]["content"].alias("assistant_content"),
        *[F.col("meta")[f].alias(f) for f in ("start_turn_index", "end_turn_index", "prompt_turns",
                                              "completion_turns", "start_timestamp", "end_timestamp",
                                              "source_file_start", "source_file_end", "target_speaker")],
    ]
    if with_split:
        cols.append("split")
    return ds_examples.select(*cols)


# ---------------------------------------------------------------- queries

def q_explode_lines(spark, d):
    c = fx.table(spark, d, "conversations")
    files = c.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_"),
                              F.col("turn").cast("string"), F.lit(".txt")).alias("source_path"),
                     F.col("text").alias("content"))
    return explode_lines(files)


def q_parse_headers(spark, d):
    lines = with_header(fx.fx_lines(spark, d))
    where = F.concat(F.col("source_path"), F.lit(" line "), F.col("line_no").cast("string"))
    heads = lines.where("h.is_header").select("source_path", "line_no", F.col("h.ts").alias("__ts"),
                                              F.col("h.speaker").alias("speaker"), F.col("h.text").alias("text"))
    return checked_timestamps(heads, where, "fail").select("source_path", "line_no", "timestamp", "speaker", "text")


def q_parse_export_files(spark, d):
    """Whole-file route: every file parsed inside its row (no shuffle)."""
    msgs = parse_export_text(fx.fx_files(spark, d))
    return msgs.select("source_path", "line_start", "timestamp", "speaker", "text")


def q_assemble_messages(spark, d):
    return _messages(spark, d).select("source_file", "line_start", "timestamp", "speaker", "text")


def q_strip_edits(spark, d):
    m = with_drop_reason(_messages(spark, d), strip_edits=True)
    return m.select("source_file", "line_start", F.col("clean_text").alias("text"))


def q_flag_system(spark, d):
    m = with_drop_reason(_messages(spark, d), strip_edits=True)
    return m.select("source_file", "line_start", is_system_text(F.col("clean_text")).alias("is_system"))


def q_flag_media(spark, d):
    m = with_drop_reason(_messages(spark, d), strip_edits=True)
    return m.select("source_file", "line_start", is_media_placeholder(F.col("clean_text")).alias("is_media"))


def q_drop_reasons(spark, d):
    m = with_drop_reason(_messages(spark, d), **README_FLAGS)
    return m.select("source_file", "line_start", "drop_reason")


def q_clean_turns(spark, d):
    return clean_turns(_messages(spark, d), **README_FLAGS)


def q_clean_turns_defaults(spark, d):
    """The reference's default flags: only the speaker exclusion."""
    return clean_turns(_messages(spark, d))


def q_parse_counters_defaults(spark, d):
    return parse_counters(_messages(spark, d))


def q_minimal_turns(spark, d):
    return clean_turns(_messages(spark, d), minimal=True, **README_FLAGS)


def q_parse_counters(spark, d):
    return parse_counters(_messages(spark, d), **README_FLAGS)


def q_turn_index(spark, d):
    return _indexed_turns(spark, d)[0].select("source_file", "line_start", "turn_idx")


def q_event_turn_index(spark, d):
    ev = fx.fx_events(spark, d).drop("ts")
    return turn_index(ev, tiebreak=["event_id"]).select("event_id", "turn_idx")


def _window_index(chunk, stride, min_turns):
    def q(spark, d):
        idx, n = _indexed_turns(spark, d)
        w = count_windows(idx, chunk, stride, min_turns, n=n)
        return w.select("chunk_index", "start_turn_index", "n_turns")
    return q


def q_event_windows(spark, d):
    ev, n = turn_index_with_count(fx.fx_events(spark, d).drop("ts"), tiebreak=["event_id"])
    w = count_windows(ev, C.DEFAULT_CHUNK_TURNS, C.DEFAULT_STRIDE, C.DEFAULT_MIN_TURNS, n=n)
    return w.select("chunk_index", "start_turn_index", "n_turns",
                    F.element_at("turns", -1)["turn_idx"].alias("last_turn_index"))


def q_event_windows_per_file(spark, d):
    """Per-key timelines at scale: the events, one timeline per source file."""
    ev = fx.fx_events(spark, d).drop("ts")
    idx = turn_index(ev, tiebreak=["event_id"], partition_by=["source_file"])
    w = count_windows(idx, C.DEFAULT_CHUNK_TURNS, C.DEFAULT_STRIDE, C.DEFAULT_MIN_TURNS, partition_by=["source_file"])
    return w.select("source_file", "chunk_index", "start_turn_index", "n_turns",
                    F.element_at("turns", -1)["turn_idx"].alias("last_turn_index"))


def q_window_members(spark, d):
    idx, n = _indexed_turns(spark, d)
    return window_members(idx, n, C.DEFAULT_CHUNK_TURNS, C.DEFAULT_STRIDE, C.DEFAULT_MIN_TURNS).select(
        "chunk_index", "turn_idx", "source_file", "line_start")


def q_format_turns(spark, d):
    t = _turns(spark, d)
    return t.select("source_file", "line_start", format_turn(F.struct("speaker", "text")).alias("formatted"))


def q_build_examples(spark, d):
    idx, n = _indexed_turns(spark, d)
    w = count_windows(idx, C.DEFAULT_CHUNK_TURNS, C.DEFAULT_STRIDE, C.DEFAULT_MIN_TURNS, n=n)
    ex = build_examples(w, C.DEFAULT_PROMPT_TURNS)
    return ex.select("chunk_index", *[F.col("messages")[i]["content"].alias(n)
                                      for i, n in enumerate(["system_content", "user_content", "assistant_content"])])


def q_example_meta(spark, d):
    ds = _dataset(spark, d)
    return ds.examples.select("chunk_index", *[F.col("meta")[f].alias(f) for f in (
        "start_turn_index", "end_turn_index", "prompt_turns", "completion_turns", "start_timestamp",
        "end_timestamp", "source_file_start", "source_file_end", "target_speaker")])


def q_split_examples(spark, d):
    return _flat_examples(_dataset(spark, d).examples, with_split=True)


def _split_examples_params(chunk, stride, min_turns):
    def q(spark, d):
        ds = _dataset(spark, d, chunk=chunk, stride=stride, min_turns=min_turns,
                      prompt=min(C.DEFAULT_PROMPT_TURNS, chunk - 1))
        return ds.examples.select("chunk_index", "split", F.col("meta.start_turn_index").alias("start_turn_index"),
                                  F.col("meta.end_turn_index").alias("end_turn_index"))
    return q


def q_split_examples_per_file(spark, d):
    """Extension: one timeline per key (here per export file); windows,
    tail rule and split are then per key."""
    ds = build_dataset(_turns(spark, d), partition_by=["source_file"], include_metadata=True, speaker_control=True)
    return ds.examples.select("source_file", "chunk_index", "split",
                              F.col("meta.start_turn_index").alias("start_turn_index"),
                              F.col("meta.end_turn_index").alias("end_turn_index"),
                              F.col("meta.target_speaker").alias("target_speaker"))


def q_split_stats(spark, d):
    # Statistics follow from the number of valid turns alone: no ordering.
    turns = _turns(spark, d).where(F.length(strip(F.col("text"))) > 0)
    s = split_stats(turns, C.DEFAULT_CHUNK_TURNS, C.DEFAULT_PROMPT_TURNS, C.DEFAULT_STRIDE,
                    C.DEFAULT_MIN_TURNS, speaker_control=True)
    return s.select("input_turns", "examples", "chunk_turns", "prompt_turns", "stride", "min_turns",
                    "speaker_control", F.col("split.train").alias("train"), F.col("split.val").alias("val"),
                    F.col("split.test").alias("test"), F.col("ratios.val_ratio").alias("val_ratio"),
                    F.col("ratios.test_ratio").alias("test_ratio"))


def q_turns_from_json(spark, d):
    return turns_from_json(fx.fx_json(spark, d))


def _context(spark, d):
    return context_lines(fx.fx_context(spark, d))


def q_context_lines(spark, d):
    return _context(spark, d)


def q_inference_prompts(spark, d):
    p = inference_prompts(_context(spark, d), fx.fx_transcripts(spark, d))
    return p.select("transcript_id", F.col("messages")[0]["content"].alias("system_content"),
                    F.col("messages")[1]["content"].alias("user_content"),
                    render_chat(F.col("messages"), add_generation_prompt=True).alias("prompt_text"))


def q_inference_prompts_speaker(spark, d):
    p = inference_prompts(_context(spark, d), fx.fx_transcripts(spark, d), speaker="user_1",
                          seed_line=SEED_LINE)
    return p.select("transcript_id", F.col("messages")[1]["content"].alias("user_content"))


def q_transcript_tail(spark, d):
    return context_lines(fx.fx_context(spark, d), last=C.DEFAULT_TAIL_LINES)


def q_tag_lines(spark, d):
    raw = fx.fx_context(spark, d).select(
        "transcript_id", "seq", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return tag_lines(raw)


def q_generated_lines(spark, d):
    return generated_lines(fx.fx_generated(spark, d), round_col="round", counts=line_counts(fx.fx_context(spark, d)))


def q_render_chat(spark, d):
    return fx.fx_chat(spark, d).select("conv_id", render_chat(F.col("messages")).alias("text"))


def q_tokenize_truncate(spark, d):
    text = fx.fx_chat(spark, d).select("conv_id", render_chat(F.col("messages")).alias("text"))
    return text_tokens(text, TOKEN_LIMIT, keep=["conv_id"]).select(
        "conv_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


# ---------------------------------------------------------------- files and rejects

EXAMPLE_SCHEMA = ("messages array<struct<role:string,content:string>>, meta struct<chunk_index:bigint,start_turn_index:bigint,"
                  "end_turn_index:bigint,prompt_turns:bigint,completion_turns:bigint,start_timestamp:string,end_timestamp:string,"
                  "source_file_start:string,source_file_end:string,target_speaker:string>")


def _folder(spark, label):
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def q_roundtrip_turns(spark, d):
    """Turns written as JSON lines and read as the dataset builder does."""
    path = _folder(spark, "turns")
    sinks.write_turns(_turns(spark, d), path)
    return turns_from_json(read_jsonl_lines(spark, path)).select("timestamp", "speaker", "text", "source_file", "line_start")


def q_roundtrip_minimal(spark, d):
    path = _folder(spark, "minimal")
    turns = clean_turns(_messages(spark, d), minimal=True, keep_path=True, **README_FLAGS)
    sinks.write_turns(turns, path, minimal=True)
    return spark.read.schema("speaker string, text string").json(path)


def q_roundtrip_splits(spark, d):
    path, ds = _folder(spark, "splits"), _dataset(spark, d)
    sinks.write_splits(ds.examples, path, ds.stats)
    parts = [spark.read.schema(EXAMPLE_SCHEMA).json(f"{path}/{s}").withColumn("split", F.lit(s)) for s in sinks.SPLITS]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _flat_examples(both.withColumn("chunk_index", F.col("meta.chunk_index")), with_split=True)


def q_verify_counts(spark, d):
    path, ds = _folder(spark, "splits"), _dataset(spark, d, include_metadata=False)
    sinks.write_splits(ds.examples, path)
    return sinks.verify_counts(spark, path)


def q_verify_counts_empty_splits(spark, d):
    """Without held-out shares, val and test are written and counted 0."""
    path = _folder(spark, "splits")
    sinks.write_splits(build_dataset(_turns(spark, d), val_ratio=0.0, test_ratio=0.0).examples, path)
    return sinks.verify_counts(spark, path)


def q_roundtrip_stats(spark, d):
    path = _folder(spark, "stats")
    turns = _turns(spark, d).where(F.length(strip(F.col("text"))) > 0)
    s = split_stats(turns, C.DEFAULT_CHUNK_TURNS, C.DEFAULT_PROMPT_TURNS, C.DEFAULT_STRIDE, C.DEFAULT_MIN_TURNS,
                    speaker_control=True)
    sinks.write_stats(s, path)
    back = spark.read.schema(s.schema).json(f"{path}/split_stats")
    return back.select("input_turns", "examples", "chunk_turns", "prompt_turns", "stride", "min_turns", "speaker_control",
                       "split.train", "split.val", "split.test", "ratios.val_ratio", "ratios.test_ratio")


def q_append_transcript(spark, d):
    """Context lines appended twice to one transcript folder."""
    path, lines = _folder(spark, "transcript"), _context(spark, d)
    sinks.append_transcript(lines, path)
    sinks.append_transcript(lines, path)
    return sinks.read_appended(spark, path).groupBy("line").agg(F.count("*").alias("n"))


def q_append_order(spark, d):
    """Three appends to one transcript folder, read back in their order."""
    path, lines = _folder(spark, "transcript"), _context(spark, d)
    for k in range(3):
        sinks.append_transcript(lines.where(F.col("transcript_id") % 3 == k), path)
    return sinks.read_appended(spark, path)


def q_parse_with_counters(spark, d):
    """The counters of the run that wrote the turns, and the turns read."""
    path = _folder(spark, "turns")
    counters = write_parsed(_messages(spark, d), path, **README_FLAGS)
    read = turns_from_json(read_jsonl_lines(spark, path)).agg(F.count("*").alias("turns_read"))
    return counters.join(F.broadcast(read))  # two rows of totals


def q_parse_routes(spark, d):
    """Real files of several messages, read whole and line by line."""
    path = _folder(spark, "exports")
    fx.fx_route_files(spark, d).repartition("file").write.partitionBy("file").text(path)
    out = None
    for route in ("whole", "lines"):
        m = parse_exports(spark, path, route=route).messages.withColumn("route", F.lit(route))
        out = m if out is None else out.unionByName(m)
    folder = F.element_at(F.split("source_path", "/"), -2)
    return out.select("route", folder.alias("folder"), "line_start", "timestamp", "speaker", "text")


def q_iso_times(spark, d):
    """Sort keys of times in all ISO forms."""
    key = iso_sort_key(F.col("value"))
    return fx.fx_iso_times(spark, d).select(
        "event_id", F.date_format(key, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("sort_key"),
        F.when(key.isNotNull(), is_aware(F.col("value"))).alias("aware"))


def q_per_key_rejects(spark, d):
    """Users without a turn or an example, from the dataset of every user."""
    ds = build_dataset(fx.fx_key_events(spark, d), chunk_turns=64, prompt_turns=16, stride=8, min_turns=60,
                       partition_by=["user_id"], tiebreak=["event_id"])
    return ds.rejects


def q_read_chat_dataset(spark, d):
    path = _folder(spark, "chat")
    chat = fx.fx_chat(spark, d)
    for name, part in (("train", chat.where("conv_id % 5 <> 0")), ("val", chat.where("conv_id % 5 = 0"))):
        part.select("messages").write.json(f"{path}/{name}")
    rows = read_chat_dataset(spark, f"{path}/train", f"{path}/val")
    return rows.select("split", render_chat(F.col("messages")).alias("text"))


def q_quarantine_headers(spark, d):
    """Messages whose header date does not exist."""
    return header_rejects(parse_export_text(fx.fx_bad_files(spark, d), on_bad="quarantine"))


def q_quarantine_json(spark, d):
    return json_rejects(fx.fx_bad_json(spark, d)).select("input_line", "reject")


def q_turns_beside_bad_json(spark, d):
    """The same lines: what stays when the rejects are taken out."""
    return turns_from_json(fx.fx_bad_json(spark, d), on_bad="quarantine").select("input_line", "timestamp", "speaker", "text")


def q_dataset_from_json(spark, d):
    """JSON lines to the timeline, equal times in input order."""
    ds = build_dataset(turns_from_json(fx.fx_json(spark, d)))
    return ds.indexed.select("input_line", "turn_idx")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: export lines -> turns -> windows -> examples -> split."""
    return q_split_examples(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**library_queries(), **CORPUS_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**library_oracles(), **CORPUS_ORACLES}


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "explode_lines": q_explode_lines,
        "parse_headers": q_parse_headers,
        "parse_export_files": q_parse_export_files,
        "assemble_messages": q_assemble_messages,
        "strip_edits": q_strip_edits,
        "flag_system": q_flag_system,
        "flag_media": q_flag_media,
        "drop_reasons": q_drop_reasons,
        "clean_turns": q_clean_turns,
        "clean_turns_defaults": q_clean_turns_defaults,
        "parse_counters_defaults": q_parse_counters_defaults,
        "minimal_turns": q_minimal_turns,
        "parse_counters": q_parse_counters,
        "turn_index": q_turn_index,
        "event_turn_index": q_event_turn_index,
        "window_index": _window_index(32, 8, 12),
        "window_index_32_10_12": _window_index(32, 10, 12),
        "window_index_20_5_8": _window_index(20, 5, 8),
        "event_windows": q_event_windows,
        "event_windows_per_file": q_event_windows_per_file,
        "window_members": q_window_members,
        "format_turns": q_format_turns,
        "build_examples": q_build_examples,
        "example_meta": q_example_meta,
        "split_examples": q_split_examples,
        "split_examples_20_5_8": _split_examples_params(20, 5, 8),
        "split_examples_per_file": q_split_examples_per_file,
        "split_stats": q_split_stats,
        "turns_from_json": q_turns_from_json,
        "context_lines": q_context_lines,
        "inference_prompts": q_inference_prompts,
        "inference_prompts_speaker": q_inference_prompts_speaker,
        "transcript_tail": q_transcript_tail,
        "tag_lines": q_tag_lines,
        "generated_lines": q_generated_lines,
        "render_chat": q_render_chat,
        "tokenize_truncate": q_tokenize_truncate,
        "roundtrip_turns": q_roundtrip_turns,
        "roundtrip_minimal": q_roundtrip_minimal,
        "roundtrip_splits": q_roundtrip_splits,
        "roundtrip_stats": q_roundtrip_stats,
        "verify_counts": q_verify_counts,
        "verify_counts_empty_splits": q_verify_counts_empty_splits,
        "append_transcript": q_append_transcript,
        "append_order": q_append_order,
        "parse_with_counters": q_parse_with_counters,
        "parse_routes": q_parse_routes,
        "iso_times": q_iso_times,
        "per_key_rejects": q_per_key_rejects,
        "read_chat_dataset": q_read_chat_dataset,
        "quarantine_headers": q_quarantine_headers,
        "quarantine_json": q_quarantine_json,
        "turns_beside_bad_json": q_turns_beside_bad_json,
        "dataset_from_json": q_dataset_from_json,
    }


# ---------------------------------------------------------------- oracles

def _with(*ctes: str) -> str:
    return "WITH " + "".join(ctes)


def _window_index_sql(chunk, stride, min_turns):
    return _with(O.FX_MSGS, O.windows_cte("w", "fx_turns", chunk, stride, min_turns)) + \
        " SELECT chunk_index, start_turn_index, n_turns FROM w_win"


def _examples_select(speaker: bool, split: bool) -> str:
    user = O.user_sql("e.prompt_text", "e.target_speaker" if speaker else None)
    cols = [f"e.chunk_index", f"{O.SYSTEM_PROMPT_SQL} AS system_content", f"{user} AS user_content",
            "e.completion_text AS assistant_content"]
    if split:
        cols += ["e.start_turn_index", "e.end_turn_index", "e.prompt_turns", "e.completion_turns",
                 "e.start_timestamp", "e.end_timestamp", "e.source_file_start", "e.source_file_end",
                 "e.target_speaker", "e.split"]
    return " SELECT " + ", ".join(cols)


def library_oracles() -> dict[str, str]:
    ws = O.WS_SQL
    msgs = _with(O.FX_MSGS)
    win = O.windows_cte("w", "fx_turns", 32, 8, 12)
    ex = O.examples_cte("w", "fx_turns", 16)
    split = O.split_cte("w", 0.1, 0.1)
    ctx = _with(O.FX_ROWS) + O.CONTEXT_LINES
    return {
        "explode_lines": """
            SELECT source_path, CAST(unnest(generate_series(1, len(parts))) AS BIGINT) AS line_no,
                   unnest(parts) AS value
            FROM (SELECT 'conv_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.txt' AS source_path,
                         string_split(text, chr(10)) AS parts FROM conversations) f""",
        "parse_headers": msgs + """
            SELECT source_file AS source_path, line_start AS line_no, timestamp, speaker,
                   string_split(body, chr(10))[1] AS text FROM fx_msgs""",
        "parse_export_files": msgs + """
            SELECT 'exports/conv_' || CAST(conv_id AS VARCHAR) || '/turn_' || CAST(turn AS VARCHAR) || '.txt' AS source_path,
                   CAST(2 AS BIGINT) AS line_start, timestamp, speaker, body AS text FROM fx_msgs""",
        "assemble_messages": msgs + " SELECT source_file, line_start, timestamp, speaker, body AS text FROM fx_msgs",
        "strip_edits": msgs + " SELECT source_file, line_start, clean_text AS text FROM fx_clean",
        "flag_system": msgs + f" SELECT source_file, line_start, regexp_matches(clean_text, {O.SYS_RE}) AS is_system FROM fx_clean",
        "flag_media": msgs + f" SELECT source_file, line_start, regexp_matches(clean_text, {O.MEDIA_RE}) AS is_media FROM fx_clean",
        "drop_reasons": msgs + " SELECT source_file, line_start, drop_reason FROM fx_reason",
        "clean_turns": msgs + """
            SELECT timestamp, speaker, clean_text AS text, source_file, line_start FROM fx_reason WHERE drop_reason IS NULL""",
        "clean_turns_defaults": msgs + """
            SELECT timestamp, speaker, strip_text AS text, source_file, line_start FROM fx_msgs_s WHERE speaker <> 'Meta AI'""",
        "parse_counters_defaults": msgs + """
            SELECT CAST(count(DISTINCT source_file) AS BIGINT) AS input_files, count(*) AS raw_messages,
              count(*) FILTER (WHERE speaker = 'Meta AI') AS dropped_speaker, CAST(0 AS BIGINT) AS dropped_system,
              CAST(0 AS BIGINT) AS dropped_media, count(*) FILTER (WHERE speaker <> 'Meta AI') AS written,
              CAST(0 AS BIGINT) AS bad_timestamps
            FROM fx_msgs""",
        "minimal_turns": msgs + " SELECT speaker, clean_text AS text FROM fx_reason WHERE drop_reason IS NULL",
        "parse_counters": msgs + """
            SELECT CAST(count(DISTINCT source_file) AS BIGINT) AS input_files, count(*) AS raw_messages,
              count(*) FILTER (WHERE drop_reason = 'speaker') AS dropped_speaker,
              count(*) FILTER (WHERE drop_reason = 'system') AS dropped_system,
              count(*) FILTER (WHERE drop_reason = 'media') AS dropped_media,
              count(*) FILTER (WHERE drop_reason IS NULL) AS written, CAST(0 AS BIGINT) AS bad_timestamps
            FROM fx_reason""",
        "turn_index": msgs + " SELECT source_file, line_start, CAST(turn_idx AS BIGINT) AS turn_idx FROM fx_turns",
        "event_turn_index": _with(O.FX_EVENTS) + " SELECT event_id, CAST(turn_idx AS BIGINT) AS turn_idx FROM fx_events",
        "window_index": _window_index_sql(32, 8, 12),
        "window_index_32_10_12": _window_index_sql(32, 10, 12),
        "window_index_20_5_8": _window_index_sql(20, 5, 8),
        "event_windows": _with(O.FX_EVENTS, O.windows_cte("w", "fx_events", 32, 8, 12)) + """
            SELECT chunk_index, start_turn_index, n_turns, start_turn_index + n_turns - 1 AS last_turn_index FROM w_win""",
        "event_windows_per_file": _with(O.FX_EVENTS) + """,
            ek AS (SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY ts, event_id) - 1 AS k_idx
                   FROM fx_events)""" + O.windows_by_key_cte("pk", "ek", "source_file", "k_idx", 32, 8, 12) + """
            SELECT source_file, chunk_index, start_turn_index, n_turns,
              start_turn_index + n_turns - 1 AS last_turn_index FROM pk_win""",
        "window_members": msgs + win + """
            SELECT w.chunk_index, CAST(t.turn_idx AS BIGINT) AS turn_idx, t.source_file, t.line_start
            FROM w_win w JOIN fx_turns t
              ON t.turn_idx >= w.start_turn_index AND t.turn_idx < w.start_turn_index + w.n_turns""",
        "format_turns": msgs + """
            SELECT source_file, line_start, speaker || ': ' || clean_text AS formatted
            FROM fx_reason WHERE drop_reason IS NULL""",
        "build_examples": msgs + win + ex + _examples_select(False, False) + " FROM w_ex e",
        "example_meta": msgs + win + ex + """
            SELECT chunk_index, start_turn_index, end_turn_index, prompt_turns, completion_turns, start_timestamp,
                   end_timestamp, source_file_start, source_file_end, target_speaker FROM w_ex""",
        "split_examples": msgs + win + ex + split + _examples_select(True, True) + " FROM w_split e",
        "split_examples_20_5_8": msgs + O.windows_cte("w", "fx_turns", 20, 5, 8) + O.examples_cte("w", "fx_turns", 16)
        + split + " SELECT chunk_index, split, start_turn_index, end_turn_index FROM w_split",
        "split_examples_per_file": msgs + O.PER_FILE_SPLIT + """
            SELECT source_file, chunk_index, split, start_turn_index, end_turn_index, target_speaker FROM pf_split""",
        "split_stats": library_oracle_split_stats(msgs, win),
        "turns_from_json": _with(O.FX_ROWS) + f""",
            j AS (SELECT *, (conv_id + turn) % 11 AS sel FROM fx_rows)
            SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, speaker,
              trim(body, {ws}) AS text,
              CASE sel WHEN 5 THEN 'unknown' WHEN 6 THEN 'None' ELSE source_file END AS source_file,
              CAST(CASE sel WHEN 4 THEN 0 ELSE turn END AS BIGINT) AS line_start,
              CAST(conv_id * 16 + turn + 1 AS BIGINT) AS input_line
            FROM j WHERE sel NOT IN (0, 1, 2) AND length(trim(body, {ws})) > 0""",
        "context_lines": ctx + " SELECT transcript_id, line_no, line FROM ctx_lines",
        "inference_prompts": ctx + f""",
            tr AS (SELECT DISTINCT conv_id AS transcript_id FROM conversations UNION SELECT max(conv_id) + 1 FROM conversations),
            jt AS (SELECT tr.transcript_id, {O.trim_ws("coalesce(string_agg(c.line, chr(10) ORDER BY c.line_no), '')")} AS t
                   FROM tr LEFT JOIN ctx_lines c ON c.transcript_id = tr.transcript_id GROUP BY tr.transcript_id),
            up AS (SELECT transcript_id, {O.user_sql("CASE WHEN length(t) = 0 THEN '(empty)' ELSE t END", None)} AS user_content FROM jt)
            SELECT transcript_id, {O.SYSTEM_PROMPT_SQL} AS system_content, user_content,
              '<|im_start|>system' || chr(10) || {O.SYSTEM_PROMPT_SQL} || '<|im_end|>' || chr(10)
              || '<|im_start|>user' || chr(10) || user_content || '<|im_end|>' || chr(10)
              || '<|im_start|>assistant' || chr(10) AS prompt_text
            FROM up""",
        "inference_prompts_speaker": ctx + f""",
            tr AS (SELECT DISTINCT conv_id AS transcript_id FROM conversations UNION SELECT max(conv_id) + 1 FROM conversations),
            jt AS (SELECT tr.transcript_id, {O.trim_ws("coalesce(string_agg(c.line, chr(10) ORDER BY c.line_no), " + O._lit(SEED_LINE.strip()) + ")")} AS t
                   FROM tr LEFT JOIN ctx_lines c ON c.transcript_id = tr.transcript_id GROUP BY tr.transcript_id)
            SELECT transcript_id, {O.user_sql("CASE WHEN length(t) = 0 THEN '(empty)' ELSE t END", "'user_1'")} AS user_content
            FROM jt""",
        "transcript_tail": ctx + """
            SELECT transcript_id, line_no, line FROM (
              SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY line_no DESC) AS r FROM ctx_lines) x
            WHERE r <= 20""",
        "tag_lines": _with(O.FX_ROWS) + f""",
            raw AS (SELECT conv_id AS transcript_id, turn AS seq,
                      CAST(unnest(generate_series(0, len(string_split(body, chr(10))) - 1)) AS INTEGER) AS pos,
                      unnest(string_split(body, chr(10))) AS line FROM fx_rows),
            st AS (SELECT transcript_id, seq, pos, {O.trim_ws("line")} AS s FROM raw)
            SELECT transcript_id, seq, pos,
              CASE WHEN contains(s, ':') THEN s ELSE 'You: ' || s END AS line
            FROM st WHERE length(s) > 0""",
        "generated_lines": ctx + f""",
            g AS (SELECT conv_id, turn, '  ' || replace(text, chr(10), chr(10) || '  ' || chr(10) || ' ') || chr(10) || chr(10) || '   ' || chr(10) AS gen FROM conversations),
            parts AS (SELECT conv_id, turn, unnest(generate_series(1, len(p))) AS k, unnest(p) AS raw
                      FROM (SELECT conv_id, turn, string_split(gen, chr(10)) AS p FROM g) q),
            kept AS (SELECT conv_id, turn, k, {O.trim_ws("raw")} AS line FROM parts WHERE length({O.trim_ws("raw")}) > 0),
            cnt AS (SELECT transcript_id, max(line_no) AS last_no FROM ctx_lines GROUP BY transcript_id)
            SELECT kept.conv_id AS transcript_id,
              CAST(coalesce(cnt.last_no, 0) + row_number() OVER (PARTITION BY kept.conv_id ORDER BY turn, k) AS BIGINT) AS line_no,
              line
            FROM kept LEFT JOIN cnt ON cnt.transcript_id = kept.conv_id""",
        "render_chat": """
            SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
            FROM conversations GROUP BY conv_id""",
        "tokenize_truncate": f"""
            WITH r AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
                       FROM conversations GROUP BY conv_id),
            t AS (SELECT conv_id, regexp_extract_all(text, {O._lit(TOKEN_REGEX)})[1:{TOKEN_LIMIT}] AS toks FROM r)
            SELECT conv_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM t""",
        **_file_oracles(msgs, win, ex, split, ctx),
    }


def _file_oracles(msgs: str, win: str, ex: str, split: str, ctx: str) -> dict[str, str]:
    """Round trips give what was written, rejects what was spoiled."""
    ws = O.WS_SQL
    json_rows = _with(O.FX_ROWS) + f""",
            j AS (SELECT *, (conv_id + turn) % 11 AS sel, CAST(conv_id * 16 + turn + 1 AS BIGINT) AS input_line FROM fx_rows),
            good AS (SELECT input_line, ts, speaker, trim(body, {ws}) AS text,
                       CASE sel WHEN 5 THEN 'unknown' WHEN 6 THEN 'None' ELSE source_file END AS source_file,
                       CASE sel WHEN 4 THEN 0 ELSE turn END AS line_start
                     FROM j WHERE sel NOT IN (0, 1, 2) AND length(trim(body, {ws})) > 0)"""
    counts = "SELECT s.split, CAST(count({x}) AS BIGINT) AS rows FROM (VALUES ('train'), ('val'), ('test')) s(split) "
    return {
        "roundtrip_turns": msgs + """
            SELECT timestamp, speaker, clean_text AS text, source_file, line_start
            FROM fx_reason WHERE drop_reason IS NULL AND length(clean_text) > 0""",
        "roundtrip_minimal": msgs + " SELECT speaker, clean_text AS text FROM fx_reason WHERE drop_reason IS NULL",
        "roundtrip_splits": msgs + win + ex + split + _examples_select(True, True) + " FROM w_split e",
        "roundtrip_stats": library_oracle_split_stats(msgs, win),
        "verify_counts": msgs + win + ex + split + counts.format(x="e.chunk_index")
        + "LEFT JOIN w_split e ON e.split = s.split GROUP BY s.split",
        "verify_counts_empty_splits": msgs + win + counts.format(x="w.chunk_index")
        + "LEFT JOIN w_win w ON s.split = 'train' GROUP BY s.split",
        "append_transcript": ctx + " SELECT line, CAST(2 * count(*) AS BIGINT) AS n FROM ctx_lines GROUP BY line",
        "append_order": ctx + """ SELECT CAST(row_number() OVER (ORDER BY transcript_id % 3, transcript_id, line_no) - 1 AS BIGINT) AS position, line
            FROM ctx_lines""",
        "parse_with_counters": msgs + """
            SELECT CAST(count(DISTINCT source_file) AS BIGINT) AS input_files, count(*) AS raw_messages,
              count(*) FILTER (WHERE drop_reason = 'speaker') AS dropped_speaker,
              count(*) FILTER (WHERE drop_reason = 'system') AS dropped_system,
              count(*) FILTER (WHERE drop_reason = 'media') AS dropped_media,
              count(*) FILTER (WHERE drop_reason IS NULL) AS written, CAST(0 AS BIGINT) AS bad_timestamps,
              count(*) FILTER (WHERE drop_reason IS NULL AND length(clean_text) > 0) AS turns_read
            FROM fx_reason""",
        "iso_times": O.ISO_TIMES,
        "per_key_rejects": O.KEY_REJECTS,
        "parse_routes": _with(O.FX_ROWS) + O.PARSE_ROUTES,
        "read_chat_dataset": """
            SELECT CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
              string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
            FROM conversations GROUP BY conv_id""",
        "quarantine_headers": msgs + """
            SELECT 'exports/conv_' || CAST(conv_id AS VARCHAR) || '/turn_' || CAST(turn AS VARCHAR) || '.txt' AS source_path,
                   CAST(2 AS BIGINT) AS line_start, speaker, body AS text FROM fx_msgs WHERE (conv_id + turn) % 29 = 0""",
        "quarantine_json": _with(O.FX_ROWS) + """,
            k AS (SELECT CAST(1000000000 + conv_id * 8 + turn AS BIGINT) AS input_line, (conv_id * 3 + turn) % 13 AS kind FROM conversations)
            SELECT input_line, CASE kind WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object'
              WHEN 2 THEN 'source_file is no plain value' ELSE 'line_start is no integer of 64 bits' END AS reject
            FROM k WHERE kind <= 4""",
        "turns_beside_bad_json": json_rows + """
            SELECT input_line, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, speaker, text FROM good""",
        "dataset_from_json": json_rows + """
            SELECT input_line, CAST(row_number() OVER (ORDER BY ts, source_file, line_start, input_line) - 1 AS BIGINT) AS turn_idx FROM good""",
    }


def library_oracle_split_stats(msgs: str, win: str) -> str:
    return msgs + win + """,
            c AS (SELECT count(*) AS total, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) AS t10 FROM w_win)
            SELECT (SELECT count(*) FROM fx_turns) AS input_turns, total AS examples,
              CAST(32 AS BIGINT) AS chunk_turns, CAST(16 AS BIGINT) AS prompt_turns, CAST(8 AS BIGINT) AS stride,
              CAST(12 AS BIGINT) AS min_turns, true AS speaker_control,
              total - 2 * t10 AS train, t10 AS val, t10 AS test, 0.1::DOUBLE AS val_ratio, 0.1::DOUBLE AS test_ratio
            FROM c"""
