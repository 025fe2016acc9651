"""Streaming parse equals the batch whole-file route."""

import os

from turnframe.plans.exports import parse_exports
from turnframe.streaming.exports import start_turns_stream

H = "[12/7/23, 09:15:{:02d}] {}: {}"


def test_stream_matches_batch(spark, tmpdir_path):
    src = f"{tmpdir_path}/in"
    os.makedirs(src)
    for f in range(3):
        body = "pre\n" + "\n".join(H.format(i, f"S{i % 2}", f"f{f} m{i}\ncont") for i in range(10))
        with open(f"{src}/c{f}.txt", "w", encoding="utf-8") as fh:
            fh.write(body)
    flags = dict(drop_system=True, drop_media=True, strip_edits=True)
    q = start_turns_stream(spark, src, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt", **flags)
    q.awaitTermination(120)
    streamed = sorted(tuple(r) for r in spark.read.json(f"{tmpdir_path}/out").select(
        "timestamp", "speaker", "text", "source_file", "line_start").collect())
    batch = sorted(tuple(r) for r in parse_exports(spark, src, **flags).turns.select(
        "timestamp", "speaker", "text", "source_file", "line_start").collect())
    assert streamed == batch and len(batch) == 30


def test_stream_running_counters(spark, tmpdir_path):
    from turnframe.streaming.exports import running_counters, stream_export_messages

    src = f"{tmpdir_path}/in"
    os.makedirs(src)
    body = "\n".join(H.format(i, "Meta AI" if i == 0 else "Ann", "image omitted" if i == 1 else f"m{i}")
                     for i in range(5))
    with open(f"{src}/a.txt", "w", encoding="utf-8") as fh:
        fh.write(body)
    counters = running_counters(stream_export_messages(spark, src), drop_system=True, drop_media=True)
    q = counters.writeStream.format("memory").queryName("tf_counters").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    row = spark.sql("SELECT * FROM tf_counters").first()
    assert (row["raw_messages"], row["dropped_speaker"], row["dropped_media"], row["written"]) == (5, 1, 1, 3)


def test_stream_counts_files_exactly(spark, tmpdir_path):
    from turnframe.streaming.exports import running_file_count, stream_export_files

    for i in range(7):
        os.makedirs(f"{tmpdir_path}/in/sub{i % 2}", exist_ok=True)
        with open(f"{tmpdir_path}/in/sub{i % 2}/f{i}.txt", "w", encoding="utf-8") as fh:
            fh.write("\n".join(H.format(k, "Ann", "x") for k in range(i + 1)))
    q = running_file_count(stream_export_files(spark, f"{tmpdir_path}/in", 3)).writeStream.format("memory") \
        .queryName("tf_files").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM tf_files").first()["input_files"] == 7


def test_stream_quarantine_fills_two_sinks(spark, tmpdir_path):
    """Bad header dates leave the turns and are the rejects, as in batch, and
    a batch that runs again changes nothing."""
    from turnframe.streaming.exports import stream_export_files, write_turns_and_rejects

    src, bad = f"{tmpdir_path}/in", "[13/7/23, 09:15:00] Ann: no such month"
    os.makedirs(src)

    def more(name, lines):
        with open(f"{src}/{name}.txt", "w", encoding="utf-8") as fh:
            fh.write("\n".join(lines))

    more("a", [H.format(1, "Ann", "one"), bad, "its second line", H.format(2, "Bob", "two")])
    more("b", [H.format(3, "Ann", "three")])
    flags = dict(drop_system=True, drop_media=True, strip_edits=True, on_bad="quarantine")
    out, rejects, ckpt = (f"{tmpdir_path}/{x}" for x in ("out", "rejects", "ckpt"))
    for _ in range(2):
        start_turns_stream(spark, src, out, ckpt, rejects_dir=rejects, **flags).awaitTermination(120)
        more("c", [bad, H.format(4, "Bob", "four")])
    parsed = parse_exports(spark, src, **flags)
    turns = ["timestamp", "speaker", "text", "source_file", "line_start"]

    def rows(df, cols):
        return sorted(tuple(r) for r in df.select(*cols).collect())

    def streamed(path, cols):
        return rows(spark.read.option("recursiveFileLookup", "true").json(path), cols)

    assert streamed(out, turns) == rows(parsed.turns, turns) and len(streamed(out, turns)) == 4
    bad_cols = ["source_path", "line_start", "speaker", "text"]
    assert streamed(rejects, bad_cols) == rows(parsed.rejects, bad_cols) and len(streamed(rejects, bad_cols)) == 2
    assert sorted(os.listdir(out)) == sorted(os.listdir(rejects)) == ["batch-0000000000", "batch-0000000001"]
    only_c = spark.read.text(f"{src}/c.txt", wholetext=True).selectExpr(f"'{src}/c.txt' AS source_path", "value AS content")
    write_turns_and_rejects(only_c, 1, out, rejects, drop_system=True, drop_media=True, strip_edits=True)
    assert len(streamed(out, turns)) == 4 and len(streamed(rejects, bad_cols)) == 2
    assert stream_export_files(spark, src).isStreaming
