"""File sources and sinks: CRLF, lone CR, BOM, invalid bytes,
no final newline, nested folders, extensions, empty files, outputs."""

import json
import os

import pytest

from turnframe.plans.dataset import build_dataset
from turnframe.plans.exports import parse_exports
from turnframe.sources.exports import count_input_files, explode_lines, read_export_lines, read_exports
from turnframe.sources.sinks import append_transcript, read_appended, verify_counts, write_splits, write_stats, write_turns

H = "[12/7/23, 09:15:{:02d}] {}: {}"


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _export(n, speaker="Ann", sep="\n"):
    return sep.join(H.format(i % 60, speaker if i % 2 else "Bob", f"msg {i}") for i in range(n)).encode()


def test_read_exports_decoding(spark, tmpdir_path):
    _write(f"{tmpdir_path}/a.txt", b"x\r\ny\rz\n")
    _write(f"{tmpdir_path}/sub/deep/b.txt", "﻿bom line\nend".encode() + b"\xff\xe2\x82")
    _write(f"{tmpdir_path}/c.TXT", b"ignored")
    _write(f"{tmpdir_path}/empty.txt", b"")
    files = read_exports(spark, tmpdir_path)
    lines = explode_lines(files).collect()
    got = {(os.path.basename(r["source_path"]), r["line_no"]): r["value"] for r in lines}
    assert got[("a.txt", 1)] == "x" and got[("a.txt", 2)] == "y" and got[("a.txt", 3)] == "z"
    assert ("a.txt", 4) not in got
    assert got[("b.txt", 1)] == "﻿bom line"
    assert got[("b.txt", 2)] == "end��"
    assert not any(k[0] == "c.TXT" for k in got)
    assert files.count() == 2  # Spark's scan skips the empty file ...
    assert count_input_files(spark, tmpdir_path) == 3  # ... the file index counts it
    single = read_exports(spark, f"{tmpdir_path}/c.TXT")
    assert single.count() == 1


def test_line_reader_matches_whole_file_reader(spark, tmpdir_path):
    _write(f"{tmpdir_path}/big.txt", _export(3000, sep="\r\n"))
    _write(f"{tmpdir_path}/x/small.txt", _export(7))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        by_lines = sorted(tuple(r) for r in read_export_lines(spark, tmpdir_path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = sorted(tuple(r) for r in explode_lines(read_exports(spark, tmpdir_path)).collect())
    assert by_lines == whole
    assert len(by_lines) == 3007


def test_parse_exports_routes_and_counters(spark, tmpdir_path):
    text = ("header junk\n" + H.format(1, "Ann", "hi") + "\n" + H.format(2, "Meta AI", "bot") + "\n"
            + H.format(3, "Bob", "image omitted") + "\n" + H.format(4, "Cy", "Sam left") + "\n"
            + H.format(5, "Dee", "ok <This message was edited>") + "\nmore")
    _write(f"{tmpdir_path}/one.txt", text.encode())
    _write(f"{tmpdir_path}/two/empty.txt", b"")
    flags = dict(drop_system=True, drop_media=True, strip_edits=True)
    res = {}
    for route, limit in (("whole", None), ("lines", None), ("auto", None), ("auto", 100)):
        p = parse_exports(spark, tmpdir_path, route=route, **flags) if limit is None else \
            parse_exports(spark, tmpdir_path, route=route, whole_file_limit=limit, **flags)
        route = route if limit is None else "mixed"
        res[route] = (sorted(tuple(r) for r in p.turns.collect()), tuple(p.counters.first()))
    assert res["whole"] == res["lines"] == res["auto"] == res["mixed"]
    turns, counters = res["whole"]
    assert counters == (2, 5, 1, 1, 1, 2, 0)
    # The marker regex also eats the newline after it: neighbours fuse.
    assert [t[2] for t in turns] == ["hi", "okmore"]


def test_outputs(spark, tmpdir_path):
    text = "\n".join(H.format(i, f"S{i % 3}", f"line {i}") for i in range(40))
    _write(f"{tmpdir_path}/in/chat.txt", text.encode())
    p = parse_exports(spark, f"{tmpdir_path}/in", drop_system=True, drop_media=True, strip_edits=True)
    write_turns(p.turns, f"{tmpdir_path}/turns")
    back = spark.read.json(f"{tmpdir_path}/turns").collect()
    assert len(back) == 40
    ds = build_dataset(p.turns, include_metadata=True, speaker_control=True)
    counts = write_splits(ds.examples, f"{tmpdir_path}/ds", ds.stats)
    write_stats(ds.stats, f"{tmpdir_path}/ds")
    assert counts == {"train": 4, "val": 0, "test": 0}  # starts 0, 8, 16, 24; no tail
    v = {r["split"]: r["rows"] for r in verify_counts(spark, f"{tmpdir_path}/ds").collect()}
    assert v == {"train": 4, "val": 0, "test": 0}
    assert set(spark.read.json(f"{tmpdir_path}/ds/train").columns) == {"messages", "meta"}
    stats_file = [f for f in os.listdir(f"{tmpdir_path}/ds/split_stats") if f.endswith(".json")][0]
    stats = json.loads(open(f"{tmpdir_path}/ds/split_stats/{stats_file}").read())
    assert stats["input_turns"] == 40 and stats["examples"] == 4
    assert stats["split"] == {"train": 4, "val": 0, "test": 0}
    assert stats["ratios"] == {"val_ratio": 0.1, "test_ratio": 0.1}
    train = spark.read.json(f"{tmpdir_path}/ds/train").orderBy("meta.chunk_index").collect()
    assert [r["meta"]["chunk_index"] for r in train] == [0, 1, 2, 3]
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "transcript_id long, line_no long, line string")
    assert [append_transcript(lines, f"{tmpdir_path}/tr") for _ in range(2)] == [1, 2]
    assert [r["line"] for r in read_appended(spark, f"{tmpdir_path}/tr").orderBy("position").collect()] == ["a", "b", "a", "b"]


def test_appends_keep_their_order(spark, tmpdir_path):
    """Many part files a batch, and appenders at the same time."""
    from concurrent.futures import ThreadPoolExecutor

    path, make = f"{tmpdir_path}/log", "transcript_id long, line_no long, line string"
    batches = [[(t, i, f"{b}/{t}/{i}") for t in range(3) for i in range(1, 200)] for b in range(5)]
    for rows in batches[:2]:
        append_transcript(spark.createDataFrame(rows[::-1], make).repartition(7), path)
    append_transcript(spark.createDataFrame([], make), path)
    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(lambda rows: append_transcript(spark.createDataFrame(rows, make), path), batches[2:]))
    assert sorted(numbers) == [4, 5, 6] and not [n for n in os.listdir(path) if n.startswith("_append")]
    order = [0, 1] + [2 + i for i in sorted(range(3), key=lambda i: numbers[i])]
    got = [(r["position"], r["line"]) for r in read_appended(spark, path).orderBy("position").collect()]
    assert got == list(enumerate(x for b in order for _, _, x in batches[b]))


def test_partitions_follow_what_the_plan_reads(spark, tmpdir_path):
    """A join's estimate is the product of its sides; its inputs are not."""
    from turnframe.session import partitions_for, shuffle_partitions

    spark.range(200_000).selectExpr("id", "uuid() AS v").write.parquet(f"{tmpdir_path}/t")
    side = lambda n: spark.read.parquet(f"{tmpdir_path}/t").withColumnRenamed("v", n)
    joined = side("a").join(side("b"), "id").join(side("c"), "id")
    assert partitions_for(side("a")) == partitions_for(joined) == shuffle_partitions(spark)
    assert partitions_for(spark.createDataFrame([(i,) for i in range(100)], "i long")) < 100


def test_appended_lines_are_read_in_few_partitions(spark, tmpdir_path):
    lines = spark.range(5000).selectExpr("id % 7 AS transcript_id", "id AS line_no", "concat('line ', id) AS line")
    append_transcript(lines, f"{tmpdir_path}/log")
    back = read_appended(spark, f"{tmpdir_path}/log")
    assert len(back.inputFiles()) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r["line"] for r in back.orderBy("position").collect()] == [f"line {i}" for k in range(7) for i in range(k, 5000, 7)]


def test_folders_are_listed_in_few_tasks_and_seldom(spark, tmpdir_path):
    """Exports in many folders: one listing a reader, not a task a folder."""
    from turnframe.sources import exports as E

    for i in range(150):
        _write(f"{tmpdir_path}/in/d{i}/f.txt", f"[1/2/23, 10:00:00] Ann: m{i}\n".encode())
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    tracker, before = spark.sparkContext.statusTracker(), spark.conf.get(setting)
    for route, most in (("whole", 1), ("lines", 2)):
        group = f"listing-{route}-{tmpdir_path}"
        spark.sparkContext.setJobGroup(group, "listing")
        with pytest.MonkeyPatch.context() as m:
            m.setattr(E, "LISTING_TASKS", 40, raising=False)
            parsed = parse_exports(spark, f"{tmpdir_path}/in", route=route)
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        spark.sparkContext.setJobGroup("", "")
        listings = [s.numTasks for s in stages if s is not None and s.numTasks >= 40]
        assert 0 < len(listings) <= most and set(listings) == {40}
        assert parsed.input_files == 150 and parsed.messages.count() == 150
    assert spark.conf.get(setting) == before


def test_counters_of_the_run_that_writes(spark, tmpdir_path):
    from turnframe.plans.exports import parse_exports, write_parsed

    for i in range(4):
        _write(f"{tmpdir_path}/in/f{i}.txt", ("\n".join(f"[1/2/23, 10:00:{k:02d}] {'Meta AI' if k == 3 else 'Ann'}: "
                                              + ("image omitted" if k == 5 else "Sam left" if k == 7 else f"m{k}") for k in range(20))).encode())
    flags = dict(drop_system=True, drop_media=True, strip_edits=True)
    parsed = parse_exports(spark, f"{tmpdir_path}/in", **flags)
    row = write_parsed(parsed.messages, f"{tmpdir_path}/out", parsed.input_files, **flags).first()
    assert row.asDict() == parsed.counters.first().asDict()
    assert (row["input_files"], row["raw_messages"], row["dropped_speaker"], row["dropped_system"], row["dropped_media"], row["written"]) == \
        (4, 80, 4, 4, 4, 68)
    assert spark.read.json(f"{tmpdir_path}/out").count() == 68


def test_lone_cr_line_reader(spark, tmpdir_path):
    _write(f"{tmpdir_path}/cr.txt", _export(50, sep="\r") + b"\r")
    by_lines = sorted(tuple(r) for r in read_export_lines(spark, tmpdir_path).collect())
    whole = sorted(tuple(r) for r in explode_lines(read_exports(spark, tmpdir_path)).collect())
    assert by_lines == whole and len(whole) == 50


def test_same_name_files_order_by_path(spark, tmpdir_path):
    same = H.format(1, "Ann", "x")
    _write(f"{tmpdir_path}/b/chat.txt", (same + "\n" + H.format(2, "Ann", "b2")).encode())
    _write(f"{tmpdir_path}/a-b/chat.txt", (same + "\n" + H.format(2, "Ann", "ab2")).encode())
    _write(f"{tmpdir_path}/a/chat.txt", (same + "\n" + H.format(2, "Ann", "a2")).encode())
    p = parse_exports(spark, tmpdir_path)
    ds = build_dataset(p.turns, chunk_turns=6, prompt_turns=2, stride=6, min_turns=2)
    ordered = [t["source_file"] + ":" + t["text"] for t in ds.windows.first()["turns"]]
    # Ties on (time, base name, line) keep the reference's input order:
    # paths sorted by components, so "a" < "a-b" < "b".
    assert [t.split(":", 1)[1] for t in ordered] == ["x", "x", "x", "a2", "ab2", "b2"]
    paths = [r["source_path"] for r in ds.indexed.orderBy("turn_idx").collect()]
    assert [pth.rsplit("/", 2)[1] for pth in paths] == ["a", "a-b", "b", "a", "a-b", "b"]


def test_turns_file_handoff(spark, tmpdir_path):
    """E1 writes turns as JSON lines, E2 reads them back: same dataset as
    building from the in-memory turns."""
    from turnframe.operators.turns import turns_from_json
    from turnframe.sources.exports import read_jsonl_lines

    text = "\n".join(H.format(i % 60, f"S{i % 4}", f"line {i}\nmore {i}" if i % 5 == 0 else f"line {i}")
                     for i in range(70))
    _write(f"{tmpdir_path}/in/b/chat.txt", text.encode())
    _write(f"{tmpdir_path}/in/a/other.txt", text.replace("line", "row").encode())
    p = parse_exports(spark, f"{tmpdir_path}/in", drop_system=True, drop_media=True, strip_edits=True)
    write_turns(p.turns.repartition(3), f"{tmpdir_path}/turns")
    back = turns_from_json(read_jsonl_lines(spark, f"{tmpdir_path}/turns"))
    assert back.count() == 140
    kw = dict(chunk_turns=20, prompt_turns=8, stride=5, min_turns=6, include_metadata=True, speaker_control=True)
    a = build_dataset(p.turns, **kw).examples
    b = build_dataset(back, **kw).examples  # in the order of input file and line
    cols = ["chunk_index", "messages", "meta", "split"]
    assert sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))


def test_awkward_file_names(spark, tmpdir_path):
    name = f"{tmpdir_path}/sub dir/Chat with Ann é#1 %20 a+b.txt"
    _write(name, (H.format(1, "Ann", "hi") + "\nmore").encode())
    whole = parse_exports(spark, tmpdir_path, route="whole").turns.collect()
    lines = parse_exports(spark, tmpdir_path, route="lines").turns.collect()
    mixed = parse_exports(spark, tmpdir_path, whole_file_limit=1).turns.collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in lines] == [tuple(r) for r in mixed]
    assert whole[0]["source_file"] == "Chat with Ann é#1 %20 a+b.txt"
    assert whole[0]["source_path"].endswith("/sub dir/Chat with Ann é#1 %20 a+b.txt")


def test_clear_staged(spark):
    from turnframe.session import clear_staged, materialize
    df = materialize(spark.range(10), "tmp")
    assert df.count() == 10
    assert clear_staged(spark) >= 1


def test_json_sink_keeps_non_ascii(spark, tmpdir_path):
    turns = spark.createDataFrame([("2023-01-01T00:00:00", "Zoë", "ça va? 😀\nnext", "a.txt", 2, "/x/a.txt")],
                                  "timestamp string, speaker string, text string, source_file string, "
                                  "line_start long, source_path string")
    write_turns(turns, f"{tmpdir_path}/t")
    part = [f for f in os.listdir(f"{tmpdir_path}/t") if f.startswith("part-") and f.endswith(".json")][0]
    raw = open(f"{tmpdir_path}/t/{part}", encoding="utf-8").read()
    assert "Zoë" in raw and "😀" in raw and "\\u" not in raw
    assert json.loads(raw.splitlines()[0]) == {"timestamp": "2023-01-01T00:00:00", "speaker": "Zoë",
                                               "text": "ça va? 😀\nnext", "source_file": "a.txt", "line_start": 2}


def test_split_parts_in_chunk_order(spark, tmpdir_path):
    n = 400
    rows = [(f"2023-01-01T00:{i // 60:02d}:{i % 60:02d}", f"S{i % 3}", f"t{i}", "f.txt", i, i) for i in range(n)]
    turns = spark.createDataFrame(rows, "timestamp string, speaker string, text string, source_file string, "
                                        "line_start long, input_line long")
    ds = build_dataset(turns, chunk_turns=8, prompt_turns=4, stride=2, min_turns=4, include_metadata=True)
    counts = write_splits(ds.examples, f"{tmpdir_path}/ds")
    from turnframe.operators.windows import layout
    assert sum(counts.values()) == layout(n, 8, 2, 4).windows == 199
    parts = sorted(f for f in os.listdir(f"{tmpdir_path}/ds/train") if f.startswith("part-"))
    seen = []
    for f in parts:
        for line in open(f"{tmpdir_path}/ds/train/{f}", encoding="utf-8"):
            seen.append(json.loads(line)["meta"]["chunk_index"])
    assert seen == list(range(counts["train"]))


def test_line_reader_split_boundaries(spark, tmpdir_path):
    """Tiny splits over mixed CRLF / CR / LF endings: every line once, in
    order, with the same numbers as the whole-file reader."""
    import random
    rnd = random.Random(3)
    for i in range(6):
        parts = []
        for _ in range(rnd.randint(50, 200)):
            parts.append("".join(rnd.choice("ab é[]:") for _ in range(rnd.randint(0, 9))))
            parts.append(rnd.choice(["\n", "\r\n", "\r", "\r\n", "\n\n"]))
        _write(f"{tmpdir_path}/f{i}.txt", "".join(parts).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        by_lines = sorted(tuple(r) for r in read_export_lines(spark, tmpdir_path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = sorted(tuple(r) for r in explode_lines(read_exports(spark, tmpdir_path)).collect())
    assert by_lines == whole


def test_minimal_turns_sink(spark, tmpdir_path):
    text = "\n".join(H.format(i, f"S{i % 2}", f"m{i}") for i in range(5))
    _write(f"{tmpdir_path}/in/b.txt", text.encode())
    _write(f"{tmpdir_path}/in/a.txt", text.replace("m", "n").encode())
    p = parse_exports(spark, f"{tmpdir_path}/in", minimal=True)
    write_turns(p.turns.repartition(3), f"{tmpdir_path}/min", minimal=True)
    parts = sorted(f for f in os.listdir(f"{tmpdir_path}/min") if f.startswith("part-"))
    rows = [json.loads(line) for f in parts for line in open(f"{tmpdir_path}/min/{f}", encoding="utf-8")]
    assert [sorted(r) for r in rows] == [["speaker", "text"]] * 10
    # File order (a before b), then line order.
    assert [r["text"] for r in rows] == [f"n{i}" for i in range(5)] + [f"m{i}" for i in range(5)]


def test_byte_order_marks(spark, tmpdir_path):
    """Both readers keep a byte order mark, so a file parses alike on each."""
    bom = "\ufeff".encode()
    bodies = {"none": "", "bom": bom, "bom_lrm": bom + "\u200e".encode(), "two": bom + bom}
    for name, start in bodies.items():
        for end in ("\n", "\r\n", ""):
            text = H.format(1, "Ann", "one") + (end or "\n") + H.format(2, "Bob", "two") + end
            _write(f"{tmpdir_path}/{name}{len(end)}.txt", (start or b"") + text.encode())
    _write(f"{tmpdir_path}/badbytes.txt", bom + b"\xff\n" + H.format(3, "Cy", "x\udc80").encode("utf-8", "replace"))
    whole = sorted(tuple(r) for r in explode_lines(read_exports(spark, tmpdir_path)).collect())
    assert sorted(tuple(r) for r in read_export_lines(spark, tmpdir_path).collect()) == whole
    turns = [sorted(tuple(r) for r in parse_exports(spark, tmpdir_path, **kw).turns.collect())
             for kw in (dict(route="whole"), dict(route="lines"), dict(whole_file_limit=1))]
    assert turns[0] == turns[1] == turns[2]
    by_file = [r[3] for r in turns[0]]
    assert by_file.count("bom1.txt") == 2 and by_file.count("bom_lrm1.txt") == 1


def test_partition_size_setting(spark, tmpdir_path):
    _write(f"{tmpdir_path}/a.txt", _export(20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    try:
        assert read_export_lines(spark, tmpdir_path).count() == 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quarantined_headers(spark, tmpdir_path):
    _write(f"{tmpdir_path}/a.txt", (H.format(1, "Ann", "ok") + "\n[13/45/23, 10:00:00] Bob: bad\nmore").encode())
    p = parse_exports(spark, tmpdir_path, on_bad="quarantine", minimal=True)
    assert [(r["line_start"], r["speaker"], r["text"]) for r in p.rejects.collect()] == [(2, "Bob", "bad\nmore")]
    assert [r["text"] for r in p.turns.collect()] == ["ok"]
    with pytest.raises(Exception, match="unparsable"):
        parse_exports(spark, tmpdir_path, minimal=True).turns.collect()


def test_per_key_splits_are_ordered_by_key(spark, tmpdir_path):
    rows = [(f"2023-01-01T00:00:{i % 60:02d}", "S", f"t{i}", f"f{i % 3}", i, i) for i in range(90)]
    turns = spark.createDataFrame(rows, "timestamp string, speaker string, text string, source_file string, "
                                        "line_start long, input_line long")
    ds = build_dataset(turns, 8, 4, 2, 4, partition_by=["source_file"])
    write_splits(ds.examples, f"{tmpdir_path}/ds")
    names = sorted(f for f in os.listdir(f"{tmpdir_path}/ds/train") if f.startswith("part-"))
    seen = [json.loads(line)["source_file"] for f in names for line in open(f"{tmpdir_path}/ds/train/{f}", encoding="utf-8")]
    assert seen == sorted(seen) and set(seen) == {"f0", "f1", "f2"}


def test_line_reader_scans_and_mixed_ends(spark, tmpdir_path):
    """Files of every line end, mark and bad byte read as whole files are;
    without a lone carriage return the lines come from one scan beside the
    sketch's, without a shuffle."""
    text = "\n".join(f"l{i} ü" for i in range(300)).encode()
    files = {"lf": text, "crlf": text.replace(b"\n", b"\r\n"), "bom": b"\xef\xbb\xbf" + text + b"\n", "bad": b"x\xe2\n\xff\r\n\r\n" + text + b"\xe2\r\n",
             "end": text + b"\r"}
    mixed = {"cr": text.replace(b"\n", b"\r"), "mix": b"a\rb\r\nc\n\rd\r\r\n\xe2\ry" + text + b"\r", "one": b"\r", "bomcr": b"\xef\xbb\xbfa\rb"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for name, data in files.items():
            _write(f"{tmpdir_path}/plain/{name}.txt", data)
        for name, data in {**files, **mixed}.items():
            _write(f"{tmpdir_path}/all/{name}.txt", data)
        for folder in ("plain", "all"):
            lines = read_export_lines(spark, f"{tmpdir_path}/{folder}")
            whole = sorted(tuple(r) for r in explode_lines(read_exports(spark, f"{tmpdir_path}/{folder}")).collect())
            assert sorted(tuple(r) for r in lines.collect()) == whole
            if folder == "plain":
                plan = lines._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
                assert plan.count("FileScan text") == 1 and "Exchange hashpartitioning(value" not in plan and "Window" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
