"""Inference-side operators, rendering and truncation."""

from pyspark.sql import functions as F

from turnframe.functions import constants as C

from turnframe.operators.chat import (context_lines, generated_lines, inference_prompts, tag_lines,
                                      transcript_tail)
from turnframe.operators.render import render_chat, text_tokens, tokenize_truncate


def _pieces(spark, rows):
    return spark.createDataFrame(rows, "transcript_id long, seq long, text string")


def test_context_lines_and_prompts(spark):
    pieces = _pieces(spark, [(1, 0, " a: x \n\n  \nb: y c: z"), (1, 1, "d: w"), (2, 0, " \n ")])
    lines = context_lines(pieces)
    got = sorted(tuple(r) for r in lines.collect())
    assert got == [(1, 1, " a: x "), (1, 2, "b: y"), (1, 3, "c: z"), (1, 4, "d: w")]
    ids = spark.createDataFrame([(1,), (2,)], "transcript_id long")
    p = {r["transcript_id"]: r["messages"] for r in inference_prompts(lines, ids).collect()}
    assert p[1][1]["content"] == ("Group chat transcript so far:\na: x \nb: y\nc: z\nd: w\n\n"
                                  "Continue the conversation naturally. Keep speaker tags in each line: Name: message")
    assert "(empty)" in p[2][1]["content"]
    assert [m["role"] for m in p[1]] == ["system", "user"]
    seeded = {r["transcript_id"]: r["messages"] for r in
              inference_prompts(lines, ids, speaker="Ann", seed_line=" Ann: hey ").collect()}
    assert seeded[2][1]["content"].startswith(
        "Group chat transcript so far:\n" + "Ann: hey" + "\n\nTARGET_SPEAKER=Ann\n")


def test_tail_tag_generated(spark):
    pieces = _pieces(spark, [(1, 0, "\n".join(f"l{i}" for i in range(30)))])
    lines = context_lines(pieces)
    tail = [r["line"] for r in transcript_tail(lines, 20).orderBy("line_no").collect()]
    assert tail == [f"l{i}" for i in range(10, 30)]
    live = spark.createDataFrame([(1, " hello "), (2, "Ann: hi"), (3, "   ")], "i long, line string")
    assert sorted(tuple(r) for r in tag_lines(live).collect()) == [(1, "You: hello"), (2, "Ann: hi")]
    gen = spark.createDataFrame([(1, "  x: 1\n\n y: 2 \n"), (3, "z")], "transcript_id long, generated string")
    got = sorted(tuple(r) for r in generated_lines(gen, lines).collect())
    assert got == [(1, 31, "x: 1"), (1, 32, "y: 2"), (3, 1, "z")]


def test_render_and_tokens(spark):
    df = spark.createDataFrame([(1, [("system", "S"), ("user", "U")])],
                               "id long, messages array<struct<role:string,content:string>>")
    r = df.select(render_chat(F.col("messages")).alias("t"), render_chat(F.col("messages"), True).alias("g")).first()
    assert r["t"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n"
    assert r["g"] == r["t"] + "<|im_start|>assistant\n"
    text = spark.createDataFrame([(1, "Hello, world! ça va?")], "id long, text string")
    full = text_tokens(text, 100, keep=["id"]).first()
    assert full["tokens"] == ["Hello", ",", "world", "!", "ça", "va", "?"]
    assert text_tokens(text, 3).columns == ["tokens"] and text_tokens(text, 3).first()["tokens"] == full["tokens"][:3]
    ids = tokenize_truncate(text, lambda xs: [[len(x), 7, 9] for x in xs], 2, keep=["id"])
    assert ids.columns == ["id", "input_ids", "attention_mask"] and tuple(ids.first()) == (1, [20, 7], [1, 1])


def test_training_and_transcript_plans(spark, tmpdir_path):
    import json
    import os
    from turnframe.plans.training import training_tokens, transcript_prompts

    os.makedirs(f"{tmpdir_path}/ds")
    rows = [{"messages": [{"role": "system", "content": "S"}, {"role": "user", "content": "hello there"},
                          {"role": "assistant", "content": "a: b"}], "meta": {"chunk_index": i}} for i in range(3)]
    with open(f"{tmpdir_path}/ds/train.jsonl", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    with open(f"{tmpdir_path}/ds/val.jsonl", "w") as f:
        f.write(json.dumps(rows[0]) + "\n")
    toks = training_tokens(spark, f"{tmpdir_path}/ds/train.jsonl", lambda xs: [[ord(c) for c in x] for x in xs],
                           f"{tmpdir_path}/ds/val.jsonl", max_length=5)
    got = toks.collect()
    assert sorted(r["split"] for r in got) == ["train", "train", "train", "validation"]
    assert all(len(r["input_ids"]) == 5 and r["attention_mask"] == [1] * 5 for r in got)
    assert set(toks.columns) == {"split", "input_ids", "attention_mask"}

    os.makedirs(f"{tmpdir_path}/tr")
    with open(f"{tmpdir_path}/tr/a.txt", "w", encoding="utf-8") as f:
        f.write("Ann: hi\n\n  \nBob: yo\r\n")
    with open(f"{tmpdir_path}/tr/empty.txt", "w", encoding="utf-8") as f:
        f.write("\n \n")
    p = {os.path.basename(r["transcript_id"]): r for r in transcript_prompts(spark, f"{tmpdir_path}/tr").collect()}
    by_line = {os.path.basename(r["transcript_id"]): r
               for r in transcript_prompts(spark, f"{tmpdir_path}/tr", whole=False).collect()}
    assert by_line["a.txt"]["messages"] == p["a.txt"]["messages"]
    assert p["a.txt"]["messages"][1]["content"].startswith("Group chat transcript so far:\nAnn: hi\nBob: yo\n\n")
    assert "(empty)" in p["empty.txt"]["messages"][1]["content"]
    assert p["a.txt"]["prompt_text"].endswith("<|im_start|>assistant\n")


def test_generated_lines_rounds(spark):
    lines = context_lines(_pieces(spark, [(1, 0, "a: 1\nb: 2")]))
    gen = spark.createDataFrame([(1, 2, " z: 5 \n"), (1, 1, "x: 3\n\ny: 4"), (2, 1, "w: 1")],
                                "transcript_id long, round long, generated string")
    got = sorted(tuple(r) for r in generated_lines(gen, lines, round_col="round").collect())
    assert got == [(1, 3, "x: 3"), (1, 4, "y: 4"), (1, 5, "z: 5"), (2, 1, "w: 1")]
