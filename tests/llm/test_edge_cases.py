"""Odd rows and empty tables through every operator and stage."""

import pytest
from pyspark.sql import functions as F

from turnframe.llm import pipeline as P
from turnframe.llm.decontaminate import find_contamination
from turnframe.llm.html_text import extract_pages
from turnframe.llm.jaccard_join import near_duplicates
from turnframe.llm.langid import identify, train as train_langid
from turnframe.llm.mixing import mix_sources
from turnframe.llm.ngram_lm import score_texts
from turnframe.llm.quality_model import grade_documents, train as train_quality
from turnframe.llm.quality_rules import apply_rules
from turnframe.llm.substring_dedup import EMPTY_SHA, remove_repeats
from turnframe.llm.token_files import token_files

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark, rows=((1, 1, 0), (2, 0, 1), (6, 0, 0), (None, 1, 0), (8, None, None), (8, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def _benchmark(spark, rows=((1, "one two"), (None, "word word"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


RUNS = {
    "rules": lambda s, d: apply_rules(d),
    "mix": lambda s, d: mix_sources(d),
    "contamination": lambda s, d: find_contamination(d, _benchmark(s)),
    "language": lambda s, d: identify(d, train_langid(d)),
    "quality": lambda s, d: grade_documents(d, train_quality(d, _labels(s))),
    "jaccard": lambda s, d: near_duplicates(d),
    "repeats": lambda s, d: remove_repeats(d),
    "model": lambda s, d: score_texts(d, F.col("doc_id") % 2 == 0),
    "tokens": lambda s, d: token_files(d, TOKENIZER),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_result_a_row(spark, odd_docs, no_docs, name):
    out = RUNS[name](spark, odd_docs).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in out), key=key) == sorted((r["doc_id"] for r in odd_docs.collect()), key=key)
    assert RUNS[name](spark, no_docs).collect() == []


def test_defined_results(spark, odd_docs):
    rules = {r["doc_id"]: r for r in apply_rules(odd_docs).collect()}
    assert rules[3]["n_words"] == 0 and rules[3]["base_failed"] and not rules[3]["kept"]
    assert rules[11]["n_repeat_words"] == 200 and rules[11]["base_failed"]
    assert rules[9]["word_chars"] == 70_000
    mix = mix_sources(odd_docs).collect()
    assert all(r["taken"] == 0 for r in mix if r["size"] == 0)
    found = {r["doc_id"]: r for r in find_contamination(odd_docs, _benchmark(spark)).collect()}
    assert found[6]["n_hit"] == 2 and found[6]["items"] == ["1"] and found[6]["contaminated"]
    assert found[11]["n_hit"] == 200 and found[11]["items"] == [] and found[3]["n_words"] == 0
    near = {r["doc_id"]: r for r in near_duplicates(odd_docs).collect()}
    assert near[3]["n_shingles"] == near[4]["n_shingles"] == near[5]["n_shingles"] == 0
    assert near[2]["component_id"] == 1 and near[13]["component_id"] == 1 and near[6]["n_shingles"] == 1
    gone = remove_repeats(odd_docs).collect()
    assert all(r["n_removed"] == 0 for r in gone if r["doc_id"] in (None, 1, 13))
    assert all((r["n_removed"], r["kept_sha256"]) == (80, EMPTY_SHA) for r in gone if r["doc_id"] == 2)
    lang = {r["doc_id"]: r for r in identify(odd_docs, train_langid(odd_docs)).collect()}
    assert all((lang[i]["lang_pred"], lang[i]["score"]) == ("und", 0.0) for i in (3, 4, 5, 7, 12))


@pytest.mark.parametrize("stage", [f for f in (P.quality_stage, P.near_duplicate_stage, P.decontamination_stage, P.mixing_stage,
                                               P.token_stage)])
def test_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path, stage):
    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    _benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    shape = lambda d: d.withColumn("n_chars", F.length("text").cast("long"))
    out = stage(spark, shape(odd_docs), str(tmp_path))
    out.collect()
    if stage is not P.token_stage:
        assert out.columns == P.COLUMNS
    assert stage(spark, shape(no_docs), str(tmp_path)).collect() == []


def test_untrained_models(spark, odd_docs):
    none = _labels(spark, [(1, None, None)])
    assert all(r["kept"] for r in grade_documents(odd_docs, train_quality(odd_docs, none)).collect())
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(odd_docs, train_langid(unlabelled)).collect()} == {"und"}
    for r in score_texts(odd_docs, F.lit(False)).collect():
        assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] <= 0


def test_pages(spark):
    rows = [(1, "u", "<article><p>Fish &amp;  chips\n are<br>good.</p></article>", 3), (1, "u", None, 3), (None, None, "", 3),
            (2, "v", "<p" * 50_000, 3), (3, "w", "<article><p>" + "word " * 50_000 + "</p></article><script>x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    out = extract_pages(pages).collect()
    assert [r["text"] for r in out][:3] == ["Fish & chips are good.", "", ""]
    assert out[4]["n_chars"] == 50_000 * 5 - 1
    assert extract_pages(pages.where("page_id > 9")).collect() == []
