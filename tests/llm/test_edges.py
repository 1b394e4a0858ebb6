"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import decontam, html_extract, langid, mixing, simhash, suffix_dedup, tiff, tokencount, toxicity, warc

LONG = ("lorem ipsum dolor sit amet consectetur " * 3000).strip()
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (None, "a text without an id but with quite a few words in it so that it is long enough", "en", "b", 3),
    (None, None, None, None, None),
    (5, LONG, "en", "b", len(LONG)),
    (6, "\u0000 ퟿ é 1234 !!!", "fr", "c", 5),
    (7, "\n\t  \r\n", "de", "c", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "target", "score", "uid", "fp", "hash", "key", "rank", "label", "toxic", "part", "digest", "words", "item_id", "host", "path", "k", "n", "__key", "__run", "__uid", "__id", "__chunk", "__n", "__start", "__place", "__text", "__bad_id"]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A data folder with the odd rows, and one with empty tables."""
    out = []
    for rows in (ROWS, []):
        folder = tmp_path_factory.mktemp("sf")
        frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        labels = [(1, 1, 0), (4, 1, 0), (6, 1, 0), (7, 1, 0), (2, 1, 1), (2, 1, 1), (None, 0, 1), (5, None, None)] if rows else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).write.parquet(f"{folder}/labels.parquet")
        bench = [(1, "the lazy dog near the river bank today"), (2, None), (3, ""), (None, "lorem")] if rows else []
        spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{folder}/benchmark.parquet")
        pages = [(1, "http://a.com/x", "<p>a</p>"), (1, "http://a.com/x", "<p>a</p>"), (2, None, None), (None, "::", ""), (3, "http://a.com", "<div" + "<p>long text " * 2000)] if rows else []
        spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit("x")).withColumn("host", F.lit("y")).write.parquet(f"{folder}/pages.parquet")
        out.append(str(folder))
    return out


QUERIES = {
    "op1": mixing.op1_mixing,
    "op2": langid.op2_langid,
    "op3": tokencount.op3_token_counts,
    "op4": suffix_dedup.op4_suffix_dedup,
    "op5": warc.op5_warc,
    "op6": simhash.op6_simhash,
    "op7": html_extract.op7_html,
    "op8": tiff.op8_tiff,
    "op10": toxicity.op10_toxicity,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_keep_every_row(spark, tables, name):
    n = 5 if name in ("op5", "op7") else len(ROWS)
    assert QUERIES[name](spark, tables[0]).count() == n
    assert QUERIES[name](spark, tables[1]).count() == 0


def test_decontamination_rows(spark, tables):
    assert {(r.doc_id, r.item_id) for r in decontam.op9_decontamination(spark, tables[0]).collect()} == {(1, 1), (2, 1)}
    assert decontam.op9_decontamination(spark, tables[1]).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, tables, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    out = stage(spark, docs, tables[0])
    assert set(SCHEMA.replace(" long", "").replace(" string", "").split(", ")) <= set(out.columns)
    assert out.count() > 0
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert stage(spark, spark.read.parquet(f"{tables[1]}/documents.parquet"), tables[1]).count() == 0


def test_defined_results(spark, tables):
    mixed = {r.doc_id: r for r in mixing.op1_mixing(spark, tables[0]).collect()}
    assert mixed[3].size == 0 and mixed[3].taken == 0 and mixed[4].taken == 0
    langs = {r.doc_id: r.lang_pred for r in langid.op2_langid(spark, tables[0]).collect()}
    assert langs[3] == langs[4] == langs[7] == "und" and langs[1] != "und"
    tokens = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.op3_token_counts(spark, tables[0]).collect()}
    assert tokens[3] == tokens[4] == (0, 0, False) and tokens[5][2]
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.op4_suffix_dedup(spark, tables[0]).collect()}
    assert cut[1] == (70, 0, 0) and cut[2] == (70, 70, 1) and cut[3] == (0, 0, 0)
    near = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, tables[0]).collect()}
    assert near[3] == near[4] == near[7] == ("0" * 16, 3) and near[2][1] == 1
    toxic = {r.doc_id: r for r in toxicity.op10_toxicity(spark, tables[0]).collect()}
    assert toxic[3].score == toxic[4].score and all(0 <= r.score <= 1 for r in toxic.values())
    media = {r.doc_id: r for r in tiff.op8_tiff(spark, tables[0]).collect()}
    assert media[3].payload_bytes == 576 and media[3].media_sha256 == media[4].media_sha256


def test_near_dedup_keeps_one_row_per_group(spark):
    kept = simhash.keep_one(frame(spark)).select("doc_id", "text").collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept)
    assert ids == [(False, 1), (False, 3), (False, 5), (False, 6), (True, 0)]
    assert len({r.text for r in kept}) == len(kept)


def test_pipeline_runs(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 0
    assert corpus_pipeline.run(spark, tables[1]).count() == 0
