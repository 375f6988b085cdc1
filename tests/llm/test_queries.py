"""The registered queries as they run in production, over small whole tables, and the pipeline over odd ones."""

import zlib

import pytest

pytest.importorskip("motionlake.llm")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from motionlake.llm import queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name,parts,rest,label", [("op4_quality", 4, 2, "quality"), ("op5_toxicity", 3, 1, "toxic")])
def test_scores_and_their_split(spark, documents, name, parts, rest, label):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert got.keys() == documents.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % parts == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_no_label_of_the_held_out_part_is_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = toxicity.labelled_sample(docs, labels, "toxic", queries.remainder(3) != 1, 10_000, "doc_id", "text").collect()
    assert seen and not [r.doc_id for r in seen if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    few = toxicity.labelled_sample(docs.unionByName(docs), labels, "toxic", F.lit(True), 5, "doc_id", "text")
    assert few.count() == 5  # rows that repeat an id count once


def test_chat_query_has_the_extra_conversation(spark):
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, SF).collect()}
    r = got[-1]
    assert r.n_turns == 2 and r.loss_chars == len("</s>[INST] ok [/INST]")
    import hashlib

    turns = "user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n"
    assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_token_query(spark, documents):
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, SF).collect()}
    assert all(r.n_bytes == len(documents[i].encode()) and r.over_limit == (r.n_tokens > 4096) for i, r in got.items())


def test_other_queries_cover_their_tables(spark, documents):
    for name in ("op1_ngram_jaccard", "op6_secret_scan", "op7_exact_dedup"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(documents)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert queries.op8_html_text(spark, SF).where("n_chars = length(text)").count() == pages.count()


ODD = [
    (1, "Alpha beta gamma delta", "en", "src1", "x"), (2, "alpha BETA gamma delta", None, None, "y"), (3, None, "fr", "odd", None), (4, "", "en", "src2", "z"),
    (None, "lone words here now", "de", "src3", None), (7, "long " * 5000, "en", "src1", None), (7, "long " * 5000, "en", "src1", None), (9, " \t\n", "es", "", None),
]


def test_pipeline_over_odd_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, key string, node string, comp int"
    odd = spark.createDataFrame([(*r, "n", None) for r in ODD], schema)
    want = {"toxicity": [1, 2, 3, 4, None, 7, 7, 9]} | dict.fromkeys(["exact_dedup", "ngram_jaccard", "decontamination"], [2, 4, None, 7, 9])
    for docs in (odd, odd.limit(0)):
        empty = docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.schema == docs.schema
            rows = out.collect()
            assert sorted(map(str, (r.doc_id for r in rows))) == ([] if empty else sorted(map(str, want[name])))
            docs = spark.createDataFrame(rows, schema)
        mixed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
        assert mixed <= (set() if empty else {2, 4, None, 7, 9})
