"""Each stage of the pipeline against a plain version of it, on its own input."""

import base64
import hashlib

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from linkcensus.llm import langid, toxicity
from linkcensus.llm.common import remainder
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    start = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("kept"))
    docs, seen = start, {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, SF)
        assert name == "byte_bpe" or out.columns == start.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before.select("doc_id", "text").collect(), {r.doc_id for r in docs.select("doc_id").collect()}

    rows, kept = seen["toxicity"]
    model = toxicity.train(start.filter(remainder("doc_id", 5) != 0), spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r.doc_id for r, s in zip(rows, model.scores(pa.array([r.text for r in rows])), strict=True) if s < 0.5}

    rows, kept = seen["language_id"]
    own = spark.read.parquet(f"{tmp_path}/toxicity")
    names, scores = langid.train(own.filter(remainder("doc_id", 5) != 0)).predict([r.text for r in rows])
    assert kept == {r.doc_id for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE}

    rows, kept = seen["near_duplicates"]
    assert kept == {component for _, component in brute([(r.doc_id, r.text) for r in rows]).values()}

    rows, kept = seen["decontamination"]
    passages = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert kept == {r.doc_id for r in rows if not any(p in r.text for p in passages)}

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in docs.collect()}
    for r in seen["byte_bpe"][0]:
        assert got[r.doc_id].ids == library.encode_ordinary(r.text)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_stages_keep_the_values_of_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("kept"), "lang_pred": F.lit(7)})
    for name, stage in corpus_pipeline.STAGES[:2]:
        rows = stage(spark, docs, SF).select("score", "lang_pred").distinct().collect()
        assert [tuple(r) for r in rows] == [("kept", 7)], name
