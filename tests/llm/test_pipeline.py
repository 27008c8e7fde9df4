"""The pipeline's stages against brute-force versions of their rules, on the small tables."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabflow.llm.catalog import vocabulary_file
from test_sets import brute_components, brute_contamination

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out, where = [docs.toPandas()], tmp_path_factory.mktemp("stages")
    for name, fn in corpus_pipeline.STAGES:
        path = str(where / name)
        fn(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def rows(pdf):
    return [(int(i), t) for i, t in zip(pdf.doc_id, pdf.text)]


def test_language_stage_drops_texts_without_letters(stages):
    want = {i for i, t in rows(stages[0]) if t and any(c.isalpha() for c in t)}
    assert set(stages[1].doc_id) == want and list(stages[1].columns) == list(stages[0].columns)


def test_jaccard_stage_keeps_the_smallest_id_of_each_group(stages):
    want = {c for _, _, c in brute_components(rows(stages[1]))}
    assert set(stages[2].doc_id) == want and list(stages[2].columns) == list(stages[0].columns)


def test_decontamination_stage(stages, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r[0] for r in brute_contamination(rows(stages[2]), items) if not r[4]}
    assert set(stages[3].doc_id) == want


def test_secret_stage_masks_and_keeps_rows(stages):
    before, after = dict(rows(stages[3])), dict(rows(stages[4]))
    assert set(before) == set(after)
    for i, t in before.items():
        assert after[i] == re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", t)
    assert (stages[4].n_chars == stages[4].text.str.len()).all()


def test_last_stage_encodes_the_masked_texts(stages):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=vocabulary_file())
    texts = dict(rows(stages[4]))
    assert set(stages[5].doc_id) == set(texts)
    for r in stages[5].itertuples():
        ids = [lib.bos_id()] + lib.encode(texts[r.doc_id]) + [lib.eos_id()]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)


def test_run_equals_the_stages(stages, spark):
    out = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    assert sorted(map(tuple, out[["doc_id", "ids_sha256"]].values.tolist())) == \
        sorted(map(tuple, stages[5][["doc_id", "ids_sha256"]].values.tolist()))


def test_language_stage_without_any_label(spark, stages):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, unlabelled, SF_SMALL)
    assert {r.doc_id for r in kept.collect()} == set(stages[1].doc_id) and kept.columns == docs.columns


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs, SF_SMALL).count() == 0
