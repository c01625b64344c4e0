"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from postsift.llm import order_minhash, quality_rules, toxicity
from tests.llm.test_decontaminate import plain
from tests.llm.test_order_minhash import plain_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Each stage's stored input and output."""
    root = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        path = os.path.join(root, str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(results):
    assert [n for n, *_ in results] == ["toxicity", "quality rules", "near duplicates", "decontamination", "tokens"]
    for _, before, after in results[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.exceptAll(before).count() == 0


def test_toxicity(spark, results):
    _, before, after = results[0]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == {r.doc_id for r in toxicity.score(before, model).where("predicted = 0").collect()}


def test_quality(results):
    _, before, after = results[1]
    assert ids(after) == {r.doc_id for r in quality_rules.judge(before).where("kept").collect()}
    assert all(not quality_rules.measure(r.text).base_failed for r in after.collect())


def test_near_duplicates(results):
    _, before, after = results[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c, _ in plain_classes(rows)})


def test_decontamination(spark, results):
    _, before, after = results[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after) == {r.doc_id for r in before.collect() if not plain(r.text, items, 10)[0]}


def test_tokens(results):
    _, before, after = results[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_run_applies_all_stages(spark, results):
    assert P.run(spark, SF).exceptAll(results[-1][2]).count() == 0
    assert P.run(spark, SF).count() == results[-1][2].count()


def test_odd_documents(spark, odd_documents):
    docs = odd_documents.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    for frame in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, frame, SF).schema == frame.schema
        assert P.STAGES[-1][1](spark, frame, SF).count() == frame.count()


def test_entry_registers_it():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert sum(n.startswith("op") and n[2].isdigit() for n in entry.queries()) == 10
