"""Plans: what stays in the JVM, what shuffles, what is pushed down."""

import re

import pytest

from postsift.operators import dedup, score
from postsift.plans import registry, views as V
from tests.conftest import SF

registry.load()

# the only queries that are allowed to leave the JVM
PYTHON = {
    "similar_pairs", "similar_pairs_blocks", "dedup_semantic", "embed_local", "dedup_semantic_blocks", "enrich_topn", "strip_html_full", "page_cards",
}
RUNS_A_STREAM = {"stream_6h_counts", "stream_dedup", "stream_ingest", "alert_once"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - PYTHON - RUNS_A_STREAM))
def test_stays_in_the_jvm_without_cross_joins(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert not re.search(r"EvalPython|InPandas|MapInArrow", text)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["jobs_top500", "digest_top10", "alerts_top15", "posts_top200", "posts_top20", "count_by_source_top8", "run_top500", "run_top10", "untracked_top30"])
def test_top_k_does_not_sort_everything(spark, name):
    assert "TakeOrderedAndProject" in plan(registry.QUERIES[name](spark, SF))


def test_exact_dedup_shuffles_once_with_partial_aggregation(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet").selectExpr(
        "o_orderkey AS seq", "o_orderpriority AS title", "o_orderstatus AS company", "'' AS location", "CAST(o_totalprice AS INT) AS salary", "true AS easy_apply", "'' AS description")
    text = plan(dedup.dedup_exact(rows, ("seq",)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_min_by" in text


@pytest.mark.parametrize("name,table,scans", [
    ("run_funnel", "orders", 1), ("kpi_analytics", "conversations", 1), ("skill_gap", "orders", 1)])
def test_tables_are_read_once(spark, name, table, scans):
    text = plan(registry.QUERIES[name](spark, SF))
    assert len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", text)) == scans


def test_first_n_limits_before_the_shuffle(spark):
    text = plan(registry.QUERIES["first_n_per_source"](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", text) and re.search(r"WindowGroupLimit .*Final", text)


def test_columns_are_pruned_and_filters_pushed(spark):
    orders = V.table(spark, SF, "orders")
    text = plan(orders.where("o_totalprice > 1000").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
    text = plan(registry.QUERIES["source_rollup"](spark, SF))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert not any("text" in s for s in scans if "doc_id" not in s)
    assert any(s == "o_orderkey:bigint,o_custkey:bigint" for s in scans)


def test_score_is_computed_once_under_a_filter(spark):
    rows = V.postings(spark, SF).selectExpr("*")
    text = plan(score.high_score(score.add_score(rows, V.as_of())).select("id", "score"))
    assert text.count("kubeflow") == 1


def test_spread_follows_the_session(spark):
    from postsift.session import SCAN_TASKS_CONF, spread

    rows = spark.range(10)
    assert "Exchange" not in plan(spread(rows, "id"))
    spark.conf.set(SCAN_TASKS_CONF, "8")
    assert "Exchange" in plan(spread(rows, "id"))
    spark.conf.unset(SCAN_TASKS_CONF)


def test_upsert_into_buckets_moves_the_batch_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from postsift.operators import upsert

    rows = V.postings(spark, SF).where("url <> ''").withColumn("score", F.lit(1))
    stored = dedup.distinct_first(rows, "url", ("id",))
    upsert.write_bucketed(stored, "stored_postings", str(tmp_path / "t"), buckets=8)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        batch = spark.read.parquet(f"{SF}/orders.parquet").selectExpr(
            "o_orderkey AS seq", "concat('https://example.com/p/', o_orderkey) AS url", "CAST(2 AS INT) AS score", "'t' AS title")
        df = upsert.upsert_metadata(spark.table("stored_postings"), batch, ("seq",))
        text = plan(df)
        join = text.index("SortMergeJoin")
        stored_side = text[join:text.index("stored_postings")]
        assert "FullOuter" in text and "Exchange" not in stored_side
        assert df.count() > stored.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE stored_postings")


def test_every_query_names_its_sql_or_a_reason():
    assert set(registry.QUERIES) - set(registry.ORACLE) == set()
