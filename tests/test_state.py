"""Upserts, patches, feedback, exports, streams and the whole run."""

import datetime as dt
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postsift import schema as S
from postsift.operators import dedup, enrich, publish, upsert
from postsift.plans import daily
from postsift.streaming import ingest

T_SCHEMA = "id BIGINT, url STRING, title STRING, score INT, notified BOOLEAN, notes STRING"
B_SCHEMA = "seq INT, url STRING, title STRING, score INT"


def sequential_upsert(target, batch, insert_only, updated):
    table = {r["url"]: dict(r) for r in target}
    for row in batch:
        if not row["url"]:
            continue
        if row["url"] in table:
            table[row["url"]].update({c: row[c] for c in updated})
        else:
            table[row["url"]] = {"url": row["url"], "notified": False, "notes": None, **{c: row[c] for c in (*insert_only, *updated)}}
    return sorted((r["url"], r["title"], r["score"], r["notified"], r["notes"]) for r in table.values())


@pytest.mark.parametrize("seed", range(3))
def test_metadata_upsert_is_sequential(spark, seed):
    rng = random.Random(seed)
    target = [dict(id=i, url=f"u{i}", title=f"old{i}", score=rng.randrange(9), notified=rng.random() < 0.5, notes=f"n{i}") for i in range(300)]
    # one url holds a third of the batch
    urls = [f"u{rng.randrange(600)}" if rng.random() < 0.66 else "u7" for _ in range(1500)]
    batch = [dict(seq=i, url=rng.choice([u, u, u, ""]), title=f"new{i}", score=i) for i, u in enumerate(urls)]
    t = spark.createDataFrame([tuple(r.values()) for r in target], T_SCHEMA)
    b = spark.createDataFrame([tuple(r.values()) for r in batch], B_SCHEMA).repartition(5)
    out = upsert.upsert_metadata(t, b, ("seq",))
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in out.drop("id").collect()), key=key)
    assert got == sorted(sequential_upsert(target, batch, ["title"], ["score"]), key=key)
    assert out.schema == t.schema and out.select("id").distinct().count() == out.count()
    again = upsert.upsert_metadata(out, b, ("seq",))
    assert again.exceptAll(out).isEmpty()
    counts = upsert.upsert_counts(t, b).first()
    assert counts.attempted == 1500 and counts.inserted + counts.updated == len({r["url"] for r in batch if r["url"]})


def test_blank_keys(spark):
    t = spark.createDataFrame([], T_SCHEMA)
    b = spark.createDataFrame([(1, "", "a", 1), (2, None, "b", 2), (3, "u", "c", 3)], B_SCHEMA)
    assert upsert.upsert_metadata(t, b, ("seq",)).count() == 1
    assert [r.seq for r in upsert.blank_key_rows(b, "url").collect()] == [1, 2]
    met = {r.url: (r.title, r.score) for r in upsert.upsert_metadata(t, b, ("seq",), blank_key="collide").collect()}
    assert met == {"": ("a", 2), "u": ("c", 3)}
    with pytest.raises(ValueError):
        upsert.upsert_metadata(t, b, ("seq",), blank_key="other")


def test_overwrite(spark):
    t = spark.createDataFrame([(1, "u", "old", 1, True, "mine")], T_SCHEMA)
    b = spark.createDataFrame([(1, "u", "new", 5)], B_SCHEMA)
    assert tuple(upsert.upsert_overwrite(t, b, ("seq",)).first()) == (1, "u", "new", 5, True, "mine")


def test_patches(spark):
    t = spark.createDataFrame([(1, True, False, "a"), (2, True, True, "b")], "id BIGINT, applied BOOLEAN, saved BOOLEAN, notes STRING")
    p = spark.createDataFrame(
        [(1, ["notes"], None, True, None, 1), (2, ["applied"], False, None, "ignored", 1), (2, ["applied", "saved"], None, False, None, 2)],
        S.PATCH + ", seq INT")
    out = {r.id: tuple(r)[1:] for r in upsert.apply_patches(t, p, ("seq",)).collect()}
    assert out == {1: (True, False, None), 2: (None, False, "b")}


def test_feedback(spark):
    at = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, "jobs", True, at), (2, "jobs", True, at)], S.FEEDBACK)
    new = spark.createDataFrame([(1, "jobs", False, at + dt.timedelta(1)), (1, "linkedin_posts", True, at)], S.FEEDBACK)
    got = {(r.job_id, r.source_table): r.liked for r in upsert.upsert_feedback(old, new).collect()}
    assert got == {(1, "jobs"): False, (2, "jobs"): True, (1, "linkedin_posts"): True}


def posting(i, **kw):
    base = dict(seq=i, title=f"Data Engineer {i}", company="Google", location="Remote", salary=160000, url=f"u{i}", source="s", posted_date=dt.datetime(2024, 3, 10, 6),
                easy_apply=True, applicants=3, description="spark kafka", job_type=None)
    return tuple({**base, **kw}.values())


RAW = ("seq BIGINT, title STRING, company STRING, location STRING, salary INT, url STRING, source STRING, posted_date TIMESTAMP_NTZ, easy_apply BOOLEAN, "
       "applicants INT, description STRING, job_type STRING")


def test_whole_run(spark, tmp_path):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")
    a = spark.createDataFrame([posting(1), posting(2, title="data engineer 1 ", salary=None), posting(3, salary=10)], RAW)
    b = spark.createDataFrame([posting(4), posting(5, title="Staff Engineer")], RAW).drop("job_type")
    target = spark.createDataFrame([], S.POSTING)
    first = daily.run([a, b], target, now, ("seq",))
    kept = first.snapshot.orderBy("url").collect()
    assert [r.url for r in kept] == ["u1", "u4"] and all(r.score == 100 and r.notified for r in kept)
    assert [r.URL for r in first.export.orderBy("URL").collect()] == ["u1", "u4"]
    assert first.digest.count() == 2 and first.alerts.count() == 2
    assert first.raw_counts.get == {"rows": 5} and first.filter_counts.get["removed"] == 2
    path = upsert.write_snapshot(first.snapshot, str(tmp_path / "jobs"), 1)
    stored = spark.read.schema(target.schema).parquet(path)
    stored = upsert.mark_notified(stored.withColumn("notified", F.lit(False)), stored.where("url = 'u1'").select("id"))
    second = daily.run([a, b], stored, now, ("seq",), answer=lambda p: pd.Series(['{"score": 9, "skills": ["x"]}'] * len(p)))
    assert second.export.isEmpty() and [r.url for r in second.alerts.collect()] == ["u4"]
    assert {r.url: (r.notified, r.llm_score, r.skills) for r in second.snapshot.collect()} == {"u1": (True, 9, ["x"]), "u4": (True, 9, ["x"])}


def test_run_with_blank_and_repeated_urls(spark):
    """Six rows stay six rows, whatever their URLs, with a model and similarity dedup; those without one come back."""
    now = F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")
    urls = ["", None, "", "same", "same", "u6"]
    rows = [posting(k, url=u) for k, u in enumerate(urls, 1)] + [posting(7, title="Data Engineer 1 again", salary=None, url="u7")]
    vectors = [[float(k == n) for n in range(6)] for k in range(6)] + [[0.99, 0.1, 0.0, 0.0, 0.0, 0.0]]
    raw = spark.createDataFrame([(*r, v) for r, v in zip(rows, vectors)], RAW + ", vec ARRAY<DOUBLE>")
    posts = spark.createDataFrame(
        [(1, "p1", "text", "a@b.example", 60), (2, "p2", "text", "", 90), (3, "", "text", "", 99)], "seq INT, post_url STRING, post_text STRING, contact_email STRING, score INT")
    owned = spark.createDataFrame([("Spark",)], "skill STRING")
    run = daily.run(
        [raw], spark.createDataFrame([], S.POSTING), now, ("seq",), vector="vec", blocking="lsh", bits=4, posts=posts, owned=owned,
        answer=lambda p: pd.Series(['{"score": 9, "skills": ["x"]}'] * len(p)))
    scored = run.scored.collect()
    assert len(scored) == 6 and len({r.row_id for r in scored}) == 6 and all(r.llm_score == 9 for r in scored)
    assert [r.title for r in sorted(scored, key=lambda r: r.row_id)] == [f"Data Engineer {k}" for k in range(1, 7)]
    assert run.rejected.count() == 3
    assert {r.url: r.notified for r in run.snapshot.collect()} == {"same": True, "u6": True}
    assert run.digest.count() == 2 and run.alerts.count() == 6
    assert {r.skill.lower(): r.status for r in run.gap.collect()}.get("spark") == "have"
    stored = run.post_snapshot.collect()
    assert {r.post_url for r in stored} == {"p1", "p2"} and all(str(r.scraped_at) == "2024-03-10 12:00:00" for r in stored)
    assert [r.post_url for r in run.post_alerts.collect()][0] == "p1"
    assert {r.name: r.rows for r in run.summary.collect()} == {"s": 7, "TOTAL RAW": 7, "After filter": 6, "New": 2}
    message = run.message.first().message
    assert "Raw collected: `7`" in message and "After filter:  `6`" in message and "New in DB:     `2`" in message


def test_overwrite_dates_new_rows(spark):
    t = spark.createDataFrame([("u", "old", dt.datetime(2020, 1, 1))], "url STRING, title STRING, scraped_at TIMESTAMP_NTZ")
    b = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "seq INT, url STRING, title STRING")
    at = F.lit("2024-03-10 12:00:00").cast("timestamp_ntz")
    got = {r.url: (r.title, r.scraped_at) for r in upsert.upsert_overwrite(t, b, ("seq",), as_of=at, id_col=None).collect()}
    assert got == {"u": ("a", dt.datetime(2020, 1, 1)), "v": ("b", dt.datetime(2024, 3, 10, 12))}
    assert upsert.upsert_overwrite(t, b, ("seq",), id_col=None).where("scraped_at IS NULL").count() == 0


def test_export_files(spark, tmp_path):
    df = spark.createDataFrame([posting(1), posting(2, salary=0, applicants=0, easy_apply=None), posting(3, url="u1")], RAW).withColumns(
        {"score": F.lit(60), "scraped_at": F.col("posted_date")})
    path = str(tmp_path / "export")
    publish.write_export(df, df.limit(0), path, ("seq",))
    rows = spark.read.option("header", True).csv(path).orderBy("URL").collect()
    assert [tuple(r) for r in rows] == [
        ("Data Engineer 1", "Google", "Remote", "$160,000", "60", "s", "2024-03-10 06:00", "Yes", "3", "u1"),
        ("Data Engineer 2", "Google", "Remote", "N/A", "60", "s", "2024-03-10 06:00", "Unknown", "N/A", "u2")]


def test_failing_model_gives_nulls(spark):
    def answer(prompts):
        if any("Engineer 3" in p for p in prompts):
            raise RuntimeError("no")
        return prompts.map(lambda p: '{"score": 5}')

    df = spark.createDataFrame([posting(i) for i in range(6)], RAW).withColumns({"id": F.col("seq"), "score": F.col("seq").cast("int")})
    got = {r.id: r.llm_score for r in enrich.enrich_top(df, "id", answer, n=4, tasks=2).collect()}
    assert got == {0: None, 1: None, 2: 5, 3: None, 4: 5, 5: 5}


# -- streams ------------------------------------------------------------------
def land(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, name))


def test_stream_upsert_twice(spark, tmp_path):
    schema = "seq INT, url STRING, title STRING, score INT"
    source, root, first_log = (str(tmp_path / n) for n in ("in", "out", "log"))
    target = spark.createDataFrame([], "id BIGINT, url STRING, title STRING, score INT, notified BOOLEAN").schema

    def go(log=first_log, path=source + "/*"):
        rows = ingest.read_files(spark, path, schema)
        ingest.run_available(rows, log, batch=ingest.upsert_batches(root, target, ("seq",), stream=log, buckets=4))
        return {r.url: (r.title, r.score) for r in ingest.read_snapshot(spark, root, target).collect()}

    land(spark, source, "a", [(1, "u", "first", 1), (2, "v", "first", 1), (3, "u", "late", 2)], schema)
    assert go() == {"u": ("first", 2), "v": ("first", 1)}
    version = ingest.latest_version(spark, root)
    assert go() and ingest.latest_version(spark, root) == version  # nothing new landed
    land(spark, source, "b", [(4, "u", "again", 9), (5, "w", "new", 3)], schema)
    want = {"u": ("first", 9), "v": ("first", 1), "w": ("new", 3)}
    assert go() == want
    # a batch that is committed is not applied again
    batch = spark.createDataFrame([(4, "u", "again", 9), (5, "w", "new", 3)], schema)
    version = ingest.latest_version(spark, root)
    ingest.upsert_batches(root, target, ("seq",), stream=first_log, buckets=4)(batch, 1)
    assert ingest.latest_version(spark, root) == version
    # a new checkpoint goes on from what is stored, though its batches count from 0
    land(spark, str(tmp_path / "more"), "c", [(6, "x", "other", 5)], schema)
    assert go(str(tmp_path / "log2"), str(tmp_path / "more") + "/*") == want | {"x": ("other", 5)}


def test_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path)
    schema = spark.createDataFrame([], "id BIGINT, url STRING, title STRING, score INT, notified BOOLEAN").schema
    rows = spark.createDataFrame([(k, f"u{k}", "t", 1) for k in range(200)], "seq INT, url STRING, title STRING, score INT")

    def put(batch, n, **how):
        return ingest.write_upsert(batch, root, schema, ("seq",), buckets=16, stream="s", batch_id=n, **how)

    assert put(rows, 0) and not put(rows, 0)
    assert put(rows.where("seq = 7").withColumn("score", F.lit(5)), 1)
    assert len(os.listdir(os.path.join(root, "data", f"v={1:020d}"))) >= 16
    second = [n for n in os.listdir(os.path.join(root, "data", f"v={2:020d}")) if n.startswith("_bucket")]
    assert len(second) == 1
    stored = ingest.read_snapshot(spark, root, schema)
    assert stored.count() == 200 and stored.where("score = 5").count() == 1
    # a write without a record is not read, and a later batch takes its version
    rows.withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(os.path.join(root, "data", f"v={3:020d}"))
    assert ingest.read_snapshot(spark, root, schema).count() == 200
    assert put(rows.where("seq = 7").withColumn("score", F.lit(6)), 2, keep=1)
    assert ingest.read_snapshot(spark, root, schema).where("score = 6").count() == 1
    # nothing that the last record does not name is kept
    kept = [n for v in os.listdir(os.path.join(root, "data")) for n in os.listdir(os.path.join(root, "data", v)) if n.startswith("_bucket")]
    assert len(kept) == 16 and len(os.listdir(os.path.join(root, "commits"))) == 1
    assert put(rows.limit(0), 3) and ingest.read_snapshot(spark, root, schema).count() == 200


SNAPSHOT = "id BIGINT, url STRING, title STRING, score INT, notified BOOLEAN"


@pytest.mark.parametrize("keep", [1, 50])
def test_two_writers_lose_no_row(spark, tmp_path, keep):
    """Both write many batches to one root, partly into the same buckets; all rows and the last scores are there."""
    root, schema = str(tmp_path), spark.createDataFrame([], SNAPSHOT).schema

    def run(who):
        for n in range(4):
            rows = [(n, f"{who}{n}", "t", n), (n, f"{who}", "t", n)]
            batch = spark.createDataFrame(rows, "seq INT, url STRING, title STRING, score INT").coalesce(1)
            assert ingest.write_upsert(batch, root, schema, ("seq",), buckets=2, stream=who, batch_id=n, keep=keep)
            assert not ingest.write_upsert(batch, root, schema, ("seq",), buckets=2, stream=who, batch_id=n, keep=keep)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(run, "ab"))
    got = {r.url: r.score for r in ingest.read_snapshot(spark, root, schema).collect()}
    assert got == {f"{w}{n}": n for w in "ab" for n in range(4)} | {"a": 3, "b": 3}
    assert ingest.latest_version(spark, root) == 8 and len(os.listdir(os.path.join(root, "commits"))) == min(keep, 8)


def test_a_record_is_put_once(spark, tmp_path):
    """On local files, and through Hadoop's rename on a store of another scheme."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.records.link./store", f"file://{tmp_path}")
    for root in (str(tmp_path / "local"), "viewfs://records/store/other"):
        path = f"{root}/commits/v=1"
        with ThreadPoolExecutor(4) as pool:
            done = list(pool.map(lambda n: ingest._put_if_absent(spark, path, f"text {n}"), range(4 if root[0] == "/" else 1)))
        assert sum(done) == 1 and not ingest._put_if_absent(spark, path, "late")
        text = (tmp_path / ("local" if root[0] == "/" else "other") / "commits" / "v=1").read_text()
        assert text == f"text {done.index(True)}"


def test_writers_of_other_buckets_need_no_second_write(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path), spark.createDataFrame([], SNAPSHOT).schema
    rows = spark.createDataFrame([(k, f"u{k}", "t", 1) for k in range(40)], "seq INT, url STRING, title STRING, score INT")
    one, other = (rows.where(ingest.bucket_of("url", 4) == b) for b in (1, 2))
    commit, writes = ingest._commit, []

    def late(spark, root, done, keep):  # another writer is faster, just before the record
        monkeypatch.setattr(ingest, "_commit", commit)
        assert ingest.write_upsert(other, root, schema, ("seq",), buckets=4, stream="other", batch_id=0)
        return commit(spark, root, done, keep)

    def counted(target, batch, order_by):
        writes.append(1)
        return ingest.upsert_metadata(target, batch, order_by)

    monkeypatch.setattr(ingest, "_commit", late)
    assert ingest.write_upsert(one, root, schema, ("seq",), buckets=4, stream="one", batch_id=0, upsert=counted)
    assert ingest.read_snapshot(spark, root, schema).count() == one.count() + other.count() > 0
    assert len(writes) == 1 and ingest.latest_version(spark, root) == 2


def test_a_writer_that_dies_before_its_record_leaves_nothing(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path), spark.createDataFrame([], SNAPSHOT).schema
    batch = spark.createDataFrame([(1, "u", "t", 1)], "seq INT, url STRING, title STRING, score INT")
    put = lambda n: ingest.write_upsert(batch.withColumn("score", F.lit(n)), root, schema, ("seq",), buckets=2, stream="s", batch_id=n, keep=2)
    assert put(0)
    with monkeypatch.context() as broken:
        broken.setattr(ingest, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            put(1)
    assert ingest.read_snapshot(spark, root, schema).first().score == 0
    assert all(put(n) for n in range(1, 5)) and ingest.read_snapshot(spark, root, schema).first().score == 4
    # what the dead one wrote is gone once no writer can be at work on it
    left = [n for v in os.listdir(os.path.join(root, "data")) for n in os.listdir(os.path.join(root, "data", v)) if n.startswith("_bucket")]
    assert len(left) == 2


def test_alerts_once(spark, tmp_path):
    root, sink = str(tmp_path / "state"), str(tmp_path / "sent")
    send = ingest.alert_once_batches(root, sink, stream="one")
    first = spark.createDataFrame([("a", 90), ("b", 10)], "url STRING, score INT")
    second = spark.createDataFrame([("a", 95), ("b", 60), ("c", 70)], "url STRING, score INT")
    for batch, number in ((first, 0), (first, 0), (second, 1), (second, 1)):
        send(batch, number)
    ingest.alert_once_batches(root, sink, stream="a new checkpoint")(second, 0)
    assert sorted((r.url, r.score) for r in spark.read.parquet(sink).collect()) == [("a", 90), ("b", 60), ("c", 70)]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts TIMESTAMP, source STRING"
    path, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    day = dt.datetime(2024, 3, 1)

    def go():
        counts = ingest.counts_per_run(ingest.read_files(spark, path + "/*", schema), "ts", "source", late=ingest.LATE)
        ingest.run_available(counts, log, sink=sink)
        return {(r.run_start.day, r.run_start.hour): r.rows for r in spark.read.parquet(sink).collect()}

    land(spark, path, "a", [(day, "s"), (day + dt.timedelta(hours=1), "s"), (day + dt.timedelta(days=5), "s")], schema)
    assert go() == {(1, 0): 2}
    land(spark, path, "b", [(day, "s"), (day + dt.timedelta(days=9), "s")], schema)  # the first row is late
    assert go() == {(1, 0): 2, (6, 0): 1}


def test_stream_dedup_over_runs(spark, tmp_path):
    schema = "url STRING, ts TIMESTAMP"
    path, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    day = dt.datetime(2024, 3, 1)

    def go():
        ingest.run_available(ingest.dedup_stream(ingest.read_files(spark, path + "/*", schema), "url", "ts"), log, sink=sink)
        return sorted(r.url for r in spark.read.parquet(sink).collect())

    land(spark, path, "a", [("u", day), ("u", day), ("v", day)], schema)
    assert go() == ["u", "v"]
    land(spark, path, "b", [("u", day + dt.timedelta(hours=1)), ("w", day)], schema)
    assert go() == ["u", "v", "w"]


def test_conform(spark):
    df = spark.createDataFrame([(1, ["NY", "LA"], "12", "x", dt.date(2024, 3, 1))], "id INT, location ARRAY<STRING>, salary STRING, applicants STRING, posted_date DATE")
    out = S.conform(df, S.POSTING)
    assert out.schema.simpleString() == spark.createDataFrame([], S.POSTING).schema.simpleString()
    row = out.first()
    assert (row.id, row.location, row.salary, row.applicants, row.posted_date, row.notes) == (1, "NY, LA", 12, None, dt.datetime(2024, 3, 1), None)


def test_canonical_types(spark):
    from postsift.plans import views as V
    from postsift.sources import feeds, prose
    from tests.conftest import SF

    feed = feeds.normalize_feed(V.feed_payloads(spark, SF, "Dice"), feeds.FEEDS["Dice"], V.as_of())
    assert set(S.FEED_COLUMNS) <= set(feed.columns)
    social = prose.extract_social_posts(V.posts(spark, SF), V.as_of())
    profiles = prose.extract_profiles(V.table(spark, SF, "documents"), "doc_id", "text")
    for df, ddl in ((feed, S.POSTING), (social, S.SOCIAL_POST), (profiles, S.PROFILE)):
        want = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], ddl).schema}
        assert [f.name for f in df.schema if f.name in want and want[f.name] != f.dataType.simpleString()] == []
    moved = spark.createDataFrame([(1, "offer")], S.STAGE)
    assert moved.columns == ["job_id", "status"]


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "i INT, s STRING"), spark.createDataFrame([(2, True)], "i INT, f BOOLEAN")
    assert sorted(map(tuple, dedup.union_sources(a, b).collect())) == [(1, "x", None), (2, None, True)]
