"""Queries: upserts, patches, notification state, feedback and enrichment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from postsift import schema as S

from postsift.operators import board, dedup, enrich, publish, upsert
from postsift.plans import oracle as O, views as V
from postsift.plans.q_board import stages
from postsift.plans.q_core import _UNIQUE, scored
from postsift.plans.registry import query
from postsift.session import cut_lineage

# Older orders are what is stored, newer ones the batch that arrives.
_CUT = "TIMESTAMP '1998-04-01 00:00:00'"
_SCORE = "CAST((id * 7) % 101 AS INT)"


def _rows(spark, sf):
    """Postings with the digests of their descriptions: what is stored names its text, which stays in the documents."""
    return V.postings(spark, sf).withColumns({
        "description": F.md5("description"),
        "score": F.expr(_SCORE), "skills": F.array("source"), "llm_reason": F.lit(None).cast("string"), "llm_summary": F.lit(None).cast("string"),
        "role_category": F.lit("data_engineer"), "notes": F.concat(F.lit("n"), "id"),
    })


def _cut():
    return F.lit("1998-04-01 00:00:00").cast("timestamp_ntz")


def target(spark, sf):
    old = _rows(spark, sf).where(F.col("scraped_at") < _cut())
    return dedup.distinct_first(old, "url", ("id",))


def batch(spark, sf):
    return _rows(spark, sf).where(F.col("scraped_at") >= _cut())


_OLD_NEW = f"""{O.P}, r AS (SELECT *, {_SCORE} AS score, 'n' || id AS notes FROM p),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM r WHERE scraped_at < {_CUT} AND url <> '') WHERE rn = 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS up, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS down FROM r WHERE scraped_at >= {_CUT}),
    bf AS (SELECT * FROM b WHERE up = 1 AND url <> ''), bl AS (SELECT * FROM b WHERE down = 1 AND url <> '')"""
_OUT = ("url", "title", "company", "salary", "score", "llm_score", "posted_date", "easy_apply", "applicants", "job_type", "scraped_at", "notified", "applied", "saved", "notes")


def _upsert_sql(updated, first, body="FROM t FULL JOIN bl ON t.url = bl.url LEFT JOIN bf ON bl.url = bf.url") -> str:
    def cell(c):
        if c == "url":
            return "coalesce(t.url, bl.url) AS url"
        if c in updated:
            return f"CASE WHEN bl.url IS NOT NULL THEN bl.{c} ELSE t.{c} END AS {c}"
        if c in first:
            return f"CASE WHEN t.url IS NOT NULL THEN t.{c} ELSE bf.{c} END AS {c}"
        other = {"notes": "NULL", "scraped_at": f"TIMESTAMP '{V.AS_OF}'"}.get(c, "false")
        return f"CASE WHEN t.url IS NOT NULL THEN t.{c} ELSE {other} END AS {c}"

    md5 = "md5(CASE WHEN bl.url IS NOT NULL THEN bl.description ELSE t.description END) AS description"
    return O.with_(_OLD_NEW, f"SELECT {', '.join(cell(c) for c in _OUT)}, {md5} {body}")


def _show(df):
    return df.select(*_OUT, "description")


@query("upsert_metadata", _upsert_sql(S.METADATA_UPDATED, S.METADATA_INSERT_ONLY))
def upsert_metadata(spark, sf):
    return _show(upsert.upsert_metadata(target(spark, sf), batch(spark, sf), ("id",)))


@query("upsert_overwrite", _upsert_sql(S.OVERWRITE_POSTING, ()))
def upsert_overwrite(spark, sf):
    return _show(upsert.upsert_overwrite(target(spark, sf), batch(spark, sf), ("id",), as_of=V.as_of()))


@query("upsert_counts", O.with_(_OLD_NEW, """SELECT (SELECT count(*) FROM b) AS attempted, (SELECT count(*) FROM bl WHERE url NOT IN (SELECT url FROM t)) AS inserted,
    (SELECT count(*) FROM bl WHERE url IN (SELECT url FROM t)) AS updated"""))
def upsert_counts(spark, sf):
    return upsert.upsert_counts(target(spark, sf), batch(spark, sf))


@query("blank_keys", O.with_(_OLD_NEW, "SELECT id FROM b WHERE url = ''"))
def blank_keys(spark, sf):
    return upsert.blank_key_rows(batch(spark, sf), "url").select("id")


@query("upsert_posts", O.with_(O.SOCIAL, """, tp AS (SELECT * FROM sp WHERE seq // 1000 < (SELECT max(conv_id) / 2 FROM conversations)),
    bp AS (SELECT * REPLACE (CAST(score + 1 AS INT) AS score) FROM sp)
    SELECT coalesce(tp.post_url, bp.post_url) AS post_url, bp.author_name, bp.score, CASE WHEN tp.post_url IS NULL THEN TIMESTAMP '2001-08-01 06:00:00' END AS scraped_at, coalesce(tp.seq = tp.seq AND (tp.seq // 1000) % 2 = 0, false) AS saved FROM tp RIGHT JOIN bp ON tp.post_url = bp.post_url WHERE bp.post_url <> ''""").replace("\n, tp AS", ", tp AS"))
def upsert_posts(spark, sf):
    from postsift.plans.q_sources import social

    posts = social(spark, sf)
    half = V.table(spark, sf, "conversations").select(F.max("conv_id") / 2).scalar()
    conv = F.floor(F.col("seq") / 1000)
    stored = posts.where(conv < half).where(F.col("post_url") != "").select(
        F.xxhash64("post_url").alias("id"), *[c for c in posts.columns if c != "seq"], F.lit(False).alias("applied"), (conv % 2 == 0).alias("saved"))
    new = posts.withColumn("score", F.col("score") + 1)
    stored = stored.withColumn("scraped_at", F.lit(None).cast("timestamp_ntz"))
    out = upsert.upsert_overwrite(stored, new, ("seq",), "post_url", S.OVERWRITE_POST, as_of=V.as_of())
    return out.select("post_url", "author_name", "score", "scraped_at", "saved")


@query("anti_new", O.with_(_OLD_NEW, "SELECT id, url FROM b WHERE up = 1 AND url NOT IN (SELECT url FROM t)"))
def anti_new(spark, sf):
    return publish.anti_new(batch(spark, sf), target(spark, sf), "url", ("id",)).select("id", "url")


@query("mark_notified", O.with_(_OLD_NEW, "SELECT id, notified OR id IN (SELECT user_id FROM events WHERE event_type = 'view') AS notified FROM t"))
def mark_notified(spark, sf):
    seen = V.table(spark, sf, "events").where(F.col("event_type") == "view").select("user_id")
    return upsert.mark_notified(target(spark, sf), seen).select("id", "notified")


@query("unnotified", O.with_(_OLD_NEW, "SELECT id, score FROM t WHERE NOT notified AND score >= 50 ORDER BY score DESC, id"))
def unnotified(spark, sf):
    return board.unnotified(target(spark, sf), 50).select("id", "score").orderBy(F.desc("score"), "id")


@query("patch_update", O.with_(O.P, """, ev AS (SELECT user_id, event_id, event_type, value FROM events),
    a AS (SELECT user_id, arg_max_null(CASE WHEN value > 8 THEN true WHEN value > 4 THEN false END, event_id) AS v FROM ev WHERE event_type IN ('click', 'purchase') GROUP BY 1),
    n AS (SELECT user_id, arg_max_null(CASE WHEN value > 6 THEN 'note ' || event_id END, event_id) AS v FROM ev WHERE event_type IN ('view', 'purchase') GROUP BY 1)
    SELECT id, CASE WHEN a.user_id IS NOT NULL THEN a.v ELSE applied END AS applied, saved, CASE WHEN n.user_id IS NOT NULL THEN n.v ELSE 'n' || id END AS notes
    FROM p LEFT JOIN a ON id = a.user_id LEFT JOIN n ON id = n.user_id""").replace("\n, ev AS", ", ev AS"))
def patch_update(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    patches = V.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "event_id",
        F.when(kind == "click", F.array(F.lit("applied"))).when(kind == "view", F.array(F.lit("notes")))
        .when(kind == "purchase", F.array(F.lit("applied"), F.lit("notes"))).otherwise(F.array().cast("array<string>")).alias("supplied"),
        F.when(value > 8, True).when(value > 4, False).alias("applied"), F.lit(None).cast("boolean").alias("saved"),
        F.when(value > 6, F.concat(F.lit("note "), "event_id")).alias("notes"))
    rows = V.postings(spark, sf).select("id", "applied", "saved", F.concat(F.lit("n"), "id").alias("notes"))
    return upsert.apply_patches(rows, patches, ("event_id",))


@query("stage_patches", O.with_(O.P, """, st AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY 1)
    SELECT id, CASE WHEN e = 'click' THEN true ELSE applied END AS applied, CASE WHEN e = 'view' THEN true ELSE saved END AS saved FROM p LEFT JOIN st ON id = user_id""").replace("\n, st AS", ", st AS"))
def stage_patches(spark, sf):
    patches = board.stage_patches(stages(spark, sf)).withColumn("at", F.lit(0))
    return upsert.apply_patches(V.postings(spark, sf).select("id", "applied", "saved"), patches, ("at",))


@query("feedback_upsert", """WITH f AS (SELECT doc_id AS job_id, 'jobs' AS source_table, quality = 1 AS liked, TIMESTAMP '2024-01-10' AS rated_at FROM labels
    UNION ALL SELECT user_id, CASE WHEN event_type = 'view' THEN 'linkedin_posts' ELSE 'jobs' END, value > 5, ts FROM events)
    SELECT job_id, source_table, arg_max(liked, (rated_at, liked)) AS liked, max(rated_at) AS rated_at FROM f GROUP BY 1, 2""")
def feedback_upsert(spark, sf):
    current = V.table(spark, sf, "labels").select(
        F.col("doc_id").alias("job_id"), F.lit("jobs").alias("source_table"), (F.col("quality") == 1).alias("liked"),
        F.lit("2024-01-10 00:00:00").cast("timestamp_ntz").alias("rated_at"))
    rated = V.table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "view", "linkedin_posts").otherwise("jobs").alias("source_table"),
        (F.col("value") > 5).alias("liked"), F.col("ts").alias("rated_at"))
    return upsert.upsert_feedback(current, rated)


@query("export_rows", O.with_(_OLD_NEW, """SELECT title AS "Title", company AS "Company", location AS "Location", CASE WHEN salary IS NULL OR salary = 0 THEN 'N/A' ELSE '$' || format('{:,}', salary) END AS "Salary",
    score AS "Score", source AS "Source", strftime(coalesce(posted_date, scraped_at), '%Y-%m-%d %H:%M') AS "Posted Date",
    CASE WHEN easy_apply THEN 'Yes' WHEN easy_apply IS NULL THEN 'Unknown' ELSE 'No' END AS "Easy Apply", CASE WHEN applicants IS NULL OR applicants IN ('', '0') THEN 'N/A' ELSE applicants END AS "Applicants", url AS "URL"
    FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS k FROM b WHERE score >= 50 AND url NOT IN (SELECT url FROM t)) WHERE k = 1"""))
def export_rows(spark, sf):
    best = batch(spark, sf).where(F.col("score") >= 50)
    return publish.export_rows(publish.anti_new(best, target(spark, sf), "url", ("id",)))


# -- enrichment ---------------------------------------------------------------
def length_model(prompts: pd.Series) -> pd.Series:
    """Stands in for a remote model: scores a prompt by its length."""
    return prompts.map(lambda p: '{"score": %d, "reason": "length", "summary": "", "skills": ["a", "b"]}' % (len(p) % 101))


_MODEL_SQL = """CAST(length('Rate how well this posting fits the reader.' || chr(10) || 'Title: ' || title || chr(10) || 'Company: ' || company
    || chr(10) || 'Location: ' || location || chr(10) || 'Type: ' || job_type || chr(10) || 'Salary: '
    || CASE WHEN salary IS NULL OR salary = 0 THEN 'not listed' ELSE '' || salary END || chr(10) || 'Description: ' || left(coalesce(description, ''), 800) || chr(10)
    || 'Answer with JSON only: {"score": 0-100, "reason": "", "summary": "", "skills": []}') % 101 AS INT)"""


@query("enrich_topn", O.with_(O.SCORED, f""", t AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 150)
    SELECT s.id, CASE WHEN t.id IS NOT NULL THEN {_MODEL_SQL} END AS llm_score,
    CASE WHEN t.id IS NOT NULL THEN 'length' END AS llm_reason, CASE WHEN t.id IS NOT NULL THEN 'a,b' ELSE '' END AS skills FROM s LEFT JOIN t ON s.id = t.id""").replace("\n, t AS", ", t AS"))
def enrich_topn(spark, sf):
    # the scored rows are read twice (top n, join back): store them once, and read texts for the rows asked only
    rows = scored(spark, sf, ref=True).select("id", "score", "title", "company", "location", "job_type", "salary", "text_ref", F.left("description", F.lit(1)).alias("description"))
    out = enrich.enrich_top(cut_lineage(rows, "scored"), "id", length_model, fetch=lambda top: V.described(spark, sf, top, 800))
    return out.select("id", "llm_score", "llm_reason", F.array_join("skills", ",").alias("skills"))


# -- the whole run ------------------------------------------------------------
_RUN = f"""{_UNIQUE + O.SCORED.removeprefix(O.P)}, good AS (SELECT * FROM s WHERE {O.REASON} IS NULL),
    t AS (SELECT id FROM good ORDER BY score DESC, id LIMIT 150),
    ee AS (SELECT good.*, CASE WHEN t.id IS NOT NULL THEN {_MODEL_SQL} END AS model FROM good LEFT JOIN t ON good.id = t.id),
    old AS (SELECT * FROM (SELECT url, title, CAST((id * 7) % 101 AS INT) AS score, id % 4 = 0 AS notified, row_number() OVER (PARTITION BY url ORDER BY id) AS rn
      FROM p_raw WHERE id % 2 = 0 AND url <> '') WHERE rn = 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS up, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS down FROM ee WHERE url <> '')"""


def daily_run(spark, sf):
    """A run over all postings with a model, against a snapshot of every second one; URLs are blank and repeated."""
    from postsift.plans import daily

    rows = V.postings(spark, sf, V.for_rules(), ref=True).drop("llm_score", "scraped_at", "notified", "applied", "saved")
    even = V.postings(spark, sf).where("id % 2 = 0").select("id", "url", "title", F.expr("CAST((id * 7) % 101 AS INT)").alias("score"), "notified")
    stored = S.conform(dedup.distinct_first(even, "url", ("id",)), S.POSTING)
    return daily.run(
        [rows], stored, V.as_of(), ("id",), answer=length_model, text_ref="text_ref", fetch=lambda top: V.described(spark, sf, top, 800))


@query("daily_snapshot", O.with_(_RUN, """SELECT coalesce(o.url, l.url) AS url, coalesce(o.title, a.title) AS title, CASE WHEN l.url IS NOT NULL THEN l.score ELSE o.score END AS score, l.model AS llm_score,
    coalesce(o.notified, false) OR CASE WHEN l.url IS NOT NULL THEN l.score ELSE o.score END >= 50 AS notified
    FROM old o FULL JOIN (SELECT * FROM f WHERE down = 1) l ON o.url = l.url LEFT JOIN (SELECT * FROM f WHERE up = 1) a ON l.url = a.url"""))
def daily_snapshot(spark, sf):
    return daily_run(spark, sf).snapshot.select("url", "title", "score", "llm_score", "notified")


@query("daily_scored", O.with_(_RUN, "SELECT id, url = '' AS rejected, score, model AS llm_score FROM ee"))
def daily_scored(spark, sf):
    """Every scored row once, and which of them have no key."""
    run = daily_run(spark, sf)
    rejected = run.rejected.select("row_id", F.lit(True).alias("rejected"))
    return run.scored.join(rejected, "row_id", "left").select("id", F.coalesce("rejected", F.lit(False)).alias("rejected"), "score", "llm_score")


@query("snapshot_buckets", O.with_(_OLD_NEW, """SELECT coalesce(t.url, bl.url) AS url, CASE WHEN t.url IS NOT NULL THEN t.title ELSE bf.title END AS title,
    CASE WHEN bl.url IS NOT NULL THEN bl.score ELSE t.score END AS score FROM t FULL JOIN bl ON t.url = bl.url LEFT JOIN bf ON bl.url = bf.url"""))
def snapshot_buckets(spark, sf):
    """Stored and new rows written as two versions of a bucketed snapshot, and read back."""
    from postsift.session import new_path
    from postsift.streaming import ingest

    root, schema = new_path(spark, "buckets"), spark.createDataFrame([], S.POSTING).schema
    for number, rows in enumerate((target(spark, sf), batch(spark, sf))):
        ingest.write_upsert(S.conform(rows, S.POSTING), root, schema, ("id",), buckets=8, stream="runs", batch_id=number)
    return ingest.read_snapshot(spark, root, schema).select("url", "title", "score")
