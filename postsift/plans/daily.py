"""The whole run as one DataFrame plan: union, dedup, filter, score, enrich, save, publish."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from postsift import config as C
from postsift.operators import board, publish
from postsift.operators.classify import filter_pass
from postsift.operators.analytics import skill_demand, skill_gap
from postsift.operators.dedup import dedup_exact, numbered_rows, union_sources
from postsift.operators.enrich import Answer, enrich_top
from postsift.operators.score import add_score, high_score
from postsift.operators.similarity import dedup_semantic
from postsift.operators.upsert import blank_key_rows, upsert_metadata, upsert_overwrite
from postsift.schema import OVERWRITE_POST, POSTING, SOCIAL_POST, conform
from postsift.session import cut_lineage


#: A number of its own for every row of a run; joins within the run go by it, as URLs may be blank or repeated.
ROW = "row_id"


@dataclass
class Run:
    """What one run produced.  Frames are lazy over *scored*, which is stored."""

    scored: DataFrame
    rejected: DataFrame  # scored rows without a URL: they have no key to be stored under
    snapshot: DataFrame  # rows of the digest are marked as notified
    export: DataFrame
    digest: DataFrame
    alerts: DataFrame
    summary: DataFrame
    message: DataFrame
    raw_counts: Observation
    filter_counts: Observation
    gap: DataFrame | None = None
    post_snapshot: DataFrame | None = None
    post_alerts: DataFrame | None = None


def prepare(
    raw: DataFrame, as_of: Column, order_by: Sequence[str], rules: C.Rules = C.DEFAULT_RULES, *,
    vector: str | None = None, metrics: Observation | None = None, text_ref: str | None = None, **similar,
) -> DataFrame:
    """Raw rows to scored rows: exact dedup, optional similarity dedup, classify, filter, score."""
    unique = dedup_exact(raw, order_by, text_ref=text_ref)
    if vector is not None:
        unique = dedup_semantic(numbered_rows(unique, order_by, ROW), ROW, vector, **similar).drop(ROW)
    return add_score(filter_pass(unique, as_of, rules, metrics), as_of, rules)


def run(
    sources: Sequence[DataFrame], target: DataFrame, as_of: Column, order_by: Sequence[str] = ("source", "seq"),
    rules: C.Rules = C.DEFAULT_RULES, *, answer: Answer | None = None, vector: str | None = None,
    posts: DataFrame | None = None, post_target: DataFrame | None = None, post_order: Sequence[str] = ("seq",),
    owned: DataFrame | None = None, text_ref: str | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None, **similar,
) -> Run:
    """One scheduled run over landed rows against the stored snapshot *target*.

    *posts* are extracted social posts, stored into *post_target*; *owned* lists the reader's skills for the skill gap.
    *order_by* has to be a total order of the raw rows.  Descriptions may be `searchable` ones; then *text_ref* is a
    column that goes with the description, and *fetch* puts whole texts into the rows that the model is asked about.
    """
    read, kept = Observation("raw"), Observation("filter")
    union = union_sources(*sources)
    raw = union.observe(read, F.count(F.lit(1)).alias("rows"))
    # stored before the model, because several steps read it
    scored = numbered_rows(prepare(raw, as_of, order_by, rules, vector=vector, metrics=kept, text_ref=text_ref, **similar), order_by, ROW)
    if answer is not None:
        scored = cut_lineage(enrich_top(scored, ROW, answer, fetch=fetch), "enriched")
    else:
        missing = {"llm_score": "int", "llm_reason": "string", "llm_summary": "string", "skills": "array<string>"}
        scored = scored.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in scored.columns})
    scored = scored.withColumn("scraped_at", as_of)
    snapshot = upsert_metadata(conform(target, POSTING), scored, order_by)
    best = high_score(scored)
    exported = publish.export_rows(publish.anti_new(best, target, "url", order_by))
    open_rows = board.unnotified(snapshot, C.ALERT_SCORE)
    new = publish.anti_new(scored.where(F.coalesce("url", F.lit("")) != ""), target, "url", order_by)
    kept_rows, new_rows = (df.agg(F.count(F.lit(1))).scalar() for df in (scored, new))
    message = publish.run_message(scored, ROW, F.lit(read.get["rows"]), kept_rows, new_rows)
    out = Run(
        scored, blank_key_rows(scored, "url"),
        # the digest speaks of all open rows
        snapshot.withColumn("notified", F.col("notified") | F.coalesce(F.col("score") >= C.ALERT_SCORE, F.lit(False))),
        exported, publish.digest(open_rows, "id"),
        # alerts go out once: rows the snapshot marks as notified are left out
        publish.job_alerts(best.join(target.where("notified").select("url"), "url", "left_anti"), ROW),
        publish.run_summary(union, known={"After filter": kept_rows, "New": new_rows}), message, read, kept,
    )
    if owned is not None:
        out.gap = skill_gap(skill_demand(scored, ROW), owned)
    if posts is not None:
        if post_target is None:
            post_target = posts.sparkSession.createDataFrame([], SOCIAL_POST)
        out.post_snapshot = upsert_overwrite(post_target, posts, post_order, "post_url", OVERWRITE_POST, as_of=as_of)
        out.post_alerts = publish.post_alerts(posts, post_order[0])
    return out
