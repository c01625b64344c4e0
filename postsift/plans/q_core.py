"""Queries: dedup, classification, filter, score, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift import config as C
from postsift.functions import parse as P, text as T
from postsift.functions.vector import cosine
from postsift.operators import analytics, classify, dedup, enrich, publish, score, similarity
from postsift.plans import oracle as O, views as V
from postsift.plans.registry import query

FEED = ("id", "title", "company", "location", "salary", "url", "source", "easy_apply", "applicants", "posted_date")


def classified(spark, sf, keep=0, ref=False):
    """Descriptions are searchable only, but for their first *keep* characters."""
    return classify.classify(V.postings(spark, sf, V.for_rules(keep), ref))


def scored(spark, sf, keep=0, ref=False, **how):
    return score.add_score(classified(spark, sf, keep, ref), V.as_of(), **how)


def _wanted(text):
    return T.searchable(text, C.DEMAND_SKILLS)


_KEYED = """k AS (SELECT *, md5(lower(trim(title)) || '|' || lower(trim(company)) || '|' || lower(trim(location))) AS k FROM p)"""
_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS rn FROM k WHERE {w}) WHERE rn = 1"
_FILL = ", ".join(
    f"coalesce(h.{c}, CASE WHEN h.salary IS NULL THEN d.{c} END) AS {c}"
    for c in ("title", "company", "location", "url", "source", "applicants", "posted_date", "llm_score")
)


@query("dedup_exact", O.with_(
    f"""{O.P}, {_KEYED}, h AS ({_FIRST.format(w='true')}), d AS ({_FIRST.format(w='salary IS NOT NULL')}),
    e AS ({_FIRST.format(w='easy_apply IS NOT NULL')}), t AS ({_FIRST.format(w="description <> ''")})""",
    f"""SELECT h.id, {_FILL}, coalesce(h.salary, d.salary) AS salary, e.easy_apply,
     md5(CASE WHEN h.description IS NOT NULL THEN h.description
              WHEN h.salary IS NULL AND d.description IS NOT NULL AND (t.id IS NULL OR d.id <= t.id) THEN d.description
              ELSE t.description END) AS description_md5
    FROM h LEFT JOIN d ON h.k = d.k LEFT JOIN e ON h.k = e.k LEFT JOIN t ON h.k = t.k""",
))
def dedup_exact(spark, sf):
    # digests are what is returned, so they move instead of the texts
    digest = F.when(F.col("description") == "", F.lit("").cast("binary")).otherwise(F.unhex(F.md5("description")))
    rows = V.postings(spark, sf).select(*FEED, "llm_score", digest.alias("description"))
    out = dedup.dedup_exact(rows, ("id",))
    shown = F.when(F.length("description") == 0, F.md5(F.lit(""))).otherwise(F.lower(F.hex("description")))
    return out.select(*FEED, "llm_score", shown.alias("description_md5"))


@query("match_key", O.with_(f"{O.P}, {_KEYED}", "SELECT id, k AS key FROM k"))
def match_key(spark, sf):
    return V.postings(spark, sf).select("id", T.match_key("title", "company", "location").alias("key"))


@query("distinct_first", O.with_(
    O.P, "SELECT id, title, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM p WHERE url <> '') WHERE rn = 1"))
def distinct_first(spark, sf):
    return dedup.distinct_first(V.postings(spark, sf).select("id", "title", "url"), "url", ("id",))


@query("union_sources", O.with_(
    O.P,
    """SELECT 'order' AS feed, id, title, company, salary, CAST(NULL AS VARCHAR) AS author_name FROM p
    UNION ALL SELECT 'post', conv_id * 1000 + turn, NULL, NULL, NULL, role || ' ' || conv_id FROM conversations"""))
def union_sources(spark, sf):
    a = V.postings(spark, sf).select(F.lit("order").alias("feed"), "id", "title", "company", "salary")
    b = V.posts(spark, sf).select(F.lit("post").alias("feed"), "id", "author_name")
    return dedup.union_sources(a, b)


@query("source_rollup", O.with_(
    O.P,
    """SELECT split_part(source, ':', 1) AS name, count(*) AS rows FROM p GROUP BY 1
    UNION ALL SELECT 'TOTAL RAW', count(*) FROM p"""))
def source_rollup(spark, sf):
    return publish.source_rollup(V.postings(spark, sf))


@query("first_n_per_source", O.with_(
    O.P,
    "SELECT source, CAST(rn AS INT) AS rn, id, title FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM p) WHERE rn <= 20"))
def first_n_per_source(spark, sf):
    return dedup.first_n_per_group(V.postings(spark, sf).select("source", "seq", "id", "title"), "source", 20, ("seq",)).drop("seq")


# -- classification and filter ------------------------------------------------
@query("classify_role", O.with_(O.CLASS, "SELECT id, role_category FROM c"))
def classify_role(spark, sf):
    return classified(spark, sf).select("id", "role_category")


@query("classify_job_type", O.with_(O.CLASS, "SELECT id, job_type FROM c"))
def classify_job_type(spark, sf):
    return classified(spark, sf).select("id", "job_type")


@query("type_label", O.with_(
    O.P,
    """SELECT id, CASE WHEN contains(l, 'contract to hire') OR contains(l, 'c2h') THEN 'contract_to_hire' WHEN contains(l, 'contract') THEN 'contract'
    WHEN contains(l, 'full') OR contains(l, 'permanent') THEN 'full_time' ELSE 'contract' END AS job_type,
    CASE WHEN contains(l, 'contract') THEN 'contract' ELSE 'full_time' END AS two_way
    FROM (SELECT id, lower(coalesce(job_type, '')) AS l FROM p)"""))
def type_label(spark, sf):
    return V.postings(spark, sf).select(
        "id", classify.type_label("job_type").alias("job_type"),
        classify.type_label("job_type", "full_time", classify.CONTRACT_ONLY_STEPS).alias("two_way"))


@query("reject_reasons", O.with_(O.P, f"SELECT id, {O.REASON} AS reason FROM p"))
def reject_reasons(spark, sf):
    return classify.with_reasons(V.postings(spark, sf, V.for_rules()), V.as_of()).select("id", "reason")


@query("filter_pass", O.with_(O.CLASS, f"SELECT id, title, role_category, job_type FROM c WHERE {O.REASON} IS NULL"))
def filter_pass(spark, sf):
    return classify.filter_pass(V.postings(spark, sf, V.for_rules()), V.as_of()).select("id", "title", "role_category", "job_type")


@query("filter_easy_only", O.with_(
    O.P, f"SELECT id, coalesce({O.REASON}, CASE WHEN easy_apply IS NOT DISTINCT FROM false THEN 'easy_apply_only mode' END) AS reason FROM p"))
def filter_easy_only(spark, sf):
    rules = C.Rules(easy_apply_only=True)
    return classify.with_reasons(V.postings(spark, sf, V.for_rules()), V.as_of(), rules).select("id", "reason")


@query("keyword_gate", O.with_(
    f"{O.P}, cm AS (SELECT id AS comment_id, {O.COMMENT.replace('o_orderkey', 'id')} AS text FROM p)",
    f"SELECT comment_id FROM cm WHERE {O.any_of('lower(text)', C.FORUM_RELEVANT_TERMS)} AND {O.any_of('lower(text)', C.FORUM_SIGNAL_TERMS)}"))
def keyword_gate(spark, sf):
    gate = classify.keyword_gate("text", C.FORUM_RELEVANT_TERMS, C.FORUM_SIGNAL_TERMS)
    searched = (*C.FORUM_RELEVANT_TERMS, *C.FORUM_SIGNAL_TERMS)
    return V.comments(spark, sf, lambda text: T.searchable(text, searched)).where(gate).select("comment_id")


# -- score --------------------------------------------------------------------
@query("score_parts", O.with_(O.SCORED, "SELECT id, " + ", ".join(f"CAST(pt_{p} AS INT) AS pt_{p}" for p in score.PARTS) + " FROM s"))
def score_parts(spark, sf):
    out = scored(spark, sf, keep_parts=True)
    return out.select("id", *[F.col(f"score_parts.{p}").alias(f"pt_{p}") for p in score.PARTS])


@query("score_total", O.with_(O.SCORED, "SELECT id, score FROM s"))
def score_total(spark, sf):
    return scored(spark, sf).select("id", "score")


@query("score_rank", O.with_(O.SCORED, "SELECT id, score FROM s ORDER BY score DESC, id"))
def score_rank(spark, sf):
    return score.ranked(scored(spark, sf).select("id", "score"), "id")


@query("high_score", O.with_(O.SCORED, "SELECT id, score FROM s WHERE score >= 50"))
def high_score(spark, sf):
    return score.high_score(scored(spark, sf)).select("id", "score")


@query("jobs_top500", O.with_(O.SCORED, "SELECT id, title, company, location, salary, role_category, job_type, score FROM s ORDER BY score DESC, id LIMIT 500"))
def jobs_top500(spark, sf):
    cols = ("id", "title", "company", "location", "salary", "role_category", "job_type", "score")
    return publish.top_k(scored(spark, sf).select(*cols), C.GRID_ROWS, F.desc("score"), "id")


@query("score_band", O.with_(
    O.SCORED,
    """SELECT id, CASE WHEN score >= 65 THEN '#22c55e' WHEN score >= 40 THEN '#f59e0b' ELSE '#ef4444' END AS digest_band,
    CASE WHEN score >= 80 THEN '🟢' WHEN score >= 60 THEN '🟡' ELSE '🟠' END AS alert_band,
    CASE WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'yellow' WHEN score >= 40 THEN 'orange' ELSE 'red' END AS card_band,
    CASE WHEN llm_score >= 80 THEN 'green' WHEN llm_score >= 60 THEN 'yellow' WHEN llm_score IS NOT NULL THEN 'slate' END AS model_band FROM s"""))
def score_band(spark, sf):
    return scored(spark, sf).select(
        "id", T.band("score", publish.DIGEST_BANDS, publish.DIGEST_LOWEST).alias("digest_band"),
        T.band("score", publish.ALERT_BANDS, publish.ALERT_LOWEST).alias("alert_band"),
        T.band("score", publish.CARD_BANDS, publish.CARD_LOWEST).alias("card_band"),
        F.when(F.col("llm_score").isNotNull(), T.band("llm_score", publish.MODEL_BANDS, publish.MODEL_LOWEST)).alias("model_band"),
    )


@query("days_ago", O.with_(
    O.P,
    f"""SELECT id, d AS days, CASE WHEN d = 0 THEN 'Today' ELSE d || 'd ago' END AS label
    FROM (SELECT id, CAST(coalesce(floor((epoch({O.AS_OF}) - epoch(posted_date)) / 86400), 0) AS INT) AS d FROM p)"""))
def days_ago(spark, sf):
    return V.postings(spark, sf).select("id", P.age_days("posted_date", V.as_of()).alias("days"), P.days_label("posted_date", V.as_of()).alias("label"))


@query("feedback_by_bucket", O.with_(
    O.SCORED,
    """SELECT CAST(CASE WHEN score <= 20 THEN 0 WHEN score <= 40 THEN 1 WHEN score <= 60 THEN 2 WHEN score <= 80 THEN 3 ELSE 4 END AS INT) AS bucket,
    count(*) AS rated, count(*) FILTER (WHERE quality = 1) AS liked, round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS like_rate
    FROM s JOIN labels ON id = doc_id GROUP BY 1"""))
def feedback_by_bucket(spark, sf):
    rated = V.table(spark, sf, "labels").select(F.col("doc_id").alias("job_id"), (F.col("quality") == 1).alias("liked"))
    return score.feedback_by_bucket(scored(spark, sf), rated).withColumn("like_rate", F.round("like_rate", 6))


# -- keyword and skill counts -------------------------------------------------
_TERMS = ("the", "tion", "reth", "license", "go", "llm", "etl", "|")


@query("keyword_hits", f"""SELECT doc_id, CAST({O.count_of('lower(text)', _TERMS)} AS INT) AS n_hits,
    array_to_string(list_filter([{', '.join(O.quote(t) for t in _TERMS)}], lambda t: contains(lower(text), t)), ',') AS hits FROM documents""")
def keyword_hits(spark, sf):
    text = F.col("_l")
    docs = V.texts(spark, sf, "documents", "doc_id").select("doc_id", F.lower("text").alias("_l"))
    return docs.select("doc_id", T.term_count(text, _TERMS).alias("n_hits"), F.array_join(T.term_list(text, _TERMS), ",").alias("hits"))


def _demand_sql(ctes: str, source: str) -> str:
    cells = " UNION ALL ".join(
        f"SELECT {i} AS place, {O.quote(t)} AS skill, count(*) AS mentions, min(id) AS first_at FROM dt WHERE contains(t, {O.quote(t)})"
        for i, t in enumerate(C.DEMAND_SKILLS)
    )
    return f"""{ctes}, dt AS (SELECT id, lower(coalesce(description, '') || ' ' || title) AS t FROM {source}), dm AS ({cells}),
    dem AS (SELECT * FROM dm WHERE mentions > 0 ORDER BY mentions DESC, first_at, place LIMIT 20)"""


@query("skill_demand", O.with_(_demand_sql(O.P, "p"), "SELECT CAST(place AS INT) AS place, skill, mentions, first_at FROM dem"))
def skill_demand(spark, sf):
    return analytics.skill_demand(V.postings(spark, sf, _wanted), "id")


_OWNED = """own AS (SELECT DISTINCT CASE p_brand WHEN 'Brand#1' THEN 'spark' WHEN 'Brand#2' THEN 'python' WHEN 'Brand#3' THEN 'aws'
    WHEN 'Brand#4' THEN 'go' ELSE 'none' END AS skill FROM part)"""


@query("skill_gap", O.with_(
    _demand_sql(O.P, "p") + ", " + _OWNED,
    """SELECT skill, mentions, 'have' AS status FROM dem WHERE skill IN (SELECT skill FROM own)
    UNION ALL (SELECT skill, mentions, 'missing' FROM dem WHERE skill NOT IN (SELECT skill FROM own) ORDER BY mentions DESC, first_at, place LIMIT 10)"""))
def skill_gap(spark, sf):
    brand = F.col("p_brand")
    owned = V.table(spark, sf, "part").select(
        F.when(brand == "Brand#1", "Spark").when(brand == "Brand#2", "Python").when(brand == "Brand#3", "AWS")
        .when(brand == "Brand#4", "Go").otherwise("none").alias("skill"))
    return analytics.skill_gap(analytics.skill_demand(V.postings(spark, sf, _wanted), "id"), owned)


@query("skills_heatmap", f"""WITH t AS (SELECT doc_id, list_filter([{', '.join(O.quote(t) for t in _TERMS)}], lambda t: contains(lower(text), t)) AS skills FROM documents),
    u AS (SELECT doc_id, unnest(skills) AS skill, generate_subscripts(skills, 1) AS pos FROM t),
    g AS (SELECT skill, count(*) AS mentions, min(doc_id * 100 + pos) AS f FROM u GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 30)
    SELECT skill, mentions, round(mentions / max(mentions) OVER (), 6) AS intensity, round(0.3 + 0.7 * mentions / max(mentions) OVER (), 6) AS opacity FROM g""")
def skills_heatmap(spark, sf):
    docs = V.texts(spark, sf, "documents", "doc_id").select("doc_id", T.term_list(F.lower("text"), _TERMS).alias("skills"))
    out = analytics.skills_heatmap(docs, "doc_id")
    return out.withColumns({"intensity": F.round("intensity", 6), "opacity": F.round("opacity", 6)})


# -- similarity ---------------------------------------------------------------
_TAU = 0.3
# walks the rows in order, carrying the ids kept so far
_GREEDY = f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
    pairs AS MATERIALIZED (SELECT b.id AS id, list(a.id ORDER BY a.id) AS before FROM v a JOIN v b ON a.id < b.id
      AND list_cosine_similarity(a.e, b.e) >= {_TAU} GROUP BY b.id),
    o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY v.id) AS n, v.id, coalesce(before, []) AS before FROM v LEFT JOIN pairs USING (id)),
    walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader
      UNION ALL
      SELECT o.n, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, o.id) END, o.id,
        list_min(list_intersect(before, kept)) FROM walk JOIN o ON o.n = walk.n + 1)"""


@query("similar_pairs", f"WITH RECURSIVE {_GREEDY} SELECT id, leader AS kept_id FROM walk WHERE leader IS NOT NULL")
def similar_pairs(spark, sf):
    return similarity.similar_pairs(V.table(spark, sf, "embeddings"), "vec_id", "embedding", _TAU, blocking="exact")


@query("similar_pairs_blocks", f"WITH RECURSIVE {_GREEDY} SELECT id, leader AS kept_id FROM walk WHERE leader IS NOT NULL")
def similar_pairs_blocks(spark, sf):
    """The same pairs by blocks, with enough blocks that no near pair is missed at this low bound."""
    return similarity.similar_pairs(V.table(spark, sf, "embeddings"), "vec_id", "embedding", _TAU, blocking="lsh", bits=2, recall=1 - 1e-7)


@query("vector_cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_cosine(spark, sf):
    """Each vector against the next one."""
    rows = V.table(spark, sf, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return rows.join(after, "vec_id").select("vec_id", F.round(cosine("embedding", "after"), 6).alias("similarity"))


def _paid_vectors(spark, sf):
    cells = (F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") % 2 == 0, F.col("label") * 1000 + 1).cast("int").alias("salary"))
    return V.table(spark, sf, "embeddings").select(*cells, F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("t"), F.col("vec_id"))).alias("title"))


@query("dedup_semantic", f"""WITH RECURSIVE {_GREEDY},
    w AS (SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN CAST(label * 1000 + 1 AS INT) END AS salary, CASE WHEN vec_id % 3 > 0 THEN 't' || vec_id END AS title FROM embeddings),
    d AS (SELECT leader, min(walk.id) AS donor FROM walk JOIN w ON w.id = walk.id WHERE leader IS NOT NULL AND w.salary IS NOT NULL GROUP BY 1)
    SELECT w.id, coalesce(w.salary, g.salary) AS salary, CASE WHEN w.salary IS NULL THEN coalesce(g.title, w.title) ELSE w.title END AS title
    FROM w JOIN walk ON w.id = walk.id AND walk.leader IS NULL LEFT JOIN d ON d.leader = w.id LEFT JOIN w g ON g.id = d.donor""")
def dedup_semantic(spark, sf):
    return similarity.dedup_semantic(_paid_vectors(spark, sf), "id", "embedding", _TAU, blocking="exact").select("id", "salary", "title")


def _embedded(rows: str, dim: int) -> str:
    """SQL of (id, e) from rows (id, text): the vector of embed_text."""
    return f"""w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM ({rows})),
    terms AS (SELECT DISTINCT id, t FROM (SELECT id, unnest(w) AS t FROM w
      UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)),
    h AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM terms),
    sums AS (SELECT id, h // 2 % {dim} AS place, sum(1 - 2 * (h % 2))::DOUBLE AS v FROM h GROUP BY 1, 2),
    n AS (SELECT id, sqrt(sum(v * v)) AS n FROM sums GROUP BY 1)"""


@query("embed_local", "WITH " + O.P + ", " + _embedded("SELECT id, concat_ws(' ', title, company, location) AS text FROM p", 64) + """
    SELECT id, CAST(place AS BIGINT) AS place, round(CAST(v / n AS FLOAT)::DOUBLE, 5) AS value FROM sums JOIN n USING (id) WHERE v <> 0""")
def embed_local(spark, sf):
    """Places of the vectors that are not 0."""
    vectors = enrich.embed_text(V.postings(spark, sf), "id", F.concat_ws(" ", "title", "company", "location"))
    cells = vectors.select("id", F.posexplode("embedding").alias("place", "value")).where("value <> 0")
    return cells.select("id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 5).alias("value"))


_DIM = 256


@query("dedup_semantic_blocks", "WITH RECURSIVE " + _embedded("SELECT doc_id AS id, text FROM documents", _DIM) + f""",
    v AS MATERIALIZED (SELECT id, list(coalesce(v / n, 0) ORDER BY place) AS e FROM (SELECT id, n, unnest(range({_DIM})) AS place FROM n) LEFT JOIN sums USING (id, place) GROUP BY id),
    one AS MATERIALIZED (SELECT e, min(id) AS id FROM v GROUP BY e),
    pairs AS MATERIALIZED (SELECT b.id AS id, list(a.id ORDER BY a.id) AS before FROM one a JOIN one b ON a.id < b.id AND list_dot_product(a.e, b.e) >= {C.SIMILARITY} GROUP BY b.id),
    o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY one.id) AS n, one.id, coalesce(before, []) AS before FROM one LEFT JOIN pairs USING (id)),
    walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader
      UNION ALL
      SELECT o.n, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, o.id) END, o.id, list_min(list_intersect(before, kept)) FROM walk JOIN o ON o.n = walk.n + 1)
    SELECT doc_id, CAST(n_chars AS INT) AS salary FROM documents WHERE doc_id NOT IN
      (SELECT v.id FROM v JOIN one USING (e) JOIN walk ON walk.id = one.id WHERE v.id <> one.id OR walk.leader IS NOT NULL)""")
def dedup_semantic_blocks(spark, sf):
    """Similarity dedup of all documents on local vectors, by blocks."""
    docs = V.texts(spark, sf, "documents", "doc_id")
    rows = enrich.embed_text(docs.withColumn("salary", F.col("n_chars").cast("int")), "doc_id", F.col("text"), _DIM, "salary")
    return similarity.dedup_semantic(rows, "doc_id", "embedding", blocking="lsh").select("doc_id", "salary")


# -- the whole run ------------------------------------------------------------
_ALL = ("title", "company", "location", "url", "source", "applicants", "posted_date", "llm_score", "job_type", "scraped_at", "notified", "applied", "saved")
_MERGED = ", ".join(f"coalesce(h.{c}, CASE WHEN h.salary IS NULL THEN d.{c} END) AS {c}" for c in _ALL)
_UNIQUE = f"""{O.P.replace('p AS (', 'p_raw AS (', 1)}, {_KEYED.replace('FROM p)', 'FROM p_raw)')},
    h AS ({_FIRST.format(w='true')}), d AS ({_FIRST.format(w='salary IS NOT NULL')}), e AS ({_FIRST.format(w='easy_apply IS NOT NULL')}), x AS ({_FIRST.format(w="description <> ''")}),
    p AS (SELECT h.id, {_MERGED}, coalesce(h.salary, d.salary) AS salary, e.easy_apply,
     CASE WHEN h.description IS NOT NULL THEN h.description WHEN h.salary IS NULL AND d.description IS NOT NULL AND (x.id IS NULL OR d.id <= x.id) THEN d.description
          ELSE x.description END AS description FROM h LEFT JOIN d ON h.k = d.k LEFT JOIN e ON h.k = e.k LEFT JOIN x ON h.k = x.k)"""


@query("run_top500", O.with_(
    _UNIQUE + O.SCORED.removeprefix(O.P), f"SELECT id, title, company, location, salary, role_category, job_type, score FROM s WHERE {O.REASON} IS NULL ORDER BY score DESC, id LIMIT 500"))
def run_top500(spark, sf):
    """Dedup, classify, filter, score and rank: the main path of a run."""
    from postsift.plans.daily import prepare

    out = prepare(V.postings(spark, sf, V.for_rules()), V.as_of(), ("id",))
    cols = ("id", "title", "company", "location", "salary", "role_category", "job_type", "score")
    return publish.top_k(out.select(*cols), C.GRID_ROWS, F.desc("score"), "id")
