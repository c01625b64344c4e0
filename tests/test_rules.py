"""Rule boundaries: classification, filter, score, display."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postsift import config as C
from postsift.functions import text as T
from postsift.operators import analytics, board, classify, publish, score

AS_OF = dt.datetime(2024, 3, 10, 12)
SCHEMA = (
    "id BIGINT, title STRING, company STRING, location STRING, salary STRING, applicants STRING, easy_apply BOOLEAN, "
    "description STRING, job_type STRING, posted_date TIMESTAMP_NTZ"
)


def as_of():
    return F.lit(AS_OF.isoformat(" ")).cast("timestamp_ntz")


def rows(spark, *overrides):
    base = dict(
        id=0, title="Clerk", company="", location="", salary=None, applicants=None, easy_apply=None, description="", job_type=None, posted_date=None
    )
    return spark.createDataFrame([tuple({**base, "id": i, **o}.values()) for i, o in enumerate(overrides)], SCHEMA)


def run(df, column):
    return [r[0] for r in df.withColumn("_out", column).orderBy("id").select("_out").collect()]


def ago(**kw):
    return AS_OF - dt.timedelta(**kw)


def test_roles(spark):
    cases = {
        "AI/ML Engineer": "ai_engineer", "HTML Engineer": "ml_engineer", "Chef": "data_engineer", "Big ETL person": "data_engineer",
        "Computer Vision Engineer": "cv_engineer", "MLOps lead": "ml_engineer", "Applied Scientist": "data_scientist", None: "data_engineer",
    }
    df = rows(spark, *[{"title": t} for t in cases])
    assert run(df, classify.role_category("title")) == list(cases.values())
    word = C.Rules(match="word")
    assert run(rows(spark, {"title": "HTML Engineer"}, {"title": "ML Engineer II"}), classify.role_category("title", word)) == ["data_engineer", "ml_engineer"]


def test_job_types(spark):
    cases = [
        ({"job_type": "Part Time"}, "part_time"), ({"job_type": "full-time", "description": "a contract"}, "contract"), ({"description": "C2H"}, "contract_to_hire"),
        ({"description": "subcontractor"}, "contract"), ({}, "full_time"), ({"job_type": "CONTRACT_TO_HIRE"}, "contract_to_hire"), ({"title": "part-time"}, "part_time"),
    ]
    df = rows(spark, *[c for c, _ in cases])
    assert run(df, classify.job_type("job_type")) == [e for _, e in cases]


def test_type_label(spark):
    cases = [("Contract to Hire", "contract_to_hire"), ("Contract", "contract"), ("Permanent", "full_time"), ("", "contract"), (None, "contract")]
    assert run(rows(spark, *[{"job_type": c} for c, _ in cases]), classify.type_label("job_type")) == [e for _, e in cases]


@pytest.mark.parametrize(
    "row, reason",
    [
        ({"salary": None}, None), ({"salary": "79999"}, "salary 79999 < 80000"), ({"salary": "80000"}, None), ({"salary": "abc"}, None),
        ({"posted_date": ago(hours=48)}, None), ({"posted_date": ago(hours=48, microseconds=1)}, "too old: 2024-03-08T11:59:59.999999+00:00"),
        ({"posted_date": ago(days=3)}, "too old: 2024-03-07T12:00:00+00:00"), ({"posted_date": ago(hours=-5)}, None),
        ({"applicants": "200"}, None), ({"applicants": "201"}, "too many applicants: 201"), ({"applicants": "x"}, None),
        ({"title": "Staff Engineer"}, "excluded keyword: staff engineer"), ({"salary": "1", "title": "Staff Engineer"}, "salary 1 < 80000"),
        ({"description": "Vice President, unpaid"}, "excluded keyword: unpaid"), ({"easy_apply": False}, None),
    ],
)
def test_reasons(spark, row, reason):
    assert run(rows(spark, row), classify.reject_reason(as_of())) == [reason]


def test_easy_apply_only(spark):
    df = rows(spark, {"easy_apply": True}, {"easy_apply": None}, {"easy_apply": False})
    assert run(df, classify.reject_reason(as_of(), C.Rules(easy_apply_only=True))) == [None, None, "easy_apply_only mode"]


def parts(spark, name, *overrides):
    return run(rows(spark, *overrides), score.score_parts(as_of())[name])


def test_score_parts(spark):
    hours = [dict(hours=12), dict(hours=12, seconds=1), dict(hours=24), dict(hours=48), dict(hours=72), dict(hours=72, seconds=1), dict(hours=-3)]
    assert parts(spark, "freshness", *[{"posted_date": ago(**h)} for h in hours], {}) == [25, 20, 20, 10, 5, 0, 25, 0]
    assert parts(spark, "applicants", *[{"applicants": a} for a in ("24", "25", "49", "50", "99", "100", None, "x")]) == [20, 15, 15, 10, 10, 0, 10, 10]
    texts = ["", "kafka", "spark kafka airflow dbt sql", "spark kafka airflow dbt sql docker", "kafka kafka"]
    assert parts(spark, "keywords", *[{"description": t} for t in texts]) == [0, 3, 15, 15, 3]
    assert parts(spark, "salary", *[{"salary": s} for s in ("99999", "100000", "149999", "150000", None, "x")]) == [0, 5, 5, 10, 0, 0]
    assert parts(spark, "title", {"title": "Data Engineer, Spark"}, {"title": "Spark dev"}, {"title": "Cook"}) == [20, 10, 0]
    assert parts(spark, "company", {"company": "Metadata Inc"}, {"company": "Acme"}) == [15, 0]
    assert parts(spark, "remote", {"location": "Hybrid, NY"}, {"location": "NY"}) == [10, 0]
    assert parts(spark, "easy_apply", {"easy_apply": True}, {"easy_apply": False}, {}) == [15, 0, 0]


def test_score_cap(spark):
    best = {
        "title": "Data Engineer", "description": "spark kafka airflow dbt sql", "posted_date": AS_OF, "applicants": "1", "easy_apply": True,
        "location": "Remote", "salary": "200000", "company": "Google",
    }
    out = score.add_score(rows(spark, best, {}), as_of(), keep_parts=True).orderBy("id").collect()
    assert [r.score for r in out] == [100, 10] and sum(out[0].score_parts) == 130


def test_display(spark):
    df = spark.createDataFrame([(1234, True), (0, False), (None, None)], "n INT, b BOOLEAN")
    got = df.select(T.money("n"), T.money("n", "Not listed", "/yr"), T.yes_no("b")).collect()
    assert [tuple(r) for r in got] == [("$1,234", "$1,234/yr", "Yes"), ("N/A", "Not listed", "No"), ("N/A", "Not listed", "Unknown")]
    text = spark.createDataFrame([("a_b*[c](d)~`>#+-=|{}.!x\\",)], "t STRING")
    assert text.select(T.escape_markdown("t"), T.strip_markdown("t")).first() == (
        "a\\_b\\*\\[c\\]\\(d\\)\\~\\`\\>\\#\\+\\-\\=\\|\\{\\}\\.\\!x\\", "abc(d)~>#+-=|{}.!x",
    )


def test_histogram_and_kpis(spark):
    df = spark.createDataFrame([(s,) for s in (0, 20, 21, 40, 41, 60, 61, 80, 81, 100)], "score INT")
    assert [r.postings for r in analytics.score_histogram(df).collect()] == [2, 2, 2, 2, 2]
    assert [r.postings for r in analytics.score_histogram(df.where("score > 90")).collect()] == [0, 0, 0, 0, 1]
    jobs = spark.createDataFrame([(2, 0, "contract", True, False), (3, 1500, "full_time", False, True)], "score INT, salary INT, job_type STRING, applied BOOLEAN, saved BOOLEAN")
    posts = spark.createDataFrame([("a@b.c",), ("",)], "contact_email STRING")
    stats = analytics.kpi_stats(jobs, posts).first()
    assert (stats.avg_score, stats.with_salary, stats.contract, stats.posts) == (3, 1, 1, 2)
    kpi = analytics.kpi_analytics(jobs, posts).first()
    assert (kpi.apply_rate, kpi.avg_salary_k, kpi.posts_with_email) == (50.0, 2, 1)
    empty = analytics.kpi_analytics(jobs.limit(0), posts.limit(0)).first()
    assert (empty.total, empty.apply_rate, empty.avg_salary_k) == (0, 0.0, None)


def test_skill_ties(spark):
    df = spark.createDataFrame([(1, "kafka", "spark"), (2, "", "python spark kafka")], "id BIGINT, title STRING, description STRING")
    got = [(r.skill, r.mentions) for r in analytics.skill_demand(df, "id").collect()]
    assert got == [("spark", 2), ("kafka", 2), ("python", 1)]
    owned = spark.createDataFrame([("Spark",)], "skill STRING")
    gap = {r.skill: r.status for r in analytics.skill_gap(analytics.skill_demand(df, "id"), owned).collect()}
    assert gap == {"spark": "have", "kafka": "missing", "python": "missing"}


def test_stages(spark):
    jobs = spark.createDataFrame([(1, True, True), (2, False, True), (3, False, False), (4, True, False)], "id BIGINT, applied BOOLEAN, saved BOOLEAN")
    moved = spark.createDataFrame([(4, "offer")], "job_id BIGINT, status STRING")
    staged = board.stage_assign(jobs, moved)
    assert {r.id: r.stage for r in staged.collect()} == {1: "applied", 2: "saved", 3: None, 4: "offer"}
    assert [(r.stage, r.postings) for r in board.stage_counts(staged).collect()] == [
        ("saved", 1), ("applied", 1), ("phone_screen", 0), ("technical", 0), ("offer", 1), ("rejected", 0)]


def test_alert_text(spark):
    df = spark.createDataFrame(
        [(85, 90, "A.B", "C", "D", "s", "u", 1000, "full_time", True, ["x", "y"], "Good!"), (10, None, "T", "C", "L", "", "", None, "", None, None, None)],
        "score INT, llm_score INT, title STRING, company STRING, location STRING, source STRING, url STRING, salary INT, job_type STRING, easy_apply BOOLEAN, skills ARRAY<STRING>, llm_summary STRING")
    full, short = [r[0] for r in df.select(publish.alert_text()).collect()]
    assert full == "\n".join([
        "🟢 *A\\.B*", "🏢 C · 📍 D", "📊 Score: `85`  🤖 AI: `90`", "💰 $1,000/yr", "📋 full\\-time", "⚡ Easy Apply", "🔗 Source: s", "🛠 x · y", "\n_Good\\!_", "\n[👉 Apply Here](u)"])
    assert short == "🟠 *T*\n🏢 C · 📍 L\n📊 Score: `10`"


def test_freshness_at_its_bounds(spark):
    """Ages are compared to the microsecond; unknown and future times are as they were."""
    as_of = F.lit("2001-08-01 06:00:00").cast("timestamp_ntz")
    rows = [("2001-07-31 18:00:00", 25), ("2001-07-31 17:59:59.999999", 20), ("2001-07-31 06:00:00", 20), ("2001-07-31 05:59:59.999999", 10),
            ("2001-07-30 06:00:00", 10), ("2001-07-29 06:00:00", 5), ("2001-07-29 05:59:59.999999", 0), ("2001-08-09 00:00:00", 25), (None, 0)]
    df = spark.createDataFrame(rows, "at string, want int").select("want", F.col("at").cast("timestamp_ntz").alias("posted_date"))
    out = df.withColumns({c: F.lit(None).cast("string") for c in ("title", "description", "location", "company", "applicants", "salary")}).withColumn("easy_apply", F.lit(False))
    parts = score.score_parts(as_of)
    assert [r for r in out.select("want", parts["freshness"].alias("got")).collect() if r.got != r.want] == []
    plan = out.select(parts["freshness"])._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan and "extract" not in plan


def test_cells_are_computed_outside_the_generator(spark):
    """Spark interprets a generator's expressions; the cells have to be compiled, once, below filters on them."""
    df = spark.range(5).select("id", F.concat(F.lit("Text "), F.col("id").cast("string")).alias("t"))
    out = T.computed_once(df, _x=F.lower("t"), _y=F.length("t")).where("_x = 'text 3' AND _y > 0")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "lower" not in generate and plan.count("lower(") == 1
    assert out.columns == ["id", "t", "_x", "_y"] and [tuple(r) for r in out.collect()] == [(3, "Text 3", "text 3", 6)]
