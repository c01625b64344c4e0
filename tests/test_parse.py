"""Salary, date and text expressions at their edges."""

import datetime as dt
import html
import html.entities
import random

import pytest
from pyspark.sql import functions as F

from postsift.functions import parse as P, text as T
from postsift.functions.arrow import unescape_full

AS_OF = dt.datetime(2024, 3, 10, 12)


def as_of():
    return F.lit(AS_OF.isoformat(" ")).cast("timestamp_ntz")


def run(spark, values, build):
    df = spark.createDataFrame(list(enumerate(values)), "i INT, t STRING")
    return [r[0] for r in df.select("i", build(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def test_salary(spark):
    cases = {
        "$50 - $60 per hour": 114400, "$120k": 120, "5,000/month": 60000, "1,000 per week": 52000, "$150,000": 150000, "55.50/hour": 109200,
        "Competitive": None, "": None, ",": None, None: None, "0": None, "9" * 30: None,
    }
    assert run(spark, list(cases), P.parse_salary) == list(cases.values())
    assert run(spark, ["0 - 100 /hr", "900", "2000 hour"], lambda c: P.parse_salary(c, "unbounded")) == [104000, 900, 4160000]
    assert run(spark, ["900", "1000"], lambda c: P.parse_salary(c, "small_is_hourly")) == [1872000, 1000]
    assert run(spark, ["$120k", "$150,000 x", "$99", "120k"], P.hashed_amount) == [120000, 150000, None, None]


def test_salary_against_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789,,.$ -hourmonthweek/") for _ in range(rng.randint(0, 18))) for _ in range(2000)]

    def plain(t):
        import re

        values = [int(d) for n in re.findall(r"[0-9,]+", t.replace("$", "")) if (d := n.replace(",", "")) and int(d) > 0]
        if not values:
            return None
        mean = sum(values) / len(values)
        for word, bound, times in (("hour", 1000, 2080), ("month", 50000, 12), ("week", 10000, 52)):
            if word in t.lower() and mean < bound:
                mean *= times
                break
        return int(mean) if mean < 2**31 else None

    assert run(spark, texts, P.parse_salary) == [plain(t) for t in texts]


@pytest.mark.parametrize(
    "text, back",
    [
        ("3 hours ago", dict(hours=3)), ("5 min", dict(minutes=5)), ("2 months", dict(days=60)), ("2d", dict(days=2)), ("1w", dict(weeks=1)), ("just now", {}),
        ("30+ days ago", {}), ("1 yr", {}), ("", {}), (None, {}), ("I know 3 days", {}), ("7 S", dict(seconds=7)),
    ],
)
def test_relative(spark, text, back):
    assert run(spark, [text], lambda c: P.parse_relative(c, as_of())) == [AS_OF - dt.timedelta(**back)]


def test_relative_before_all_times(spark):
    texts = ["9999999999999999999999 days", "900000 days", "99999999999 s", "700000 days"]
    assert run(spark, texts, lambda c: P.parse_relative(c, as_of())) == [None, None, None, AS_OF - dt.timedelta(days=700000)]


def test_iso(spark):
    texts = ["2024-01-15", "2024-01-15T10:00:00Z", "2024-01-15T10:00:00+05:00", "2024-01-15 10:00:00.5", "2024-13-01", "soon", None]
    day = dt.datetime(2024, 1, 15)
    ten = day.replace(hour=10)
    half = ten.replace(microsecond=500000)
    assert run(spark, texts, lambda c: P.parse_iso(c, as_of())) == [day, ten, ten, half, AS_OF, AS_OF, AS_OF]
    assert run(spark, texts[:3], lambda c: P.parse_iso(c, as_of(), "convert")) == [day, ten, day.replace(hour=5)]
    assert run(spark, ["Tue, 05 Mar 2024 10:00:00 +0100", "5 Mar 2024 10:00 GMT", "x"], lambda c: P.parse_rfc822(c, as_of())) == [
        dt.datetime(2024, 3, 5, 10), dt.datetime(2024, 3, 5, 10), AS_OF]
    assert run(spark, ["0", "1700000000", "x", "999999999999999"], lambda c: P.parse_epoch(c, as_of())) == [
        dt.datetime(1970, 1, 1), dt.datetime(2023, 11, 14, 22, 13, 20), AS_OF, AS_OF]


def test_freshness(spark):
    labels = ["2d", "3d", "1w", "23h", "30m", "4mo", "1y", "", None, "2 weeks", "last year", "3d • Edited"]
    assert run(spark, labels, P.is_fresh_label) == [True, False, False, True, False, False, False, True, True, False, False, False]
    assert run(spark, ["30m", "4mo", "3d"], lambda c: P.is_fresh_label(c, minutes_are_months=False)) == [True, False, False]


def test_days(spark):
    df = spark.createDataFrame([(AS_OF - dt.timedelta(hours=h),) for h in (0, 23, 24, 49, -1)] + [(None,)], "t TIMESTAMP_NTZ")
    assert [r[0] for r in df.select(P.days_label("t", as_of())).collect()] == ["Today", "Today", "1d ago", "2d ago", "-1d ago", "Today"]


def test_match_key(spark):
    df = spark.createDataFrame([(" Data Eng\t", None), ("data eng", ""), ("data eng ", "")], "a STRING, b STRING")
    keys = [r[0] for r in df.select(T.match_key("a", "b")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_unescape_matches_the_library(spark):
    marks = ["&amp;", "&lt;", "&#39;", "&#x27;", "&#38;", "&#X41;", "&quot;", "&nbsp;", "&bogus;", "&", ";", "lt;", "#39;", "a", "é", "&#128512;", "&#0;", "&#xD800;"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 7))) for _ in range(500)]
    texts += [f"x&{name}y &{name}" for name in html.entities.html5]
    texts += [f"&#{n};&#x{n:X} " for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**9]]
    texts += ["&#0000000038;", "&#x000000000026", "&amp R&D", "&notit;", "&notin;", "&#150;&#x80;", "&" + "a" * 40 + ";", "&amp;amp;", "&&amp;&", "&#;&#x;", "&eacute;&rarr;"]
    for text, ours, full in zip(texts, run(spark, texts, T.unescape), run(spark, texts, unescape_full)):
        assert ours == full == html.unescape(text), text


def test_replies(spark):
    texts = ['{"score": 7, "reason": "r", "skills": ["a"]}', '```json\n{"summary": "s"}\n```', "not json", '{"score": "x"}', "[1]", None, ""]
    got = run(spark, texts, T.model_reply)
    assert [tuple(r) for r in got] == [
        (7, "r", "", ["a"]), (50, "", "s", []), *[(None, None, None, [])] * 5]
    posts = run(spark, ['{"is_job_posting": false}', "bad", None], T.post_reply)
    assert [(p.is_job_posting, p.score) for p in posts] == [(False, None), (True, 30), (None, None)]


def test_small_texts(spark):
    assert run(spark, ["mail a.b+c@x-y.co.uk now", "none", None], T.first_email) == ["a.b+c@x-y.co.uk", "", ""]
    assert run(spark, ["see https://x.example/a).", "no"], T.first_url) == ["https://x.example/a", ""]
    assert run(spark, ["Over 200", "x", None], T.first_int) == [200, None, None]
    assert run(spark, ["a | b | c", "a"], lambda c: T.pipe_field(c, 1)) == ["b", ""]
    assert run(spark, ["x" * 61 + "|b", "x" * 60 + "|b"], lambda c: T.pipe_field(c, 0, 60)) == ["", "x" * 60]
    assert run(spark, ["A: B: C", "only"], lambda c: F.struct(*T.split_label(c))) == [("A", "B: C"), ("", "only")]
    assert run(spark, ["nan", None, " x "], T.clean_missing) == ["", "", "x"]
    assert run(spark, ['["a"]', "oops", None], T.skills_from_json) == [["a"], [], []]
