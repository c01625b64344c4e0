"""Short texts that stand in for long ones, and texts read for the rows that need them only."""

import random

from pyspark.sql import functions as F

from postsift import config as C
from postsift.functions import text as T
from postsift.operators import dedup
from postsift.plans import views as V
from tests.conftest import SF

TERMS = ("part time", "etl", "c2c", "10+ years", "go", "é b")


def test_searchable_answers_as_the_long_text_does(spark):
    rng = random.Random(3)
    bits = [*TERMS, *(t.upper() for t in TERMS), "part", " ", "time", "c2", "c", "10+", "é", "x", "filler words ", "\0", "ἐΣ"]

    def some(n):
        return "".join(rng.choices(bits, k=n))

    rows = [(n, some(rng.randrange(4)), some(rng.randrange(60)), some(rng.randrange(4))) for n in range(3000)]
    rows += [(-1, "x", "", "y"), (-2, "x", None, "y"), (-3, "par", "t time" + "z" * 500 + "par", "t time"), (-4, "e", "t", "l")]
    df = spark.createDataFrame(rows, "id INT, a STRING, b STRING, c STRING")
    for keep in (0, 40):
        short = T.searchable("b", TERMS, keep)
        out = df.select("id", "a", "b", "c", short.alias("s"), T.term_list(F.lower(F.concat("a", short, "c")), TERMS).alias("hits"))
        for r in out.collect():
            if r.b is None:
                assert r.s is None
                continue
            whole = (r.a + r.b + r.c).lower()
            assert r.hits == [t for t in TERMS if t in whole], r
            assert (r.s == "") == (r.b == "") and r.s[:keep] == r.b[:keep]
            assert len(r.s) <= max(keep, 8) + 8 + 2 + sum(map(len, TERMS)) + len(TERMS)


def test_rule_queries_do_not_join_whole_texts_to_orders(spark):
    """A text is searched once for all its orders: what meets the orders is short."""
    rows = V.postings(spark, SF, V.for_rules())
    longest = rows.agg(F.max(F.length("description"))).scalar()
    assert rows.select(longest).first()[0] < 600 < V.postings(spark, SF).agg(F.max(F.length("description"))).first()[0]
    assert set(C.DESCRIPTION_TERMS) < set(C.DEFAULT_RULES.text_terms)


def test_first_url_of_html_is_the_first_of_the_plain_text(spark):
    rng = random.Random(5)
    bits = ["http", "https://", "https:&#x2F;&#x2F;a.example/b", "http://c.example).", "&#104;ttp://d", "<a href=http://t>", "<", ">", "<>",
            " ", "\n", "&amp;", "&amp", ";", "<p>", "word", "\x1c", "\x85", "&lt;b&gt;", "</a>", "."]
    rows = [("".join(rng.choices(bits, k=rng.randrange(12))),) for _ in range(6000)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t STRING")
    out = df.select("t", T.first_url_of_html("t").alias("got"), T.first_url(T.plain_text("t")).alias("want")).collect()
    assert [r for r in out if (r.got or "") != r.want] == [] and sum(r.want != "" for r in out) > 1000


def test_text_ref_goes_with_the_description(spark):
    rows = [(1, "a", None, None, None), (2, "a", 5, "", None), (3, "a", None, "text", "r3"), (4, "b", 1, "", None), (5, "b", 1, "t", "r5"),
            (6, "c", 1, "own", "r6"), (7, "c", 2, "other", "r7"), (8, "d", 1, None, None)]
    df = spark.createDataFrame(rows, "seq INT, title STRING, salary INT, description STRING, ref STRING").withColumns(
        {"company": F.lit(""), "location": F.lit(""), "easy_apply": F.lit(True)})
    out = dedup.dedup_exact(df, ("seq",), text_ref="ref")
    assert {r.seq: (r.description, r.ref) for r in out.collect()} == {1: ("", None), 4: ("", None), 6: ("own", "r6"), 8: (None, None)}
    plain = dedup.dedup_exact(df.drop("ref"), ("seq",))
    assert {tuple(r) for r in plain.select("seq", "description").collect()} == {tuple(r) for r in out.select("seq", "description").collect()}


def test_described_finds_texts_of_repeated_documents(spark, tmp_path):
    for name in ("customer", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 300").write.parquet(f"{tmp_path}/orders.parquet")
    docs = spark.createDataFrame([(n, t) for n in range(40) for t in (None, "", f"one {n} " * 50, f"two {n}", f"two {n}") if n % 3 or t is None], "doc_id LONG, text STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = V.postings(spark, str(tmp_path)).select("id", F.left("description", F.lit(90)).alias("description"))
    short = V.postings(spark, str(tmp_path), lambda t: F.left(t, F.lit(1)), ref=True).select("id", "description", "text_ref")
    found = V.described(spark, str(tmp_path), short, 90).select("id", "description")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.collect()))
    # few short rows per order, not its texts
    assert short.agg(F.max(F.length("description"))).first()[0] < 60
