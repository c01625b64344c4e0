"""Landed files: JSON, RSS, HTML, forum and social text."""

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from postsift.sources import feeds, html, prose, tabular

NOW = dt.datetime(2024, 3, 10, 12)


def as_of():
    return F.lit(NOW.isoformat(" ")).cast("timestamp_ntz")


def feed(spark, source, payload, **kw):
    raw = spark.createDataFrame([(1, payload if isinstance(payload, str) else json.dumps(payload))], "seq INT, payload STRING")
    return feeds.normalize_feed(raw, feeds.FEEDS[source], as_of(), **kw).orderBy("pos").collect()


def test_dice_location_forms(spark):
    item = {"title": "T", "companyName": "C", "salary": "$50 per hour", "postedDate": "2024-03-01T10:00:00Z", "summary": "s" * 600}
    got = feed(spark, "Dice", {"data": [
        {**item, "jobLocation": {"displayName": "NY"}}, {**item, "jobLocation": [{"displayName": "LA"}, {"displayName": "SF"}], "easyApply": True},
        {**item, "isRemote": True}, {**item, "title": ""}, {**item, "jobLocation": []}]})
    assert [r.location for r in got] == ["NY", "LA", "Remote", ""]
    assert [r.easy_apply for r in got] == [False, True, False, False]
    assert (got[0].salary, len(got[0].description), got[0].posted_date) == (104000, 500, dt.datetime(2024, 3, 1, 10))


def test_small_feeds(spark):
    row = feed(spark, "USAJobs", {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {
        "PositionTitle": "T", "PositionURI": "u", "PositionLocation": [{"LocationName": "DC"}, {"LocationName": "VA"}], "PositionRemuneration": [{"MinimumRange": "100.0", "MaximumRange": "201.0"}]}}]}})[0]
    assert (row.location, row.salary, row.company, row.job_type, row.easy_apply, row.posted_date) == ("DC", 150, "US Government", "full_time", False, NOW)
    row = feed(spark, "RemoteOK", [{"legal": "x"}, {"id": "7", "position": "P", "tags": ["a", "b"], "salary_max": 9.0, "epoch": 1700000000, "applicants": 4}])[0]
    assert (row.url, row.description, row.salary, row.applicants, row.location) == ("https://remoteok.com/l/7", "a b", 9, 4, "Remote")
    assert feed(spark, "RemoteOK", [{"legal": "x"}]) == [] == feed(spark, "RemoteOK", [])
    got = feed(spark, "Arbeitnow", {"data": [{"slug": "s", "title": "A", "url": "1"}, {"slug": "s", "title": "B", "url": "2"}, {"slug": "t", "title": "C", "url": "1", "tags": ["x"]}]})
    assert [(r.title, r.description) for r in got] == [("A", ""), ("C", "x")]
    got = feed(spark, "Jooble", {"jobs": [{"title": "T", "link": "l", "updated": "3 days ago"}, {"title": "T", "link": "l"}, {"title": "T", "link": ""}]})
    assert [(r.posted_date, r.location) for r in got] == [(NOW - dt.timedelta(days=3), "United States")]


def test_broken_payload_is_set_aside(spark, tmp_path):
    for name, text in (("a.json", '{"results": [{"title": "T"}]}'), ("b.json", '{"results": [{'), ("c.json", "<html>")):
        (tmp_path / name).write_text(text)
    raw = feeds.read_landed(spark, str(tmp_path))
    spec = feeds.FEEDS["Adzuna"]
    assert [r.title for r in feeds.normalize_feed(raw, spec, as_of()).collect()] == ["T"]
    assert sorted(r.seq[-6:] for r in feeds.quarantine(raw, spec).collect()) == ["b.json", "c.json"]


def test_rss_file(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0100</pubDate><description>pays $90,000</description><author>{}</author></item>"
    body = item.format("Acme: Data Engineer", "u1", "Boss") + item.format("No label", "u2", "") + item.format("", "u3", "x")
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{body}</channel></rss>")
    raw = tabular.read_rss(spark, str(tmp_path / "feed.xml")).withColumn("seq", F.col("link"))
    got = {r.url: r for r in tabular.normalize_rss(raw, as_of(), "W", labelled_title=True).collect()}
    assert {u: (r.company, r.title, r.location) for u, r in got.items()} == {"u1": ("Acme", "Data Engineer", "Remote"), "u2": ("", "No label", "Remote")}
    assert got["u1"].posted_date == dt.datetime(2024, 3, 5, 10)
    got = {r.url: r for r in tabular.normalize_rss(raw, as_of(), "M", labelled_title=False).collect()}
    assert (got["u1"].company, got["u1"].salary, got["u1"].location) == ("Boss", 90000, "United States")


def test_rss_query_returns_all_items_of_a_feed(spark, tmp_path):
    from postsift.plans import registry

    registry.load()
    names = {"nation": "0 AS n_nationkey, 'N' AS n_name, 4 AS n_regionkey", "customer": "1 AS c_custkey, 'C' AS c_name, 0 AS c_nationkey, 'BUILDING' AS c_mktsegment"}
    for name, cells in names.items():
        spark.sql(f"SELECT {cells}").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.range(140).select((F.col("id") * 3).alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(5.0).alias("o_totalprice"),
                                     F.lit(NOW).alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "x" * 700), (1, "y" * 700)], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["rss_normalize"](spark, str(tmp_path)).collect()
    assert sorted(r.seq for r in rows) == [3 * n for n in range(140)]  # one feed: its number of items is not bounded
    shown = hashlib.md5(b"x" * 500).hexdigest()
    assert {r.description for r in rows if r.seq % 2 == 0 and r.seq % 17 and r.seq % 19} == {shown}


def test_tabular(spark):
    schema = ("title STRING, site STRING, company STRING, location STRING, job_url STRING, description STRING, interval STRING, min_amount DOUBLE, max_amount DOUBLE, "
              "date_posted DATE, is_easy_apply BOOLEAN, num_applicants STRING")
    df = spark.createDataFrame(
        [("T", "indeed", "nan", None, "u", "d", "hourly", 50.0, float("nan"), dt.date(2024, 3, 1), None, "Over 200"),
         ("S", "my_site2go", "", "", "v", "", "", None, None, None, True, None), ("nan", "x", "", "", "", "", "", None, None, None, None, None)], schema)
    row, other = tabular.normalize_tabular(df, as_of()).collect()
    assert (other.source, other.salary, other.posted_date) == ("My_Site2Go", None, NOW)
    assert (row.source, row.company, row.salary, row.posted_date, row.easy_apply, row.applicants) == ("Indeed", "", 104000, dt.datetime(2024, 3, 1), None, 200)


PAGE = """<html><body><ul>
<li class="card big" data-job-title="From data"><span class="co"> Acme <b>Inc</b></span></li>
<li class="card"><h2><a href="/j/1?x=1&amp;y=2">Data &amp; AI</a></h2><p class="loc">NY</p></li>
<li class="card"><h2><a href="https://other.example/j">Second</a></h2></li>
<li class="card"><p>no title</p></li></ul><div class="footer"><a href="/imprint">x</a></div></body></html>"""


def test_cards(spark):
    rules = html.CardRules(
        cards=("div.result", "li.card"), texts={"title": ("h2 a", "a.title"), "company": (".co", "span"), "location": ("p.loc", "[data-loc]")},
        links={"link": ("h2 a", "a[href*=job]")}, card_attributes={"title": "data-job-title"})
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>nothing")], "page_id INT, html STRING")
    got = html.extract_cards(pages, rules, F.lit("https://site.example")).orderBy("position").collect()
    assert [(r.title, r.company, r.location, r.link) for r in got] == [
        ("From data", "AcmeInc", "", ""), ("Data & AI", "", "NY", "https://site.example/j/1?x=1&y=2"), ("Second", "", "", "https://other.example/j")]


def test_flat_page_rules(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none")], "page_id INT, html STRING")
    got = pages.select(
        html.first_text("html", html.element("h1"), html.element("h2")).alias("t"), html.first_text("html", html.element("p", "loc")).alias("l"),
        html.first_link("html", "https://b.example", html.attribute("a", "href")).alias("u")).collect()
    assert [tuple(r) for r in got] == [("Data & AI", "NY", "https://b.example/j/1?x=1&amp;y=2"), ("", "", "")]
    links = html.page_links(pages, "page_id", "html", F.lit("https://b.example"), html.element("div", "footer")).collect()
    assert [r.link for r in links] == ["https://b.example/imprint"]


def forum(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    return {r.comment_id: r for r in prose.extract_forum_posts(df, "text", "id", as_of()).collect()}


def test_forum(spark):
    tail = "<p>We&#x27;re hiring to build a data pipeline, write to jobs@acme.example or see https://x.example/a)."
    got = forum(
        spark, f"Acme | Data Engineer | NY | $120k{tail}", "short | spark", f"{'x' * 61} | ML | Berlin | $150,000 | REMOTE {tail}", "We are hiring cooks and waiters. " * 5,
        "No pipes at all but spark and contract work with a part time remoteness" + "." * 40)
    assert sorted(got) == [0, 2, 4]
    a, b, c = got[0], got[2], got[4]
    assert (a.company, a.title, a.location, a.salary, a.url, a.contact_email, a.job_type) == (
        "Acme", "Data Engineer", "NY", 120000, "https://x.example/a", "jobs@acme.example", "full_time")
    assert (b.company, b.title, b.location, b.salary) == ("Unknown Company (HN)", "ML", "Remote", 150000)
    assert (c.title, c.location, c.job_type, c.url) == ("Software Engineer (Data/AI)", "USA", "contract", "https://news.ycombinator.com/item?id=4")
    assert "We're hiring" in a.description


def test_social(spark):
    schema = "seq INT, query STRING, post_text STRING, author_name STRING, author_headline STRING, author_profile_url STRING, post_url STRING, time_text STRING, reply STRING"
    text = "We are hiring a data engineer for a great team, write to a@b.example"
    rows = [
        (1, "q", text, "Ann", "H", "/in/ann", "/p/1", "2d", None), (2, "q", text, "Bo", "", "", "/p/2", "3d", None), (3, "q", text, "Cy", "", "", "/p/1", "1d", None),
        (4, "q", "x" * 60, "Di", "", "", "/p/4", "", None), (5, "q", "x" * 60, "Ed", "", "", "/p/5", "", '{"is_job_posting": true, "job_title": "T", "contact_email": "e@f.example", "score": 88}'),
        (6, "q", text, "Fi", "", "", "/p/6", "", '{"is_job_posting": false}'), (7, "q", "short", "Gu", "", "", "/p/7", "", None), (8, "q", "y" * 60, "Hy", "", "", "/p/8", "", "oops")]
    df = spark.createDataFrame(rows, schema)
    got = {r.seq: r for r in prose.extract_social_posts(df, as_of(), reply="reply").collect()}
    assert sorted(got) == [1, 5, 8]
    assert (got[1].score, got[1].contact_email, got[1].contact_name, got[1].post_url) == (40, "a@b.example", "Ann", "https://www.linkedin.com/p/1")
    assert (got[1].contact_linkedin, got[5].extracted_title, got[5].contact_email, got[5].score, got[8].score) == (
        "https://www.linkedin.com/in/ann", "T", "e@f.example", 88, 30)
    assert prose.extract_social_posts(df, as_of(), per_query=1, order_by=("seq",)).count() == 1


def test_profile(spark):
    docs = spark.createDataFrame([(1, "call (555) 123-4567 or me@x.example, knows dbt, PYTHON"), (2, "")], "id INT, text STRING")
    got = prose.extract_profiles(docs, "id", "text").orderBy("doc_id").collect()
    assert (got[0].phone, got[0].email, got[0].skills) == ("(555) 123-4567", "me@x.example", ["Python", "dbt"])
    assert (got[1].phone, got[1].email, got[1].skills, got[1].years_experience) == ("", "", [], 0)


def test_deep_and_broken_pages(spark):
    rules = html.CardRules(cards=["div.card"], texts={"title": ["h2"]}, links={"link": ["a"]})
    card = '<div class="card"><h2>T</h2><a href="/x">go</a>'
    pages = ["<p>" * 100_000 + card, "<b><i>" * 50_000 + card + "</u>" * 50_000, "<ul><li>a<li>b" + card, card + "<", "</div>" * 10 + card]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id INT, html STRING")
    got = html.extract_cards(df, rules, F.lit("http://e.example")).collect()
    assert [(r.page_id, r.title, r.link) for r in sorted(got, key=lambda r: r.page_id)] == [(k, "T", "http://e.example/x") for k in range(5)]


def test_implied_ends():
    tree = html._Tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<div>g</div>")
    items = [n.text() for n in tree.root.walk() if n.tag == "li"]
    assert items == ["a", "bc", "c", "d"]
    assert [n.text() for n in tree.root.walk() if n.tag == "p"] == ["e", "f"]
