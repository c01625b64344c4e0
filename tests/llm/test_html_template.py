"""Template deduction: extracted texts against what the pages were made of."""

import html
import re

from pyspark.sql import functions as F

from postsift.llm import html_template as H

NONE = frozenset()


def article(page):
    """The blocks of <article>, for the given pages."""
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    rows = H.extract(pages).collect()
    assert {r.page_id: r.text for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows)


def site(k, notice="Read our terms today."):
    """A page without any telling names: only the template shows what is the article."""
    body = "".join(f"<p>para {k} {n} of a text that differs from page to page</p>" for n in range(3 + k % 4))
    menu = "".join(f"<li><a href=/{k}{n}>link {k} {n}</a></li>" for n in range(6))
    return (
        f"<html><head><title>t{k}</title></head><body><div id=top><ul>{menu}</ul></div><div id=mid><div class=x{k}><p>{notice}</p>{body}</div>"
        f"</div><div id=low><p>Page made {k}</p></div></body></html>"
    )


def test_slot_without_names(spark):
    pages = spark.createDataFrame([(k, f"http://one.example/{k}", site(k)) for k in range(40)], "page_id long, url string, html string")
    found = H.templates(pages).first()
    assert len(found.slots) == 1 and len(found.constant) == 1
    for r in H.extract(pages).collect():
        k = r.page_id
        assert r.text == "\n".join(f"para {k} {n} of a text that differs from page to page" for n in range(3 + k % 4))


def test_few_pages_keep_what_they_share(spark):
    pages = spark.createDataFrame([(k, f"http://two.example/{k}", site(1)) for k in range(3)], "page_id long, url string, html string")
    assert all("Read our terms today." in r.text and "para 1 0" in r.text for r in H.extract(pages).collect())


def test_markup():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>a</nav><div class="cookie-notice">we use</div>
    <div id="content"><h1>T &amp; U&eacute;</h1><p>one  two<p>three <b>f</b>our<br>five<ul><li>x<li>y</ul><form>f<input></form><pre>a
 b</pre><script>if(a<b)"</p>"</script><!-- c <p>no</p> --><table><tr><td>1<td>2</table><span hidden>h</span></div>
    <aside>s</aside><section class="comments"><article><p>c</p></article></section><div role=contentinfo>z</div><footer>f</footer>"""
    assert H.main_text(page, NONE, NONE).split("\n") == ["T & Ué", "one two", "three four five", "x", "y", "a b", "1", "2"]
    own = "<main><article><header><h1>Head</h1></header><p>text</p><footer>by</footer></article></main>"
    assert H.main_text(own, NONE, NONE) == "Head\ntext"


def test_words_in_attribute_values_are_no_attributes():
    for value in ("overflow: hidden", "the hidden truth", "a hidden=x aria-hidden=true class=ad", "x role=navigation id=comments"):
        for name in ("style", "title", "data-x", "aria-label"):
            for quote in "\"'":
                for tag in ("body", "div"):
                    page = f"<{tag} {name}={quote}{value}{quote}><p>text</p></{tag}>"
                    assert H.main_text(page, NONE, NONE) == "text", page
    assert H.main_text("<div hidden-by=x data-hidden><p>text</p></div><p title=\"5\" hidden\">more</p>", NONE, NONE) == "text\nmore"
    for real in ("hidden", "HIDDEN", "hidden=''", "title=\"x\"hidden", "a=b/c hidden", "style = 'x y' aria-hidden = \"true\"", "class = 'a nav'", "/hidden/"):
        assert H.main_text(f"<div {real}><p>text</p></div><p>more</p>", NONE, NONE) == "more", real
    # the path of a tag has its own class and id only
    assert H.parse('<div aria-label="more id" title="a class=b">x</div>').tags.keys() == H.parse("<div>x</div>").tags.keys()
    assert H.parse("<div class=a>x</div>").tags.keys() != H.parse("<div>x</div>").tags.keys()
    assert H._attributes(" a b=1 c='2 d=3' class=first class=last e=\"open f=4") == {"a": "", "b": "1", "c": "2 d=3", "class": "first", "e": "open f=4"}
    assert len(H._attributes(" a" * 200_000 + " " * 200_000)) == 1


def test_broken_pages_never_fail():
    for page in (None, "", "plain", "<", "<p", "<p a='", "</p></p>", "<!-- open", "<script>x", "&am &amp &#x110000; &#0;", "<a b=\"c>d</a>e", "<p>" * 50_000 + "x"):
        assert isinstance(H.main_text(page, NONE, NONE), str)
    deep = "<div><span>" * 50_000 + "x" + "</b></div>" * 50_000
    assert H.main_text(deep, NONE, NONE) == "x"
    assert len(H.main_text("<p>" + "word " * 500_000, NONE, NONE)) == 2_499_999


def test_odd_rows(spark):
    rows = [(1, "http://a.b/x", "<p>t</p>"), (1, "http://a.b/x", "<p>t</p>"), (None, None, "<p>u</p>"), (2, "bad", None), (3, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {n: F.lit("clash") for n in ("host", "token", "slots", "constant", "text", "id", "n_pages")})
    got = H.extract(pages).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == sorted(
        [("1", "http://a.b/x", "t", 1)] * 2 + [("None", "None", "u", 1), ("2", "bad", "", 0), ("3", "None", "", 0)])
    assert H.extract(pages.limit(0)).count() == 0


def test_same_vectors_make_a_class():
    token = lambda k, parent, pages, total, sign, chars=0, text=False: H.Token(k, text, parent, False, pages, total, (sign, sign), chars, 0)
    root = [token(0, 0, 10, 10, 5, 100), token(1, 0, 10, 10, 5, 100), token(2, 1, 10, 10, 5, 90), token(3, 1, 10, 10, 5, 10)]
    lone = token(4, 2, 6, 6, 9, 80)  # on some pages only, and no other tag with its vector
    assert H.deduce(10, [*root, lone]) == ([2], [])
    pair = token(5, 2, 6, 6, 9, 0)
    assert H.deduce(10, [*root, lone, pair])[0] == [4]


def extracted(spark, pages, host="http://x.example"):
    rows = [(k, f"{host}/{k}", page) for k, page in enumerate(pages)]
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def words(k, n=80):
    """A text of its own for every k."""
    return " ".join(f"{a}{chr(97 + (k * 7 + i * i) % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for i, a in enumerate("so it was said by them " .split() * (n // 6)))


def test_headline_and_lead_beside_the_body_are_kept(spark):
    def page(head, lead, k, low):
        menu = f"<div id=menu><a href=/{k}>see page {words(k, 6)}</a></div>"
        content = f"<h1>{head}</h1><div class=start>{lead}</div><div class=text><p>{words(k)}</p><p>{words(k + 100)}</p></div>"
        return f"<html><body>{menu}<div id=content>{content}</div><div id=low><p>Page made {low}</p></div></body></html>"

    text = lambda k: f"{words(k)}\n{words(k + 100)}"
    for n in (1, 2, 6, 25):
        got = extracted(spark, [page(f"Head {words(k, 6)}", f"Lead {words(k, 12)}", k, 10 + k) for k in range(n)])
        low = "\nPage made 10" if n == 1 else ""
        assert got == {k: f"Head {words(k, 6)}\nLead {words(k, 12)}\n{text(k)}{low}" for k in range(n)}
    # headlines that differ in digits only are headlines; what differs in more than digits may be the article's
    got = extracted(spark, [page(f"Head {k}", f"Lead {k}", k, words(k, 6)) for k in range(6)])
    assert got == {k: f"Head {k}\nLead {k}\n{text(k)}\nPage made {words(k, 6)}" for k in range(6)}
    assert extracted(spark, [f"<html><body><h1><a href=/>T</a></h1><p>{words(0)}</p></body></html>"]) == {0: f"T\n{words(0)}"}
    main = [f"<html><body><main><h1>T {k}</h1><article><p>{words(k)}</p></article></main></body></html>" for k in range(4)]
    assert extracted(spark, main) == {k: f"T {k}\n{words(k)}" for k in range(4)}
    parts = [f"<html><body><article class=first>Lead {k}</article><article class=rest>{words(k)}</article></body></html>" for k in range(4)]
    assert extracted(spark, parts) == {k: f"Lead {k}\n{words(k)}" for k in range(4)}


def test_names_win_only_with_most_of_the_text(spark):
    cards = "<article><h2>Card {0}</h2><p>teaser {0} of more</p></article>"
    for n in (1, 5, 24):
        pages = [f"<html><body><div id=text><p>{words(k)}</p><p>{words(k + 100)}</p></div>{cards.format(words(k, 6)) * c}</body></html>"
                 for c in (1, 3) for k in range(n)]
        got = extracted(spark, pages[:n])
        assert all(f"{words(k)}\n{words(k + 100)}" in got[k] for k in range(n)), n
        got = extracted(spark, pages[n:])
        assert all(f"{words(k)}\n{words(k + 100)}" in got[k] for k in range(n)), n
        # a named container with most of the text wins
        pages = [f"<html><body><div id=x>Other {words(k, 6)}</div><article><p>{words(k)}</p></article></body></html>" for k in range(n)]
        assert extracted(spark, pages) == {k: words(k) for k in range(n)}
    # and on a page by itself
    assert H.main_text(f"<div id=text>{words(1)}</div>{cards.format(1)}", NONE, NONE) == f"{words(1)}\nCard 1\nteaser 1 of more"
    assert H.main_text(f"<div id=x>other</div><article>{words(1)}</article>", NONE, NONE) == words(1)


def test_constant_texts_go_by_one_rule_at_every_number_of_pages(spark):
    own = lambda k: f"{words(k)}\n{words(k + 100)}"
    noted = lambda k: f"<html><body><div class=x><p>Read our terms.</p><p>{words(k)}</p><p>{words(k + 100)}</p><p>All rights.</p></div></body></html>"
    for n in (2, 19, 20, 21):
        assert extracted(spark, [noted(k) for k in range(n)]) == {k: own(k) for k in range(n)}, n
    # repeated pages are one page, by which nothing is known to be constant
    whole = f"Read our terms.\n{own(1)}\nAll rights."
    assert extracted(spark, [noted(1)] * 25) == dict.fromkeys(range(25), whole)
    # repeated pages among others change nothing
    assert extracted(spark, [noted(1)] * 30 + [noted(2)] * 3 + [noted(3)]) == {k: own(1 if k < 30 else 2 if k < 33 else 3) for k in range(34)}
    # near copies of an article keep what they share, wherever the edited paragraph stands
    for n in (2, 19, 20, 21, 30):
        for at in (0, 2, 4):
            parts = lambda k: [words(k + 100 if i == at else i) for i in range(5)]
            pages = ["<html><body><div class=x><h1>Same head</h1>" + "".join(f"<p>{p}</p>" for p in parts(k)) + "</div></body></html>" for k in range(n)]
            assert extracted(spark, pages) == {k: "\n".join(["Same head", *parts(k)]) for k in range(n)}, (n, at)
    # a text that every page has among its own paragraphs stays
    pages = [f"<html><body><div class=x><p>{words(k)}</p><p>So it goes.</p><p>{words(k + 100)}</p></div></body></html>" for k in range(25)]
    assert extracted(spark, pages) == {k: f"{words(k)}\nSo it goes.\n{words(k + 100)}" for k in range(25)}


def test_a_container_with_the_article_is_read_whatever_its_name():
    for name in ("layout sidebar-right", "page search-enabled", "elementor-widget-wrap", "related", "comment-enabled post"):
        for inner in ("<article><h1>Head</h1><p>{0}</p></article>", "<h1>Head</h1><p>{0}</p>", "<div class='x widget'><h1>Head</h1><p>{0}</p></div>"):
            menu = "<div class=sidebar><a href=/>one</a> menu</div>"
            page = f"<body>{menu}<div class='{name}'>{inner.format(words(1))}{menu}<div id=comments>reader says so</div></div></body>"
            assert H.main_text(page, NONE, NONE) == f"Head\n{words(1)}", (name, inner)
    # long comments and a long sidebar are not the article, if one is named
    for name in ("comments", "sidebar"):
        page = f"<body><main><article><p>short text</p></article><div class={name}><p>{words(2)}</p></div></main></body>"
        assert H.main_text(page, NONE, NONE) == "short text"
    assert H.main_text(f"<article><p>short text</p><div class=comments>{words(2)}</div></article>", NONE, NONE) == "short text"
    assert H.main_text("<article></article><div class=cookie-notice>we use</div>", NONE, NONE) == ""
    # a form around the whole page
    assert H.main_text(f"<body><form><div id=x><p>{words(1)}</p></div><label>Name</label><input></form></body>", NONE, NONE) == words(1)


def test_names_inside_an_article_need_all_words():
    for name in ("related-work", "search-results-text", "code-comment"):
        page = f"<article><p>{words(1)}</p><section id={name}><p>own text</p></section></article>"
        assert H.main_text(page, NONE, NONE) == f"{words(1)}\nown text", name
    for name in ("share-buttons", "related-posts", "ad", "newsletter-signup", "comment-list"):
        page = f"<article><p>{words(1)}</p><section id={name}><p>no text</p></section></article>"
        assert H.main_text(page, NONE, NONE) == words(1), name


def test_controls_in_sentences_and_shared_headings(spark):
    page = "<article><p>Press <button>Go</button> now.</p><p><label>x</label> is defined</p><button>Share</button><button>Print</button></article>"
    assert H.main_text(page, NONE, NONE) == "Press Go now.\nx is defined"
    pages = [f"<html><body><div class=x><h1>Weekly letter</h1><p>{words(k)}</p><p>{words(k + 100)}</p></div></body></html>" for k in range(6)]
    assert extracted(spark, pages) == {k: f"Weekly letter\n{words(k)}\n{words(k + 100)}" for k in range(6)}


def test_clashing_columns_and_a_very_long_page(spark):
    long = "word " * 400_000
    rows = [(k, f"http://l.example/{k}", f"<html><body><article><p>{long if k == 3 else words(k)}</p></article></body></html>") for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit("clash") for n in ("content", "copies", "html_", "pages", "Text")})
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert got == {k: long.strip() if k == 3 else words(k) for k in range(5)}
