"""Fields out of HTML pages.

Two forms: regular expressions that stay in the JVM, for pages with flat markup; and a
parser over Arrow batches, for nested cards chosen by selectors.
"""

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from postsift.functions import text as T


# -- regular expressions ------------------------------------------------------
def element(tag: str, cls: str | None = None) -> str:
    """Pattern of an element's inner HTML: first element with this tag and class."""
    mark = rf"""\sclass=["'](?:[^"']*\s)?{cls}(?:\s[^"']*)?["']""" if cls else ""
    return rf"(?is)<{tag}\b[^>]*{mark}[^>]*>(.*?)</{tag}>" if mark else rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"


def attribute(tag: str, name: str) -> str:
    """Pattern of an attribute's value: first element of this tag that has it."""
    return rf"""(?is)<{tag}\s(?:[^>]*\s)?{name}=["']([^"']*)["']"""


def all_matches(html: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(T.col_of(html), F.lit(pattern), F.lit(1))


def inner_text(inner: Column) -> Column:
    """Text pieces of an element, each stripped, joined without a gap."""
    return F.array_join(F.transform(F.split(inner, "<[^>]+>"), lambda p: T.strip(T.unescape(p))), "")


def first_text(html: Column | str, *patterns: str) -> Column:
    """Text of the first pattern that finds an element, '' if none does."""
    found = F.coalesce(*[F.get(all_matches(html, p), F.lit(0)) for p in patterns])
    return F.coalesce(T.let(found, inner_text), F.lit(""))


def first_link(html: Column | str, base: Column | str, *patterns: str) -> Column:
    """First non-empty link, made absolute."""
    found = [F.nullif(F.get(all_matches(html, p), F.lit(0)), F.lit("")) for p in patterns]
    return T.absolute_url(F.coalesce(*found, F.lit("")), base)


def page_links(pages: DataFrame, id_col: str, html: str, base: Column, scope: str | None = None) -> DataFrame:
    """One row per link of a page (or of one element of it), in page order."""
    area = F.col(html) if scope is None else F.get(all_matches(html, scope), F.lit(0))
    links = all_matches(area, attribute("a", "href"))
    rows = pages.select(F.col(id_col), base.alias("_base"), F.posexplode(links).alias("position", "href"))
    return rows.select(id_col, "position", T.absolute_url("href", F.col("_base")).alias("link")).where(F.length("link") > 0)


# -- selectors ----------------------------------------------------------------
@dataclass(frozen=True)
class CardRules:
    """Where the records of a page are and where their fields are inside a record.

    Each list is tried in order.  Selectors: tag, .class, #id, [attr], [attr=v], [attr*=v] and
    descendants ("h2 a").
    """

    cards: Sequence[str]
    texts: Mapping[str, Sequence[str]]
    links: Mapping[str, Sequence[str]]
    card_attributes: Mapping[str, str] | None = None  # used where the text is ''


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements that end an open paragraph, and those that end an open one of their own kind, up to a limit.
_ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
_ENDS_OWN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_P_LIMIT = {"table", "td", "th", "caption", "button", "object", "template"}


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def _each(self):
        """Nodes and texts below, in page order; pages nest as deep as they like."""
        open_lists = [iter(self.children)]
        while open_lists:
            child = next(open_lists[-1], None)
            if child is None:
                open_lists.pop()
                continue
            yield child
            if isinstance(child, _Node):
                open_lists.append(iter(child.children))

    def walk(self):
        return (child for child in self._each() if isinstance(child, _Node))

    def text(self):
        return "".join(child.strip() for child in self._each() if not isinstance(child, _Node))


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("", {}, None)
        self.count = Counter()
        self.feed(html)
        self.close()

    def _end(self, tag, limits=()):
        """Close the nearest open element of this name, unless a limit comes first."""
        if not self.count[tag]:
            return
        node = self.open
        while node.tag != tag:
            if node.tag in limits:
                return
            node = node.parent
        while self.open is not node.parent:
            self.count[self.open.tag] -= 1
            self.open = self.open.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._end("p", _P_LIMIT)
        if tag in _ENDS_OWN:
            self._end(tag, _ENDS_OWN[tag])
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in _VOID:
            self.open = node
            self.count[tag] += 1

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        if self.open.tag not in ("script", "style"):
            self.open.children.append(data)


_PART = re.compile(r"""([.#]?)([\w-]+)|\[([\w-]+)(?:(\*?=)['"]?([^'"\]]*)['"]?)?\]""")


def _step(text: str):
    """One compound selector as a test on a node."""
    tests = []
    for kind, name, attr, op, value in _PART.findall(text):
        if kind == ".":
            tests.append(lambda n, v=name: v in n.attrs.get("class", "").split())
        elif kind == "#":
            tests.append(lambda n, v=name: n.attrs.get("id") == v)
        elif name:
            tests.append(lambda n, v=name.lower(): n.tag == v)
        elif op == "=":
            tests.append(lambda n, a=attr, v=value: n.attrs.get(a) == v)
        elif op == "*=":
            tests.append(lambda n, a=attr, v=value: v in n.attrs.get(a, ""))
        else:
            tests.append(lambda n, a=attr: a in n.attrs)
    return lambda node: all(test(node) for test in tests)


def _select(root: _Node, selector: str):
    """Nodes below *root* that match, in page order."""
    *outer, last = [_step(part) for part in selector.split()]

    def inside(node: _Node) -> bool:
        at = node.parent
        for step in reversed(outer):
            while at is not None and not step(at):
                at = at.parent
            if at is None:
                return False
            at = at.parent
        return True

    return (n for n in root.walk() if last(n) and inside(n))


def _card_fields(html: str, rules: CardRules) -> list[dict[str, str]]:
    root = _Tree(html).root
    cards: list[_Node] = []
    for selector in rules.cards:
        cards = list(_select(root, selector))
        if cards:
            break
    out = []
    for card in cards:
        row = {}
        for name, selectors in rules.texts.items():
            hit = next((n for s in selectors if (n := next(_select(card, s), None)) is not None), None)
            row[name] = hit.text() if hit else ""
        for name, selectors in rules.links.items():
            hits = (next(_select(card, s), None) for s in selectors)
            row[name] = next((n.attrs["href"] for n in hits if n is not None and n.attrs.get("href")), "")
        for name, attr in (rules.card_attributes or {}).items():
            row[name] = row.get(name) or card.attrs.get(attr, "")
        out.append(row)
    return out


def extract_cards(pages: DataFrame, rules: CardRules, base: Column, *, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """One row per record with a title: page id, position, every field; links absolute."""

    @F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
    def cards(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _card_fields(t, rules) if t else [])

    rows = pages.select(id_col, base.alias("_base"), F.posexplode(cards(F.col(html))).alias("position", "_f"))
    return rows.select(
        id_col, "position", *[F.col("_f")[n].alias(n) for n in rules.texts],
        *[T.absolute_url(F.col("_f")[n], F.col("_base")).alias(n) for n in rules.links],
    ).where(F.length("title") > 0)
