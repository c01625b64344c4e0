"""HTML extraction by deducing the template of each host's pages.

Tokens are start tags, told apart by the path of tags they stand in, and texts of blocks.  Tokens with the same
occurrence vector over a host's pages form an equivalence class; a class of enough tokens and pages belongs to the
template.  The class of what every page has once is its root; other classes nest below it by their paths.  What lies
between template tokens are slots: one of them holds the article, and texts that are template tokens themselves
(notices on every page) belong to no article.

The vectors are never built: two sums of page hashes, weighted by the token's count in the page, stand for one.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from postsift.llm.common import small_batches
from postsift.llm.url_rules import url_host
from postsift.session import cut_lineage

#: Share of a host's pages on which a template's tags and texts occur at least.
TAG_SUPPORT = 0.5
#: Texts that all pages share are the template's if they hold at most this share of the text; else pages are near copies.
FIXED_SHARE = 0.25
#: A container named as an article wins over the slot around it if it holds this share of the text that differs.
NAMED_SHARE = 0.7

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul video".split()
)
#: Start tags that end an open element, up to the nearest of the tags that limit its scope.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
P_SCOPE = frozenset("table td th caption button object template html body".split())

# Elements and names (in class, id and role) of what is no article.
NO_ARTICLE = frozenset(
    "aside audio canvas datalist dialog fieldset footer head header iframe input menu meter nav noscript object "
    "optgroup option output progress script select style svg template textarea title video".split()
)
NO_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense alert aside banner breadcrumb breadcrumbs comment "
    "comments commentary consent contentinfo cookie cookies disqus discussion footer gdpr header login masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended "
    "related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe "
    "subscription toolbar topbar widget widgets".split()
)
ARTICLE_NAMES = frozenset("article articlebody article-body main maincontent main-content post-content entry-content story-body".split())
#: Words beside those names that say nothing of a container.
NEUTRAL_NAMES = frozenset(
    "area bar block bottom box btn button buttons col column container content group holder inner item items left link links list "
    "outer panel posts right row section site slot title top unit wrap wrapper zone".split()
)
COMMENT_NAMES = frozenset("comment comments disqus discussion replies reply respond responses".split())
#: Words on them are read where they stand in a sentence.
CONTROLS = frozenset(("button", "label"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: An article's own header holds its headline.
IN_ARTICLE = frozenset(("header",))
NEVER_NAMED = frozenset(("html", "body", "main", "article"))
NEGATIONS = frozenset(("has", "no", "with", "without", "not"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
#: One attribute: a name and its value.  Values are matched, so that no name is found in one; an open quote holds the rest.
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]*))?""")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


@dataclass
class Element:
    name: str
    path: int
    #: Gives no text: never, or as a suspect that is not kept stands around it.
    hard: bool
    dropped: bool
    article: bool
    inside: bool
    link: bool
    control: bool = False
    #: The innermost suspect around or at it, and how many containers named as articles.
    suspect: int = 0
    articles: int = 0
    chars: int = 0
    link_chars: int = 0


@dataclass
class Page:
    """tags: path -> [count, parent path, begins an article by name, chars of text inside, of them in links, chars before the first];
    blocks: (text, text token, inside the chosen slots, inside an article by name, path of the tag around it, chars in links, heading)."""

    tags: dict[int, list] = field(default_factory=dict)
    blocks: list[tuple[str, int, bool, bool, int, int, bool]] = field(default_factory=list)


@dataclass
class Suspect:
    """An element that its name or class calls no part of an article; the first stands for the page itself.

    chars: text outside of links, with no other suspect nearer around it; articles: containers named as articles, alike;
    around: such containers around the element, in whatever suspect.
    """

    parent: int
    comments: bool = False
    around: int = 0
    chars: int = 0
    articles: int = 0


def _kept(suspects: list[Suspect]) -> frozenset[int]:
    """Suspects that hold the article in spite of their names, as a layout called after its sidebar.

    Such a one holds most of the page's text outside of links, and no container named as an article stands beside it.
    Reader comments, which may be longer than their article, are kept only where no such container stands around them either.
    """
    chars = [s.chars for s in suspects]
    for k in range(len(suspects) - 1, 0, -1):
        chars[suspects[k].parent] += chars[k]
    kept, articles = {0}, suspects[0].articles
    for k, s in enumerate(suspects):
        if k and s.parent in kept and 2 * chars[k] > chars[0] and articles <= (0 if s.comments else s.around):
            kept.add(k)
            articles += s.articles
    return frozenset(kept)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return found


def parse(html: str | None, slots: frozenset[int] = frozenset()) -> Page:
    """Tags and text blocks of a page; what stands in menus, headers, forms and the like gives no block.

    An element that holds the article is read whatever its class and id say: the page is read a second time where there is one.
    Never fails: unclosed, stray and nested tags of any depth are read as browsers do, roughly.
    """
    if not html:
        return Page()
    page, suspects = _read(html, slots, frozenset((0,)))
    kept = _kept(suspects)
    return _read(html, slots, kept)[0] if len(kept) > 1 else page


def _read(html: str, slots: frozenset[int], kept: frozenset[int]) -> tuple[Page, list[Suspect]]:
    """The page without the suspects that are not *kept*, and all suspects, numbered in page order."""
    page, suspects = Page(), [Suspect(0)]
    stack = [Element("", 0, False, False, False, False, False)]
    opened: dict[str, int] = {}
    text: list[str] = []
    links = seen = 0
    spoken = False

    def flush() -> None:
        nonlocal links, seen, spoken
        if text:
            block = " ".join("".join(text).split())
            top = stack[-1]
            # what buttons and labels say alone is no text
            if block and spoken:
                links = min(links, len(block))
                heading = any(opened.get(h) for h in HEADINGS)
                page.blocks.append((block, _hash(block, top.path & 0xFFFFFFFF), top.inside, top.article, top.path, links, heading))
                top.chars += len(block)
                top.link_chars += links
                seen += len(block)
            text.clear()
            links, spoken = 0, False

    def pop() -> None:
        top = stack.pop()
        opened[top.name] -= 1
        tag = page.tags[top.path]
        tag[3] += top.chars
        tag[4] += top.link_chars
        stack[-1].chars += top.chars
        stack[-1].link_chars += top.link_chars

    def close(names: tuple[str, ...], limits) -> None:
        """Close the nearest open element of these names, unless a limit comes first."""
        if any(opened.get(n) for n in names):
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].name in names:
                    while len(stack) > at:
                        pop()
                    break
                if stack[at].name in limits:
                    break

    def say(part: str) -> None:
        nonlocal links, spoken
        top = stack[-1]
        if part and not top.hard and not top.link:
            suspects[top.suspect].chars += len(part.strip())
        if part and not top.dropped:
            spoken = spoken or (not top.control and not part.isspace())
            part = html_entities.unescape(part) if "&" in part else part
            text.append(part)
            # a headline that links to its own page is no menu
            links += len(part) if top.link and not opened.get("h1") else 0

    at, size = 0, len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        if found is None:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            if name in BLOCK:
                flush()
            if opened.get(name):
                close((name,), ())
            continue
        if name in BLOCK:
            flush()
            close(("p",), P_SCOPE)
        if name in ENDS:
            close(*ENDS[name])
        if name == "br":
            say(" ")
        attributes = _attributes(found[3] or found[6] or "")
        parent = stack[-1]
        label = f"{parent.path}>{name}.{attributes.get('class', '')}#{attributes.get('id', '')}"
        path = _hash(_DIGITS.sub("", label.partition(">")[2]), parent.path & 0xFFFFFFFF)
        article, hard, named = _kind(name, attributes, parent)
        suspect = parent.suspect
        if named:
            suspect = len(suspects)
            suspects.append(Suspect(parent.suspect, named == "comments", parent.articles))
        dropped = parent.dropped or hard or suspect not in kept
        own = article and not hard and (not parent.article or name == "article")
        suspects[suspect].articles += own
        tag = page.tags.setdefault(path, [0, parent.path, own and not dropped, 0, 0, seen])
        tag[0] += 1
        if name in RAW:
            # raw text up to its end tag
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
        elif name not in VOID:
            stack.append(Element(
                name, path, hard, dropped, article, parent.inside or path in slots, parent.link or name == "a",
                parent.control or name in CONTROLS, suspect, parent.articles + own))
            opened[name] = opened.get(name, 0) + 1
    flush()
    while len(stack) > 1:
        pop()
    page.tags[0] = [1, 0, False, stack[0].chars, stack[0].link_chars, 0]
    return page, suspects


def _kind(name: str, attributes: dict[str, str], parent: Element) -> tuple[bool, bool, str]:
    """(inside an article by name, never part of an article, "names" or "comments" of a suspect).

    In an article a class or id makes a suspect only if all its words are such names or say nothing: `share-buttons` does,
    `related-work` and `code-comment` do not.
    """
    if parent.hard or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return parent.article, True, ""
    named = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".strip()
    article = parent.article or name in ("article", "main") or attributes.get("itemprop", "").lower() == "articlebody"
    if name in NO_ARTICLE and not (parent.article and name in IN_ARTICLE):
        return article, True, ""
    if named:
        article = article or not ARTICLE_NAMES.isdisjoint(named.lower().split())
        if name not in NEVER_NAMED:
            for word in named.split():
                pieces = {p.lower() for p in _NAME.findall(word)}
                found = pieces & NO_ARTICLE_NAMES
                if not found or not NEGATIONS.isdisjoint(pieces):
                    continue
                if parent.article and (found <= IN_ARTICLE or not pieces <= NO_ARTICLE_NAMES | NEUTRAL_NAMES):
                    continue
                return article, False, "names" if COMMENT_NAMES.isdisjoint(found) else "comments"
    return article, False, "names" if name == "form" else ""


TOKEN = (
    "host string, token long, is_text boolean, copies long, parent long, article boolean, n_pages long, total long, sign_a long, sign_b long, "
    "chars long, link_chars long, start long"
)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of pages, summed over the pages of a task that come together."""
    names = [f.split()[0] for f in TOKEN.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in TOKEN.split(", ")]
    sums: dict[tuple, list] = {}

    def emit() -> pa.RecordBatch:
        rows = [(*key, *value) for key, value in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in small_batches(batches):
        for host, html, copies in zip(*(c.to_pylist() for c in batch.columns)):
            page = parse(html)
            key = _hash(html or "")
            a, b = key & 0x3FFFFFFF, key >> 32 & 0x3FFFFFFF
            rows = [(token, False, parent, article, n, c, k, start) for token, (n, parent, article, c, k, start) in page.tags.items()]
            texts: dict[int, list[int]] = {}
            for text, token, _, _, path, links, _ in page.blocks:
                # texts that differ in digits only, as counters and dates, are also one text of a place
                label = _DIGITS.sub("", text)
                label = _hash(label, path & 0xFFFFFFFF) if label != text and any(map(str.isalpha, label)) else token
                for one in {token, label}:
                    text_sums = texts.setdefault(one, [path, one != token, 0, 0, 0])
                    for i, more in enumerate((1, len(text), links), 2):
                        text_sums[i] += more
            rows += [(token, True, *values, 0) for token, values in texts.items()]
            for token, is_text, parent, article, n, chars, links, start in rows:
                s = sums.setdefault((host, token, is_text, copies), [parent, article, 0, 0, 0, 0, 0, 0, 0])
                for i, more in enumerate((1, n, a * n, b * n, chars, links, start), 2):
                    s[i] += more
        if len(sums) > 50_000:
            yield emit()
    if sums:
        yield emit()


TEMPLATE = "host string, slots array<long>, constant array<long>"


@dataclass
class Token:
    token: int
    is_text: bool
    parent: int
    #: Of a tag: begins an article by name; of a text: stands for texts that differ in digits.
    article: bool
    n_pages: int
    total: int
    sign: tuple[int, int]
    chars: int
    link_chars: int
    start: int = 0
    #: Of a tag: chars outside of links in texts that differ between pages, and of them in texts that differ in digits only.
    loose: int = 0
    labels: int = 0
    #: Of a text: whether it belongs to the template.
    fixed: bool = False

    @property
    def vector(self) -> tuple:
        return (*self.sign, self.n_pages, self.total)

    def held(self, labels: bool = True) -> int:
        """Chars that may be an article's: none of what is mostly links."""
        return self.loose - (0 if labels else self.labels) if 2 * self.link_chars < self.chars else 0


def _valid(pages: int, tokens: list[Token]) -> dict[int, Token]:
    """Tags of the template: of classes of two tokens or more (a lone tag may be chance) on enough pages, and the root's."""
    classes: dict[tuple, list[Token]] = {}
    for t in tokens:
        if not t.is_text:
            classes.setdefault(t.vector, []).append(t)
    valid = {t.token: t for members in classes.values() for t in members if len(members) > 1 and t.n_pages >= TAG_SUPPORT * pages}
    return valid | {t.token: t for t in tokens if not t.is_text and t.n_pages == t.total == pages}


def _around(t: Token, tags: dict[int, Token]) -> Iterator[Token]:
    """The tags around a token, innermost first."""
    while t.is_text or t.token != 0:
        t = tags.get(t.parent)
        if t is None:
            return
        yield t


def mark(pages: int, tokens: list[Token]) -> None:
    """Find the template's texts, and how much text of each tag differs between pages.

    A text belongs to the template if it has the vector of a template tag around it, once a page.  Pages that share more
    than FIXED_SHARE of their text are near copies of an article, whose paragraphs are no template.
    """
    tags = {t.token: t for t in tokens if not t.is_text}
    for t in tags.values():
        t.loose = t.chars - t.link_chars
    if pages < 2 or 0 not in tags:
        return
    valid = _valid(pages, tokens)
    found = [t for t in tokens if t.is_text and t.n_pages == t.total > 1]
    found = [t for t in found if any(a.token in valid and a.vector == t.vector for a in _around(t, tags))]
    same = [t for t in found if not t.article]
    twins = {(t.parent, t.chars, t.vector) for t in same}
    found = [t for t in found if t.article and (t.parent, t.chars, t.vector) not in twins]
    most = FIXED_SHARE * tags[0].loose
    for texts, counted in ((same, "loose"), (found, "labels")):
        most -= sum(t.chars - t.link_chars for t in texts)
        if most < 0:
            break
        for t in texts:
            t.fixed = True
            for a in _around(t, tags):
                setattr(a, counted, getattr(a, counted) + (t.chars - t.link_chars) * (-1 if counted == "loose" else 1))


def deduce(pages: int, tokens: list[Token]) -> tuple[list[int], list[int]]:
    """(paths of the slots that hold the article, constant texts) of a host.

    No slots means that the pages have no common one; then each page is read by its own tags.
    """
    valid = _valid(pages, tokens)
    tags = {t.token: t for t in tokens if not t.is_text}
    slot = _slot(valid, tags)
    named = _named(slot or tags.get(0), valid, tags)
    slots = sorted(t.token for t in named) or ([slot.token] if slot else [])
    fixed = [t for t in tokens if t.fixed and not t.article]
    return slots, [t.token for t in fixed if not slots or any(a.token in slots for a in _around(t, tags))]


def _named(slot: Token | None, valid: dict[int, Token], tags: dict[int, Token]) -> list[Token]:
    """The outermost containers in the slot that are named as articles, if one of them, once on every page, holds most of
    the text; a slot that is named itself, or stands in one that is, stays whole."""
    if slot is None or slot.article or any(a.article for a in _around(slot, tags)):
        return []
    found = []
    for t in valid.values():
        if t.article:
            around = list(_around(t, tags))
            if slot in around and not any(a.article and a.token in valid for a in around):
                found.append(t)
    best = max((t.loose for t in found if t.n_pages == t.total == slot.n_pages), default=0)
    return found if best >= NAMED_SHARE * slot.loose and best > 0 else []


def _slot(valid: dict[int, Token], tags: dict[int, Token]) -> Token | None:
    """The innermost tag that holds all text that differs between pages.

    Left out are menus, which are mostly links, and what differs in digits only and follows the slot, as a page's date.
    """
    inside: dict[int, list[Token]] = {}
    for t in tags.values():
        if t.token != 0:
            inside.setdefault(t.parent, []).append(t)
    at, slot = tags.get(0), None
    while at is not None:
        nested = inside.get(at.token, [])
        # what stands in no frequent tag, or right here
        sums = [getattr(at, n) - sum(getattr(t, n) for t in nested) for n in ("chars", "link_chars")]
        rest = Token(0, False, 0, False, 0, 0, (0, 0), *sums, loose=at.loose - sum(t.loose for t in nested)).held()
        found = []
        for t in nested:
            if t.token in valid and t.total == t.n_pages and 2 * t.link_chars < t.chars:
                others = (o.held(not (o.n_pages == t.n_pages and o.start >= t.start + t.chars)) for o in nested if o is not t)
                if rest <= 0 and not any(others):
                    found.append(t)
        # where no text differs, the largest
        at = max(found, key=lambda t: (t.chars, t.token), default=None)
        slot = at or slot
    return slot


def templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, slots, constant) of every host.

    Repeated pages count as one: what counts is a page's content.  Sums per host and token are combined in the tasks before the shuffle, so a host with a third of the pages sends a
    row per token and task.  A host's template keeps tokens that half of its pages have: about as many as a page holds.
    """
    rows = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), F.unhex(F.md5(F.coalesce(html_col, F.lit("")))).alias("content"))
    # stored, so that its size is known and the pages are not shuffled to meet a few repeated contents
    repeated = cut_lineage(rows.groupBy("host", "content").agg(F.count("*").alias("copies")).where("copies > 1"), "html-copies")
    rows = rows.join(repeated, ["host", "content"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    sums = ("n_pages", "total", "sign_a", "sign_b", "chars", "link_chars", "start")
    counted = rows.mapInArrow(_tokens, TOKEN).groupBy("host", "token", "is_text", "copies").agg(
        F.first("parent").alias("parent"), F.max("article").alias("article"), *[F.sum(c).alias(c) for c in sums])
    # every content of so many copies has gone into a sum as often
    counted = counted.groupBy("host", "token", "is_text").agg(
        F.first("parent").alias("parent"), F.max("article").alias("article"), *[F.sum(F.expr(f"{c} div copies")).alias(c) for c in sums])
    # a text of one page is no constant one
    counted = cut_lineage(counted.where("n_pages > 1 OR NOT is_text"), "html-tokens")
    hosts = counted.where("token = 0 AND NOT is_text").select("host", F.col("n_pages").alias("pages"))
    frequent = counted.join(hosts, "host").where(F.col("n_pages") >= TAG_SUPPORT * F.col("pages"))
    grouped = frequent.groupBy("host", "pages").agg(F.collect_list(F.struct(*[c for c in counted.columns if c != "host"])).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            found = []
            for n, tokens in zip(batch["pages"].to_pylist(), batch["tokens"].to_pylist()):
                tokens = [Token(sign=(t.pop("sign_a"), t.pop("sign_b")), **t) for t in tokens]
                mark(n, tokens)
                found.append(deduce(n, tokens))
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["host"], *lists], names=["host", "slots", "constant"])

    return grouped.mapInArrow(run, TEMPLATE)


def main_text(html: str | None, slots: frozenset[int], constant: frozenset[int]) -> str:
    """The article's blocks, joined by newlines: those in the template's slots, else, where the page has none of them,
    those in an article by name, if they are most of its text, else all."""
    blocks = parse(html, slots).blocks
    chosen = [b for b in blocks if b[2]]
    if not chosen:
        chosen = [b for b in blocks if b[3]]
        if sum(len(b[0]) - b[5] for b in chosen) < NAMED_SHARE * sum(len(b[0]) - b[5] for b in blocks) or not chosen:
            chosen = blocks
    own = [i for i, b in enumerate(chosen) if b[1] not in constant]
    # constant texts go before the first, if they are no headings, and after the last of the page's own; a page of nothing
    # but them keeps them
    return "\n".join(b[0] for i, b in enumerate(chosen) if not own or own[0] <= i <= own[-1] or (b[6] and i < own[0]))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Null and empty html gives empty text.  Pages without a host (null or malformed url) share a template.  Repeated
    pages give repeated rows; other columns are ignored.  All of a page's html is read, twice: once for its host's
    template, once for its text.  The pages are joined with the stored templates; their size decides how.
    """
    found = cut_lineage(templates(pages, url_col=url_col, html_col=html_col), "html-templates")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [
                main_text(html, frozenset(slots or ()), frozenset(constant or ()))
                for html, slots, constant in zip(*(batch[n].to_pylist() for n in ("html", "slots", "constant")))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"]
            )

    joined = rows.join(found, "host", "left").select("id", "url", "html", "slots", "constant")
    return joined.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
