"""Text column expressions.  All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from html import unescape as unescape_one
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

# Characters that count as white space at the ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A character reference, as HTML 5 reads it.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# The names met most, looked up first.
COMMON_NAMES = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;")

# The patterns of e-mail addresses and phone numbers; (?U) gives classes their Unicode meaning.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"(?U)[\+]?[\d\s\-\(\)]{10,15}"
URL = r"(?U)https?://\S+"
MARKDOWN_SPECIAL = r"([_*\[\]()~`>#+\-=|{}.!])"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate *value* once and use it several times in *body*."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, **cells: Column) -> DataFrame:
    """Add columns that the optimizer will neither inline nor compute a second time.

    A one-element array of a struct is turned into columns: filters on them stay above
    it, so a costly text search is not repeated below the filter.  The cells are columns
    before that, as Spark interprets what stands inside a generator.
    """
    ahead = {name: f"_ahead_{name}" for name in cells}
    row = F.struct(*[F.col(held).alias(name) for name, held in ahead.items()])
    out = df.select("*", *[cell.alias(ahead[name]) for name, cell in cells.items()])
    return out.select("*", F.inline(F.array(row))).drop(*ahead.values())


def as_text(c: Column | str, is_array: bool = False) -> Column:
    """NULL becomes '', an array becomes a ', ' joined text, anything else its text form."""
    c = col_of(c)
    return F.coalesce(F.array_join(c, ", ") if is_array else c.cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Remove white space (not only blanks) from both ends."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def match_key(*cols: Column | str) -> Column:
    """Digest under which two records count as the same one."""
    return F.md5(F.concat_ws("|", *[strip(F.lower(as_text(c))) for c in cols]))


# -- keyword tests ------------------------------------------------------------
# In all of them *text* is lower case already and cheap to read (a column, or the
# variable of let), because it is read once per term.  The terms travel as one array
# literal: a chain of OR tests would outgrow the size limit of generated code.
def _terms(terms: Iterable[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def _word(term: str) -> str:
    return r"(?U)\b" + re.escape(term) + r"\b"


def has_term(text: Column, term: str, match: str = "substring") -> Column:
    return text.rlike(_word(term)) if match == "word" else F.contains(text, F.lit(term))


def any_term(text: Column, terms: Sequence[str], match: str = "substring") -> Column:
    if match == "word":
        return text.rlike("|".join(_word(t) for t in terms))
    if len(terms) == 1:
        return F.contains(text, F.lit(terms[0]))
    return F.exists(_terms(terms), lambda t: F.contains(text, t))


def term_count(text: Column, terms: Sequence[str], match: str = "substring", enough: int | None = None) -> Column:
    """Number of distinct terms present; each counts once however often it occurs.

    Counting stops at *enough*: terms beyond it are not searched for.
    """
    if match == "word":
        found = F.filter(_terms([_word(t) for t in terms]), lambda t: F.regexp_like(text, t))
        return F.size(found) if enough is None else F.least(F.size(found), F.lit(enough))

    def add(seen: Column, term: Column) -> Column:
        more = seen + F.contains(text, term).cast("int")
        return more if enough is None else F.when(seen >= enough, seen).otherwise(more)

    return F.aggregate(_terms(terms), F.lit(0), add)


def term_list(text: Column, terms: Sequence[str], match: str = "substring") -> Column:
    """The terms present, in dictionary order and spelling."""
    if match == "word":
        return F.filter(_terms(terms), lambda t: F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), F.lower(t), F.lit(r"\E\b"))))
    return F.filter(_terms(terms), lambda t: F.contains(text, F.lower(t)))


def first_term(text: Column, terms: Sequence[str], match: str = "substring") -> Column:
    """The first term of the list that is present, else NULL."""
    return F.get(term_list(text, terms, match), F.lit(0))


# Fixed value: a character that no term contains.
GAP = "\0"


def searchable(c: Column | str, terms: Sequence[str], keep: int = 0) -> Column:
    """A short text that stands in for a long one in substring tests: its two ends and, between them, the terms in it.

    Put together with any other texts and made lower case, it holds just those *terms* that the long text would hold
    there; terms across a border lie within the ends.  The first *keep* characters are those of the long text.  NULL and
    short texts stay as they are.  Terms are lower case, without a Greek sigma (its form depends on what follows it).
    """
    reach = max(map(len, terms)) - 1
    start = max(keep, reach)

    def short(text: Column) -> Column:
        found = let(F.lower(text), lambda t: F.array_join(term_list(t, terms), GAP))
        whole = text.isNull() | (F.length(text) <= start + reach)
        return F.when(whole, text).otherwise(F.concat_ws(GAP, F.left(text, F.lit(start)), found, F.right(text, F.lit(reach))))

    return let(col_of(c), short)


# -- HTML ---------------------------------------------------------------------
def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), "<[^>]+>", " ")


def _table(entries: dict[str, str]) -> Column:
    """A literal map; one text literal, so that plans stay small."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entries.items())), F.lit("\x01"), F.lit("\x02"))


def _character(code: Column) -> Column:
    """The text of '#38', '#x26;' or 'amp;'; NULL if it is no reference."""
    # names that need no semicolon also count at the beginning of a longer one
    loose = {name: char for name, char in html5.items() if not name.endswith(";")}
    named = F.try_element_at(_table({n: html5[n] for n in COMMON_NAMES}), code)
    begins = [
        F.when(F.length(code) > n, F.concat(F.try_element_at(_table(loose), F.substring(code, 1, n)), F.substring(code, F.lit(n + 1), F.length(code))))
        for n in range(max(map(len, loose)), 1, -1)
    ]
    named = F.coalesce(named, F.try_element_at(_table(dict(html5)), code), *begins)
    hexadecimal = F.lower(code).startswith("#x")
    digits = F.regexp_replace(F.regexp_replace(code, "^#[xX]?0*|;$", ""), "^$", "0")
    number = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int"))
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    # the standard's exceptions: codes 128 to 159 mean Windows-1252, some stand for nothing
    special = {str(n): unescape_one(f"&#{n};") for n in (0, 13, *range(1, 9), 11, *range(14, 32), *range(127, 160))}
    nothing = [0xFDD0 + n for n in range(32)] + [plane * 0x10000 + n for plane in range(17) for n in (0xFFFE, 0xFFFF)]
    value = (
        F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(number.isin(nothing), F.lit("")).otherwise(F.coalesce(F.try_element_at(_table(special), number.cast("string")), plain))
    )
    return F.when(code.startswith("#"), value).otherwise(named)


def unescape(c: Column | str) -> Column:
    """Decode every character reference as HTML 5 does; one pass, so nothing is decoded twice.

    The text is cut at its references and put together again with their characters.
    """

    def decode(text: Column) -> Column:
        marks = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
        chars = F.transform(marks, lambda m: let(m, lambda k: F.coalesce(_character(k), F.concat(F.lit("&"), k))))
        between = F.split(text, REFERENCE)
        out = F.array_join(F.zip_with(between, chars, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(F.contains(text, F.lit("&")), out).otherwise(text)

    return let(col_of(c), decode)


def plain_text(c: Column | str, entities: str = "table") -> Column:
    """Tags out, entities decoded, ends stripped."""
    from postsift.functions.arrow import unescape_full

    decode = unescape_full if entities == "full" else unescape
    return strip(decode(strip_tags(c)))


# -- extraction ---------------------------------------------------------------
def first_match(c: Column | str, pattern: str, group: int = 0) -> Column:
    """First match, '' if there is none (also for NULL input)."""
    return F.coalesce(F.regexp_extract(col_of(c), pattern, group), F.lit(""))


def first_match_with(c: Column | str, must: str, pattern: str, group: int = 0) -> Column:
    """first_match for a pattern that needs the text *must*; the regular expression runs on
    rows that have it, and a plain search settles all others."""
    c = col_of(c)
    return F.when(F.contains(c, F.lit(must)), first_match(c, pattern, group)).otherwise(F.lit(""))


def has_word(text: Column, words: Sequence[str]) -> Column:
    """True when one of the words stands alone in a lower case text.  Plain search first."""
    return any_term(text, words) & any_term(text, words, match="word")


def first_email(c: Column | str) -> Column:
    return first_match_with(c, "@", EMAIL)


def first_phone(c: Column | str) -> Column:
    return strip(first_match(c, PHONE))


def first_url(c: Column | str) -> Column:
    return F.rtrim(first_match_with(c, "http", URL), F.lit(".,)>"))


def first_url_of_html(c: Column | str) -> Column:
    """first_url of plain_text, reading no more of the text than that needs.

    Letters come from no reference but a numeric one, so a text with neither "http" nor "&#" has no URL.  The end of a tag
    becomes a blank, which nothing that is decoded or matched goes beyond: a URL found up to there is the first of all.  One
    that ends in a character that `strip` removes is looked for in the whole text, whose end it may be.
    """

    def found(text: Column) -> Column:
        begin = F.regexp_extract(text, r"(?s)^.*?http.*?<[^>]+>", 0)
        early = F.when(begin != "", first_url(unescape(strip_tags(begin)))).otherwise(F.lit(""))
        whole = first_url(plain_text(text))
        may = F.contains(text, F.lit("http")) | F.contains(text, F.lit("&#"))
        return F.when(may, let(early, lambda url: F.when((url != "") & (strip(url) == url), url).otherwise(whole))).otherwise(F.lit(""))

    return let(col_of(c), found)


def first_int(c: Column | str) -> Column:
    """First run of digits as INT, NULL if none: 'Over 200' gives 200."""
    return F.nullif(first_match(c, "[0-9]+"), F.lit("")).try_cast("int")


def url_without_query(c: Column | str) -> Column:
    return F.split_part(col_of(c), F.lit("?"), F.lit(1))


def absolute_url(c: Column | str, base: Column | str) -> Column:
    """Prefix *base* unless the link is absolute already; '' stays ''."""
    c = col_of(c)
    base = F.lit(base) if isinstance(base, str) else base
    return F.when((c == "") | c.startswith("http"), c).otherwise(F.concat(base, c))


def url_origin(c: Column | str) -> Column:
    """scheme://host of a URL, '' if it has none."""
    return first_match(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+")


def pipe_field(c: Column | str, index: int, max_chars: int | None = None) -> Column:
    """Field *index* of a 'a | b | c' text, '' if missing or longer than *max_chars*."""
    value = F.coalesce(strip(F.get(F.split(col_of(c), r"\|"), F.lit(index))), F.lit(""))
    if max_chars is None:
        return value
    return F.when(F.length(value) > max_chars, F.lit("")).otherwise(value)


def split_label(c: Column | str) -> tuple[Column, Column]:
    """'Company: Title' into (company, title) at the first colon; no colon means no company."""
    c = col_of(c)
    parts = F.split(c, ":", 2)
    has = F.contains(c, F.lit(":"))
    return F.when(has, strip(parts[0])).otherwise(F.lit("")), F.when(has, strip(parts[1])).otherwise(c)


def clean_missing(c: Column | str) -> Column:
    """NULL and 'nan' become '', the rest is stripped."""
    text = strip(col_of(c).cast("string"))
    return F.when(text.isNull() | (text == "nan") | (text == "NaN"), F.lit("")).otherwise(text)


# -- display ------------------------------------------------------------------
def known_amount(c: Column | str) -> Column:
    """True for a usable amount: NULL and 0 both count as missing."""
    c = col_of(c)
    return c.isNotNull() & (c != 0)


def money(c: Column | str, missing: str = "N/A", suffix: str = "") -> Column:
    c = col_of(c)
    return F.when(known_amount(c), F.concat(F.lit("$"), F.format_number(c, 0), F.lit(suffix))).otherwise(F.lit(missing))


def yes_no(c: Column | str) -> Column:
    c = col_of(c)
    return F.when(c.isNull(), "Unknown").when(c, "Yes").otherwise("No")


def band(score: Column | str, bounds: Sequence[tuple[int, str]], lowest: str) -> Column:
    """Label of the first bound that the score reaches."""
    score = col_of(score)
    out = F.lit(lowest)
    for bound, label in reversed(bounds):
        out = F.when(score >= bound, F.lit(label)).otherwise(out)
    return out


def escape_markdown(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), MARKDOWN_SPECIAL, r"\\$1")


def strip_markdown(c: Column | str) -> Column:
    return F.left(F.regexp_replace(col_of(c), r"[*_`\[\]\\]", ""), F.lit(4096))


def title_case(c: Column | str) -> Column:
    """Capital letter at the start of every run of letters: 'my_site' gives 'My_Site'."""
    runs = F.regexp_extract_all(F.lower(col_of(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def pretty_label(c: Column | str, separator: str = " ") -> Column:
    return F.replace(col_of(c), F.lit("_"), F.lit(separator))


# -- JSON ---------------------------------------------------------------------
def unfence(c: Column | str) -> Column:
    """Drop a ``` fence around a reply."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-z]*\n?", ""), r"\n?```$", "")


def _decode_object(c: Column | str, schema: str) -> tuple[Column, Column]:
    body = strip(unfence(c))
    parsed = F.from_json(body, schema + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    valid = F.coalesce(parsed["_bad"].isNull() & parsed.isNotNull() & body.startswith("{"), F.lit(False))
    return parsed, valid


def model_reply(c: Column | str) -> Column:
    """Decode a scoring reply to STRUCT<score, reason, summary, skills>.

    Missing fields get defaults; an unreadable reply gives NULLs and no skills.
    """
    from postsift.config import REPLY_DEFAULT_SCORE

    raw, valid = _decode_object(c, "score STRING, reason STRING, summary STRING, skills ARRAY<STRING>")
    score = F.when(raw["score"].isNull(), F.lit(REPLY_DEFAULT_SCORE)).otherwise(raw["score"].try_cast("double").try_cast("int"))
    valid = valid & score.isNotNull()
    return F.struct(
        F.when(valid, score).alias("score"),
        F.when(valid, F.coalesce(raw["reason"], F.lit(""))).alias("reason"),
        F.when(valid, F.coalesce(raw["summary"], F.lit(""))).alias("summary"),
        F.when(valid, F.coalesce(raw["skills"], F.array().cast("array<string>"))).otherwise(
            F.array().cast("array<string>")
        ).alias("skills"),
    )


def post_reply(c: Column | str) -> Column:
    """Decode a post reply; an unreadable one counts as a posting with a low score.

    A NULL input means that no model ran: every field stays NULL.
    """
    from postsift.config import POST_INVALID_REPLY_SCORE

    names = ("job_title", "company", "contact_name", "contact_email", "contact_linkedin", "role_category")
    raw, valid = _decode_object(
        c, "is_job_posting BOOLEAN, score STRING, " + ", ".join(f"{n} STRING" for n in names)
    )
    asked = col_of(c).isNotNull()
    return F.struct(
        F.when(valid, raw["is_job_posting"]).when(asked, F.lit(True)).alias("is_job_posting"),
        F.when(valid, raw["score"].try_cast("double").try_cast("int")).when(asked, F.lit(POST_INVALID_REPLY_SCORE)).alias("score"),
        *[F.when(valid, raw[n]).alias(n) for n in names],
    )


def skills_to_json(c: Column | str) -> Column:
    return F.coalesce(F.to_json(col_of(c)), F.lit("[]"))


def skills_from_json(c: Column | str) -> Column:
    """Unreadable text gives an empty list."""
    return F.coalesce(F.from_json(col_of(c), "array<string>"), F.array().cast("array<string>"))
