"""Model enrichment hook, prompt text and the local text vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postsift import config as C
from postsift.functions import text as T
from postsift.functions.digest import md5_prefixes
from postsift.operators.publish import top_k

PROMPT = (
    "Rate how well this posting fits the reader.\n"
    "Title: {title}\nCompany: {company}\nLocation: {location}\nType: {job_type}\n"
    "Salary: {salary}\nDescription: {description}\n"
    'Answer with JSON only: {{"score": 0-100, "reason": "", "summary": "", "skills": []}}'
)
POST_PROMPT = (
    "Extract the opening described in this post.\nAuthor: {author_name}\nPost: {post_text}\n"
    'Answer with JSON only: {{"is_job_posting": true, "job_title": null, "company": null, "contact_name": null, '
    '"contact_email": null, "contact_linkedin": null, "role_category": null, "score": 0-100}}'
)
LETTER_PROMPT = (
    "Write a short letter for this application.\nApplicant: {name}, {profile_title}, {years} years\n"
    "Skills: {skills}\nSummary: {summary}\nTitle: {title}\nCompany: {company}\nLocation: {location}\n"
    "Description: {description}"
)


def fill(template: str, **values: Column) -> Column:
    """Replace {name} marks of a template by columns."""
    parts, rest = [], template.replace("{{", "\0").replace("}}", "\1")
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head.replace("\0", "{").replace("\1", "}")), values[name]]
    return F.concat(*parts, F.lit(rest.replace("\0", "{").replace("\1", "}")))


def prompt_column(template: str = PROMPT, description_chars: int = 800) -> Column:
    salary = F.when(T.known_amount("salary"), F.col("salary").cast("string")).otherwise(F.lit("not listed"))
    return fill(
        template, salary=salary, description=F.left(T.as_text("description"), F.lit(description_chars)),
        **{c: T.as_text(c) for c in ("title", "company", "location", "job_type")},
    )


def post_prompt_column(template: str = POST_PROMPT, text_chars: int = 1500) -> Column:
    return fill(template, author_name=T.as_text("author_name"), post_text=F.left(T.as_text("post_text"), F.lit(text_chars)))


def letter_prompt_column(profile: str = "profile", template: str = LETTER_PROMPT) -> Column:
    """Prompt of an application letter: posting columns plus a *profile* struct."""
    p = F.col(profile)
    return fill(
        template, name=F.coalesce(p["name"], F.lit("the applicant")), profile_title=F.coalesce(p["title"], F.lit(C.PROFILE_DEFAULT_TITLE)),
        years=F.coalesce(p["years_experience"], F.lit(0)).cast("string"),
        skills=F.coalesce(F.array_join(F.slice(p["skills"], 1, 12), ", "), F.lit("")), summary=F.coalesce(p["summary"], F.lit("")),
        description=F.left(T.as_text("description"), F.lit(600)), **{c: T.as_text(c) for c in ("title", "company", "location")},
    )


Answer = Callable[[pd.Series], pd.Series]


def ask(df: DataFrame, id_col: str, prompt: Column, answer: Answer) -> DataFrame:
    """(id, reply) for every row; *answer* maps a batch of prompts to replies.

    A batch that raises is asked again row by row; a row that still raises gets NULL, so a
    failing call never fails the task.
    """

    def one(text: str) -> str | None:
        try:
            return answer(pd.Series([text])).iloc[0]
        except Exception:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                replies = list(answer(batch["prompt"]))
            except Exception:
                replies = [one(text) for text in batch["prompt"]]
            yield pd.DataFrame({"id": batch["id"], "reply": replies})

    asked = df.select(F.col(id_col).alias("id"), prompt.alias("prompt"))
    kind = dict(asked.dtypes)["id"]
    return asked.mapInPandas(run, f"id {kind}, reply string")


def enrich_top(
    df: DataFrame, id_col: str, answer: Answer, *, by: str = "score", n: int = C.ENRICH_ROWS, tasks: int = 8,
    prompt: Column | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ask about the n best rows and add llm_score, llm_reason, llm_summary and skills.

    The budget counts rows asked.  Rows that share an id share the answer; no row is multiplied.  If *df* does not carry
    the texts of the prompt, *fetch* puts them into the rows asked.
    """
    top = top_k(df, n, F.desc(by), id_col).dropDuplicates([id_col])
    top = (top if fetch is None else fetch(top)).repartition(tasks, id_col)
    replies = ask(top, id_col, prompt_column() if prompt is None else prompt, answer)
    decoded = replies.select(F.col("id").alias(id_col), T.model_reply("reply").alias("_m"))
    fields = {"score": "llm_score", "reason": "llm_reason", "summary": "llm_summary", "skills": "skills"}
    out = df.drop(*fields_present(df, fields)).join(decoded, id_col, "left")
    cols = [F.col(f"_m.{k}").alias(v) for k, v in fields.items() if k != "skills"]
    skills = F.coalesce(F.col("_m.skills"), F.array().cast("array<string>")).alias("skills")
    return out.select(*[c for c in out.columns if c != "_m"], *cols, skills)


def fields_present(df: DataFrame, fields: dict[str, str]) -> list[str]:
    return [c for c in fields.values() if c in df.columns]


#: Bytes of text whose terms are hashed together.
_HASHED = 1 << 22


def _term_vectors(texts: list[bytes], dim: int) -> list[np.ndarray | None]:
    """The vectors of `embed_text` for lower-case texts."""
    out, some, size = [], [], 0
    for text in texts:
        some.append(b" ".join(text.split()))
        size += len(some[-1])
        if size >= _HASHED:
            out += _hashed_vectors(some, dim)
            some, size = [], 0
    return out + _hashed_vectors(some, dim)


def _hashed_vectors(texts: list[bytes], dim: int) -> list[np.ndarray | None]:
    """The same for texts of words with one blank between them: white space is nowhere else, so a line break ends a text."""
    full = [t for t in texts if t]
    data = np.frombuffer(b"".join(t + b"\n" for t in full), np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    last = data[ends] == 10
    paired = np.flatnonzero(~last)
    words, pairs = md5_prefixes(data, starts, ends), md5_prefixes(data, starts[paired], ends[paired + 1])
    till = np.flatnonzero(last) + 1  # words up to the end of each text; it has one pair less than words
    vectors, at = [], 0
    for n, end in enumerate(till):
        # 64 bits of the digest tell the terms of a text apart
        terms = np.sort(np.concatenate([words[at:end], pairs[at - n:end - n - 1]]))
        terms = (terms[np.concatenate([[True], terms[1:] != terms[:-1]])] >> np.uint64(32)).astype(np.int64)
        vector = np.bincount((terms >> 1) % dim, weights=1 - 2 * (terms & 1), minlength=dim)
        length = np.sqrt((vector * vector).sum())
        vectors.append((vector / length if length else vector).astype(np.float32))
        at = end
    rest = iter(vectors)
    return [next(rest) if t else None for t in texts]


def embed_text(df: DataFrame, id_col: str, text: Column, dim: int = 64, *keep: str) -> DataFrame:
    """(id, embedding) and the columns *keep*: the distinct words and pairs of neighbours, each hashed to a place and a sign;
    unit length.  NULL for a text without words.

    Signs keep unlike texts near a right angle.  The hash is the first 32 bits of MD5: the lowest is the sign, the rest
    modulo *dim* the place.  A local stand-in for a remote embedding; any array<float> column serves instead.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        # bytes are split at ASCII white space, as Spark's \s does
        return pd.Series(_term_vectors([t or b"" for t in texts], dim), dtype=object)

    return df.select(F.col(id_col), *keep, embed(F.lower(text).cast("binary")).alias("embedding"))
