"""Quality rules as weak supervision: rules vote good, bad or abstain; expectation-maximisation estimates how often each
is right; the posterior probability of good quality decides, instead of "all rules must pass".

The votes of a document form a code.  The corpus enters the estimate as counts of codes, of which there are at most
3 ** len(RULES), so nothing that grows with the corpus leaves the executors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsift.llm.common import small_batches
from postsift.session import cut_lineage

SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
BAD, GOOD, ABSTAIN = 0, 1, 2
#: The share of good documents below which none is kept.
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass
class Measures:
    """Counts over one whole text; words are `[^\\x20\\x09-\\x0D]+`."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    n_lines: int = 0
    n_ended: int = 0
    n_bare: int = 0
    n_shouted: int = 0
    n_top_word: int = 0
    n_marked: int = 0

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def measure(text: str | None) -> Measures:
    """Null and empty texts, and texts of white space, have no words and only zeros."""
    m = Measures()
    words = text.encode().split() if text else ()  # bytes split at exactly ASCII white space
    if not words:
        return m
    m.n_words = len(words)
    m.word_chars = len(text) - sum(map(text.count, SPACE))
    m.n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    m.n_lines = len(lines)
    m.n_dup_lines = len(lines) - len(set(lines))
    m.n_ended = sum(line.rstrip(SPACE)[-1] in ".!?…:;\"'”»)" for line in lines)
    m.n_repeat_words = _repeated(words)
    counts = Counter(words)
    m.n_top_word = max(counts.values())
    for word, n in counts.items():
        kept = word.rstrip(MARKS)
        if not kept:
            m.n_bare += n
        elif len(word) - len(kept) > 1:
            m.n_marked += n
        if len(kept) > 1 and kept.isupper():
            m.n_shouted += n
    return m


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, inside = Counter(windows), bytearray(len(words))
    for at, window in enumerate(windows):
        if counts[window] > 1:
            inside[at : at + 3] = b"\1\1\1"
    return sum(inside)


def _band(bad: Callable[[Measures], bool], good: Callable[[Measures], bool]) -> Callable[[Measures], int]:
    return lambda m: ABSTAIN if not m.n_words else BAD if bad(m) else GOOD if good(m) else ABSTAIN


#: Each rule has a band in which it says bad, one in which it says good, and abstains between them.
RULES: dict[str, Callable[[Measures], int]] = {
    "symbols": _band(lambda m: m.n_symbols > 0.1 * m.n_words, lambda m: m.n_symbols <= 0.02 * m.n_words),
    "repeated_lines": _band(lambda m: m.n_dup_lines > max(3, 0.3 * m.n_lines), lambda m: m.n_dup_lines <= 0.1 * m.n_lines and m.n_lines > 1),
    "repeated_words": _band(lambda m: m.n_repeat_words > 0.25 * m.n_words, lambda m: m.n_repeat_words <= 0.1 * m.n_words),
    "word_length": _band(
        lambda m: not 2.5 * m.n_words <= m.word_chars <= 14 * m.n_words, lambda m: 3 * m.n_words <= m.word_chars <= 11 * m.n_words
    ),
    "shouting": _band(lambda m: m.n_shouted > 0.3 * m.n_words, lambda m: m.n_shouted <= 0.1 * m.n_words),
    "sentence_ends": _band(lambda m: m.n_ended < 0.1 * m.n_lines and m.n_lines > 3, lambda m: m.n_ended >= 0.5 * m.n_lines),
    "marked_words": _band(lambda m: m.n_marked > 0.3 * m.n_words, lambda m: m.n_marked <= 0.05 * m.n_words),
    "bare_marks": _band(lambda m: m.n_bare > 0.2 * m.n_words, lambda m: m.n_bare <= 0.03 * m.n_words),
    "one_word": _band(lambda m: m.n_top_word > 0.3 * m.n_words and m.n_words > 20, lambda m: m.n_top_word <= 0.2 * m.n_words),
}


def vote_code(m: Measures) -> int:
    """The votes as one number, a digit of base 3 for each rule."""
    code = 0
    for rule in RULES.values():
        code = 3 * code + rule(m)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """Codes to rows of votes, in the order of RULES."""
    n = len(RULES)
    return (codes[:, None] // 3 ** np.arange(n - 1, -1, -1)) % 3


@dataclass
class LabelModel:
    """prior of good; right[j] = (P(rule j says bad | bad), P(it says good | good)), given that it votes."""

    prior: float
    right: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """P(good) for each code."""
        votes = votes_of(codes)
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(codes), 1))
        for j in range(votes.shape[1]):
            bad_right, good_right = self.right[j]
            log[votes[:, j] == BAD] += np.log([bad_right, 1 - good_right])
            log[votes[:, j] == GOOD] += np.log([1 - bad_right, good_right])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over counts of codes.

    It begins with the belief that rules are mostly right and most documents good, and keeps a little of it as
    pseudo-counts, so that an empty or uniform corpus has a defined result and bad and good cannot change places.
    """
    k = len(RULES)
    model = LabelModel(0.8, np.tile([0.6, 0.95], (k, 1)))
    votes = votes_of(codes)
    for _ in range(rounds):
        good = model.posterior(codes)
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = (weight[1].sum() + 8) / (counts.sum() + 10)
        right = np.empty((k, 2))
        for j in range(k):
            for y, (hit, miss) in enumerate(((BAD, GOOD), (GOOD, BAD))):
                a, b = weight[y][votes[:, j] == hit].sum(), weight[y][votes[:, j] == miss].sum()
                believed = (0.6, 0.95)[y]
                right[j, y] = (a + 10 * believed) / (a + b + 10)
        moved = abs(prior - model.prior) + np.abs(right - model.right).max()
        model = LabelModel(float(prior), right)
        if moved < 1e-9:
            break
    return model


MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, code long"


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    names = [f.split()[0] for f in MEASURED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [measure(text) for text in batch.column(1).to_pylist()]
            columns = [pa.array([getattr(m, n) for m in rows]) for n in names[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array([vote_code(m) for m in rows], pa.int64())], names=["id", *names]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {MEASURED}")


def _fit_on(coded: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """The model of a corpus, and its codes.  The counts that reach the driver are at most 3 ** len(RULES)."""
    rows = sorted(tuple(r) for r in coded.groupBy("code").count().collect())
    codes = np.array([c for c, _ in rows], dtype=np.int64)
    return fit(codes, np.array([n for _, n in rows], dtype=float)), codes


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: id, the measures, base_failed, the votes' code, quality (posterior) and kept.

    kept is false if base_failed, else quality >= keep_at.  Null and empty texts measure zero, fail the base check and
    get the prior as quality, as all rules abstain.  Repeated documents count, and are returned, as often as they occur.
    Other columns are ignored.  An empty table gives no rows.

    The texts are read once; a narrow table of measures is stored in the shared folder and read twice.
    """
    measured = cut_lineage(_measured(docs, id_col, text_col), "quality-rules")
    model, codes = _fit_on(measured)
    qualities = docs.sparkSession.createDataFrame(
        [(int(c), float(q)) for c, q in zip(codes, model.posterior(codes))], "code long, quality double"
    )
    judged = measured.join(F.broadcast(qualities), "code")  # one row per code: bounded by the rules
    return judged.select(
        F.col("id").alias(id_col), *[c for c in measured.columns if c != "id"], "quality",
        (~F.col("base_failed") & (F.col("quality") >= keep_at)).alias("kept"),
    )


def keep_good(docs: DataFrame, *, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that `judge` keeps, with all their columns as they are.

    The texts are read twice, once for the model and once to filter; nothing but code counts is shuffled or stored.
    """
    at = docs.columns.index(text_col)
    model, codes = _fit_on(_measured(docs, text_col, text_col))
    good = {int(c) for c, q in zip(codes, model.posterior(codes)) if q >= keep_at}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [measure(text) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([not m.base_failed and vote_code(m) in good for m in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
