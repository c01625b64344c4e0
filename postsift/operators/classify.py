"""Role and type classification, rejection reasons and the filter pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from postsift.config import DEFAULT_RULES, Rules
from postsift.functions.parse import seconds_after
from postsift.functions.text import any_term, as_text, col_of, computed_once, first_term, let


def _ordered(text: Column, steps, match: str) -> Column:
    """CASE over (label, terms) steps, first match wins; the caller adds the default."""
    out = None
    for label, terms in steps:
        test = any_term(text, terms, match)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def role_category(title: Column | str, rules: Rules = DEFAULT_RULES) -> Column:
    """First category with a phrase in the title; then the looser phrases; then the default."""
    steps = (*rules.role_phrases.items(), *rules.role_fallbacks)
    return let(F.lower(as_text(title)), lambda t: _ordered(t, steps, rules.match).otherwise(F.lit(rules.default_role)))


def rule_text(title: Column | str = "title", description: Column | str = "description") -> Column:
    """The lower case text that the phrase rules search."""
    return F.lower(F.concat_ws(" ", as_text(title), as_text(description)))


def job_type(current: Column | str, text: Column | None = None, rules: Rules = DEFAULT_RULES) -> Column:
    """A valid stated type wins; otherwise phrases in the rule text decide."""
    stated = F.replace(F.lower(as_text(current)), F.lit(" "), F.lit("_"))
    derived = let(
        rule_text() if text is None else text, lambda t: _ordered(t, rules.job_type_phrases, rules.match).otherwise(F.lit(rules.default_job_type))
    )
    return F.when(stated.isin(*rules.job_types), stated).otherwise(derived)


# Phrases of portal labels, first match wins.
LABEL_STEPS = (
    ("contract_to_hire", ("contract to hire", "c2h")), ("contract", ("contract",)), ("full_time", ("full", "permanent")),
)
CONTRACT_ONLY_STEPS = (("contract", ("contract",)),)


def type_label(raw: Column | str, default: str = "contract", steps=LABEL_STEPS) -> Column:
    """Map a portal's free-text type label."""
    return let(F.lower(as_text(raw)), lambda t: _ordered(t, steps, "substring").otherwise(F.lit(default)))


def iso_utc(ts: Column) -> Column:
    """ISO text of a UTC clock reading; microseconds only when there are any."""
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == ".000000", F.lit("")).otherwise(micros), F.lit("+00:00")
    )


def reject_reason(
    as_of: Column, rules: Rules = DEFAULT_RULES, *, text: Column | None = None, salary: str = "salary",
    posted: str = "posted_date", applicants: str = "applicants", easy_apply: str = "easy_apply",
) -> Column:
    """Text of the first rule a row breaks, NULL for a row that passes.  Unknown values pass."""
    word = let(rule_text() if text is None else text, lambda t: first_term(t, rules.excluded_terms, rules.match))
    cutoff = seconds_after(as_of, F.lit(-3600 * rules.max_age_hours))
    tests = [
        F.when(
            F.col(salary).try_cast("double") < rules.min_salary,
            F.concat(F.lit("salary "), F.col(salary).cast("string"), F.lit(f" < {rules.min_salary}")),
        ),
        F.concat(F.lit("excluded keyword: "), word),
        F.when(F.col(posted) < cutoff, F.concat(F.lit("too old: "), iso_utc(F.col(posted)))),
        F.when(
            F.col(applicants).try_cast("int") > rules.max_applicants,
            F.concat(F.lit("too many applicants: "), F.col(applicants).cast("string")),
        ),
    ]
    if rules.easy_apply_only:
        tests.append(F.when(F.col(easy_apply).eqNullSafe(F.lit(False)), F.lit("easy_apply_only mode")))
    return F.coalesce(*tests)


def classify(df: DataFrame, rules: Rules = DEFAULT_RULES, text: Column | None = None) -> DataFrame:
    """Set role_category and job_type."""
    current = "job_type" if "job_type" in df.columns else F.lit(None)
    return df.withColumns({"role_category": role_category("title", rules), "job_type": job_type(current, text, rules)})


def with_reasons(df: DataFrame, as_of: Column, rules: Rules = DEFAULT_RULES, text: Column | None = None) -> DataFrame:
    """All rows with a *reason* column, for auditing what the filter removes."""
    return df.withColumn("reason", reject_reason(as_of, rules, text=text))


def filter_pass(df: DataFrame, as_of: Column, rules: Rules = DEFAULT_RULES, metrics: Observation | None = None) -> DataFrame:
    """Classified rows that break no rule.  *metrics* collects the counts without another job."""
    # the rule text is lowered once for the filter and the type rules
    out = computed_once(df, _text=rule_text())
    out = with_reasons(out, as_of, rules, F.col("_text"))
    if metrics is not None:
        out = out.observe(
            metrics, F.count(F.lit(1)).alias("read"), F.count_if(F.col("reason").isNotNull()).alias("removed")
        )
    return classify(out.where(F.col("reason").isNull()), rules, F.col("_text")).drop("reason", "_text")


def keyword_gate(text: Column | str, any_of: tuple[str, ...], and_any_of: tuple[str, ...] = ()) -> Column:
    """True when the text has a term of the first list and, if given, one of the second."""

    def test(lowered: Column) -> Column:
        first = any_term(lowered, any_of)
        return first & any_term(lowered, and_any_of) if and_any_of else first

    return let(F.lower(as_text(col_of(text))), test)
