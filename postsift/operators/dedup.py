"""Exact deduplication with record merging, and first-wins distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postsift.functions.text import match_key
from postsift.session import cut_lineage


def order_struct(order_by: Sequence[str]) -> Column:
    return F.struct(*order_by)


def dedup_exact(
    df: DataFrame, order_by: Sequence[str] = ("source", "seq"), *, key: Column | None = None,
    salary: str = "salary", easy_apply: str = "easy_apply", description: str = "description",
    treat_empty_as_null: bool = False, text_ref: str | None = None,
) -> DataFrame:
    """One row per match key, filled from later copies.

    The first row in *order_by* (which has to be a total order) is the head.  If its
    salary is unknown, the first copy with a salary fills every unknown column of
    the head.  easy_apply comes from the first copy that knows it; a missing
    description from the first copy with some text, and with it the column *text_ref*.

    A single aggregate: copies meet already before the shuffle, so a key that holds a
    third of all rows sends one partial row per task.  A description may be text or binary: of a digest
    that is '' where the text is, less travels than of the text.
    """
    names = [c for c in df.columns if c not in (description, text_ref)]
    order = order_struct(order_by)
    key = F.unhex(match_key("title", "company", "location")) if key is None else key
    if treat_empty_as_null:
        df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c, t in df.dtypes if t == "string"})
    # The long text travels once: the rows only note whether theirs is '' (known
    # but empty), because any other text of theirs is the first one there is.
    is_empty = F.coalesce(F.length(description) == 0, F.lit(False))
    carried = [c for c in names if c != easy_apply or c in order_by]
    row = F.struct(*carried, is_empty.alias("_empty"))
    refs = [] if text_ref is None else [F.col(text_ref).alias("ref")]
    text = F.struct(F.struct(*order_by).alias("at"), F.col(description).alias("text"), *refs)
    paid = F.col(salary).isNotNull()

    def first(value: Column, when: Column) -> Column:
        """min_by over the rows that qualify: a NULL order key is never the minimum."""
        return F.min_by(value, F.when(when, order))

    # a row is the first of one kind only, so it does not travel as head and as donor
    grouped = df.groupBy(key.alias("_key")).agg(
        first(row, ~paid).alias("_unpaid"),
        first(row, paid).alias("_paid"),
        first(F.col(easy_apply), F.col(easy_apply).isNotNull()).alias("_easy"),
        first(text, F.length(description) > 0).alias("_text"),
    )
    unpaid_at, paid_at = (F.struct(*[F.col(f"{kind}.{c}") for c in order_by]) for kind in ("_unpaid", "_paid"))
    unpaid_leads = F.col("_unpaid").isNotNull() & (F.col("_paid").isNull() | (unpaid_at <= paid_at))
    grouped = grouped.withColumns({
        "_head": F.when(unpaid_leads, F.col("_unpaid")).otherwise(F.col("_paid")),
        "_donor": F.when(unpaid_leads, F.col("_paid")),
    })
    donor_at = F.struct(*[F.col(f"_donor.{c}") for c in order_by])
    donor_empties = F.coalesce(F.col("_donor._empty"), F.lit(False)) & (F.col("_text").isNull() | (donor_at < F.col("_text.at")))
    merged = {c: F.coalesce(F.col(f"_head.{c}"), F.col(f"_donor.{c}")) for c in carried}
    merged[easy_apply] = F.col("_easy")
    empty = F.col("_head._empty") | donor_empties
    merged[description] = F.when(empty, F.lit("").cast(df.schema[description].dataType)).otherwise(F.col("_text.text"))
    if text_ref is not None:
        merged[text_ref] = F.when(~F.coalesce(empty, F.lit(False)), F.col("_text.ref"))
    return grouped.select(*[merged[c].alias(c) for c in df.columns])


def distinct_first(df: DataFrame, key: str, order_by: Sequence[str], blank: str = "drop") -> DataFrame:
    """First row per key in *order_by*.

    blank="drop" removes rows with an empty key, "keep_one" treats '' like any key,
    "keep_all" keeps every one of them.
    """
    names = df.columns
    is_blank = F.coalesce(F.col(key), F.lit("")) == ""
    keyed = df if blank == "keep_one" else df.where(~is_blank)
    group = F.coalesce(F.col(key), F.lit("")) if blank == "keep_one" else F.col(key)
    kept = (
        keyed.groupBy(group.alias("_key"))
        .agg(F.min_by(F.struct(*names), order_struct(order_by)).alias("_row"))
        .select("_row.*")
    )
    return kept.unionByName(df.where(is_blank)) if blank == "keep_all" else kept


def union_sources(*frames: DataFrame) -> DataFrame:
    """Bag union by name; a column a source lacks is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def first_n_per_group(df: DataFrame, group: str, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first *n* rows of each group; a group limit runs before the shuffle."""
    from pyspark.sql import Window

    window = Window.partitionBy(group).orderBy(*order_by)
    return df.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n)


def numbered_rows(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """The rows, stored, with a number that is unique and ascends in *order_by*.

    A number made for each stored row cannot collide, unlike a hash of a key, and needs no key to be present.
    The rows are stored before they are sorted, too: a sort samples its input first, and would compute it twice.
    """
    ordered = cut_lineage(df, "unordered").orderBy(*order_by).withColumn(name, F.monotonically_increasing_id())
    return cut_lineage(ordered, "numbered")
