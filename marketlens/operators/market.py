"""Filters, price summaries, paging and checks over listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators import ranks


def filter_verdict(filters: dict[str, str]) -> Column:
    """``hide`` if an active field has another value, else ``unknown`` if one is missing, else ``keep``.

    An empty filter value is no filter; an empty field counts as missing.
    """
    active = {k: v for k, v in filters.items() if v != ""}
    if not active:
        return F.lit("keep")
    missing = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    any_of = lambda cs: F.array_contains(F.array(*cs), True)
    hide = any_of([~missing(k) & F.coalesce(F.col(k) != v, F.lit(False)) for k, v in active.items()])
    return F.when(hide, "hide").when(any_of([missing(k) for k in active]), "unknown").otherwise("keep")


def filter_counts(rows: DataFrame, filters: dict[str, str], by: list[str]) -> DataFrame:
    """How many rows of each group are kept, hidden, and hidden only for lack of a value."""
    v = rows.withColumn("_v", filter_verdict(filters))
    return v.groupBy(*by).agg(F.count_if(F.col("_v") == "keep").alias("kept"), F.count_if(F.col("_v") != "keep").alias("hidden"), F.count_if(F.col("_v") == "unknown").alias("unknown"))


def normal_filters(values: dict[str, object], fields: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """A filter value for each field: what is not one of the field's options is no filter."""
    return {k: v if isinstance(v := values.get(k), str) and v in options else "" for k, options in fields.items()}


def describe_filters(filters: dict[str, str]) -> str:
    return " · ".join(v for v in filters.values() if v)


def price_summary(rows: DataFrame, price: str, by: list[str]) -> DataFrame:
    """Counts, minimum and nearest-rank quartiles of the prices of each group; q1 and q3 need four prices.  A group may be of any size, see ``ranks``."""
    n = F.col("n")
    counts = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count(price).alias("priced"), (F.count("*") - F.count(price)).alias("unpriced"), F.min(price).alias("min_price"))
    quartile = lambda q: F.when(n >= 4, ranks.nearest(q, n))
    found = ranks.at_ranks(rows, by, price, {"median_price": ranks.nearest(0.5, n), "q1_price": quartile(0.25), "q3_price": quartile(0.75)})
    found = found.select(*[F.col(c).alias(f"_{c}") for c in by], "median_price", "q1_price", "q3_price")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return counts.join(found, same, "left").drop(*[f"_{c}" for c in by])


def page_of(rows: DataFrame, by: list[str], order: list[Column], page: int, size: int = 10) -> DataFrame:
    """One page of each group; a page number outside 1 to the last is moved to the nearest."""
    w = Window.partitionBy(*by)
    last = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / F.lit(size)))
    shown = F.least(F.greatest(F.lit(1), F.lit(page)), last).cast("int")
    n = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("page", shown).withColumn("rn", n).where((F.col("rn") > (F.col("page") - 1) * size) & (F.col("rn") <= F.col("page") * size))


def cross_check(n_rows: Column, markers: Column, says_empty: Column, trading: Column) -> Column:
    """Why a view's row count does not agree with the page's own markers, or ``passed`` or ``empty``.

    Listings may have more rows than markers, finished trades may not.
    """
    none = F.when((markers == 0) & says_empty, "empty").otherwise("no_rows")
    wrong = (trading & (n_rows < markers)) | (~trading & (n_rows != markers))
    return F.when(n_rows == 0, none).when(markers == 0, "no_anchor").when(wrong, "row_mismatch").otherwise("passed")


def view_gate(settled: Column, has_rows: Column, guard: Column, view_ok: Column, item_ok: Column, login: Column, count_code: Column) -> Column:
    """The first reason, in fixed order, why a view cannot be used."""
    return (
        F.when(~settled & ~has_rows, "timeout").when(guard.isNotNull(), guard).when(~view_ok, "wrong_view").when(~item_ok, "wrong_item")
        .when(~settled, "unsettled").when(login, "login_required").otherwise(count_code)
    )


def checks_summary(checks: dict[str, Column]) -> list[Column]:
    """Whether all named checks hold, and the names of those that do not, in order."""
    bad = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return [(F.size(bad) == 0).alias("passed"), bad.alias("failed_checks")]


#: Fixed value: what is said where none of the rows that came has the base's name.
NO_ROWS_OF_BASE = "網站回傳的 {n} 筆裡沒有名稱是「{base}」的掛單"


def rows_of_base(rows: DataFrame, base: Column, name: str = "item_name") -> DataFrame:
    """The rows whose name is the base, without regard to case; all where no base is asked for (null or empty)."""
    asked = F.coalesce(base, F.lit(""))
    return rows.where((asked == "") | F.coalesce(F.lower(name) == F.lower(asked), F.lit(False)))


def base_notes(views: DataFrame, rows: DataFrame, by: str, name: str = "item_name") -> DataFrame:
    """``by, base, rows_before_base, rows, note`` of each view (``by, base, passed``): how many rows came and how many have the base's name.

    Only views that passed and ask for a base are filtered: others count all their rows and have no ``rows_before_base``.  The note is there where all rows went.
    """
    asked = F.coalesce(F.col("base"), F.lit("")) != ""
    counted = rows.select(by, F.lower(name).alias("_name")).groupBy(by, "_name").agg(F.count("*").alias("_c"))
    both = views.select(by, "base", "passed", F.lower("base").alias("_base")).join(counted, by, "left")
    g = both.groupBy(by, "base", "passed").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_all"), F.coalesce(F.sum(F.when(F.col("_name") == F.col("_base"), F.col("_c"))), F.lit(0)).alias("_own"))
    filtered = F.coalesce(F.col("passed"), F.lit(False)) & asked
    before, after = NO_ROWS_OF_BASE.split("{n}")[0], NO_ROWS_OF_BASE.split("{n}")[1].split("{base}")
    note = F.concat(F.lit(before), F.col("_all").cast("string"), F.lit(after[0]), F.col("base"), F.lit(after[1]))
    return g.select(
        by, "base", F.when(filtered, F.col("_all")).alias("rows_before_base"), F.when(filtered, F.col("_own")).otherwise(F.col("_all")).alias("rows"),
        F.when(filtered & (F.col("_all") > 0) & (F.col("_own") == 0), note).alias("note"),
    )
