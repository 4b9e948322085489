"""Prefix scans of ordered rows per key that no key holds up: a key with a third of all rows spreads over many tasks.

A window sorts all rows of a key in one task. Here rows are dealt by ranges of (key, order), so a large key covers many
ranges; each range of a key is scanned by itself and folded to a summary (its number of rows, its sums, its first and last
values, its last values that are not null). Summaries are few, one for a key in a range, and what each range takes over
from those before it comes from a window over summaries alone. Applying it gives what a window over the whole key would.

A key with few rows costs a window and no scan: ``scanned`` counts rows by key first, and deals rows by ranges only if a key
has over ``HOT_ROWS``. Both ways give the same rows. Ties in ``order`` are taken in no fixed order, as in any window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import checkpointed

HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Wanted:
    """Columns to add, by name: ``lags`` the value of the row before (null for a key's first row), ``fills`` the last value
    so far that is not null, ``sums`` the sum so far, and ``number`` the name of the number of rows so far."""

    lags: dict[str, Column] = field(default_factory=dict)
    fills: dict[str, Column] = field(default_factory=dict)
    sums: dict[str, Column] = field(default_factory=dict)
    number: str | None = None


def _windowed(df: DataFrame, keys: list[str], order: list[str], w: Wanted) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    now = by.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.lag(c).over(by) for n, c in w.lags.items()}
    out |= {n: F.last(c, ignorenulls=True).over(now) for n, c in w.fills.items()}
    out |= {n: F.sum(c).over(now) for n, c in w.sums.items()}
    if w.number:
        out[w.number] = F.row_number().over(by).cast("long")
    return df.withColumns(out)


def by_ranges(df: DataFrame, keys: list[str], order: list[str], w: Wanted, ranges: int | None = None) -> DataFrame:
    """``df`` with the columns of ``w``, by summaries of ranges. ``ranges``: how many, or as many as the session shuffles to."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_scan_of_{name}": c for part in (w.lags, w.fills, w.sums) for name, c in part.items()}
    dealt = df.withColumns(values).repartitionByRange(n, *keys, *order)
    rows = checkpointed(dealt.withColumn("_scan_range", F.spark_partition_id()))  # written, so ranges stay what they are
    own = lambda part: {f"_scan_in_{x}": F.col(f"_scan_of_{x}") for x in part}
    inside = _windowed(rows, [*keys, "_scan_range"], order, Wanted(own(w.lags), own(w.fills), own(w.sums), "_scan_nth"))
    at, value = F.struct(*order), lambda x: F.col(f"_scan_of_{x}")
    shown = lambda x: F.struct(value(x).alias("v"))
    filled = lambda x, c: F.when(value(x).isNotNull(), c)
    folded = rows.groupBy(*keys, "_scan_range").agg(
        F.count("*").alias("rows"),
        *(F.max_by(shown(x), at).alias(f"last_{x}") for x in w.lags),
        *(F.max_by(filled(x, shown(x)), filled(x, at)).alias(f"last_{x}") for x in w.fills),
        *(F.sum(value(x)).alias(f"sum_{x}") for x in w.sums),
    )
    earlier = Window.partitionBy(*keys).orderBy("_scan_range")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    taken = {"_scan_before": F.coalesce(F.sum("rows").over(before), F.lit(0))}
    taken |= {f"_scan_pre_{x}": F.lag(f"last_{x}").over(earlier)["v"] for x in w.lags}
    taken |= {f"_scan_pre_{x}": F.last(f"last_{x}", ignorenulls=True).over(before)["v"] for x in w.fills}
    taken |= {f"_scan_pre_{x}": F.sum(f"sum_{x}").over(before) for x in w.sums}
    named = {f"_scan_key_{i}": F.col(k) for i, k in enumerate(keys)} | {"_scan_from": F.col("_scan_range")}
    carry = folded.select(*(c.alias(x) for x, c in (named | taken).items()))
    same = F.col("_scan_range") == F.col("_scan_from")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_scan_key_{i}"))
    x = inside.join(carry, same)
    here, pre = (lambda name: F.col(f"_scan_in_{name}")), (lambda name: F.col(f"_scan_pre_{name}"))
    out = {name: F.when(F.col("_scan_nth") > 1, here(name)).otherwise(pre(name)) for name in w.lags}
    out |= {name: F.coalesce(here(name), pre(name)) for name in w.fills}
    out |= {name: F.coalesce(here(name) + pre(name), here(name), pre(name)) for name in w.sums}
    if w.number:
        out[w.number] = F.col("_scan_before") + F.col("_scan_nth")
    return x.select(*(c for c in df.columns if c not in out), *(c.alias(name) for name, c in out.items()))


def scanned(df: DataFrame, keys: str | list[str], order: str | list[str], wanted: Wanted, hot_rows: int = HOT_ROWS, *, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with the columns of ``wanted`` over rows of equal ``keys`` in ``order``. ``counted``: a table with as many rows
    of each key, where making ``df`` only to count it would cost more."""
    keys, order = ([x] if isinstance(x, str) else list(x) for x in (keys, order))
    if (df if counted is None else counted).groupBy(*keys).count().where(F.col("count") > hot_rows).isEmpty():
        return _windowed(df, keys, order, wanted).select(*(c for c in df.columns if c not in _names(wanted)), *_names(wanted))
    return by_ranges(df, keys, order, wanted)


def _names(w: Wanted) -> list[str]:
    return [*w.lags, *w.fills, *w.sums, *([w.number] if w.number else [])]
