"""Row-order operators: the last n times of a key, gaps between them, regularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slicing import DEFAULT_SLICE_ROWS, HOT, SLICE, slice_hot_keys


def last_n(
    df: DataFrame,
    key: str,
    n: int,
    *,
    name: str = "last_times",
    when: Column | None = None,
    retention_us: int | None = None,
    t: str = "t",
    row_id: str = "row_id",
    slice_rows: int = DEFAULT_SLICE_ROWS,
    total_rows: int | None = None,
    census: DataFrame | None = None,
) -> DataFrame:
    """Up to ``n`` latest times of the key, ascending, the row itself included.

    Only rows for which ``when`` holds take part and get a value.
    """
    marked = df.withColumn("_on", F.lit(1) if when is None else F.when(when, 1).otherwise(0))
    sliced = slice_hot_keys(marked, [key], t, slice_rows=slice_rows, total_rows=total_rows, spread_by=row_id, census=census)
    part = [key, SLICE, "_on"]
    w = Window.partitionBy(*part).orderBy(t, row_id)
    out = sliced.df.withColumn(name, F.collect_list(t).over(w.rowsBetween(-(n - 1), 0)))
    if sliced.cut:
        newest = Window.partitionBy(*part).orderBy(F.desc(t), F.desc(row_id))
        tails = (
            sliced.df.where(f"{HOT} AND _on = 1")
            .withColumn("_rank", F.row_number().over(newest))
            .where(F.col("_rank") < n)
            .groupBy(*part)
            .agg(F.sort_array(F.collect_list(t)).alias("_tail"))
        )
        # every slice holds at least one row, so n-1 earlier slices hold n-1 earlier rows
        across = Window.partitionBy(key, "_on").orderBy(SLICE).rowsBetween(-(n - 1), -1)
        carry = tails.select(
            *[F.col(p).alias(f"_k_{p}") for p in part], F.flatten(F.collect_list("_tail").over(across)).alias("_carry")
        )
        cond = F.lit(True)
        for p in part:
            cond = cond & F.col(p).eqNullSafe(F.col(f"_k_{p}"))
        joined = F.concat(F.coalesce(F.col("_carry"), F.array().cast("array<bigint>")), F.col(name))
        out = (
            out.join(carry, cond, "left")
            .withColumn(name, joined)
            .withColumn(name, F.slice(F.col(name), F.greatest(F.size(name) - (n - 1), F.lit(1)), n))
            .drop("_carry", *[f"_k_{p}" for p in part])
        )
    times = F.col(name)
    if retention_us is not None:
        times = F.filter(times, lambda x: x > F.col(t) - retention_us)
    return out.withColumn(name, F.when((F.col("_on") == 1) & F.col(key).isNotNull(), times)).drop("_on", SLICE, HOT)


def gaps(times: Column) -> Column:
    """Differences between consecutive entries of an ascending array."""
    return F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), lambda b, a: b - a)


def mean_gap_s(times: Column) -> Column:
    n = F.size(times)
    return F.when(n > 1, (F.element_at(times, -1) - F.element_at(times, 1)) / (n - 1) / F.lit(1e6))


def gap_cv(times: Column) -> Column:
    """Population standard deviation of the gaps over their mean; 0 when the mean is 0."""
    mean = mean_gap_s(times)
    n = (F.size(times) - 1).cast("double")
    squares = F.aggregate(gaps(times), F.lit(0.0), lambda acc, g: acc + F.pow(g / F.lit(1e6) - mean, 2))
    return F.when(mean <= 0, 0.0).otherwise(F.sqrt(squares / n) / mean)
