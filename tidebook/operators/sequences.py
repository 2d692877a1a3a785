"""Window functions and sequence analytics: newest rows, regressions, islands, gaps, latches and series."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.exact import floor_div


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """one row per key, the first in the order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def newest_and_newest_valid(prices: DataFrame) -> DataFrame:
    """side by side in one pass."""
    at, value = F.struct("block", "log_index"), F.struct("block", "price")
    both = prices.groupBy("asset", "source").agg(F.max_by(value, at).alias("n"), F.max_by(value, F.when(F.col("valid"), at)).alias("v"))
    return both.select("asset", "source", F.col("n.block").alias("newest_block"), F.col("n.price").alias("newest_price"), F.col("v.block").alias("valid_block"), F.col("v.price").alias("valid_price"))


def regressions(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """rows whose value is lower than that of the row before."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(value) < F.col("previous"))


def invalid_ranges(prices: DataFrame) -> DataFrame:
    """contiguous runs of invalid prices per source and asset, with their reasons."""
    order = Window.partitionBy("asset", "source").orderBy("block", "log_index")
    change = F.coalesce((F.col("valid") != F.lag("valid").over(order)).cast("int"), F.lit(1))
    rows = prices.withColumn("change", change).withColumn("island", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.filter(~F.col("valid")).groupBy("asset", "source", "island")
    return runs.agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons")).drop("island")


def strided(rows: DataFrame, key: list[str], at: str, step: int, flips: str | None = None) -> DataFrame:
    """per key keep the first row, then those at least `step` after the last kept one or where `flips` changes.

    What is kept depends on what was kept before, so rows stream in order through one pass; a key is never held as a
    whole, and keys are split over partitions.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, state = None, None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            places = batch.column(at).to_pylist()
            marks = batch.column(flips).to_pylist() if flips else [None] * len(places)
            chosen = []
            for k, p, m in zip(keys, places, marks, strict=True):
                take = k != own or m != state or p >= last + step
                own, state = k, m
                last = p if take else last
                chosen.append(take)
            yield batch.filter(pa.array(chosen, pa.bool_()))

    order = [*key, at, *(["log_index"] if "log_index" in rows.columns else [])]
    return rows.repartition(*key).sortWithinPartitions(*order).mapInArrow(keep, rows.schema)


def publication_gaps(prices: DataFrame) -> DataFrame:
    """seconds between successive rows that carry a time, at least 0."""
    order = Window.partitionBy("asset", "source").orderBy("block", "log_index")
    rows = prices.filter("as_of is not null").withColumn("since", F.col("as_of") - F.lag("as_of").over(order)).filter("since is not null")
    return rows.select("asset", "source", "block", "log_index", F.greatest(F.lit(0), "since").alias("gap"))


def nearest_rank(gaps: DataFrame, key: list[str], value: str, percent: int) -> DataFrame:
    """the value at index floor(n * percent / 100), at most n - 1, of each key's sorted values.  Equal values are counted
    before they are put in order, so a key with very many rows is one row per value."""
    counts = gaps.groupBy(*key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key)
    ranked = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_n").over(w))
    wanted = F.least(floor_div(F.col("n") * percent, F.lit(100)), F.col("n") - 1) + 1
    return ranked.filter((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_n") < wanted)).select(*key, F.col(value).alias("quantile"), "n")


def judged_max(gaps: DataFrame, prices: DataFrame, boundary: int) -> DataFrame:
    """F8: the longest gap of a source, counting the open one from its newest row to the boundary."""
    longest = gaps.groupBy("asset", "source").agg(F.max("gap").alias("longest"))
    head = prices.groupBy("asset", "source").agg(F.greatest(F.lit(0), F.lit(boundary) - F.max("as_of")).alias("head"))
    return head.join(longest, ["asset", "source"], "left").select("asset", "source", "head", F.greatest("head", F.coalesce("longest", F.lit(0))).alias("judged"))


def newest_groups(rows: DataFrame, key: list[str], group: str, n: int) -> DataFrame:
    """rows of the n newest groups of each key."""
    return rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(*key).orderBy(F.desc(group)))).filter(F.col("_r") <= n).drop("_r")


def latched(series: DataFrame, key: list[str], step: str, flag: str) -> DataFrame:
    """once the flag holds on a key's steps it stays; `newly` marks the first step."""
    w = Window.partitionBy(*key).orderBy(step)
    held = F.max(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = series.withColumn("cumulative", held)
    return rows.withColumn("newly", F.col("cumulative") - F.coalesce(F.lag("cumulative").over(w), F.lit(0)))


def falls(series: DataFrame, key: list[str], step: str, value: str) -> DataFrame:
    """steps at which a series that must not fall does."""
    return series.withColumn("before", F.lag(value).over(Window.partitionBy(*key).orderBy(step))).filter(F.col(value) < F.col("before"))


def increments(series: DataFrame, key: list[str], step: str, value: str) -> DataFrame:
    """differences between steps, with checks of order and sign."""
    w = Window.partitionBy(*key).orderBy(step)
    rows = series.select(*key, step, value, F.lag(step).over(w).alias("from_step"), F.lag(value).over(w).alias("from_value")).filter("from_step is not null")
    return rows.select(*key, "from_step", step, (F.col(value) - F.col("from_value")).alias("increment"), (F.col(step) > F.col("from_step")).alias("ordered"), (F.col(value) >= F.col("from_value")).alias("rising"))


def cliff(series: DataFrame, key: list[str], step: str, newly: str) -> DataFrame:
    """the first step after the baseline with something new, and the peak."""
    after = F.when((F.col(step) > 0) & (F.col(newly) > 0), F.col(step))
    return series.groupBy(*key).agg(F.min(after).alias("cliff_step"), F.max(newly).alias("peak"), F.min(F.when(F.col(newly) > 0, F.col(step))).alias("first_step"))


def filled_axis(points: DataFrame, at: str, step: int, value: str, withheld: Column) -> DataFrame:
    """every stride between the first and the last point: captured, withheld or absent."""
    span = points.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter("lo is not null")
    axis = span.select(F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias(at))
    state = F.when(F.col("_there").isNull(), "absent").when(withheld, "withheld").otherwise("captured")
    return axis.join(points.withColumn("_there", F.lit(1)), at, "left").select(at, state.alias("state"), F.when(state == "captured", F.col(value)).alias(value))


def history_with_holes(batches: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """F16: row, withheld or no_row per batch and key."""
    keys = rows.select(key).distinct()
    axis = batches.join(keys)
    seen = rows.select(key, "batch", "value", F.lit(1).alias("there"))
    state = F.when(F.col("there").isNotNull(), "row").when(F.col("withheld"), "withheld").otherwise("no_row")
    return axis.join(seen, [key, "batch"], "left").select(key, "batch", state.alias("state"), "value")


def extremes(series: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """where the series is highest (ties: earliest), and its newest value that is not null."""
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at)))
    top = F.max(F.struct(F.col(value), (-F.col(at)).alias("at")))
    out = series.groupBy(*key).agg(top.alias("t"), newest.alias("newest"))
    return out.select(*key, F.col(f"t.{value}").alias("top"), (-F.col("t.at")).alias("top_at"), "newest")


def concentration(positions: DataFrame, tiers: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """share of the debt that the largest debtors of an engine owe, floor of tenths of a percent."""
    w = Window.partitionBy("engine").orderBy(F.desc("debt"), "account")
    rows = positions.select("engine", "account", "debt", F.row_number().over(w).alias("n"))
    total = rows.groupBy("engine").agg(F.sum("debt").alias("total"), F.count("*").alias("accounts"))
    top = rows.filter(F.col("n") <= max(tiers))
    tier = F.explode(F.array(*map(F.lit, tiers))).alias("tier")
    sums = top.select("*", tier).filter("n <= tier").groupBy("engine", "tier").agg(F.sum("debt").alias("owed"))
    return sums.join(total, "engine").select("engine", F.col("tier").cast("long").alias("tier"), "owed", floor_div(F.col("owed") * 1000, F.col("total")).alias("tenths"))


def headroom_curve(bands: DataFrame) -> DataFrame:
    """running counts over the bands of each engine."""
    w = Window.partitionBy("engine").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return bands.select("engine", "band", "n", F.sum("n").over(w).alias("running"))


def previous_by_batch(rows: DataFrame, key: list[str], batch: str, value: str) -> DataFrame:
    """F21."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(*key).orderBy(batch)))
