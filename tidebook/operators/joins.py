"""Comparisons and lookups between tables: full outer, anti, as-of and bounded joins.

Strategies are left to Catalyst and adaptive execution; a hint is given for tables of fixed size only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.sources.shared import dealt


def mismatches(derived: DataFrame, stored: DataFrame, key: list[str], value: str = "amount") -> DataFrame:
    """Keys at which two tables differ, null-safe: derived and stored values."""
    both = derived.select(*key, F.col(value).alias("derived")).join(stored.select(*key, F.col(value).alias("stored")), key, "full")
    return both.filter(~F.col("derived").eqNullSafe(F.col("stored")))


def orphans(rows: DataFrame, parents: DataFrame, key: list[str], unique: bool = False) -> DataFrame:
    """Rows without a parent.  Where parents hardly repeat (unique), they are not made distinct before they are
    exchanged; the rows are the same."""
    parents = parents.select(*key)
    return rows.join(parents if unique else parents.distinct(), key, "left_anti")


def newest_within(rows: DataFrame, bounds: DataFrame, key: list[str], bound_key: list[str]) -> DataFrame:
    """D3: per key the newest row at or below the bound of its bound_key."""
    kept = rows.join(bounds, bound_key).filter("block <= bound")
    return kept.groupBy(*key).agg(F.max("block").alias("block"), F.max_by("value", "block").alias("value"))


def as_of(events: DataFrame, history: DataFrame, key: list[str], value: str, order: list[str], tasks: int | None = None) -> DataFrame:
    """Each event with the last non-null value of its key at or before it, in one pass over the union, which is exchanged
    over so many tasks."""
    marked = history.select(*key, *order, F.col(value).alias("_value"), F.lit(0).alias("_kind"))
    both = dealt(events.withColumn("_kind", F.lit(1)).unionByName(marked, allowMissingColumns=True), tasks, *key)
    before = Window.partitionBy(*key).orderBy(*order, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_value", F.last("_value", ignorenulls=True).over(before)).filter("_kind = 1").drop("_kind").withColumnRenamed("_value", value)


def own_clock_sums(events: DataFrame, clocks: DataFrame) -> DataFrame:
    """Per account the sum of deltas up to its own clock (account, clock); accounts without events have 0."""
    hit = (F.col("block") <= F.col("clock")) & F.col("delta").isNotNull()
    return clocks.join(events.select("account", "block", "delta"), "account", "left").groupBy("account", "clock").agg(F.coalesce(F.sum(F.when(hit, F.col("delta"))), F.lit(0)).alias("total"))


def with_defaults(registry: DataFrame, facts: DataFrame, key: list[str], defaults: dict[str, object]) -> DataFrame:
    """Every registered key with its facts or the defaults."""
    return registry.join(facts, key, "left").fillna(defaults)


def restrict(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the listed keys."""
    return rows.join(keys.select(*key).distinct(), key, "left_semi")


def attached(page: DataFrame, details: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows of a page with their details as one sorted array; no details give an empty one."""
    entries = restrict(details, page, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("details"))
    return page.join(entries, key, "left").withColumn("details", F.coalesce("details", F.array().cast(entries.schema["details"].dataType)))


def price_coverage(prices: DataFrame) -> DataFrame:
    """Newest row of each asset and source, with the count and newest block of its quarantined rows."""
    newest = prices.groupBy("asset", "source").agg(F.max_by(F.struct("block", "price", "valid"), F.struct("block", "log_index")).alias("n"))
    bad = prices.filter(~F.col("valid")).groupBy("asset", "source").agg(F.count("*").alias("quarantined"), F.max("block").alias("last_bad"))
    return newest.join(bad, ["asset", "source"], "left").select("asset", "source", "n.block", "n.price", "n.valid", F.coalesce("quarantined", F.lit(0)).alias("quarantined"), "last_bad")


def headers_coherent(pins: DataFrame, headers: DataFrame) -> DataFrame:
    """Blocks whose pinned hashes are several, or not the header's; a missing header is no contradiction."""
    seen = pins.groupBy("block").agg(F.array_sort(F.collect_set("hash")).alias("pinned"))
    both = seen.join(headers, "block", "left")
    return both.filter((F.size("pinned") > 1) | (F.col("header_hash").isNotNull() & ~F.array_contains("pinned", F.col("header_hash"))))


def set_comparison(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Which keys are only left, only right, or in both."""
    a, b = left.select(*key).distinct().withColumn("l", F.lit(True)), right.select(*key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full").select(*key, F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both").alias("place"))


def newest_usable(prices: DataFrame, asset: Column, source: Column) -> DataFrame:
    """The newest valid price of one key; a price that is not positive is an error."""
    rows = prices.filter((F.col("asset") == asset) & (F.col("source") == source) & F.col("valid"))
    price = F.when(F.col("n.price") > 0, F.col("n.price")).otherwise(F.raise_error(F.lit("a usable price is not positive")).cast("long"))
    return rows.agg(F.max_by(F.struct("block", "price"), F.struct("block", "log_index")).alias("n")).filter("n is not null").select("n.block", price.alias("price"))
