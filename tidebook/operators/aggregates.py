"""Exact aggregates over ledgers, prices, sweeps and positions.  Sums never cross engines unless asked to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of_sums(events: DataFrame, block: int) -> DataFrame:
    """Sums per balance up to a block."""
    rows = events.filter((F.col("block") <= block) & F.col("delta").isNotNull() & (F.col("side") != ""))
    return rows.groupBy("engine", "account", "asset", "side").agg(F.sum("delta").alias("amount"))


def net_per_asset(events: DataFrame) -> DataFrame:
    """E2."""
    return events.filter("delta is not null").groupBy("engine", "asset", "side").agg(F.sum("delta").alias("net"))


def conflicting(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value, and the values."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("n"), F.array_join(F.array_sort(F.collect_set(value)), ",").alias("values")).filter("n > 1")


def ever_flags(events: DataFrame) -> DataFrame:
    """What ever happened to an account."""
    return events.groupBy("account").agg(F.bool_or(F.col("event_type") == "repay").alias("repaid"), F.bool_or(F.col("side") == "debt").alias("indebted"), F.bool_or(F.col("engine") == "pool").alias("pooled"))


def sweep_counts(sweeps: DataFrame) -> DataFrame:
    """E5: statuses of each engine in one pass."""
    return sweeps.groupBy("engine").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("never", "failed", "success")), F.count("*").alias("accounts"))


def sweep_watermark(engines: DataFrame, sweeps: DataFrame) -> DataFrame:
    """A stamp for every engine, zeros for those without sweeps."""
    stamp = sweeps.groupBy("engine").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("last_success").alias("success_sum"), F.max("last_attempt").alias("newest"), F.max("generation").alias("generation"))
    return engines.join(stamp, "engine", "left").select("engine", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "failed", "success_sum", "newest", "generation")))


def census(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts of (table, kind) over several tables."""
    parts = [df.groupBy(F.col(kind).cast("string").alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "kind", "n") for name, (df, kind) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def book_rollup(engines: DataFrame, positions: DataFrame) -> DataFrame:
    """Per engine counts and totals; refused positions are counted, not summed.  A computed position without a
    verdict is an error."""
    checked = positions.withColumn("_ok", F.when((F.col("status") == "computed") & F.col("liquidatable").isNull(), F.raise_error(F.lit("a computed position has no verdict")).cast("boolean")).otherwise(True))
    sums = checked.filter("_ok").groupBy("engine").agg(
        F.count("*").alias("positions"),
        F.count_if(F.col("status") == "computed").alias("computed"),
        F.count_if(F.col("status") == "refused").alias("refused"),
        F.count_if("liquidatable").alias("liquidatable"),
        F.sum(F.when(F.col("status") == "computed", F.col("collateral"))).alias("collateral"),
        F.sum(F.when(F.col("status") == "computed", F.col("debt"))).alias("debt"),
    )
    return engines.join(sums, "engine", "left").fillna(0)


def header_cohorts(pins: DataFrame, headers: DataFrame, blocks: DataFrame) -> DataFrame:
    """An exact partition of blocks: matched, pending, mismatched, several pins, no pin."""
    seen = pins.groupBy("block").agg(F.count_distinct("hash").alias("n"), F.min("hash").alias("pin"))
    rows = blocks.join(seen, "block", "left").join(headers, "block", "left")
    cohort = F.when(F.col("n").isNull(), "no_pin").when(F.col("n") > 1, "multi_pin").when(F.col("header_hash").isNull(), "pending").when(F.col("header_hash") == F.col("pin"), "matched").otherwise("mismatched")
    return rows.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("blocks"))


def price_buckets(prices: DataFrame, step: int) -> DataFrame:
    """Open, close, least, most, sum and rows per bucket of blocks; validity breaks a bucket."""
    rows = prices.withColumn("bucket", F.expr(f"block div {step}"))
    at = F.struct("block", "log_index")
    return rows.groupBy("asset", "source", "bucket", "valid").agg(
        F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close"), F.min("price").alias("low"), F.max("price").alias("high"), F.sum("price").alias("total"),
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )


def first_block(events: DataFrame, side: str) -> DataFrame:
    """E11."""
    return events.filter(F.col("side") == side).groupBy("account").agg(F.min("block").alias("first_block"))


def generation_spans(sweeps: DataFrame) -> DataFrame:
    """E12."""
    return sweeps.groupBy("engine", "generation").agg(F.min("last_attempt").alias("first_attempt"), F.max("last_attempt").alias("last_attempt"), F.count("last_attempt").alias("n"))


def distinct_counts(rows: DataFrame, key: list[str], value: str, exact: bool = True) -> DataFrame:
    """Distinct values per key, exact or by sketch."""
    count = F.count_distinct(value) if exact else F.approx_count_distinct(value)
    return rows.groupBy(*key).agg(count.alias("n"))


def nested_rates(rates: DataFrame) -> DataFrame:
    """The newest rate of each kind as one `kind=value@block` list per asset."""
    newest = rates.groupBy("asset", "kind").agg(F.max("block").alias("block"), F.max_by("value", "block").alias("value"))
    entries = F.array_sort(F.collect_list(F.struct("kind", "value", "block")))
    return newest.groupBy("asset").agg(F.array_join(F.transform(entries, lambda e: F.concat(e["kind"], F.lit("="), e["value"], F.lit("@"), e["block"])), ",").alias("rates"))


def collateral_by_disclosure(legs: DataFrame, disclosure: Column) -> DataFrame:
    """E15."""
    return legs.groupBy("asset", disclosure.alias("disclosure")).agg(F.sum("amount").alias("amount"), F.sum(F.col("amount") * F.col("price")).alias("value"))


def tallies(positions: DataFrame) -> DataFrame:
    """How often each flag and each refusal occurs per engine."""
    flags = positions.select("engine", F.lit("flag").alias("kind"), F.explode("flags").alias("name"))
    refusals = positions.filter("refusal_code is not null").select("engine", F.lit("refusal").alias("kind"), F.col("refusal_code").alias("name"))
    return flags.union(refusals).groupBy("engine", "kind", "name").agg(F.count("*").alias("n"))


def closing_census(positions: DataFrame) -> DataFrame:
    """All positions fall into in_book, refused and excluded, or it is an error."""
    c = positions.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "computed").alias("in_book"), F.count_if(F.col("status") == "refused").alias("refused"), F.count_if(F.col("status") == "excluded").alias("excluded"))
    closes = F.col("total") == F.col("in_book") + F.col("refused") + F.col("excluded")
    return c.withColumn("total", F.when(closes, F.col("total")).otherwise(F.raise_error(F.lit("the census does not close")).cast("long")))


def interval_count(events: DataFrame, low: int, high: int) -> DataFrame:
    """Events per account in (low, high]."""
    return events.filter((F.col("block") > low) & (F.col("block") <= high)).groupBy("account").agg(F.count("*").alias("n"))


def quarantine_backlog(prices: DataFrame) -> DataFrame:
    """E19."""
    return prices.filter(~F.col("valid")).groupBy("source").agg(F.count("*").alias("n"), F.min("as_of").alias("oldest"), F.max("as_of").alias("newest"), F.max("block").alias("highest"))


def repair_exposure(prices: DataFrame, anchors: DataFrame, target: int) -> DataFrame:
    """Rows above the target per source, and those of them whose block is no stored anchor."""
    known = anchors.select("block").distinct().withColumn("anchored", F.lit(True))
    rows = prices.filter(F.col("block") > target).join(known, "block", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("anchored").isNull()).alias("unanchored"))


def digest(rows: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """A digest per key of its rows, whatever their order; equal rows count as often as they are there.

    A row's line has each value with its length, and null apart, so no two rows share one; of lines only digests go on.
    They are sorted and digested in 4,096 parts by their first digits, then the parts in order, so no task has to hold
    the rows of a key that a table is full of.
    """
    value = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    lines = rows.select(*key, F.sha2(F.concat(*(value(F.col(c)) for c in columns)), 256).alias("_h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(c), "\n"), 256)
    parts = lines.groupBy(*key, F.substring("_h", 1, 3).alias("_p")).agg(joined(F.collect_list("_h")).alias("_d"), F.count("*").alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), "\n"), 256)
    return parts.groupBy(*key).agg(whole.alias("digest"), F.sum("n").alias("n"))


def maxima(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """E22."""
    return rows.groupBy(*key).agg(F.max(value).alias(value))


def stamped_series(aggregates: DataFrame, stamps: DataFrame, newest: int) -> DataFrame:
    """The newest batches with their stamps as one line each."""
    batches = aggregates.select("batch").distinct().orderBy(F.desc("batch")).limit(newest)
    lines = stamps.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "engine", "stamp"))), ",").alias("stamps"))
    return aggregates.join(batches, "batch", "left_semi").join(lines, "batch", "left")


def withheld(aggregates: DataFrame) -> DataFrame:
    """Engines with a refusal code, per batch."""
    return aggregates.filter("refusal_code <> ''").groupBy("batch").agg(F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("withheld"))
