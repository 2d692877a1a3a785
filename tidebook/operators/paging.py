"""Sorts, pages, top lists, work queues and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feed_page(events: DataFrame, size: int, where: Column | None = None) -> DataFrame:
    """G1: the newest rows; those without a block last, then by transaction and place."""
    rows = events.filter(where) if where is not None else events
    return rows.orderBy(F.desc_nulls_last("block"), F.desc("tx"), F.desc("log_index"), F.desc("seq"), "account").limit(size)


def ranked_page(rows: DataFrame, order: list[Column], skip: int, size: int) -> DataFrame:
    """the rows of a page with their places.  Only the first skip + size rows in the order are ranked; deep pages
    should be asked for by cursor (after_cursor)."""
    top = rows.orderBy(*order).limit(skip + size)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("place") > skip)


def after_cursor(rows: DataFrame, columns: list[str], values: list[object]) -> DataFrame:
    """Rows strictly after a cursor in descending order of the columns."""
    place = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    kinds = dict(rows.dtypes)
    cursor = F.struct(*(F.lit(v).cast(kinds[c]).alias(f"c{i}") for i, (c, v) in enumerate(zip(columns, values, strict=True))))
    return rows.filter(place < cursor)


def position_order(engine: str, by: str, descending: bool) -> list[Column]:
    """Sort keys of a book; refused rows are last, an unknown headroom after every known one."""
    turn = (lambda c: F.desc_nulls_last(c)) if descending else (lambda c: F.asc_nulls_last(c))
    keys = {"debt": "debt", "collateral": "collateral", "account": "account", "headroom": "headroom", "health": "health"}
    if by == "health" and engine == "debt":
        keys["health"] = "headroom"  # judged by its limit
    return [F.asc("refused"), turn(keys[by]), F.asc("account")]


def placed(rows: DataFrame, cell: list[Column], order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their place in an order, within `by` or in all, without a task that gets all rows.

    The columns of `cell` must be the first keys of the order, ascending, or steps of them; each cell is ranked by itself and
    starts after the rows of the cells before it, of which there is one count each.
    """
    names = [f"_cell{i}" for i in range(len(cell))]
    celled = rows.withColumns(dict(zip(names, cell, strict=True)))
    counts = celled.groupBy(*by, *names).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(*(F.asc_nulls_last(n) for n in names)).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, *names).orderBy(*order))
    a, b = celled.withColumn("_within", within).alias("a"), starts.alias("b")
    same = F.lit(True)
    for c in (*by, *names):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(*(F.col(f"a.`{c}`") for c in rows.columns), (F.col("_before") + F.col("_within")).cast("long").alias("place"))


def steps(rows: DataFrame, column: str, parts: int = 64) -> Column:
    """The step of a numeric column among about `parts` steps of equal numbers of rows; null stays null."""
    cuts = rows.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    known = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return F.when(F.col(column).isNotNull(), F.size(F.filter(known, lambda c: c <= F.col(column))))


def at_least(positions: DataFrame, least: int) -> DataFrame:
    """Drops computed rows whose larger side is below the least value; refused and unknown rows stay."""
    small = (F.col("status") == "computed") & F.col("debt").isNotNull() & F.col("collateral").isNotNull() & (F.greatest("debt", "collateral") < least)
    return positions.filter(~F.coalesce(small, F.lit(False)))


def top_by_size(events: DataFrame, n: int) -> DataFrame:
    """Accounts with the largest absolute sum."""
    sums = events.filter("delta is not null").groupBy("account").agg(F.sum("delta").alias("total"))
    return sums.orderBy(F.desc(F.abs("total")), "account").limit(n)


def top_movers(before: DataFrame, after: DataFrame, n: int = 20) -> DataFrame:
    """Per engine the accounts whose value fell most, with how many moved at all."""
    both = before.select("engine", "account", F.col("value").alias("was")).join(after.select("engine", "account", F.col("value").alias("now")), ["engine", "account"])
    moved = both.withColumn("drop", F.col("was") - F.col("now")).filter("drop > 0")
    rank = F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("drop"), "account"))
    counts = moved.groupBy("engine").agg(F.count("*").alias("movers"))
    return moved.withColumn("place", rank).filter(F.col("place") <= n).join(counts, "engine")


def work_queue(sweeps: DataFrame, debts: DataFrame, generation: int, n: int) -> DataFrame:
    """Accounts to sweep: never seen, then of an older generation, then failed; indebted ones first in each."""
    turn = F.when(F.col("status") == "never", 0).when(F.col("generation") < generation, 1).when(F.col("status") == "failed", 2)
    rows = sweeps.join(debts.select("account", (F.col("debt") > 0).alias("owes")), "account", "left").withColumn("turn", turn).filter("turn is not null")
    return rows.select("account", "turn", F.coalesce("owes", F.lit(False)).alias("owes")).orderBy("turn", F.desc("owes"), "account").limit(n)


def seeded_order(accounts: DataFrame, seed: str) -> DataFrame:
    """Place of each account in its stratum: live ones first, then by a hash of the seed and the account."""
    h = F.md5(F.concat(F.lit(seed), F.col("account").cast("string")).cast("binary"))
    cell = [(~F.col("live")).cast("int"), F.substring(h, 1, 2)]
    return placed(accounts, cell, [F.desc("live"), h, F.col("account")], ("stratum",))


def quota_sample(accounts: DataFrame, seed: str, quotas: dict[str, int], total: int, forced: list[int] = ()) -> DataFrame:
    """The first of each stratum up to its quota; what is missing of the total is filled in order of strata; forced
    accounts come on top."""
    ordered = seeded_order(accounts, seed)
    quota = F.coalesce(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("stratum")], F.lit(0))
    chosen = ordered.filter(F.col("place") <= quota).withColumn("why", F.lit("quota"))
    rest = ordered.join(chosen.select("account"), "account", "left_anti")
    missing = F.lit(total) - F.lit(0)
    have = chosen.agg(F.count("*").alias("have"))
    fill = rest.orderBy("stratum", "place").limit(total).withColumn("n", F.row_number().over(Window.orderBy("stratum", "place")))
    fill = fill.join(have).filter(F.col("n") <= missing - F.col("have")).drop("n", "have").withColumn("why", F.lit("fill"))
    out = chosen.unionByName(fill)
    extra = ordered.filter(F.col("account").isin(*forced)).join(out.select("account"), "account", "left_anti").withColumn("why", F.lit("forced"))
    return out.unionByName(extra)


def newest_batches(batches: DataFrame, n: int) -> DataFrame:
    """The newest complete batches."""
    return batches.filter("complete").orderBy(F.desc("batch")).limit(n)


def usable_anchors(anchors: DataFrame, neutralized: DataFrame, below: int, n: int) -> DataFrame:
    """Newest anchors below a height that no neutralized row is bound to."""
    return anchors.filter(F.col("block") < below).join(neutralized.select("block").distinct(), "block", "left_anti").orderBy(F.desc("block")).limit(n)


def retained(anchors: DataFrame, protected: DataFrame, newest: int) -> DataFrame:
    """The newest anchors of each engine, and protected ones; anchors are one row per engine and block.

    The rank has a limit per group, so a task sorts no more than it keeps; the protected ones are found by their block alone."""
    rank = F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("block")))
    kept = anchors.withColumn("_r", rank).filter(F.col("_r") <= newest).drop("_r")
    return kept.union(anchors.join(protected.select("block").distinct(), "block", "left_semi").select(anchors.columns)).distinct()


def account_history(rows: DataFrame, n: int) -> DataFrame:
    """Rows of each account in its last n batches."""
    return rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("account").orderBy(F.desc("batch")))).filter(F.col("_r") <= n).drop("_r")


def series_range(rows: DataFrame, ranges: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """Of each series that is asked for (key, low, high), its first n rows within the range of blocks, ends included."""
    inside = rows.join(ranges, key).filter(F.col("block").between(F.col("low"), F.col("high"))).drop("low", "high")
    return inside.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def replayed_sample(listed: DataFrame, population: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Strata of a stored sample held against quotas and population: count, least that was possible, taint."""
    quota = F.coalesce(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("stratum")], F.lit(0))
    have = listed.join(population, "account").groupBy("stratum").agg(F.count("*").alias("have"))
    there = population.groupBy("stratum").agg(F.count("*").alias("there"))
    rows = there.join(have, "stratum", "left").select("stratum", F.coalesce("have", F.lit(0)).alias("have"), F.least(quota.cast("long"), F.col("there")).alias("due"))
    return rows.withColumn("tainted", F.col("have") < F.col("due"))
