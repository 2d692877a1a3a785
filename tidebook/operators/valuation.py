"""Valuation of positions: refusals, judged prices, folded parameters, values per leg, health and limits per account.

Legs have account, asset, amount, price and weights in percent; every leg is rounded down on its own before sums.
A missing input refuses a position, it never drops it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import exact as X
from tidebook.functions import wide as W
from tidebook.functions.exact import ceil_div, floor_div


def leg_values(legs: DataFrame) -> DataFrame:
    """Value of each leg, what it lets borrow, and its weight in the health, each rounded down."""
    value = F.col("amount") * F.col("price")
    return legs.withColumn("value", value).withColumn("limit_value", floor_div(value * F.col("ltv"), F.lit(100))).withColumn("weighted", floor_div(value * F.col("threshold"), F.lit(100)))


#: Why a leg cannot be valued; the first that holds counts.
LEG_CODES = ("missing_price", "bad_price", "missing_amount", "negative", "missing_param")


def leg_flaw(*params: str, wide: bool = False) -> Column:
    """Place in LEG_CODES of a leg's flaw, null if it has none; params are the weights that must be there.  Prices and amounts
    are longs or, if `wide`, decimal strings."""
    absent = F.lit(False)
    for p in params:
        absent = absent | F.col(p).isNull()
    price, amount = F.col("price"), F.col("amount")
    below = lambda c: c.cast("string").startswith("-") if wide else c < 0
    return F.when(price.isNull(), 0).when(below(price) | (price == ("0" if wide else 0)), 1).when(amount.isNull(), 2).when(below(amount), 3).when(absent, 4)


def with_sums(debts: DataFrame, legs: DataFrame, params: tuple[str, ...], by: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """Every debt with sums over its account's legs (and `by`, which debts has too), and refusal.

    An account without legs has sums of 0.  A leg without price, amount or weight refuses its account with a code, as
    does a missing debt; the sums of a refused account are null, so no verdict is taken on a part of it.
    """
    rows = legs.withColumn("_flaw", leg_flaw(*params)).groupBy(*by, "account").agg(F.min("_flaw").alias("_flaw"), *(c.alias(n) for n, c in sums.items()))
    return refused_sums(debts.join(rows, [*by, "account"], "left"), list(sums))


def refused_sums(rows: DataFrame, sums: list[str], zero: int | str = 0) -> DataFrame:
    """Adds the refusal of each account from _flaw and debt; sums of refused accounts are null, missing ones 0."""
    code = F.when(F.col("debt").isNull(), "missing_debt").when(F.col("_flaw").isNotNull(), F.element_at(F.array(*map(F.lit, LEG_CODES)), F.col("_flaw") + 1))
    both = rows.withColumn("refusal", code)
    return both.withColumns({n: F.when(F.col("refusal").isNull(), F.coalesce(n, F.lit(zero))) for n in sums}).drop("_flaw")


def debt_positions(legs: DataFrame, debts: DataFrame) -> DataFrame:
    """An account may be liquidated if its debt is strictly above the sum of its legs' limits."""
    rows = with_sums(debts, leg_values(legs), ("ltv",), collateral=F.sum("value"), borrow_limit=F.sum("limit_value"))
    return rows.select("account", "engine", "debt", "collateral", "borrow_limit", (F.col("debt") > F.col("borrow_limit")).alias("liquidatable"), "refusal")


def pool_positions(legs: DataFrame, debts: DataFrame) -> DataFrame:
    """Health as weighted collateral over debt in parts per million: half up by 1e10, then floor by 1e4.

    No debt is infinite health; an account is eligible below 1; a refused one is neither.
    """
    rows = with_sums(debts, leg_values(legs), ("threshold",), collateral=F.sum("value"), weighted=F.sum("weighted"))
    lowest = legs.groupBy("account").agg(F.min("price").alias("lowest_price"))
    rows = rows.join(lowest, "account", "left")
    scaled = F.col("weighted").cast("decimal(20,0)") * F.lit(10_000_000_000).cast("decimal(11,0)")
    debt = F.nullif(F.col("debt"), F.lit(0)).cast("decimal(20,0)")
    near = scaled + floor_div(F.col("debt"), F.lit(2)).cast("decimal(20,0)")
    fine = ((near - F.pmod(near, debt)) / debt).cast("decimal(38,0)")
    health = ((fine - fine % 10_000) / 10_000).cast("long")
    judged = F.col("refusal").isNull()
    return rows.select(
        "account", "engine", "debt", "collateral", "weighted", health.alias("health"), F.when(judged, F.col("debt") == 0).alias("infinite"),
        F.when(judged, F.coalesce(health < 1_000_000, F.lit(False))).alias("eligible"), "lowest_price", "refusal",
    )


def wide_sums_of(debts: DataFrame, legs: DataFrame, params: tuple[str, ...], inputs: list[str], f, names: list[str]) -> DataFrame:
    """with_sums() in whole numbers of any width: per account the sums of the numbers that f makes of a leg's inputs."""
    sums = W.folded(legs.withColumn("_flaw", leg_flaw(*params, wide=True)), ["account"], inputs, f, len(names), "_flaw")
    sums = sums.select("account", "_flaw", *(F.col("_sums")[i].alias(c) for i, c in enumerate(names)))
    return refused_sums(debts.join(sums, "account", "left"), names, "0")


def wide_debts(debts: DataFrame, unit: int) -> DataFrame:
    """J4 in wide integers: debt of (account, engine, shares, index, price): shares times ray index, times price over the unit,
    each rounded up."""
    live = X.ray_mul_ceil(F.col("shares"), F.col("index"))
    rows = debts.withColumn("live", live).withColumn("debt", X.mul_div_ceil(F.col("live"), F.col("price"), F.lit(str(unit))))
    return rows.select("account", "engine", "debt")


def wide_positions(legs: DataFrame, debts: DataFrame, unit: int) -> DataFrame:
    """J1, J2 in wide integers: amounts, indexes, prices and results are whole numbers or decimal strings of any width.

    legs: (account, asset, amount in shares, ray index, price, ltv and threshold in basis points); debts as of wide_debts.
    Every leg is rounded down on its own; the health factor is half up by 1e18 and then floored by 1e4.
    """

    def values(amount, index, price, ltv, threshold):
        if None in (amount, index, price):
            return None, None, None
        value = amount * index // X.RAY * price // unit
        return value, None if ltv is None else value * ltv // 10_000, None if threshold is None else value * threshold // 10_000

    both = wide_sums_of(debts, legs, ("ltv", "threshold"), ["amount", "index", "price", "ltv", "threshold"], values, ["value", "limit", "weight"])
    both = both.withColumn("health", X.health_wad(F.col("weight"), F.col("debt")))
    judged = F.col("refusal").isNull()
    below = F.coalesce(~(W.compare(F.col("health"), F.lit(str(10**14 - 1))) > 0), F.lit(False))
    return both.select(
        "account", "engine", "debt", F.col("value").alias("collateral"), F.col("limit").alias("borrow_limit"), F.col("weight").alias("weighted"), "health",
        F.when(judged, W.compare(F.col("debt"), F.col("limit")) > 0).alias("liquidatable"), F.when(judged, below).alias("eligible"), "refusal",
    )


def wide_limits(legs: DataFrame, debts: DataFrame, points: list[tuple], unit: int) -> DataFrame:
    """Every wide debt with its account's borrow limit at each of some price falls (grid, percent; prices are rounded down,
    too) and whether it is refused there, as one that has no debt, or a leg without a value or with a price that isn't
    positive, is.  A leg is read once for all points."""
    n = len(points)
    none, bad = [None] * n, [1] * n

    def limits(amount, index, price, ltv):
        prices = [None if price is None or p is None else price * p // 100 for _, p in points]
        refused = [None if p is not None and p > 0 else 1 for p in prices]
        if None in (amount, index, ltv):
            return none + (bad if None in (amount, ltv) else refused)
        live = amount * index // X.RAY
        return [None if p is None else live * p // unit * ltv // 10_000 for p in prices] + refused

    # the price is judged at each point, the rest of a leg once
    rows = legs.withColumnRenamed("price", "_price").withColumn("price", F.when(F.col("_price").isNotNull(), "1"))
    rows = rows.withColumn("_flaw", leg_flaw("ltv", "threshold", wide=True))
    sums = W.folded(rows, ["account"], ["amount", "index", "_price", "ltv"], limits, 2 * n, "_flaw")
    at = F.array(*(F.struct(F.lit(g).alias("grid"), F.coalesce(F.col("_sums")[i], F.lit("0")).alias("limit"), (F.col("debt").isNull() | F.col("_flaw").isNotNull() | F.col("_sums")[n + i].isNotNull()).alias("refused")) for i, (g, _) in enumerate(points)))
    return debts.join(sums, "account", "left").select(*debts.columns, F.explode(at).alias("_p")).select(*debts.columns, "_p.*")


def refusals(legs: DataFrame, order: Column | None = None) -> DataFrame:
    """The first reason to refuse each account: price, amount, weight or duplicate, of several legs the one of the
    lowest asset; or first by another `order` of rank (place of the reason) and asset, these two where it leaves a tie."""
    twice = F.count("*").over(Window.partitionBy("account", "asset")) > 1
    ranked = legs.withColumn("rank", F.coalesce(leg_flaw("threshold"), F.when(twice, len(LEG_CODES)))).filter("rank is not null")
    first = ranked.groupBy("account").agg(F.min(F.struct(*([] if order is None else [order.alias("order")]), "rank", "asset")).alias("f"), F.count("*").alias("legs_refused"))
    code = F.element_at(F.array(*map(F.lit, (*LEG_CODES, "duplicate"))), F.col("f.rank") + 1)
    return first.select("account", code.alias("refusal_code"), F.col("f.asset").alias("refusal_asset"), "legs_refused")


def live_debt(balances: DataFrame, rates: DataFrame, block: int, unit: int = 1_000_000) -> DataFrame:
    """Sums of floor(amount * index / unit) with the index of the newest block at or below the given one."""
    index = rates.filter((F.col("kind") == "debt") & (F.col("block") <= block)).groupBy("asset").agg(F.max_by("value", "block").alias("idx"))
    rows = balances.filter("side = 'debt'").join(index, "asset", "left")
    return rows.groupBy("account").agg(F.sum(floor_div(F.col("amount") * F.col("idx"), F.lit(unit))).alias("debt"), F.count_if(F.col("idx").isNull()).alias("without_index"))


def collateral_flags(legs: DataFrame, events: DataFrame) -> DataFrame:
    """The last enabling or disabling event of an account and asset; never seen is not collateral, and flagged."""
    last = events.groupBy("account", "asset").agg(F.max_by(F.col("event_type") == "borrow", F.struct("block", "log_index", "seq", "tx")).alias("on"))
    return legs.join(last, ["account", "asset"], "left").select("account", "asset", F.coalesce("on", F.lit(False)).alias("counted"), F.col("on").isNull().alias("never_seen"))


def judged_prices(prices: DataFrame, now: int, budget: int, step_bps: int = 2000) -> DataFrame:
    """A verdict for the newest row of each key, and whether it is a large step from the row before."""
    order = Window.partitionBy("asset", "source").orderBy("block", "log_index")
    rows = prices.withColumn("previous", F.lag("price").over(order)).withColumn("rn", F.row_number().over(Window.partitionBy("asset", "source").orderBy(F.desc("block"), F.desc("log_index")))).filter("rn = 1")
    age = F.greatest(F.lit(0), F.lit(now) - F.col("as_of"))
    verdict = F.when(~F.col("valid"), "missing").when(age > 2 * budget, "over_ceiling").when(age > budget, "stale_in_ceiling").otherwise("accepted")
    large = F.coalesce(F.abs(F.col("price") - F.col("previous")) * 10_000 > F.col("previous") * step_bps, F.lit(False))
    return rows.select("asset", "source", "block", "price", "previous", verdict.alias("verdict"), large.alias("large_step"))


def folded_params(history: DataFrame, block: int | None = None) -> DataFrame:
    """Per asset the last value that each parameter was set to, up to a block."""
    rows = history if block is None else history.filter(F.col("block") <= block)
    at = F.struct("block", "log_index")
    return rows.groupBy("asset").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("ltv", "threshold", "bonus")), F.max("block").alias("as_of_block"))


def param_state(events: DataFrame, block: int) -> DataFrame:
    """Assets in force at a block from added / removed / configured events; what is removed is out until it is added
    again."""
    rows = events.filter(F.col("block") <= block)
    at = F.struct("block", "log_index", "seq", "tx")
    kind = F.max_by("event_type", F.when(F.col("event_type") != "record", at))
    return rows.groupBy("asset").agg(kind.alias("last"), F.max_by("amount", F.when(F.col("event_type") == "record", at)).alias("config")).filter("last is null or last <> 'repay'").select("asset", "config")


def merged_legs(collateral: DataFrame, debt: DataFrame) -> DataFrame:
    """Both sides of an asset on one leg."""
    return collateral.join(debt, ["account", "asset"], "full").fillna(0)


def next_deadline(prices: DataFrame, now: int, budget: int) -> DataFrame:
    """When the next price crosses its budget or its ceiling."""
    newest = prices.groupBy("asset", "source").agg(F.max("as_of").alias("as_of"))
    times = newest.select("source", F.explode(F.array(F.col("as_of") + budget, F.col("as_of") + 2 * budget)).alias("deadline"))
    return times.filter(F.col("deadline") > now).groupBy("source").agg(F.min("deadline").alias("deadline"))


def liquidation_scale(legs: DataFrame, debts: DataFrame, moved: Column, unit: int = 1_000_000) -> DataFrame:
    """By what factor (parts per million, rounded up) the moved assets may fall before debt meets the weights.

    outcome: refused (a leg cannot be valued), none (no debt), never (the rest alone covers it), breached (already), distance.
    """
    inside, outside = (F.sum(F.when(c, F.col("weighted")).otherwise(0)) for c in (moved, ~moved))
    both = with_sums(debts, leg_values(legs), ("threshold",), inside=inside, outside=outside)
    gap = F.col("debt") - F.col("outside")
    outcome = F.when(F.col("refusal").isNotNull(), "refused").when(F.col("debt") == 0, "none").when(gap <= 0, "never").when(F.col("inside") + F.col("outside") < F.col("debt"), "breached").otherwise("distance")
    return both.select("account", outcome.alias("outcome"), F.when(outcome == "distance", ceil_div(gap * unit, F.col("inside"))).alias("scale"))


def verified(stored: DataFrame, recomputed: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Stored rows with whether every field is what the recomputation gives; a mismatch excludes the row."""
    again = recomputed.select(*key, *(F.col(f).alias(f"r_{f}") for f in fields), F.lit(True).alias("there"))
    same = F.coalesce(F.col("there"), F.lit(False))
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"r_{f}"))
    return stored.join(again, key, "left").select(*key, *fields, F.when(same, "in_book").otherwise("excluded").alias("state"))


def projected_debt(positions: DataFrame, per_second: int, horizons: list[int]) -> DataFrame:
    """Debt after each horizon at a rate per second in 1e-12, and whether it is above the limit then."""
    h = F.explode(F.array(*(F.lit(x).cast("long") for x in horizons))).alias("horizon")
    rows = positions.select("account", "engine", "debt", "borrow_limit", h)
    grown = F.col("debt") + floor_div(F.col("debt") * F.lit(per_second) * F.expr("horizon div 3600"), F.lit(1_000_000_000))
    return rows.select("account", "engine", "horizon", grown.alias("projected"), (grown > F.col("borrow_limit")).alias("liquidatable"))


def watermark_refusals(sweeps: DataFrame) -> DataFrame:
    """Accounts without the blocks that a valuation needs."""
    return sweeps.select("account", F.when(F.col("last_attempt").isNull() | (F.col("last_attempt") == 0), "no_attempt").when(F.col("last_success").isNull(), "no_success").alias("refusal")).filter("refusal is not null")


def presented(positions: DataFrame, registry: DataFrame) -> DataFrame:
    """A line per account: state, distance to the limit and its registered name."""
    state = F.when(F.col("debt") == 0, "none").when(F.col("liquidatable"), "breached").when(F.col("borrow_limit") == 0, "never").otherwise("distance")
    distance = F.when(state == "distance", F.col("borrow_limit") - F.col("debt"))
    return positions.join(registry, "account", "left").select("account", "engine", state.alias("state"), distance.alias("distance"), F.coalesce("name", F.lit("unregistered")).alias("name"))
