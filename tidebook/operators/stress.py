"""Scenarios on a book: shocked prices, waterfalls over a grid, recoverable values, shortfalls and transitions.

Scenarios and grids are tables of a few dozen rows that are multiplied with the book; the book is partitioned by account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import exact as X
from tidebook.functions import wide as W
from tidebook.functions.exact import floor_div, half_decade, headroom_band, headroom_tenths, health_lane
from tidebook.operators.valuation import leg_flaw, leg_values, refused_sums, wide_limits, with_sums

#: Scenarios and grid points together, at most; tables beyond are refused, as they are meant to be small.
MAX_SCENARIOS = 1000


def _small(df: DataFrame) -> DataFrame:
    """A table that is broadcast after its size is checked."""
    n = df.limit(MAX_SCENARIOS + 1).count()
    if n > MAX_SCENARIOS:
        raise ValueError(f"more than {MAX_SCENARIOS} scenarios or grid points")
    return F.broadcast(df)


def shocked(prices: DataFrame, responses: DataFrame, factors: DataFrame, unit: int = 1_000_000) -> DataFrame:
    """Prices moved by scenarios, and why each is what it is.

    prices: (asset, price, and cap if there is one; longs, or decimal strings of any width); responses: (asset, axis,
    stable_snap, base_snap, and scenario if they differ between scenarios); factors: (scenario, axis, num, den).  The
    factors of all axes that an asset responds to are multiplied as exact rationals, and the price is rounded down once.
    A stable snaps to the unit strictly within a hundredth of it; over a stable base, the factor that counts is that of
    the snapped base.  A cap binds upward.  An asset without response is held flat and says so.
    """
    factors = _small(factors)
    names = F.broadcast(factors.select("scenario").distinct())  # no more of them than factors
    known = responses if "scenario" in responses.columns else responses.join(names)
    moves = known.join(factors, ["scenario", "axis"], "left").groupBy("scenario", "asset").agg(
        F.collect_list("num").alias("nums"), F.collect_list("den").alias("dens"), F.bool_or("stable_snap").alias("stable"), F.bool_or("base_snap").alias("over_stable"),
    )
    moves = moves.select("scenario", "asset", W.product(F.col("nums")).alias("num"), W.product(F.col("dens")).alias("den"), "stable", "over_stable", F.lit(True).alias("answers"))
    base = X.mul_div_floor(F.when(F.col("over_stable"), F.lit(str(unit))), F.col("num"), F.col("den"))
    near = lambda b: (W.compare(b, F.lit(str(unit * 99 // 100))) > 0) & (W.compare(b, F.lit(str(unit * 101 // 100))) < 0)
    moves = moves.withColumn("base", base).withColumn("base_snapped", F.coalesce(W.let(F.col("base"), near), F.lit(False)))
    wide = dict(prices.dtypes)["price"] == "string"
    rows = prices.join(names).join(moves, ["scenario", "asset"], "left")
    par, low, high = (F.lit(str(x)) if wide else F.lit(x).cast("long") for x in (unit, unit * 99 // 100, unit * 101 // 100))
    above = (lambda a, b: W.compare(a, b) > 0) if wide else (lambda a, b: a > b)
    typed = (lambda c: c) if wide else (lambda c: c.cast("long"))
    cap = F.col("cap") if "cap" in prices.columns else F.lit(None).cast("string" if wide else "long")

    def judged(moved: Column, base_snapped: Column) -> Column:
        snapped = F.coalesce(F.col("stable") & above(moved, low) & above(high, moved), F.lit(False))
        value = F.when(snapped, par).otherwise(moved)
        bound = F.coalesce(F.col("answers") & above(value, cap), F.lit(False))
        return F.struct(F.when(bound, cap).otherwise(value).alias("shocked"), snapped.alias("snapped"), base_snapped.alias("base_snapped"), bound.alias("cap_bound"))

    moved = X.mul_div_floor(F.col("price"), F.when(F.col("base_snapped"), F.lit(str(unit))).otherwise(F.coalesce("base", "num")), F.when(F.col("over_stable"), F.lit(str(unit))).otherwise(F.col("den")))
    out = rows.withColumn("_", W.let(F.coalesce(typed(moved), F.col("price")), lambda m: judged(m, F.coalesce("base_snapped", F.lit(False)))))
    return out.select("scenario", "asset", "price", F.col("_.shocked").alias("shocked"), F.col("answers").isNull().alias("held_flat"), "_.snapped", "_.base_snapped", "_.cap_bound")


def rescaled(factors: DataFrame, grid: DataFrame) -> DataFrame:
    """K3: each scenario's one shock with the factor of every grid point (grid, num, den) instead of its own.

    A scenario with several shocks has no single factor: it is refused, in one row without a grid point."""
    ones = factors.groupBy("scenario").agg(F.min("axis").alias("axis"), F.count("*").alias("n"))
    bad = (F.col("num") <= 0) | (F.col("den") <= 0)
    points = grid.withColumn("num", F.when(bad, F.raise_error(F.lit("a grid factor is not positive")).cast("long")).otherwise(F.col("num")))
    rows = ones.where("n = 1").join(_small(points)).select("scenario", "grid", "axis", "num", "den", F.lit(None).cast("string").alias("refusal"))
    none = F.lit(None).cast("long")
    return rows.unionByName(ones.where("n > 1").select("scenario", none.alias("grid"), F.lit(None).cast("string").alias("axis"), none.alias("num"), none.alias("den"), F.lit("several_shocks").alias("refusal")))


def scaled(factors: DataFrame, grid: DataFrame) -> DataFrame:
    """K3: every factor at every grid point (grid, percent), its distance from 1 at that percentage, as an exact rational;
    scenarios of several shocks keep all of them."""
    num = F.col("den") * 100 + (F.col("num") - F.col("den")) * F.col("percent")
    return factors.join(_small(grid)).select("scenario", "grid", "axis", num.alias("num"), (F.col("den") * 100).alias("den"))


def eligible_on_grid(legs: DataFrame, debts: DataFrame, grid: DataFrame) -> DataFrame:
    """For each grid point (grid, percent of prices) and account with a debt: collateral, limit and whether debt is
    above it; an account without legs has none, one with a leg that cannot be valued is refused.

    Legs meet their debts before the grid, so one exchange by account serves the join, the sums and windows per account.
    """
    rows = debts.join(legs.withColumn("_leg", F.lit(True)), "account", "left").join(_small(grid)).withColumn("price", floor_div(F.col("price") * F.col("percent"), F.lit(100)))
    flaw = F.min(F.when(F.col("_leg"), leg_flaw("ltv"))).alias("_flaw")
    sums = leg_values(rows).groupBy("grid", *debts.columns).agg(flaw, F.sum("value").alias("collateral"), F.sum("limit_value").alias("borrow_limit"))
    both = refused_sums(sums, ["collateral", "borrow_limit"])
    return both.withColumn("eligible", F.col("debt") > F.col("borrow_limit"))


def waterfall(legs: DataFrame, debts: DataFrame, grid: DataFrame) -> DataFrame:
    """Per grid point and engine: newly and cumulatively eligible accounts, their debt, collateral at risk,
    insolvent accounts, bad debt, and refused accounts.  An account that was eligible stays counted."""
    rows = eligible_on_grid(legs, debts, grid)
    w = Window.partitionBy("account").orderBy("grid")
    held = F.coalesce(F.max(F.col("eligible").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("held", held).withColumn("newly", F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0)))
    bad = F.greatest(F.lit(0), F.col("debt") - F.col("collateral"))
    total = lambda c: F.coalesce(F.sum(F.col("held") * c), F.lit(0))
    return rows.groupBy("grid", "engine").agg(
        F.sum("newly").alias("newly"), F.sum("held").alias("cumulative"), total(F.col("debt")).alias("debt_eligible"), total(F.col("collateral")).alias("at_risk"),
        F.count_if((F.col("held") == 1) & (bad > 0)).alias("insolvent"), total(bad).alias("bad_debt"), F.count("refusal").alias("refused"),
    )


def wide_waterfall(legs: DataFrame, debts: DataFrame, grid: DataFrame, unit: int) -> DataFrame:
    """K6 in wide integers: newly and cumulatively eligible accounts, their debt, and refused accounts."""
    points = [(r.grid, r.percent) for r in _small(grid).select("grid", "percent").collect()]
    rows = wide_limits(legs, debts, points, unit)
    rows = rows.withColumn("liquidatable", F.when(~F.col("refused"), W.compare(F.col("debt"), F.col("limit")) > 0))
    w = Window.partitionBy("account").orderBy("grid")
    held = F.coalesce(F.max(F.col("liquidatable").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("held", held).withColumn("newly", F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0)))
    rows = rows.withColumn("debt_eligible", F.when(F.col("held") == 1, F.col("debt")).otherwise("0"))
    sums = rows.groupBy("grid", "engine").agg(F.sum("newly").alias("newly"), F.sum("held").alias("cumulative"), F.count_if("refused").alias("refused"), *(c.alias(n) for n, c in W.limb_sums("debt_eligible").items()))
    return W.without_limbs(sums, "debt_eligible")


def seizable(legs: DataFrame, debts: DataFrame) -> DataFrame:
    """K4: what a liquidator may take: each leg's share of the debt with the leg's bonus, at most the leg.  Nothing of an
    account without legs; null, with the code, of a refused one."""
    rows = leg_values(legs).withColumn("total", F.sum("value").over(Window.partitionBy("account"))).join(debts.select("account", F.col("debt").alias("owed")), "account")
    # three factors: value and debt stay below 10**15, the bonus below 10**4
    wanted = F.col("owed").cast("decimal(19,0)") * (F.col("value") * F.col("bonus")).cast("decimal(19,0)")
    per = F.nullif(F.col("total") * 100, F.lit(0)).cast("decimal(19,0)")
    take = ((wanted - F.pmod(wanted, per)) / per).cast("decimal(38,0)")
    both = with_sums(debts, rows, ("bonus",), seizable=F.sum(F.least(F.col("value").cast("decimal(38,0)"), take)).cast("long"))
    return both.select("account", "engine", "seizable", "refusal")


def recoverable(legs: DataFrame, debts: DataFrame) -> DataFrame:
    """K5: debt that the legs pay back once bonuses are given, and the bad debt of accounts above their limit; an account
    without legs pays nothing back."""
    back = F.sum(floor_div(F.col("value") * 100, F.col("bonus")))
    both = with_sums(debts, leg_values(legs), ("ltv", "bonus"), recoverable=back, borrow_limit=F.sum("limit_value"))
    bad = F.when(F.col("debt") > F.col("borrow_limit"), F.greatest(F.lit(0), F.col("debt") - F.col("recoverable"))).when(F.col("refusal").isNull(), 0)
    return both.select("account", "engine", "debt", "recoverable", bad.alias("bad_debt"), "refusal")


def shortfall(legs: DataFrame, debts: DataFrame, ratios: DataFrame) -> DataFrame:
    """K7: collateral at the oracle and at market ratios (percent, default 100), what the market leaves unpaid, and refused
    accounts, which are in neither."""
    rows = leg_values(legs).join(ratios, "asset", "left").withColumn("market", floor_div(F.col("value") * F.coalesce("ratio", F.lit(100)), F.lit(100)))
    both = with_sums(debts, rows, (), at_oracle=F.sum("value"), at_market=F.sum("market"))
    gap = lambda c: F.greatest(F.lit(0), F.col("debt") - F.col(c))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("refusal").isNull(), c)), F.lit(0))
    return both.groupBy("engine").agg(
        total(F.col("at_oracle")).alias("at_oracle"), total(F.col("at_market")).alias("at_market"), total(gap("at_oracle")).alias("bad_at_oracle"),
        total(gap("at_market")).alias("bad_at_market"), F.count("refusal").alias("refused"),
    )


def health_histogram(positions: DataFrame, lanes: DataFrame) -> DataFrame:
    """K9: accounts per engine and lane, zeros included."""
    counts = positions.groupBy("engine", health_lane(F.col("weighted"), F.col("debt")).alias("lane")).agg(F.count("*").alias("n"))
    return positions.select("engine").distinct().join(_small(lanes)).join(counts, ["engine", "lane"], "left").fillna(0, ["n"])


def measure(positions: DataFrame, *by: str) -> DataFrame:
    """Accounts, totals, eligible, at risk and bad debt per engine, and by what `by` names."""
    liquid = F.col("liquidatable").cast("long")
    return positions.groupBy(*by, "engine").agg(
        F.count("*").alias("accounts"), F.sum("collateral").alias("collateral"), F.sum("debt").alias("debt"), F.sum(liquid).alias("eligible"),
        F.sum(liquid * F.col("debt")).alias("debt_eligible"), F.sum(liquid * F.col("collateral")).alias("at_risk"), F.sum(liquid * F.greatest(F.lit(0), F.col("debt") - F.col("collateral"))).alias("bad_debt"),
    )


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Accounts and debt by lane before and lane after."""
    both = before.select("engine", "account", F.col("lane").alias("from_lane"), F.col("debt").alias("debt_before")).join(after.select("engine", "account", F.col("lane").alias("to_lane"), F.col("debt").alias("debt_after")), ["engine", "account"])
    return both.groupBy("engine", "from_lane", "to_lane").agg(F.count("*").alias("accounts"), F.sum("debt_before").alias("debt_before"), F.sum("debt_after").alias("debt_after"))


def crossings(cells: DataFrame, edge: int) -> DataFrame:
    """Accounts that cross an edge of the lanes either way."""
    into = (F.col("from_lane") >= edge) & (F.col("to_lane") < edge)
    out = (F.col("from_lane") < edge) & (F.col("to_lane") >= edge)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("accounts"))), F.lit(0))
    return cells.groupBy("engine").agg(n(into).alias("entries"), n(out).alias("exits"), (n(into) - n(out)).alias("net"))


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """Four counts for each scenario and engine that close: to eligible, to healthy, stayed eligible, stayed healthy."""
    both = before.select("account", "engine", F.col("liquidatable").alias("b")).join(after.select("scenario", "account", F.col("liquidatable").alias("a")), "account")
    return both.groupBy("scenario", "engine").agg(F.count_if(~F.col("b") & F.col("a")).alias("to_eligible"), F.count_if(F.col("b") & ~F.col("a")).alias("to_healthy"), F.count_if(F.col("b") & F.col("a")).alias("stayed_eligible"), F.count_if(~F.col("b") & ~F.col("a")).alias("stayed_healthy"), F.count("*").alias("accounts"))


def reach(audit: DataFrame) -> DataFrame:
    """Distinct assets that a scenario moves, holds flat, or leaves where they are although they respond."""
    rows = audit.dropDuplicates(["scenario", "asset"])
    kind = F.when(F.col("held_flat"), "held").when(F.col("shocked") == F.col("price"), "unmoved").otherwise("moved")
    return rows.groupBy("scenario").agg(*(F.count_if(kind == k).alias(k) for k in ("moved", "held", "unmoved")))


def set_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per scenario and engine the changes against the measure before, and their share of the debt in tenths of
    a percent (null without debt)."""
    b = before.select("engine", *(F.col(c).alias(f"b_{c}") for c in ("debt", "eligible", "debt_eligible", "bad_debt")))
    rows = after.join(b, "engine")
    delta = F.col("debt_eligible") - F.col("b_debt_eligible")
    return rows.select("scenario", "engine", (F.col("eligible") - F.col("b_eligible")).alias("eligible_delta"), delta.alias("debt_delta"), (F.col("bad_debt") - F.col("b_bad_debt")).alias("bad_delta"), floor_div(delta * 1000, F.col("b_debt")).alias("tenths"))


def bad_debt_rate(measures: DataFrame) -> DataFrame:
    """Bad debt over eligible debt in tenths of a percent: undefined at 0 / 0, contradiction at x / 0."""
    state = F.when(F.col("debt_eligible") > 0, "rate").when(F.col("bad_debt") > 0, "contradiction").otherwise("undefined")
    return measures.select("engine", state.alias("state"), floor_div(F.col("bad_debt") * 1000, F.col("debt_eligible")).alias("tenths"))


def risk_map(positions: DataFrame) -> DataFrame:
    """Accounts and debt by band of headroom and half-decade of debt; accounts without debt or limit stand aside."""
    aside = F.when(F.col("debt") == 0, "no_debt").when(F.col("borrow_limit") == 0, "no_limit").otherwise("mapped")
    band = F.when(aside == "mapped", headroom_band(headroom_tenths(F.col("borrow_limit"), F.col("debt"))))
    return positions.groupBy("engine", aside.alias("place"), band.alias("band"), F.when(aside == "mapped", half_decade(F.col("debt"))).alias("bin")).agg(F.count("*").alias("accounts"), F.sum("debt").alias("debt"))


def below_dust(series: DataFrame, dust: int) -> DataFrame:
    """Engines of which every rung is below the dust."""
    return series.groupBy("engine").agg(F.max("debt_eligible").alias("top")).filter(F.col("top") < dust).select("engine")


