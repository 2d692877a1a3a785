"""Positions of the debt engine, and what liquidations of them recover, in whole numbers of any width.

Amounts, prices, debts and results are decimal strings (or whole numbers, as far as they go).  Legs are rounded down one by
one; sums are taken on Python integers, so no width is a limit.  An account with a leg that cannot be valued is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import exact as X
from tidebook.functions import wide as W
from tidebook.operators.valuation import wide_sums_of

WAD, PERCENT = 10**18, 100 * 10**18

_product = X.Quotient((None, None, 1))


def _value(amount, price, unit):
    """floor(amount * price / unit); None without one of them."""
    return None if None in (amount, price) or not unit else amount * price // unit


def _over(x, by):
    return None if x is None or not by else x // by


def debt_positions(legs: DataFrame, debts: DataFrame) -> DataFrame:
    """An account may be liquidated if its debt is strictly above the sum of its legs' limits.

    legs: (account, asset, amount, price, unit of the asset, threshold in 1e18 per percent); debts: (account, engine, debt).
    """

    def values(amount, price, unit, threshold):
        value = _value(amount, price, unit)
        return value, None if None in (value, threshold) else value * threshold // PERCENT

    both = wide_sums_of(debts, legs, ("threshold",), ["amount", "price", "unit", "threshold"], values, ["value", "limit"])
    return both.select("account", "engine", "debt", F.col("value").alias("collateral"), F.col("limit").alias("borrow_limit"), F.when(F.col("refusal").isNull(), W.compare(F.col("debt"), F.col("limit")) > 0).alias("liquidatable"), "refusal")


def liquidations(legs: DataFrame, debts: DataFrame) -> DataFrame:
    """K4, K5, K7: what a liquidation of each account would take and pay back, at the oracle and at the market.

    legs as of debt_positions(), with bonus_num / bonus_den (the multiplier of a liquidation; null: none) and ratio (market
    over oracle in 1e18; null: 1).  Per account: seizable, the sum of min(value, debt * value * bonus / all values) of the
    legs; recoverable, the sum of value / bonus; bad_debt, what that leaves of the debt if the account may be liquidated;
    realizable, the sum of value * ratio; market, the seizable part at the weighted mean of ratios; shortfall, what is
    lost by it; market_bad_debt, what the realizable leaves of the debt.  Each quotient is rounded down.
    """
    num, den = F.coalesce(F.col("bonus_num").cast("string"), F.lit("1")), F.coalesce(F.col("bonus_den").cast("string"), F.lit("1"))
    rows = legs.withColumn("bonus_num", num).withColumn("bonus_den", den).withColumn("ratio", F.coalesce(F.col("ratio").cast("string"), F.lit(str(WAD))))
    totals = W.folded(rows.withColumn("_none", F.lit(None).cast("int")), ["account"], ["amount", "price", "unit"], lambda *leg: (_value(*leg),), 1, "_none")
    rows = rows.join(totals.select("account", F.col("_sums")[0].alias("total")), "account").join(debts.select("account", F.col("debt").cast("string").alias("owed")), "account")

    def values(amount, price, unit, threshold, num, den, ratio, total, owed):
        value = _value(amount, price, unit)
        if value is None:
            return None, 0, None, None, None, None
        wanted = None if None in (total, owed) else _over(owed * value * num, total * den)
        weighted = value * ratio
        return value, 0 if wanted is None else min(value, wanted), _over(value * den, num), None if threshold is None else value * threshold // PERCENT, weighted // WAD, weighted

    inputs = ["amount", "price", "unit", "threshold", "bonus_num", "bonus_den", "ratio", "total", "owed"]
    both = wide_sums_of(debts, rows, ("threshold",), inputs, values, ["value", "seizable", "recoverable", "limit", "realizable", "weighted"])
    market = F.coalesce(X.mul_div_floor(F.col("seizable"), F.col("weighted"), _product(F.col("value"), F.lit(str(WAD)))), F.lit("0"))
    fine = F.col("refusal").isNull()
    both = both.withColumn("market", F.when(fine, market)).withColumn("liquidatable", F.when(fine, W.compare(F.col("debt"), F.col("limit")) > 0))
    bad = F.when(F.col("liquidatable"), W.floored_gap(F.col("debt"), F.col("recoverable"))).when(fine, "0")
    return both.select(
        "account", "engine", F.col("debt").cast("string").alias("debt"), "liquidatable", "seizable", "recoverable", bad.alias("bad_debt"), "realizable", "market", F.when(fine, W.floored_gap(F.col("seizable"), F.col("market"))).alias("shortfall"),
        F.when(fine, W.floored_gap(F.col("debt"), F.col("realizable"))).alias("market_bad_debt"), "refusal",
    )


def shortfall(liquidated: DataFrame) -> DataFrame:
    """K7: per engine the accounts that may be liquidated, their shortfall and bad debt at the market, how many of them have
    some, and refused accounts."""
    due = F.col("liquidatable")
    rows = liquidated.withColumns({c: F.when(due, F.col(c)).otherwise("0") for c in ("shortfall", "market_bad_debt")})
    sums = rows.groupBy("engine").agg(F.count_if(due).alias("liquidatable"), F.count_if(due & (F.col("market_bad_debt") != "0")).alias("insolvent"), F.count("refusal").alias("refused"), *(c.alias(n) for x in ("shortfall", "market_bad_debt") for n, c in W.limb_sums(x).items()))
    return W.without_limbs(sums, "shortfall", "market_bad_debt")
