"""Reconciliation of derived against observed tables, and backtests of liquidations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.exact import floor_div
from tidebook.sources.shared import dealt, written


def token_comparison(derived: DataFrame, observed: DataFrame, unit: int) -> DataFrame:
    """L1: floor(net * index / unit) against what was observed per account and asset, with a verdict."""
    bridged = derived.select("account", "asset", floor_div(F.col("net") * F.col("index"), F.lit(unit)).alias("bridged"))
    both = bridged.join(observed, ["account", "asset"], "full")
    verdict = F.when(F.col("bridged").isNull(), "only_observed").when(F.col("observed").isNull(), "only_derived").when(F.col("bridged") == F.col("observed"), "equal").otherwise("different")
    return both.withColumn("verdict", verdict)


def mismatch_class(rows: DataFrame) -> DataFrame:
    """L2: why a comparison differs: residue of one unit, missing genesis, stable snap, index, unclassified."""
    d = F.col("bridged") - F.col("observed")
    kind = F.when(F.abs(d) == 1, "residue").when(F.col("verdict") == "only_observed", "missing_genesis").when(F.col("verdict") == "only_derived", "missing_observed").when(F.abs(d) * 100 <= F.abs(F.col("observed")), "snap_suspect").when(F.col("bridged") % 2 == F.col("observed") % 2, "index").otherwise("unclassified")
    return rows.filter("verdict <> 'equal'").withColumn("class", kind)


def aggregate_weld(derived: DataFrame, observed: DataFrame) -> DataFrame:
    """Totals per asset on both sides; an asset that was not read is gated, not wrong."""
    a = derived.groupBy("asset").agg(F.sum("amount").alias("derived"))
    both = a.join(observed.groupBy("asset").agg(F.sum("amount").alias("observed")), "asset", "full")
    return both.select("asset", F.coalesce("derived", F.lit(0)).alias("derived"), "observed", F.when(F.col("observed").isNull(), "gated").when(F.coalesce("derived", F.lit(0)) == F.col("observed"), "equal").otherwise("different").alias("verdict"))


def index_recurrence(rates: DataFrame, per_block: int, unit: int) -> DataFrame:
    """L4: whether each index is what the one before grows to over the blocks between."""
    w = Window.partitionBy("asset", "kind").orderBy("block")
    rows = rates.withColumns({"before": F.lag("value").over(w), "dt": F.col("block") - F.lag("block").over(w)}).filter("before is not null")
    expected = F.col("before") + floor_div(F.col("before") * per_block * F.col("dt"), F.lit(unit))
    return rows.select("asset", "kind", "block", "value", expected.alias("expected"), (expected == F.col("value")).alias("holds"))


def document_differences(derived: DataFrame, observed: DataFrame) -> DataFrame:
    """Entries of two documents (account, amounts: map) that differ."""
    left, right = (df.select("account", F.explode("amounts").alias("asset", name)) for df, name in ((derived, "derived"), (observed, "observed")))
    return left.join(right, ["account", "asset"], "full").filter(~F.col("derived").eqNullSafe(F.col("observed")))


def fleet_freshness(sweeps: DataFrame, now: int, bound: int) -> DataFrame:
    """Accounts per engine that are fresh, stale, failed or never swept, and whether 95 % are fresh."""
    state = F.when(F.col("last_success").isNull(), F.when(F.col("status") == "failed", "failed").otherwise("never")).when(F.lit(now) - F.col("last_success") <= bound, "fresh").otherwise("stale")
    counts = sweeps.groupBy("engine").agg(*(F.count_if(state == s).alias(s) for s in ("fresh", "stale", "failed", "never")), F.count("*").alias("accounts"))
    return counts.withColumn("enough", F.col("fresh") * 100 >= F.col("accounts") * 95)


def sweep_class(sweeps: DataFrame, pin: int) -> DataFrame:
    """Whether an account can be judged at a pin."""
    return sweeps.select("account", F.when(F.col("last_success").isNull(), "never").when(F.col("last_success") > pin, "above_pin").otherwise("evaluable").alias("class"))


def verdict_comparison(facts: DataFrame) -> DataFrame:
    """Derived and observed verdicts: exact, drifted since, unread, at the boundary, or wrong."""
    label = F.when(F.col("observed").isNull(), "unread").when(F.col("derived") == F.col("observed"), "exact").when(F.col("moved"), "drift").when(F.abs(F.col("debt") - F.col("borrow_limit")) * 1000 <= F.col("borrow_limit"), "boundary").otherwise("wrong")
    return facts.withColumn("label", label)


def cohorts(candidates: DataFrame, debts: DataFrame, seen: DataFrame) -> DataFrame:
    """Each candidate is finite, without debt, candidate only or never seen."""
    rows = candidates.join(debts.select("account", "debt"), "account", "left").join(seen.select("account").distinct().withColumn("seen", F.lit(True)), "account", "left")
    return rows.select("account", F.when(F.col("debt") > 0, "finite").when(F.col("debt") == 0, "zero_debt").when(F.col("seen"), "candidate_only").otherwise("never_seen").alias("cohort"))


def parameter_weld(folded: DataFrame, observed: DataFrame, fields: list[str]) -> DataFrame:
    """Folded parameters against an observed configuration, the first field that differs."""
    both = folded.join(observed.select("asset", *(F.col(f).alias(f"o_{f}") for f in fields), F.lit(True).alias("_o")), "asset", "full")
    first = F.when(F.col("_o").isNull(), "unread")
    for f in fields:
        first = first.when(~F.col(f).eqNullSafe(F.col(f"o_{f}")), f)
    return both.select("asset", F.coalesce(first, F.lit("equal")).alias("verdict"))


def heartbeat_scan(prices: DataFrame, limit: int, now: int, step: int = 86_400) -> DataFrame:
    """Per source rows, distinct places, missing times, the longest gap including the open one, and a verdict.

    Gaps are taken within spans of `step` seconds, and between the last and the first row of spans that follow each other, so
    a source with very many rows is put in order in parts.
    """
    span = F.floor(F.col("as_of") / step).alias("span")
    inside = prices.select("source", "as_of", span).withColumn("gap", F.col("as_of") - F.lag("as_of").over(Window.partitionBy("source", "span").orderBy("as_of")))
    spans = inside.filter("as_of is not null").groupBy("source", "span").agg(F.max("gap").alias("gap"), F.min("as_of").alias("first"), F.max("as_of").alias("last"))
    between = F.col("first") - F.lag("last").over(Window.partitionBy("source").orderBy("span"))
    longest = spans.withColumn("gap", F.greatest("gap", between)).groupBy("source").agg(F.greatest(F.max("gap"), F.lit(now) - F.max("last")).alias("longest"))
    out = prices.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("block", "asset").alias("places"), F.count_if(F.col("as_of").isNull()).alias("missing"))
    out = out.join(longest, "source", "left").select("source", "n", "places", "missing", "longest")
    return out.withColumn("verdict", F.when(F.col("missing") > 0, "incomplete").when(F.col("longest") > limit, "late").otherwise("ok"))


def liquidation_facts(events: DataFrame, tasks: int | None = None) -> DataFrame:
    """Repayments with the balance before and after, earlier ones of the transaction, and the next one's block; events
    are exchanged once, over so many tasks."""
    key = ["engine", "account", "asset", "side"]
    w = Window.partitionBy(*key).orderBy("block", "log_index", "seq", "tx")
    rows = dealt(events.filter("delta is not null"), tasks, *key).withColumn("after", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter("event_type = 'repay'").withColumn("next_block", F.lead("block").over(w)).withColumn("earlier", F.row_number().over(Window.partitionBy("tx", *key).orderBy("block", "log_index", "seq")) - 1)
    return rows.select(*key, "tx", "block", "log_index", "seq", (F.col("after") - F.col("delta")).alias("before"), "after", "next_block", F.col("earlier").cast("long").alias("earlier"))


def carried_budget(elements: DataFrame, budgets: DataFrame) -> DataFrame:
    """Elements take from a budget in order: how much each gets, and whether all, part or nothing is left.

    The running sum before an element says what is left for it.
    """
    w = Window.partitionBy("account").orderBy("asset").rowsBetween(Window.unboundedPreceding, -1)
    rows = elements.join(budgets, "account").withColumn("left", F.greatest(F.lit(0), F.col("budget") - F.coalesce(F.sum("value").over(w), F.lit(0))))
    return rows.select("account", "asset", "value", F.least("value", "left").alias("taken"), F.when(F.col("left") == 0, "drained").when(F.col("value") <= F.col("left"), "whole").otherwise("partial").alias("shape"))


def seizure_shapes(elements: DataFrame, unit: int = 100) -> DataFrame:
    """Which course explains the amounts of a liquidation pass: (account, elements, shape).

    elements: (account, seq, balance, price, percent of bonus, amount, bonus, liquidated, prior), in order of seq; liquidated is
    what the pass paid back, prior what earlier passes of the transaction took of the balance, null without one.  An
    element takes the whole balance, of which the bonus is its share (partial), while what it pays for is less than what is
    left of the budget, and else what is left and the bonus on it (final).  Shapes: drained (nothing was left by earlier
    passes), partial (every element), final (the last element only), ambiguous (both fit) and unexplained.  As only the
    last element may be final, what is left before each is a running sum.
    """
    c = F.col
    net = floor_div(c("balance") * 100, c("percent") + 100)
    rows = elements.withColumn("net", net).withColumn("credit", floor_div(c("net") * c("price"), F.lit(unit)))
    w = Window.partitionBy("account").orderBy("seq")
    before = F.coalesce(F.sum("credit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.greatest(F.lit(0), c("liquidated") - before)).withColumn("last", F.lead("seq").over(w).isNull())
    rows = rows.withColumn("pays", floor_div(c("left") * unit, c("price"))).withColumn("on_it", floor_div(c("pays") * c("percent"), F.lit(100)))
    whole = (c("amount") == c("balance")) & (c("bonus") == c("balance") - c("net"))
    nothing = (c("amount") == 0) & (c("bonus") == 0)
    rest = (c("amount") == c("pays") + c("on_it")) & (c("bonus") == c("on_it"))
    more_due = c("net") < c("pays")
    every = lambda x: F.bool_and(F.coalesce(x, F.lit(False)))
    paid = F.max("liquidated")
    out = rows.groupBy("account").agg(
        F.count("*").alias("elements"), ((paid == 0) & every(nothing) & every(c("prior") == c("balance"))).alias("drained"),
        (every(whole | (nothing & (c("balance") == 0))) & (F.sum(floor_div((c("amount") - c("bonus")) * c("price"), F.lit(unit))) == paid)).alias("partial"),
        ((paid > 0) & every(F.when(c("last"), ~more_due & rest).otherwise(more_due & whole))).alias("final"),
    )
    shape = F.when(c("drained"), "drained").when(c("partial") & c("final"), "ambiguous").when(c("partial"), "partial").when(c("final"), "final").otherwise("unexplained")
    return out.select("account", "elements", shape.alias("shape"))


def flip_causes(witnesses: DataFrame, debts: DataFrame) -> DataFrame:
    """The witness (account, place, amount) in order at which the running sum first exceeds the account's limit."""
    w = Window.partitionBy("account").orderBy("block", "log_index", "seq", "tx")
    rows = witnesses.withColumn("running", F.sum("amount").over(w)).join(debts, "account").filter(F.col("running") > F.col("debt"))
    return rows.groupBy("account").agg(F.min_by(F.struct("block", "log_index", "running"), F.struct("block", "log_index", "seq", "tx")).alias("c")).select("account", "c.*")


def basket_continuity(before: DataFrame, after: DataFrame, transfers: DataFrame) -> DataFrame:
    """What a basket's leg changed by less its signed transfers; a rest that came in is refused."""
    moved = transfers.groupBy("account", "asset").agg(F.sum("delta").alias("moved"))
    key = ["account", "asset"]
    rows = before.select(*key, F.col("amount").alias("was")).join(after.select(*key, F.col("amount").alias("now")), key, "full").join(moved, key, "left").fillna(0)
    rest = F.col("now") - F.col("was") - F.col("moved")
    return rows.select(*key, rest.alias("rest"), F.when(rest > 0, "refused").when(rest < 0, "outflow").otherwise("continuous").alias("verdict"))


def golden(sums: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Committed values and whether the sums still give them."""
    return vectors.join(sums, key, "left").withColumn("ok", F.col("amount").eqNullSafe(F.col("expected")))


def composition(links: DataFrame) -> DataFrame:
    """For each asset (asset, base) the root of its chain of bases, how many steps away it is, and whether it has none.

    Paths double in each round: what an asset reaches is joined with what that reaches, so n rounds follow 2**n steps.  No
    chain without a cycle is longer than there are assets; what has not ended after as many steps leads into a cycle, and
    has neither root nor steps.  An asset with two bases is an error.
    """
    links = links.select("asset", "base")
    if not links.groupBy("asset").count().where("count > 1").isEmpty():
        raise ValueError("an asset has two bases")
    paths = written(links.select("asset", F.col("base").alias("root"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")), "paths")
    for _ in range(paths.count().bit_length() + 1):
        if paths.where("not done").isEmpty():
            break
        on = paths.select(F.col("asset").alias("root"), F.col("root").alias("_root"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        more = paths.where("not done").join(on.hint("merge"), "root", "left")  # a broadcast would pass all paths through the driver
        ends = F.col("_root").isNull()
        longer = more.select("asset", F.coalesce("_root", "root").alias("root"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), (ends | F.col("_done")).alias("done"))
        paths = written(paths.where("done").unionByName(longer), "paths")
    cyclic = ~F.col("done")
    return paths.select("asset", F.when(~cyclic, F.col("root")).alias("root"), F.when(~cyclic, F.col("steps")).alias("steps"), cyclic.alias("cyclic"))


def eligibility_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Verdicts at the prices of each scenario against those before."""
    both = before.select("account", F.col("liquidatable").alias("b")).join(after.select("scenario", "account", F.col("liquidatable").alias("a")), "account")
    return both.select("scenario", "account", F.when(F.col("a") & ~F.col("b"), "became").when(~F.col("a") & F.col("b"), "ceased").when(F.col("a"), "stayed").otherwise("never").alias("label"))


def selected_cohort(positions: DataFrame, multi: DataFrame, seed: str, healthy: int, several: int, nearest: int, rest: int) -> DataFrame:
    """All liquidatable accounts, some healthy, some with several legs, the nearest to their limit and a seeded rest;
    each account once, under the first rule that takes it."""
    h = F.md5(F.concat(F.lit(seed), F.col("account").cast("string")).cast("binary"))
    take = lambda df, n, why, order: df.orderBy(order, "account").limit(n).select("account", F.lit(why).alias("rule"))
    fine = positions.filter("not liquidatable")
    parts = [
        positions.filter("liquidatable").select("account", F.lit("1_liquidatable").alias("rule")), take(fine, healthy, "2_healthy", h), take(positions.join(multi, "account", "left_semi"), several, "3_several", h),
        take(fine, nearest, "4_nearest", F.col("borrow_limit") - F.col("debt")), take(positions, rest, "5_rest", h),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("account").agg(F.min("rule").alias("rule"))


def frames_to(frames: DataFrame, targets: list[str], selectors: list[str]) -> DataFrame:
    """Transactions with a call frame, at any depth, to a target with an administrative selector.  Frames are flat
    rows, so depth needs no recursion."""
    hit = F.col("target").isin(targets) & F.substring("input", 1, 8).isin(selectors)
    return frames.filter(hit).groupBy("tx").agg(F.count("*").alias("frames"), F.min("depth").alias("depth"))


def integrity_report(checks: dict[str, DataFrame], details: int = 5) -> DataFrame:
    """Per check how many violations there are, with the first few as text."""
    out = None
    for name, df in checks.items():
        line = F.to_json(F.struct(*df.columns))
        few = df.select(line.alias("line")).orderBy("line").limit(details).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("details"))
        part = df.agg(F.count("*").alias("violations")).join(few).select(F.lit(name).alias("check_name"), "violations", "details")
        out = part if out is None else out.union(part)
    return out
