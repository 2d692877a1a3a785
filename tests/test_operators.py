"""Laws and seeded violations that the oracles do not show."""

import pytest
from pyspark.sql import functions as F

from tidebook.operators import aggregates, gates, paging, reconcile, sequences, stress, valuation
from tidebook.operators import ledger as L
from tidebook.plans.bindings import Views


@pytest.fixture(scope="module")
def views(spark, sf):
    return Views(spark, sf)


def grid(spark, n=6):
    return spark.range(n).select(F.col("id").alias("grid"), (100 - F.col("id") * 12).alias("percent"))


def test_waterfall_never_falls_and_closes(spark, views):
    rows = stress.waterfall(views.legs, views.debts, grid(spark))
    assert sequences.falls(rows, ["engine"], "grid", "cumulative").isEmpty()
    for r in rows.groupBy("engine").agg(F.sum("newly").alias("newly"), F.max("cumulative").alias("top")).collect():
        assert r.newly == r.top
    broken = rows.withColumn("cumulative", F.when(F.col("grid") == 3, -1).otherwise(F.col("cumulative")))
    assert sequences.falls(broken, ["engine"], "grid", "cumulative").count() > 0


def test_sums_stay_within_their_engine(views):
    p = valuation.debt_positions(views.legs, views.debts)
    moved = p.withColumn("debt", F.when(F.col("engine") == "pool", F.col("debt") * 7).otherwise(F.col("debt")))
    debt_side = lambda df: tuple(stress.measure(df).filter("engine = 'debt'").first())
    assert debt_side(p) == debt_side(moved)


def test_shortfall_leaves_the_oracle_side_alone(spark, views):
    none = spark.createDataFrame([], "asset long, ratio long")
    all_ = views.legs.select("asset", F.lit(50).cast("long").alias("ratio")).distinct()
    a, b = ({r.engine: r for r in stress.shortfall(views.legs, views.debts, x).collect()} for x in (none, all_))
    for engine, r in a.items():
        assert r.at_oracle == r.at_market == b[engine].at_oracle and r.bad_at_oracle == b[engine].bad_at_oracle
        assert b[engine].at_market <= r.at_market // 2


def test_a_missing_verdict_or_an_open_census_is_an_error(spark):
    engines = spark.createDataFrame([("pool",)], "engine string")
    rows = spark.createDataFrame([("pool", "computed", None, 1, 1)], "engine string, status string, liquidatable boolean, collateral long, debt long")
    with pytest.raises(Exception, match="no verdict"):
        aggregates.book_rollup(engines, rows).collect()
    assert aggregates.book_rollup(engines, rows.withColumn("status", F.lit("refused"))).first().refused == 1
    with pytest.raises(Exception, match="does not close"):
        aggregates.closing_census(rows.withColumn("status", F.lit("lost"))).collect()


def test_refusals_name_the_first_reason(spark):
    rows = [(1, 5, 1, None, 50), (1, 2, 1, 0, 50), (2, 1, -1, 5, 50), (3, 1, 1, 5, None), (4, 1, 1, 5, 50), (4, 1, 1, 5, 50), (5, 1, 1, 5, 50)]
    df = spark.createDataFrame(rows, "account long, asset long, amount long, price long, threshold long")
    got = {r.account: (r.refusal_code, r.refusal_asset) for r in valuation.refusals(df).collect()}
    assert got == {1: ("missing_price", 5), 2: ("negative", 1), 3: ("missing_param", 1), 4: ("duplicate", 1)}


def test_refusals_in_the_order_of_the_sql(spark, tmp_path):
    """j3_refusals goes by k: an asset beyond a million outweighs the reason."""
    rows = [(1, 2_000_000, 1, None, 50), (1, 3, 1, 0, 50), (2, 7, 1, 5, None), (2, 1_500_007, -1, 5, 50)]
    df = spark.createDataFrame(rows, "account long, asset long, amount long, price long, threshold long")
    k = (F.col("rank") - F.when(F.col("rank") > 2, 1).otherwise(0)) * 1_000_000 + F.col("asset")
    got = lambda *order: {r.account: (r.refusal_code, r.refusal_asset, r.legs_refused) for r in valuation.refusals(df, *order).collect()}
    assert got(k) == {1: ("bad_price", 3, 2), 2: ("missing_param", 7, 2)}
    assert got() == {1: ("missing_price", 2_000_000, 2), 2: ("negative", 1_500_007, 2)}


def test_debt_at_the_limit_is_not_liquidatable(spark):
    legs = spark.createDataFrame([(1, 1, 10, 100, 65, 80, 105), (2, 1, 10, 100, 65, 80, 105)], "account long, asset long, amount long, price long, ltv long, threshold long, bonus long")
    debts = spark.createDataFrame([(1, "debt", 650), (2, "debt", 651), (3, "debt", 1), (4, "debt", 0)], "account long, engine string, debt long")
    got = {r.account: (r.borrow_limit, r.liquidatable) for r in valuation.debt_positions(legs, debts).collect()}
    assert got == {1: (650, False), 2: (650, True), 3: (0, True), 4: (0, False)}
    health = {r.account: (r.health, r.infinite, r.eligible) for r in valuation.pool_positions(legs, debts).collect()}
    assert health[1] == (800 * 10**6 // 650, False, False) and health[3] == (0, False, True) and health[4] == (None, True, False)


def test_recoverable_and_seizable_by_hand(spark):
    legs = spark.createDataFrame([(1, 1, 10, 100, 50, 80, 110), (1, 2, 1, 500, 50, 80, 105)], "account long, asset long, amount long, price long, ltv long, threshold long, bonus long")
    debts = spark.createDataFrame([(1, "debt", 1400)], "account long, engine string, debt long")
    r = stress.recoverable(legs, debts).first()
    assert r.recoverable == 100000 // 110 + 50000 // 105 and r.bad_debt == 1400 - r.recoverable
    take = stress.seizable(legs, debts).first().seizable
    assert take == min(1000, 1400 * 1000 * 110 // (1500 * 100)) + min(500, 1400 * 500 * 105 // (1500 * 100))


def test_debts_without_legs_and_unknown_legs_stay_in_the_book(spark, views):
    points = grid(spark, 2)
    legs = spark.createDataFrame([(2, 1, 10, None, 65, 80, 105), (2, 2, 10, 100, 65, 80, 105), (3, 1, 10, 100, 65, 80, 105)], "account long, asset long, amount long, price long, ltv long, threshold long, bonus long")
    debts = spark.createDataFrame([(1, "debt", 900), (2, "debt", 900), (3, "debt", 900)], "account long, engine string, debt long")
    by = lambda df, *c: {r.account: tuple(r[x] for x in c) for r in df.collect()}
    assert by(valuation.debt_positions(legs, debts), "collateral", "liquidatable", "refusal") == {1: (0, True, None), 2: (None, None, "missing_price"), 3: (1000, True, None)}
    assert by(valuation.pool_positions(legs, debts), "eligible", "refusal") == {1: (True, None), 2: (None, "missing_price"), 3: (True, None)}
    assert by(stress.seizable(legs, debts), "seizable", "refusal") == {1: (0, None), 2: (None, "missing_price"), 3: (945, None)}
    assert by(stress.recoverable(legs, debts), "bad_debt") == {1: (900,), 2: (None,), 3: (0,)}
    first = stress.waterfall(legs, debts, points).filter("grid = 0").first()
    assert (first.cumulative, first.debt_eligible, first.bad_debt, first.refused) == (2, 1800, 900, 1)
    market = stress.shortfall(legs, debts, spark.createDataFrame([], "asset long, ratio long")).first()
    assert (market.at_oracle, market.bad_at_oracle, market.refused) == (1000, 900, 1)
    # every debt of the tables is in the waterfall once prices are gone
    gone = spark.createDataFrame([(0, 100), (1, 1)], "grid long, percent long")
    assert stress.eligible_on_grid(views.legs, views.debts, gone).filter("grid = 0").count() == views.debts.count()


def test_seizure_shapes_by_hand(spark):
    """Balance 110 at a bonus of 10 % pays for 100; the last element takes what is left and the bonus on it."""
    rows = [
        (1, 1, 110, 100, 10, 110, 10, 200, None), (1, 2, 110, 100, 10, 110, 10, 200, None),  # whole, whole, and the budget just spent
        (2, 1, 110, 100, 10, 110, 10, 150, None), (2, 2, 110, 100, 10, 55, 5, 150, None),  # whole, then half
        (3, 1, 110, 100, 10, 0, 0, 0, 110), (4, 1, 110, 100, 10, 0, 0, 0, None),  # drained by a pass before; no such pass
        (5, 1, 110, 100, 10, 55, 5, 150, None), (5, 2, 110, 100, 10, 110, 10, 150, None),  # the rest is not last
        (6, 1, 110, 100, 10, 110, 10, 100, None),  # the budget is just what the balance pays for: both fit
        (7, 1, 110, 7, 5, 110, 6, 7, None),  # what is paid back is rounded down, so the rest would be less than the balance
    ]
    df = spark.createDataFrame(rows, "account long, seq long, balance long, price long, percent long, amount long, bonus long, liquidated long, prior long")
    got = {r.account: r.shape for r in reconcile.seizure_shapes(df).collect()}
    assert got == {1: "ambiguous", 2: "final", 3: "drained", 4: "unexplained", 5: "unexplained", 6: "ambiguous", 7: "partial"}


def test_wide_positions_on_256_bit_amounts(spark):
    """Amounts in wads, ray indexes and prices of 1e18, beyond 38 digits, next to ordinary rows, an unknown leg and no legs."""
    ray, wad = 10**27, 10**18
    legs = {1: [(3 * 10**30, ray + 7, 2_000 * wad, 7500, 8000), (5, 2 * ray, 3, 5000, 6000)], 2: [(10, ray, 100, 6500, 8000)], 3: [(10**40, ray * 3 // 2, None, 1, 1)], 4: []}
    debts = {1: (10**33, ray + 1, 4 * wad), 2: (800, ray, 1), 3: (1, ray, 1), 4: (2, ray, 5)}
    rows = [(a, i, str(x), str(idx), None if p is None else str(p), ltv, th) for a, own in legs.items() for i, (x, idx, p, ltv, th) in enumerate(own)]
    owed = spark.createDataFrame([(a, "pool", str(x), str(i), str(p)) for a, (x, i, p) in debts.items()], "account long, engine string, shares string, index string, price string")
    table = spark.createDataFrame(rows, "account long, asset long, amount string, index string, price string, ltv long, threshold long")
    unit = 10**6
    got = {r.account: r for r in valuation.wide_positions(table, valuation.wide_debts(owed, unit), unit).collect()}
    for a, own in legs.items():
        x, i, p = debts[a]
        debt = -(-(-(-x * i // ray)) * p // unit)
        r = got[a]
        assert int(r.debt) == debt
        if a == 3:
            assert r.refusal == "missing_price" and r.collateral is None and r.liquidatable is None and r.eligible is None
            continue
        values = [(n * idx // ray * price // unit, ltv, th) for n, idx, price, ltv, th in own]
        limit, weighted = sum(v * ltv // 10_000 for v, ltv, _ in values), sum(v * th // 10_000 for v, _, th in values)
        health = (weighted * wad + debt // 2) // debt // 10_000
        assert (int(r.collateral), int(r.borrow_limit), int(r.weighted), int(r.health)) == (sum(v for v, _, _ in values), limit, weighted, health)
        assert (r.liquidatable, r.eligible, r.refusal) == (debt > limit, health < 10**14, None)


def test_places_are_those_of_one_window(spark):
    from pyspark.sql import Window

    df = spark.range(500).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 101).alias("x"), (F.col("id") % 3).alias("g")).repartition(5)
    order = [F.asc_nulls_last("x"), F.col("id")]
    for by in ((), ("g",)):
        want = {r.id: r.p for r in df.withColumn("p", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).collect()}
        got = paging.placed(df, [paging.steps(df, "x", 8)], order, by)
        assert got.columns == ["id", "x", "g", "place"] and {r.id: r.place for r in got.collect()} == want
    assert paging.placed(df.limit(0), [paging.steps(df.limit(0), "x")], order).count() == 0


def test_too_many_scenarios_are_refused(spark, views):
    with pytest.raises(ValueError, match="more than"):
        stress.eligible_on_grid(views.legs, views.debts, spark.range(2000).select(F.col("id").alias("grid"), F.lit(100).cast("long").alias("percent")))


def test_share_fold_rounds_by_regime(spark):
    rows = [(1, 1, 5, 1, 0, 10, 3_000_000), (1, 1, 20, 1, 0, 10, 3_000_000), (1, 1, 21, 1, 0, -25, 3_000_000), (2, 1, 20, 1, 0, 10, 3_000_000)]
    df = spark.createDataFrame(rows, "account long, asset long, block long, log_index long, seq long, amount long, index long")
    got = {(r.account, r.block): (r.moved, r.shares) for r in L.share_fold(df, 10).collect()}
    assert got[1, 5] == (3, 3)  # 10 / 3, half up
    assert got[1, 20] == (4, 7)  # floor(3 * 3) + 10 = 19, rounded up
    assert got[1, 21] == (-7, 0) and got[2, 20] == (4, 4)


def test_stride_depends_on_what_was_kept(spark):
    rows = [(1, b, i, v) for i, (b, v) in enumerate([(0, True), (4, True), (9, True), (10, True), (12, False), (13, False), (25, False)])]
    df = spark.createDataFrame(rows, "asset long, block long, log_index long, valid boolean")
    kept = [r.block for r in sequences.strided(df, ["asset"], "block", 10, "valid").orderBy("block").collect()]
    assert kept == [0, 10, 12, 25]


def test_cursor_pages_are_the_whole_feed(views):
    rows = views.position_events.filter("account < 20").select("block", "tx", "log_index", "seq")
    columns = ["block", "tx", "log_index", "seq"]
    seen, cursor = [], [10**9] * 4
    while page := [tuple(r) for r in paging.after_cursor(rows, columns, cursor).orderBy(*(F.desc(c) for c in columns)).limit(200).collect()]:
        seen += page
        cursor = list(page[-1])
    assert seen == sorted((tuple(r) for r in rows.collect()), reverse=True)


def test_sample_is_seeded_and_complete(spark):
    people = spark.range(60).select(F.col("id").alias("account"), F.when(F.col("id") < 40, "a").otherwise("b").alias("stratum"), (F.col("id") % 3 == 0).alias("live"))
    take = lambda seed: sorted((r.account, r.why) for r in paging.quota_sample(people, seed, {"a": 5, "b": 30}, 30, [59, 0]).collect())
    assert take("s") == take("s") != take("t")
    why = [w for _, w in take("s")]
    assert why.count("quota") == 25 and why.count("fill") == 5 and {59, 0} <= {a for a, _ in take("s")}


def test_epoch_gate_reasons(spark):
    required = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "engine string, chain long")
    cursors = spark.createDataFrame([("a", 1, 3), ("b", 2, 3), ("d", 2, 0)], "engine string, chain long, acked long")
    epochs = spark.createDataFrame([(1, 3), (2, 1)], "chain long, epoch long")
    assert {r.engine: r.reason for r in gates.epoch_gate(required, cursors, epochs).collect()} == {"a": "ok", "b": "wrong_chain", "c": "no_cursor", "d": "unacknowledged"}


def test_composition_names_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3)], "asset long, base long")
    assert {r.asset: (r.root, r.steps) for r in reconcile.composition(links).collect()} == {1: (3, 2), 2: (3, 1)}
    ring = links.union(spark.createDataFrame([(3, 1), (9, 1), (7, 7), (5, 6)], links.schema))
    assert {r.asset: (r.root, r.steps, r.cyclic) for r in reconcile.composition(ring).collect()} == dict.fromkeys((1, 2, 3, 7, 9), (None, None, True)) | {5: (6, 1, False)}
    with pytest.raises(ValueError, match="two bases"):
        reconcile.composition(links.union(spark.createDataFrame([(1, 3)], links.schema)))
    assert reconcile.composition(links.limit(0)).count() == 0


def test_long_compositions_double(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(reconcile, "written", lambda df, name, f=reconcile.written: rounds.append(1) or f(df, name))
    links = spark.range(1000).select(F.col("id").alias("asset"), (F.col("id") + 1).alias("base"))
    assert {(r.asset, r.root, r.steps) for r in reconcile.composition(links).collect()} == {(i, 1000, 1000 - i) for i in range(1000)}
    assert len(rounds) <= 12  # the links, ten doublings, and one that finds no more


def test_report_counts_and_shows_violations(spark):
    bad = spark.range(7).toDF("k")
    rows = {r.check_name: r for r in reconcile.integrity_report({"none": bad.limit(0), "seven": bad}, 2).collect()}
    assert rows["none"].violations == 0 and rows["seven"].violations == 7 and len(rows["seven"].details.split("\n")) == 2


def test_digests_tell_rows_apart(spark):
    schema = "k long, a string, b string"
    of = lambda rows: {r.k: (r.digest, r.n) for r in aggregates.digest(spark.createDataFrame(rows, schema).repartition(3), ["a", "b"], ["k"]).collect()}
    one = of([(1, "x|y", "z"), (2, "x", "y|z"), (3, None, "z"), (4, "~", "z"), (5, "x", None), (6, "x", ""), (7, "a", "b"), (7, "a", "b"), (8, "a", "b")])
    assert len({d for d, _ in one.values()}) == 8 and one[7][1] == 2
    rows = [(1, str(i), None) for i in range(300)]
    assert of(rows) == of(rows[::-1]) != of(rows[1:])
