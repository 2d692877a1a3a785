"""What one task holds does not grow with the tables."""

from pyspark.sql import functions as F

from tidebook.plans import bindings
from tidebook.plans.bindings import Views


def test_position_events_are_dealt_over_tasks_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(bindings, "MOST_ROWS", 500)
    events = Views(spark, sf).position_events
    sizes = [r["count"] for r in events.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 1500
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [l_orderkey") == 1


def test_repeated_orders_make_places_of_their_own(spark, sf, tmp_path):
    for name in ("lineitem", "orders"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        (rows.union(rows.limit(100)) if name == "orders" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    events = Views(spark, str(tmp_path)).position_events
    assert events.count() > spark.read.parquet(f"{sf}/lineitem.parquet").count()
    places = events.groupBy("tx", "log_index").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("d"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    assert places.where("n <> d or low <> 0 or high <> n - 1").isEmpty()


def test_wide_quotients_use_no_decimals(spark):
    from tidebook.functions import exact as X

    rows = spark.sql("select * from values (5L, 3L), (-5L, 3L), (7L, 0L), (null, 2L), (123456789012L, 987654321L) as t(a, b)")
    got = rows.select("a", "b", X.ray_div_half_up(F.col("a"), F.col("b")).alias("near"), X.percent_mul_floor(F.col("a"), F.col("b")).alias("part"))
    assert "decimal(38" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        known = r.a is not None and r.b
        assert r.near == (str((r.a * 10**27 + r.b // 2) // r.b) if known else None)
        assert r.part == (None if r.a is None else str(r.a * r.b // 10_000))


def test_paths_are_not_sent_to_the_driver(spark, monkeypatch):
    from tidebook.operators import reconcile as R

    plans, write = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    links = spark.range(1, 200).select(F.col("id").alias("asset"), (F.col("id") - 1).alias("base"))
    got = {r.asset: (r.root, r.steps) for r in R.composition(links).collect()}
    assert got == {i: (0, i) for i in range(1, 200)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_wide_sums_are_folded_over_sorted_rows(spark):
    """Also over a join by the group, whose rows adaptive execution deals anew."""
    from tidebook.functions import wide as W

    rows = spark.range(3000).select((F.col("id") % 7).alias("account"), F.concat((F.col("id") - 1500).cast("string"), F.lit("0" * 170)).alias("x"), F.when(F.col("id") % 7 == 3, (F.col("id") % 5).cast("int")).alias("flaw"))
    names = spark.range(6).select(F.col("id").alias("account"), F.lit("2").alias("y"))
    got = W.folded(rows.join(names, "account"), ["account"], ["x", "y"], lambda x, y: (x * y, None), 2, "flaw").collect()
    want = {a: sum((i - 1500) * 2 * 10**170 for i in range(3000) if i % 7 == a) for a in range(6)}
    assert {r.account: (r.flaw, r._sums) for r in got} == {a: (0 if a == 3 else None, [str(s), None]) for a, s in want.items()} and len(got) == 6


def test_a_leg_is_valued_once_for_all_grid_points(spark):
    from tidebook.operators import stress

    ray = "1" + "0" * 27
    legs = spark.createDataFrame([(1, 7, "10", ray, "100", 5000, 6000), (2, 7, "10", ray, "1", 5000, 6000)], "account long, asset long, amount string, index string, price string, ltv long, threshold long")
    debts = spark.createDataFrame([(1, "pool", "300"), (2, "pool", "6"), (3, "pool", "5"), (4, "pool", None)], "account long, engine string, debt string")
    grid = spark.createDataFrame([(0, 100), (1, 50)], "grid long, percent long")
    out = stress.wide_waterfall(legs, debts, grid, 1)
    got = [tuple(r) for r in out.orderBy("grid").select("grid", "newly", "cumulative", "refused", "debt_eligible").collect()]
    # the second account's price falls to 0 at the second point, which refuses it, but it stays held
    assert got == [(0, 2, 2, 1, "11"), (1, 1, 3, 2, "311")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_ratio_order_of_a_table_is_that_of_its_terms(spark):
    from tidebook.functions import wide as W

    big = 10**60
    terms = [(big + 1, 3, big, 3), (big, 3, big + 1, 3), (-big, 7, -big - 1, 7), (big * 2, 4, big, 2), (9 * 10**40, 1, 8, 10**30), (0, 1, -5, 2), (5, 0, 6, 0), (1, 2, None, 3), (1, -2, 1, 3), (10**18 - 1, 10**18, 10**17, 10**17)]
    rows = spark.createDataFrame([[None if x is None else str(x) for x in t] for t in terms], "a string, b string, c string, d string")
    out = W.with_ratio_order(rows, "r", *map(F.col, "abcd"))
    want = [1, -1, 1, 0, 1, 1, 0, None, None, -1]
    assert [r.r for r in out.collect()] == want == [r.r for r in rows.select(W.compare_ratios(*map(F.col, "abcd")).alias("r")).collect()]
    assert "decimal" not in out._jdf.queryExecution().optimizedPlan().toString() and out.columns == ["a", "b", "c", "d", "r"]


def exchanges(df) -> list[str]:
    """Lines of a plan, not yet run, that exchange rows by a key."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_new_rows_are_exchanged_once_over_the_tasks_asked_for(spark):
    from tidebook.sources import tables as T

    rows = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"))
    got = T.new_rows(rows.union(rows), rows.where("a < 400"), ["a", "b"], 7)
    assert sorted(r.a for r in got.collect()) == list(range(400, 1000))
    found = exchanges(T.new_rows(rows.union(rows), rows.where("a < 400"), ["a", "b"], 7))
    assert len(found) == 2 and all(", 7), REPARTITION_BY_NUM" in x for x in found)


def test_orphans_of_parents_that_hardly_repeat_need_no_aggregation(spark):
    from tidebook.operators import joins

    rows, parents = spark.range(20).withColumn("x", F.col("id") * 2), spark.createDataFrame([(3,), (3,), (7,), (None,)], "id long")
    got = joins.orphans(rows, parents, ["id"], unique=True)
    assert sorted(r.id for r in got.collect()) == [i for i in range(20) if i not in (3, 7)]
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_windows_are_exchanged_once_over_the_tasks_asked_for(spark, sf):
    from tidebook.operators import joins, reconcile

    events = spark.createDataFrame([("pool", 1, 2, "debt", 7, b, 0, 0, 5 - b, "repay") for b in range(9)], "engine string, account long, asset long, side string, tx long, block long, log_index long, seq long, delta long, event_type string")
    history = spark.createDataFrame([(2, 3, 0, 11), (2, 5, 0, None)], "asset long, block long, log_index long, bonus long")
    facts = reconcile.liquidation_facts(events, 7)
    assert [(r.earlier, r.after) for r in facts.orderBy("block").collect()] == [(b, sum(5 - x for x in range(b + 1))) for b in range(9)]
    bonus = joins.as_of(events, history, ["asset"], "bonus", ["block", "log_index"], 7)
    assert [r.bonus for r in bonus.orderBy("block").collect()] == [None] * 3 + [11] * 6
    for df in (reconcile.liquidation_facts(events, 7), joins.as_of(events, history, ["asset"], "bonus", ["block", "log_index"], 7)):
        assert [", 7), REPARTITION_BY_NUM" in x for x in exchanges(df)] == [True]


def test_sweeps_and_balances_share_their_legs(spark, sf, monkeypatch):
    from tidebook.plans.catalog import QUERIES

    monkeypatch.setattr(bindings, "MOST_ROWS", 500)
    tasks = Views(spark, sf).tasks
    swept = QUERIES["a7_swept_balances"](spark, sf)
    # the amounts of an account are collected where its legs were dealt to
    assert tasks > 8 and len([x for x in exchanges(swept) if "(account#" in x and f", {tasks}), REPARTITION_BY_NUM" in x]) >= 2
    swept.collect()
    assert "ReusedExchange" in swept._jdf.queryExecution().executedPlan().toString()
