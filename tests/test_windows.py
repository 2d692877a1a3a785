import re

import pytest
from pyspark.sql import functions as F

from tidebook.sources import tables as T
from tidebook.sources import windows as W
from tidebook.sources.shared import children

LOG = "chain string, block long, log_index long, address string, amount long"
EVENTS = "tx long, log_index long, seq long, account long, asset long, side string, block long, delta long"
RATES = "asset long, kind string, block long, value long"


def logs(spark, blocks, amount=1, chain="c"):
    return spark.createDataFrame([(chain, b, i, f"a{b % 3}", amount * b) for b in blocks for i in range(2)], LOG)


def test_appends_read_only_the_buckets_of_their_batch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    assert W.append_log(logs(spark, range(0, 1000, 7)), path, span=100) == 286
    assert W.append_log(logs(spark, range(0, 1000, 7)), path, span=100) == 0
    seen = []
    monkeypatch.setattr(W, "_in_buckets", lambda rows, f=W._in_buckets: seen.append(f(rows)) or seen[-1])
    assert W.append_log(logs(spark, [704, 711, 712]).unionByName(logs(spark, [712])), path, span=100) == 6
    files = spark.read.parquet(path).where(seen[0])
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((chain" in plan.replace("isnotnull(chain", "((chain") and {f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(path).where(seen[0]).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {"7"}
    for bad in (logs(spark, [0], 1).withColumn("amount", F.lit(5).cast("long")), logs(spark, [5000]).unionByName(logs(spark, [5000], 2))):
        with pytest.raises(T.Divergence):
            W.append_log(bad, path, span=100)
    assert spark.read.parquet(path).count() == 292
    monkeypatch.setattr(W, "NAMED_BUCKETS", 2)  # ranges of buckets instead of their names
    assert W.append_log(logs(spark, range(0, 1001, 7)), path, span=100) == 0 and W.append_log(logs(spark, [3, 500, 990], chain="d"), path, span=100) == 6


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "ledger"), []
    monkeypatch.setattr(W, "_in_buckets", lambda rows, f=W._in_buckets: asked.append(rows.columns) or f(rows))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50000")
    try:
        rows = spark.range(20_000).select(F.lit("c").alias("chain"), (F.col("id") % 90).alias("block"), F.col("id").alias("log_index"), F.sha2(F.col("id").cast("string"), 256).alias("address"), F.col("id").alias("amount"))
        assert W.append_log(rows, path, 100, 8) == 20_000 and W.append_log(rows, path, 100, 8) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in children(spark, f"{path}/chain=c/bucket=0") if f.endswith(".parquet")]
    assert len(files) > 2 and spark.read.parquet(path).distinct().count() == 20_000
    assert asked == [["chain", "bucket"]]  # so a batch's other columns are not computed for it


def test_scans_prune_by_block(spark, tmp_path):
    path = str(tmp_path / "ledger")
    W.append_log(logs(spark, range(300)).unionByName(logs(spark, range(300), chain="d")), path, span=50)
    addresses = spark.createDataFrame([("a0",), ("a2",), ("a0",)], "x string")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = W.scan_log(spark, path, addresses, 60, 130, chain="c", span=50)
    assert [tuple(r) for r in rows.select("block", "log_index").collect()] == [(b, i) for b in range(60, 131) if b % 3 != 1 for i in range(2)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert re.search(r"bucket#\d+L? >= 1.*bucket#\d+L? <= 2", pruned[1]) and "= c)" in pruned[1] and "GreaterThanOrEqual(block,60)" in pruned[2]
    assert W.scan_log(spark, path, addresses, 60, 130, span=50).count() == 2 * rows.count()
    assert W.append_log(logs(spark, []), path, span=50) == 0


def window(spark, low, high, factor=1):
    e = spark.createDataFrame([(b, 0, 0, b % 4, b % 3, "debt", b, factor * (b % 7 - 3) if b % 5 else None) for b in range(low + 1, high + 1)], EVENTS)
    return e, spark.createDataFrame([(1, "debt", b, 10 + b) for b in range(low + 1, high + 1)], RATES)


def balances(spark, folder, engine="pool"):
    return {(r.account, r.asset): (r.amount, r.updated_block) for r in W.balances_of(spark, folder, engine).collect()}


def plain(high):
    out = {}
    for b in range(1, high + 1):
        if b % 5:
            amount, _ = out.get((b % 4, b % 3), (0, 0))
            out[b % 4, b % 3] = amount + b % 7 - 3, b
    return out


def test_windows_replay_and_diverge(spark, tmp_path):
    folder = str(tmp_path)
    for i in range(5):  # records 2 and 4 are compacted
        assert W.apply_window(folder, "pool", *window(spark, 20 * i, 20 * i + 20), 20 * i, 20 * i + 20, covered_from=3 - min(i, 2), compact=2)
        assert balances(spark, folder) == plain(20 * i + 20)
    assert not W.apply_window(folder, "pool", *window(spark, 20, 40), 20, 40)  # a replay
    assert not W.apply_window(folder, "pool", *window(spark, 10, 50), 10, 50)  # over parts of windows
    assert balances(spark, folder) == plain(100) and [tuple(r) for r in W.cursors(spark, folder).collect()] == [("pool", 5, 100, 1)]
    for bad in (window(spark, 20, 40, 2), (window(spark, 20, 40)[0], window(spark, 20, 40)[1].withColumn("value", F.lit(0).cast("long"))), (window(spark, 20, 39)[0], window(spark, 20, 40)[1])):
        with pytest.raises(T.Divergence):
            W.apply_window(folder, "pool", *bad, 20, 40)
    with pytest.raises(ValueError, match="cursor"):
        W.apply_window(folder, "pool", *window(spark, 110, 120), 110, 120)
    with pytest.raises(ValueError, match="outside"):
        W.apply_window(folder, "pool", *window(spark, 99, 120), 100, 120)
    assert W.apply_window(folder, "debt", *window(spark, 0, 5), 0, 5) and balances(spark, folder) == plain(100) and balances(spark, folder, "debt") == plain(5)
    assert W.events_of(spark, folder, "pool", EVENTS).count() == 100 and W.leftovers(spark, folder) == []
    empty = [x.limit(0) for x in window(spark, 0, 1)]
    assert W.apply_window(folder, "pool", *empty, 100, 130) and balances(spark, folder) == plain(100)


@pytest.mark.parametrize("at", ["rates", "balances", "record"])
def test_a_killed_run_leaves_readers_where_they_were(spark, tmp_path, monkeypatch, at):
    folder = str(tmp_path)
    W.apply_window(folder, "pool", *window(spark, 0, 20), 0, 20)
    events, rates = window(spark, 20, 40)
    with monkeypatch.context() as m, pytest.raises(Exception, match="killed"):
        if at == "record":
            m.setattr(W, "_write_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        broken = F.raise_error(F.lit("killed"))
        if at == "rates":
            rates = rates.withColumn("value", F.when(F.col("value") > 0, broken).cast("long"))
        if at == "balances":
            events = events.withColumn("delta", F.col("delta") * 2**62)  # its sum overflows
            try:
                W.apply_window(folder, "pool", events, rates, 20, 40)
            except Exception as e:
                raise RuntimeError("killed") from e
        W.apply_window(folder, "pool", events, rates, 20, 40)
    assert balances(spark, folder) == plain(20) and W.events_of(spark, folder, "pool", EVENTS).count() == 20
    assert W.leftovers(spark, folder)
    assert W.apply_window(folder, "pool", *window(spark, 20, 40), 20, 40) and balances(spark, folder) == plain(40)


def test_retention_keeps_the_newest_batches(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    batches = [T.write_batch(folder, f"k{i}", {"a": spark.range(i + 1), "b": spark.range(2)}, keep=3) for i in range(6)]
    kept = {r.batch for r in T.manifests(spark, folder).collect()}
    assert kept == set(batches[3:]) and T.manifests(spark, folder, 1).first().batch == batches[5]
    for table in ("a", "b"):
        assert children(spark, f"{folder}/{table}") == sorted(f"batch={b}" for b in batches[3:])
    with pytest.raises(ValueError):
        T.write_batch(folder, "k", {"a": spark.range(1)}, keep=0)
    monkeypatch.setattr(T, "removed", lambda *_: None)  # a run that ends after its tombstones
    T.write_batch(folder, "k6", {"a": spark.range(1), "b": spark.range(1)}, keep=3)
    assert batches[3] not in {r.batch for r in T.manifests(spark, folder).collect()} and f"batch={batches[3]}" in children(spark, f"{folder}/a")
    monkeypatch.undo()
    assert T.pruned(spark, folder, 3) == 0 and f"batch={batches[3]}" not in children(spark, f"{folder}/a")
    assert T.write_batch(folder, "k3", {"a": spark.range(1)}, keep=3) not in batches  # the key of a removed batch is free


def test_a_replay_is_compared_in_one_pass_with_repeats(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, 5)], "a long, b long")
    assert not W._differ(rows, rows.orderBy(F.desc("a")))
    assert W._differ(rows, rows.distinct()) and W._differ(rows.distinct(), rows) and W._differ(rows, rows.limit(0))


def test_a_window_is_applied_from_its_own_folder(spark, sf, monkeypatch):
    from tidebook.plans.bindings import Views
    from tidebook.plans.catalog_more import windows_applied

    plans = []
    apply = lambda folder, engine, events, rates, *rest, **named: plans.append(events._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(W, "apply_window", apply)
    windows_applied(Views(spark, sf))
    assert len(plans) == 8 and all("PartitionFilters: [isnotnull(_window" in p and "Exchange" not in p for p in plans)
