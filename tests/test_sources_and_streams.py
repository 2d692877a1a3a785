import duckdb
import pytest
from pyspark.sql import functions as F

from tidebook.operators import gates, joins, ledger
from tidebook.plans.bindings import Views
from tidebook.plans.catalog import ORACLES, QUERIES
from tidebook.plans.catalog_flows import kinds, raw_logs
from tidebook.sources import events as E
from tidebook.sources import tables as T
from tidebook.sources.shared import children
from tidebook.streaming import jobs as M

KEY = ["tx", "log_index", "seq"]


@pytest.fixture(scope="module")
def views(spark, sf):
    return Views(spark, sf)


def same(a, b):
    return sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect()))


def test_replay_is_a_no_op_and_divergence_an_error(spark, views, tmp_path):
    rows = views.position_events.filter("block < 600").select(*KEY, "account", "amount")
    path = str(tmp_path / "log")
    assert T.append(rows, path, KEY) == rows.count()
    assert T.append(rows.union(rows), path, KEY) == 0
    assert T.append(rows.limit(0), path, KEY) == 0
    with pytest.raises(T.Divergence):
        T.append(rows.withColumn("amount", F.col("amount") + 1), path, KEY)
    with pytest.raises(T.Divergence):
        T.append(rows.filter("tx < 0").union(spark.createDataFrame([(-1, 0, 0, 1, 1), (-1, 0, 0, 1, 2)], rows.schema)), path, KEY)
    assert spark.read.parquet(path).count() == rows.count()


def test_null_content_diverges_from_a_value(spark, tmp_path):
    schema = "tx long, log_index long, seq long, amount long"
    path = str(tmp_path / "log")
    T.append(spark.createDataFrame([(1, 1, 0, None)], schema), path, KEY)
    with pytest.raises(T.Divergence):
        T.append(spark.createDataFrame([(1, 1, 0, 0)], schema), path, KEY)


def test_balances_do_not_depend_on_order_or_rewinds(views):
    events = views.position_events
    assert same(ledger.balance_fold(events.orderBy(F.rand(3))), ledger.balance_fold(events))
    rebuilt = ledger.rewound(events, 10_000)
    alive = events.filter("side = 'debt' and delta is not null").select("engine", "account").distinct()
    assert same(rebuilt, ledger.balance_fold(events).join(alive, ["engine", "account"], "left_semi"))


def test_checks_find_what_is_broken(spark, views):
    fold = ledger.balance_fold(views.position_events)
    assert joins.mismatches(fold, fold, list(ledger.KEY)).isEmpty()
    broken = fold.withColumn("amount", F.when(F.col("account") == 5, None).otherwise(F.col("amount")))
    assert joins.mismatches(fold, broken, list(ledger.KEY)).count() == fold.filter("account = 5").count() > 0
    calm = spark.createDataFrame([("e", 1, "s", "event", 1, 2)], "engine string, account long, side string, source string, amount long, asset long")
    assert gates.source_conflicts(calm).isEmpty()
    assert gates.source_conflicts(calm.union(calm.withColumn("source", F.lit("snapshot")))).count() == 1


def test_batches_are_adopted_and_read_by_manifest(spark, views, tmp_path):
    folder = str(tmp_path / "batches")
    rows = views.legs.limit(20)
    assert T.manifests(spark, folder).count() == 0
    first = T.write_batch(folder, "a", {"legs": rows})
    assert T.write_batch(folder, "a", {"legs": rows.limit(1)}) == first
    second = T.write_batch(folder, "b", {"legs": rows.limit(3)})
    newest = T.manifests(spark, folder, 1).first()
    assert newest.batch == second and newest.counts == {"legs": 3}
    assert T.batch_rows(spark, folder, "legs", first, rows.schema).count() == 20


def test_stream_of_splits_equals_the_batch(spark, views, tmp_path):
    rows = views.position_events.select(*KEY, "account", "asset", "block", "delta", "event_type")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(5).write.parquet(source)
    rows.filter("block % 2 = 0").coalesce(1).write.mode("append").parquet(source)  # a late replay
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    M.append_stream(stream, target, KEY, str(tmp_path / "c1")).awaitTermination()
    assert same(spark.read.parquet(target), rows.dropDuplicates())
    # restarting with the same checkpoint finds nothing new
    M.append_stream(spark.readStream.schema(rows.schema).parquet(source), target, KEY, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(target).count() == rows.dropDuplicates().count()
    with pytest.raises(Exception, match="acknowledged"):
        M.append_stream(stream, target, KEY, str(tmp_path / "c2"), gate=lambda: False).awaitTermination()


def test_upserts_keep_the_newest(spark, tmp_path):
    schema = "k long, version long, value string"
    source = str(tmp_path / "in")
    for part in ([(1, 1, "a"), (2, 5, "b")], [(1, 3, "c"), (2, 4, "old")], [(3, 1, "d"), (1, 3, "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = str(tmp_path / "t")
    assert M.upserted(spark, table, schema).isEmpty()
    M.upsert_stream(stream, table, ["k"], "version", str(tmp_path / "c"), buckets=4).awaitTermination()
    want = [(1, 3, "c"), (2, 5, "b"), (3, 1, "d")]
    assert sorted(map(tuple, M.upserted(spark, table, schema).collect())) == want
    # a restart goes on; another checkpoint on the same table is refused and changes nothing
    spark.createDataFrame([(2, 9, "new")], schema).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="another checkpoint"):
        M.upsert_stream(stream, table, ["k"], "version", str(tmp_path / "c2"), buckets=4).awaitTermination()
    assert sorted(map(tuple, M.upserted(spark, table, schema).collect())) == want
    M.upsert_stream(stream, table, ["k"], "version", str(tmp_path / "c"), buckets=4).awaitTermination()
    assert sorted(map(tuple, M.upserted(spark, table, schema).collect())) == [(1, 3, "c"), (2, 9, "new"), (3, 1, "d")]
    for i in range(4):  # what older states alone need goes
        spark.createDataFrame([(2, 10 + i, "x"), (4 + i, 1, "y")], schema).coalesce(1).write.mode("append").parquet(source)
    M.upsert_stream(stream, table, ["k"], "version", str(tmp_path / "c"), buckets=4).awaitTermination()
    assert {r.k: r.value for r in M.upserted(spark, table, schema).collect()} == {1: "c", 2: "x", 3: "d"} | dict.fromkeys(range(4, 8), "y")
    lying = [b for d in children(spark, f"{table}/data") for b in children(spark, f"{table}/data/{d}") if b.startswith("_bucket")]
    assert len(lying) <= 2 * 4 and len([x for x in children(spark, f"{table}/manifest") if x.startswith("batch")]) == 2


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "t")
    rows = spark.range(200_000).select((F.col("id") % 100_000).alias("k"), F.col("id").alias("version"))
    rows.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    M.upsert_stream(stream, table, ["k"], "version", str(tmp_path / "c"), buckets=1).awaitTermination()
    assert same(M.upserted(spark, table, rows.schema), rows.where("version >= 100000"))
    assert len([f for f in children(spark, f"{table}/data/batch=1/_bucket=0") if f.endswith(".parquet")]) > 1
    assert spark.conf.get("spark.sql.shuffle.partitions") == usual


def test_an_unacknowledged_rewind_closes_the_gate(spark, tmp_path):
    control, source, target = (str(tmp_path / x) for x in ("control", "in", "out"))
    rows = spark.createDataFrame([(1, 5)], "k long, block long")
    rows.write.parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source)
    run = lambda: M.append_stream(stream(), target, ["k"], str(tmp_path / "c"), gate=M.rewind_gate(spark, control)).awaitTermination()
    spark.createDataFrame([("pool", 3, 4)], "engine string, epoch long, target long").write.parquet(f"{control}/epochs")
    spark.createDataFrame([("pool", 2)], "engine string, acked long").write.parquet(f"{control}/acks")
    with pytest.raises(Exception, match="acknowledged"):
        run()
    spark.createDataFrame([("pool", 3)], "engine string, acked long").write.mode("append").parquet(f"{control}/acks")
    run()
    assert spark.read.parquet(target).count() == 1


def test_write_off_takes_the_balance_of_its_moment(spark):
    rows = [(1, 1, 1, 1, 0, "borrow", 10), (1, 1, 2, 1, 0, "record", None), (1, 1, 3, 1, 0, "borrow", 4), (1, 1, 3, 2, 0, "repay", -1), (1, 1, 9, 1, 0, "record", None)]
    df = spark.createDataFrame(rows, "account long, asset long, block long, log_index long, seq long, event_type string, delta long")
    got = [(r.moved, r.balance) for r in M.write_off_fold(df).orderBy("block", "log_index").collect()]
    assert got == [(10, 10), (-10, 0), (4, 4), (-1, 3), (-3, 0)]


# ---- words of logs


def word(n):
    return (n % (1 << 256)).to_bytes(32, "big")


def test_words_of_any_size(spark):
    values = [0, 1, 10**18, (1 << 120) - 1, 1 << 120, (1 << 256) - 1, -1, -(1 << 100), -(1 << 255)]
    df = spark.createDataFrame([(bytearray(word(v)), str(v)) for v in values], "w binary, v string")
    for r in df.select("v", E.as_integer(F.col("w")).alias("u"), E.as_integer(F.col("w"), True).alias("s")).collect():
        v = int(r.v)
        assert int(r.u) == v % (1 << 256)
        assert int(r.s) == (v if v < 1 << 255 else v - (1 << 256))


@pytest.mark.parametrize("read,bad", [(E.as_address, 1 << 160), (E.as_bool, 2)])
def test_dirty_words_are_errors(spark, read, bad):
    df = spark.createDataFrame([(bytearray(word(bad)),)], "w binary")
    with pytest.raises(Exception):
        df.select(read(F.col("w"))).collect()


def test_captured_shape_of_a_borrow(spark):
    """Fields in topics and data are told apart, and a wrong length is an error."""
    topic = bytearray(b"t" * 32)
    address = [0x1000 + i for i in range(3)]
    log = lambda data: [("pool", 1, 1, 1, [topic, bytearray(word(address[0])), bytearray(word(address[1])), bytearray(word(0))], bytearray(data))]
    schema = "engine string, block long, tx long, log_index long, topics array<binary>, data binary"
    registry = spark.createDataFrame([("pool", topic, "pool.borrow")], "engine string, topic0 binary, kind string")
    good = word(address[2]) + word(2_000_000_000) + word(2) + word(3 * 10**25)
    fields = E.typed_events(spark.createDataFrame(log(good), schema), registry).first().fields
    assert fields["amount"] == "2000000000" and fields["borrow_rate"] == str(3 * 10**25) and fields["user"].endswith("1002") and fields["on_behalf_of"].endswith("1001")
    with pytest.raises(Exception, match="another length"):
        E.typed_events(spark.createDataFrame(log(good + word(1)), schema), registry).collect()
    other = spark.createDataFrame([("debt", topic, "x")], registry.schema)
    assert E.routed(spark.createDataFrame(log(good), schema), other).isEmpty()
    with pytest.raises(Exception, match="unknown topic"):
        E.routed(spark.createDataFrame(log(good), schema), other, strict=True).collect()


def test_registry_files(spark, tmp_path):
    (tmp_path / "feeds.json").write_text('{"assets": [{"chain": "c", "engine": "pool", "address": "0xAB", "symbol": "S", "decimals": 6, "roles": ["debt", "collateral"], "oracle": {"kind": "feed", "heartbeatSeconds": 3600, "graceSeconds": 60}}]}')
    rows = T.registry(spark, str(tmp_path / "feeds.json")).collect()
    assert [(r.address, r.role, r.heartbeat) for r in rows] == [("0xab", "debt", 3600), ("0xab", "collateral", 3600)]


def other_tables(spark, tmp_path, sf, **changed):
    """The small tables, some of them changed; their folder."""
    for name in ("customer", "part", "orders", "lineitem", "events"):
        changed.get(name, spark.read.parquet(f"{sf}/{name}.parquet")).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def equals_sql(spark, folder, name):
    """A query gives what its SQL does on the Parquet folders of a place."""
    db = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, folder)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    return sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_newest_version_is_not_the_highest_block(spark, sf, tmp_path):
    """Order keys beyond a million outweigh blocks in a4's version; one account has all orders here."""
    key = lambda c: F.col(c) * 1009
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderkey", key("o_orderkey")).withColumn("o_custkey", F.col("o_custkey") % 2)
    items = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_orderkey", key("l_orderkey"))
    folder = other_tables(spark, tmp_path, sf, orders=orders.withColumn("o_orderkey", F.col("o_orderkey") % 5 * 100_000_000 + F.col("o_orderkey")), lineitem=items.withColumn("l_orderkey", F.col("l_orderkey") % 5 * 100_000_000 + F.col("l_orderkey")))
    assert equals_sql(spark, folder, "a4_newest_wins")


@pytest.mark.parametrize("name", ["b4_typed_events", "b7_feed_events"])
def test_answers_of_zero(spark, sf, tmp_path, name):
    """Zero has no sign: its word is all zeros."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events = events.withColumn("value", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))).withColumn("user_id", F.when(F.col("event_id") == 0, 0).otherwise(F.col("user_id")))
    assert equals_sql(spark, other_tables(spark, tmp_path, sf, events=events), name)


def test_logs_are_not_exchanged_by_topic(spark, views):
    """A topic can have most logs: routing them by an exchange gives one task all of them."""
    plan = E.routed(raw_logs(views), kinds(views))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_events_are_not_exchanged_by_engine(spark):
    epochs = spark.range(4).selectExpr("'pool' as engine", "id as epoch", "5L as target")
    acks = spark.range(4).selectExpr("'pool' as engine", "1L as acked")
    out = M.retracted(spark.range(20).selectExpr("'pool' as engine", "id as block"), epochs, acks.limit(1))
    assert sorted(r.block for r in out.collect()) == [0, 1, 2, 3, 4, 5]
    side = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in side
