import random
import time

from tidebook.sources.shared import children
from tidebook.streaming import jobs as M
from tidebook.streaming import ordered as O

SCHEMA = "account long, asset long, block long, log_index long, seq long, event_type string, delta long"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(3), rng.randrange(2), b, i, 0, *rng.choice([("record", None), ("borrow", rng.randint(1, 9)), ("repay", -rng.randint(1, 9))])) for b in range(n) for i in range(2)]


def put(spark, folder, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, delay=20):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    O.ordered_fold_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), delay)
    return sorted(map(tuple, O.folded(spark, str(tmp_path / "out")).collect()))


def plain(spark, some):
    return sorted(map(tuple, M.write_off_fold(spark.createDataFrame(some, SCHEMA)).collect()))


def test_rows_out_of_order_and_a_restart(spark, tmp_path):
    data = rows(60)
    rng = random.Random(2)
    late = sorted(data, key=lambda r: r[2] + rng.randint(0, 15))  # up to 15 blocks late, over several micro-batches
    cuts = [late[i : i + 30] for i in range(0, 90, 30)]
    for part in cuts:
        put(spark, str(tmp_path / "in"), part)
    first = run(spark, tmp_path)
    high = max(r[2] for part in cuts for r in part) - 20
    assert first == [r for r in plain(spark, data) if r[2] <= high] and first
    assert run(spark, tmp_path) == first  # a restart without new files
    put(spark, str(tmp_path / "in"), late[90:] + late[80:90])  # ten rows again
    put(spark, str(tmp_path / "in"), [(-1, -1, 10_000, 0, 0, O.HEARTBEAT, None)])
    assert run(spark, tmp_path) == plain(spark, data)


def test_a_rewind_discards_what_waits(spark, tmp_path):
    data = [r for r in rows(40, 3) if r[:2] == (0, 0)]
    put(spark, str(tmp_path / "in"), data)
    put(spark, str(tmp_path / "in"), [(0, 0, 25, 0, 0, O.DISCARD, None)])
    again = [(0, 0, b, 7, 0, "borrow", 100) for b in (26, 30)]
    put(spark, str(tmp_path / "in"), again)
    put(spark, str(tmp_path / "in"), [(-1, -1, 10_000, 0, 0, O.HEARTBEAT, None)])
    assert run(spark, tmp_path, delay=100) == plain(spark, [r for r in data if r[2] <= 25] + again)


def test_balances_over_many_small_batches(spark, tmp_path, monkeypatch):
    """Balances are compacted on the way, and what older states need alone is removed."""
    monkeypatch.setattr(O, "COMPACT", 3)
    data = rows(24, 4)
    for i in range(0, len(data), 8):
        put(spark, str(tmp_path / "in"), data[i : i + 8])
        run(spark, tmp_path, delay=3)
    put(spark, str(tmp_path / "in"), [(-1, -1, 10_000, 0, 0, O.HEARTBEAT, None)])
    assert run(spark, tmp_path, delay=3) == plain(spark, data)
    assert children(spark, str(tmp_path / "out" / "state" / "waiting")) == ["batch=5", "batch=6"]
    assert len(children(spark, str(tmp_path / "out" / "state" / "balances"))) <= 4


def test_work_does_not_grow_with_calls_per_account(spark, tmp_path):
    """Fifty thousand accounts: state by account took a call into Python for each, some minutes here."""
    spark.range(50_000).selectExpr("id as account", "0L as asset", "1L as block", "0L as log_index", "0L as seq", "'borrow' as event_type", "id as delta").coalesce(1).write.parquet(str(tmp_path / "in"))
    put(spark, str(tmp_path / "in"), [(-1, -1, 10_000, 0, 0, O.HEARTBEAT, None)])
    began = time.monotonic()
    assert len(run(spark, tmp_path)) == 50_000
    assert time.monotonic() - began < 60
