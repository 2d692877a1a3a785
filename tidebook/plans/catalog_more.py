"""Queries of further scalars, folds and comparisons, and the read shapes of a book."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import exact as X
from tidebook.operators import ledger as L
from tidebook.operators import paging as G
from tidebook.operators import reconcile as R
from tidebook.operators import sequences as S
from tidebook.operators import stress as K
from tidebook.operators import valuation as J
from tidebook.plans.bindings import query
from tidebook.plans.catalog_risk import AFTER, FACTORS, POSITIONS, SHOCKED, after, factors, positions, shocked
from tidebook.sources import events as E
from tidebook.sources import tables as T
from tidebook.sources import windows as W
from tidebook.sources.shared import shared_folder, written


def windows_applied(v: Views) -> str:
    """Every engine's events and rates, applied in three windows of blocks, the second of them twice; the folder.

    Both tables are written once, in folders by engine and window, so that a window is applied by reading its own rows.
    """
    folder = f"{shared_folder(v.spark)}/windows-{uuid.uuid4().hex}"
    low, high = v.position_events.select("block").union(v.rate_indexes.select("block")).agg(F.min("block"), F.max("block")).first()
    cuts = [low - 1, low + (high - low) // 3, low + 2 * (high - low) // 3, high]
    window = F.when(F.col("block") <= cuts[1], 0).when(F.col("block") <= cuts[2], 1).otherwise(2).alias("_window")
    events = written(v.position_events.select("engine", "tx", "log_index", "seq", "account", "asset", "side", "block", "delta", window), "window-events", "engine", "_window")
    rates = written(v.rate_indexes.select("asset", "kind", "block", "value", window), "window-rates", "_window")
    for engine in sorted(r.engine for r in events.select("engine").distinct().collect()):
        for i in (0, 1, 1, 2):
            inside = (F.col("_window") == i) & F.col("block").between(cuts[i] + 1, cuts[i + 1])
            W.apply_window(folder, engine, events.filter(inside & (F.col("engine") == engine)).drop("engine", "_window"), rates.filter(inside).drop("_window"), cuts[i], cuts[i + 1], cuts[i] + 1, compact=2)
    return folder


@query("a3_window_apply", "select engine, account, asset, side, cast(sum(delta) as bigint) as amount, max(block) as updated_block from position_events where delta is not null group by all")
def _(v):
    """Balances as of the last commit of each engine."""
    folder = windows_applied(v)
    one = lambda e: W.balances_of(v.spark, folder, e).withColumn("engine", F.lit(e))
    return functools.reduce(lambda a, b: a.unionByName(b), [one(r.engine) for r in W.cursors(v.spark, folder).collect()])


@query("a3_cursors", """
with b as (select min(block) as low, max(block) as high from (select block from position_events union all select block from rate_indexes))
select engine, 3::bigint as windows, high as through, low as covered_from from (select distinct engine from position_events), b""")
def _(v):
    return W.cursors(v.spark, windows_applied(v))


@query("a9_param_append", "select asset, block, log_index, ltv, threshold, bonus from param_history where block >= 700")
def _(v):
    """What the ledger lacks of all rows, when it has those before block 700."""
    rows = v.param_history
    return T.new_rows(rows, rows.filter("block < 700"), ["asset", "block", "log_index"])


@query("a18_merged_observations", "select distinct asset, source, block, log_index, price from prices")
def _(v):
    rows = v.prices.select("asset", "source", "block", "log_index", "price")
    return T.new_rows(rows.union(rows), rows.limit(0), ["asset", "source", "block", "log_index"])


@query("b3_words", "select event_id, lower(to_hex(event_id + 1)) as first_word, cast(user_id as varchar) as second_word, event_id % 2 = 1 as third_word from events")
def _(v):
    w = lambda c: F.lpad(F.hex(c), 64, "0")
    data = F.unhex(F.concat(w(F.col("event_id") + 1), w(F.col("user_id")), w(F.col("event_id") % 2)))
    d = v.table("events").select("event_id", data.alias("data"))
    first = F.regexp_replace(E.as_address(E.word(F.col("data"), 0)), "^0x0*", "")
    return d.select("event_id", first.alias("first_word"), E.as_integer(E.word(F.col("data"), 1)).alias("second_word"), E.as_bool(E.word(F.col("data"), 2)).alias("third_word"))


@query("c7_share_fold", """
with recursive rate as (select asset, block, max(value) as idx from rate_indexes group by all),
o as (select account, e.asset, e.block, log_index, delta as amount, idx, row_number() over (partition by account, e.asset order by e.block, log_index, seq, delta) as rn from position_events e join rate on rate.asset = e.asset and rate.block = e.block where delta is not null),
r as (select account, asset, block, log_index, amount, rn, case when block < 1200 then (greatest(0, amount) * 1000000 + idx // 2) // idx else (greatest(0, amount) * 1000000 + idx - 1) // idx end as shares, 0::bigint as was from o where rn = 1 union all
  select o.account, o.asset, o.block, o.log_index, o.amount, o.rn,
    case when o.block < 1200 then (greatest(0, r.shares * o.idx // 1000000 + o.amount) * 1000000 + o.idx // 2) // o.idx else (greatest(0, r.shares * o.idx // 1000000 + o.amount) * 1000000 + o.idx - 1) // o.idx end, r.shares
  from r join o on o.account = r.account and o.asset = r.asset and o.rn = r.rn + 1)
select account, asset, block, log_index, amount, shares - was as moved, shares from r""")
def _(v):
    rate = v.rate_indexes.groupBy("asset", "block").agg(F.max("value").alias("index"))
    rows = v.position_events.filter("delta is not null").join(rate, ["asset", "block"])
    return L.share_fold(rows.select("account", "asset", "block", "log_index", "seq", F.col("delta").alias("amount"), "index"), 1200)


@query("d16_scenario_book", f"select scenario, account, engine, debt, collateral, liquidatable from {AFTER} where scenario <> 'par' or engine = 'pool'")
def _(v):
    covered = F.when(F.col("scenario") == "par", F.array(F.lit("pool"))).otherwise(F.array(F.lit("pool"), F.lit("debt")))
    return after(v).filter(F.array_contains(covered, F.col("engine"))).select("scenario", "account", "engine", "debt", "collateral", "liquidatable")


@query("f10_ranked_page", f"select * from (select account, debt, row_number() over (order by debt desc nulls last, account) as place from {POSITIONS}) where place > 40 and place <= 90")
def _(v):
    return G.ranked_page(positions(v).select("account", "debt"), [F.desc_nulls_last("debt"), F.asc("account")], 40, 50)


@query("h4_account_union", "select account from balances where source = 'event' union select account from sweeps where status = 'failed'")
def _(v):
    return v.balances.filter("source = 'event'").select("account").union(v.sweeps.filter("status = 'failed'").select("account")).distinct()


RATED = "(select e.*, idx from position_events e join (select asset, block, max(value) as idx from rate_indexes group by all) using (asset, block))"


def rated(v):
    return v.position_events.join(v.rate_indexes.groupBy("asset", "block").agg(F.max("value").alias("idx")), ["asset", "block"])


@query("i5_live_value", f"""
select tx, log_index, seq, case when block < 1200 then (amount * idx + 500000) // 1000000 else (amount * idx + 999999) // 1000000 end as debt, case when block < 1200 then (amount * idx + 500000) // 1000000 else amount * idx // 1000000 end as collateral from {RATED}""")
def _(v):
    new = F.col("block") >= 1200
    return rated(v).select("tx", "log_index", "seq", X.live_value(F.col("amount"), F.col("idx"), new, True).alias("debt"), X.live_value(F.col("amount"), F.col("idx"), new, False).alias("collateral"))


@query("i12_units", f"select tx, log_index, seq, amount * 1000000 // idx as down, (amount * 1000000 + idx - 1) // idx as up, (amount * 1000000 // idx) * idx // 1000000 as back from {RATED}")
def _(v):
    a, i = F.col("amount"), F.col("idx")
    down = X.to_units(a, i, False)
    return rated(v).select("tx", "log_index", "seq", down.alias("down"), X.to_units(a, i, True).alias("up"), X.from_units(down, i).alias("back"))


@query("i13_age", "select log_index, case when log_index % 7 <> 0 then greatest(0, 1705000000 - as_of) end as age from prices")
def _(v):
    return v.prices.select("log_index", X.age(F.lit(1705000000), F.when(F.col("log_index") % 7 != 0, F.col("as_of"))).alias("age"))


@query("i18_dust", f"select account, coalesce(greatest(debt, collateral) < 10000000, false) as dust from {POSITIONS}")
def _(v):
    return positions(v).select("account", X.is_dust(F.col("debt"), F.col("collateral"), 7).alias("dust"))


@query("i20_source_key", "select c_custkey as account, lower(regexp_extract(c_mktsegment || '(x)', '^([A-Za-z_0-9-]+)', 1)) || ':' || lower(to_hex(c_custkey + 4096)) as key from customer")
def _(v):
    key = X.source_key(F.concat("c_mktsegment", F.lit("(x)")), F.concat(F.lit("0x"), F.hex(F.col("c_custkey") + 4096)))
    return v.table("customer").select(F.col("c_custkey").alias("account"), key.alias("key"))


@query("i26_floored_ratio", f"select account, case when borrow_limit > 0 then cast(debt::hugeint * 10000 // borrow_limit as bigint) end as ratio from {POSITIONS}")
def _(v):
    return positions(v).select("account", X.floored_ratio(F.col("debt"), F.col("borrow_limit"), 10_000).alias("ratio"))


@query("j9_refused_book", """
with r as (select account, case when price < 91000 then 'low_price' when ltv < 55 then 'low_weight' end as code from legs)
select account, engine, case when n > 0 then 'refused' else 'computed' end as status, case when n > 0 then null else debt end as debt from debts left join (select account, count(code) as n from r group by account) using (account)""".replace("case when n > 0 then 'refused' else 'computed' end", "case when coalesce(n, 0) > 0 then 'refused' else 'computed' end").replace("case when n > 0 then null", "case when coalesce(n, 0) > 0 then null"))
def _(v):
    code = F.when(F.col("price") < 91000, "low_price").when(F.col("ltv") < 55, "low_weight")
    bad = v.legs.groupBy("account").agg(F.count(code).alias("n"))
    refused = F.coalesce("n", F.lit(0)) > 0
    return v.debts.join(bad, "account", "left").select("account", "engine", F.when(refused, "refused").otherwise("computed").alias("status"), F.when(~refused, F.col("debt")).alias("debt"))


@query("k16_tornado", f"""
select scenario, engine, case when d > 0 then cast((e - b) * 1000 // d as bigint) end as tenths from (select scenario, engine, sum(case when liquidatable then debt else 0 end) as e from {AFTER} group by all) join (
select engine, sum(case when liquidatable then debt else 0 end) as b, sum(debt) as d from {POSITIONS} group by engine) using (engine) where e >= b""")
def _(v):
    eligible = F.sum(F.when(F.col("liquidatable"), F.col("debt")).otherwise(0))
    a = after(v).groupBy("scenario", "engine").agg(eligible.alias("e"))
    b = positions(v).groupBy("engine").agg(eligible.alias("b"), F.sum("debt").alias("d"))
    return a.join(b, "engine").filter("e >= b").select("scenario", "engine", X.floor_div((F.col("e") - F.col("b")) * 1000, F.col("d")).alias("tenths"))


@query("k21_mover_pairs", f"""
select scenario, account, was, now from (select *, row_number() over (partition by scenario order by was - now desc, account) as rn from (
  select scenario, account, p.collateral as was, a.collateral as now from {POSITIONS} p join {AFTER} a using (account)) where was > now) where rn <= 20""")
def _(v):
    both = positions(v).select("account", F.col("collateral").alias("was")).join(after(v).select("scenario", "account", F.col("collateral").alias("now")), "account").filter("was > now")
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc(F.col("was") - F.col("now")), "account"))
    return both.withColumn("rn", rank).filter("rn <= 20").select("scenario", "account", "was", "now")


@query("k23_audit_lists", f"select distinct scenario, asset, price, shocked::bigint as shocked from {SHOCKED} where not held_flat")
def _(v):
    return shocked(v).filter("not held_flat").dropDuplicates(["scenario", "asset"]).select("scenario", "asset", "price", "shocked")


@query("l5_scaled_identity", f"select tx, log_index, seq, (amount * idx // 1000000) <= amount * idx / 1000000.0 as holds from {RATED} where false union all select tx, log_index, seq, ((amount * 1000000 + idx - 1) // idx) * idx // 1000000 >= amount as holds from {RATED}")
def _(v):
    back = X.from_units(X.to_units(F.col("amount"), F.col("idx"), True), F.col("idx"))
    return rated(v).select("tx", "log_index", "seq", (back >= F.col("amount")).alias("holds"))


@query("l12_registry_gate", """
with newest as (select asset, block, price, dense_rank() over (partition by asset order by block desc) as r from prices where source = 'view' and valid)
select asset, block, price, price % 3 <> 0 as equal from newest where r <= 2""")
def _(v):
    rows = S.newest_groups(v.prices.filter("source = 'view' and valid").select("asset", "block", "price"), ["asset"], "block", 2)
    observed = rows.withColumn("observed", F.when(F.col("price") % 3 != 0, F.col("price")).otherwise(F.col("price") + 1))
    return observed.select("asset", "block", "price", (F.col("price") == F.col("observed")).alias("equal"))


@query("l26_own_clock_limit", """
select account, clock, cast(sum(case when block <= clock then amount * ltv // 100 else 0 end) as bigint) as borrow_limit
from (select account, last_success as clock from sweeps where last_success is not null) join position_events using (account) join (select p_partkey as asset, cast(50 + p_size % 40 as bigint) as ltv from part) using (asset) group by all""")
def _(v):
    clocks = v.sweeps.filter("last_success is not null").select("account", F.col("last_success").alias("clock"))
    weights = v.table("part").select(F.col("p_partkey").alias("asset"), (50 + F.col("p_size") % 40).cast("long").alias("ltv"))
    rows = v.position_events.join(clocks, "account").join(weights, "asset")
    limit = F.when(F.col("block") <= F.col("clock"), X.floor_div(F.col("amount") * F.col("ltv"), F.lit(100))).otherwise(0)
    return rows.groupBy("account", "clock").agg(F.sum(limit).alias("borrow_limit"))


@query("l27_vector_comparison", "select account, count(*) as assets, count(*) filter (asset % 6 <> 0) as equal, cast(sum(case when asset % 6 = 0 then 1 else 0 end) as bigint) as difference from legs group by account")
def _(v):
    other = v.legs.select("account", "asset", (F.col("amount") + F.when(F.col("asset") % 6 == 0, 1).otherwise(0)).alias("observed"))
    both = v.legs.select("account", "asset", "amount").join(other, ["account", "asset"], "full")
    return both.groupBy("account").agg(F.count("*").alias("assets"), F.count_if(F.col("amount").eqNullSafe(F.col("observed"))).alias("equal"), F.sum(F.abs(F.col("observed") - F.col("amount"))).alias("difference"))


@query("l29_masked_pairs", "select account, min(asset) filter (side = 'debt') as masked, arg_min(asset, amount * 1000000 + asset) filter (side = 'collateral') as control from balances group by account having bool_or(side = 'debt') and bool_or(side = 'collateral')")
def _(v):
    debt, held = F.col("side") == "debt", F.col("side") == "collateral"
    rows = v.balances.groupBy("account").agg(F.bool_or(debt).alias("d"), F.bool_or(held).alias("c"), F.min(F.when(debt, F.col("asset"))).alias("masked"), F.min_by("asset", F.when(held, F.col("amount") * 1000000 + F.col("asset"))).alias("control"))
    return rows.filter("d and c").select("account", "masked", "control")


# ---- N1: read shapes


N1_ADDRESS = f"select p.account, engine, debt, collateral, borrow_limit, liquidatable, refusal, coalesce(legs, 0) as legs from {POSITIONS} p left join (select account, count(*) as legs from legs group by account) l using (account)"


@query("n1_address", N1_ADDRESS)
def _(v):
    legs = v.legs.groupBy("account").agg(F.count("*").alias("legs"))
    return positions(v).join(legs, "account", "left").fillna(0, ["legs"])


N1_HISTORY = "select account, block // 100 as batch, cast(sum(delta) as bigint) as moved, count(*) as n from position_events where delta is not null group by all"


@query("n1_history", N1_HISTORY)
def _(v):
    return v.position_events.filter("delta is not null").groupBy("account", F.expr("block div 100").alias("batch")).agg(F.sum("delta").alias("moved"), F.count("*").alias("n"))


@query("n1_scenarios", f"select scenario, string_agg(axis || ':' || num || '/' || den, ',' order by axis) as shocks, count(*) as axes from {FACTORS} group by scenario")
def _(v):
    return factors(v).groupBy("scenario").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("axis"), F.lit(":"), F.col("num"), F.lit("/"), F.col("den")))), ",").alias("shocks"), F.count("*").alias("axes"))


@query("n1_meta", "select (select count(*) from position_events) as events, (select max(block) from position_events) as newest_block, (select count(*) from prices where not valid) as quarantined, (select count(*) from sweeps where status = 'success') as swept")
def _(v):
    one = lambda df, expr, name: df.agg(expr.alias(name))
    parts = [one(v.position_events, F.count("*"), "events"), one(v.position_events, F.max("block"), "newest_block"), one(v.prices, F.count_if(~F.col("valid")), "quarantined"), one(v.sweeps, F.count_if(F.col("status") == "success"), "swept")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)
    return out


N1_PARAMS = "select asset, block, log_index, ltv, threshold, bonus from param_history"


@query("n1_params", N1_PARAMS)
def _(v):
    return v.param_history


@query("n3_sql_functions", """select tx, log_index, seq, cast(amount::hugeint * 1000000007 // (asset + 1) as varchar) as x, cast((amount::hugeint * 1000000000000000000 + (asset + 1) // 2) // (asset + 1) as varchar) as wad, cast((amount::hugeint * (asset + 1) + 9999) // 10000 as varchar) as part,
 cast(((amount::hugeint * 1000000000000000000 + (asset + 1) // 2) // (asset + 1)) // 10000 as varchar) as health, cast(amount::hugeint + asset as varchar) as total from position_events""")
def _(v):
    X.register(v.spark)
    a, b = "cast(amount as string)", "cast(asset + 1 as string)"
    return v.position_events.selectExpr(
        "tx", "log_index", "seq", f"mul_div_floor({a}, '1000000007', {b}) as x", f"wad_div_half_up({a}, {b}) as wad", f"mul_div_ceil({a}, {b}, '10000') as part", f"health_wad({a}, {b}) as health", f"wide_add({a}, cast(asset as string)) as total",
    )


@query("n5_reach_rows", f"select scenario, kind, count(*) as n from (select scenario, case when held_flat then 'held' when shocked = price then 'unmoved' else 'moved' end as kind from {SHOCKED}) group by all")
def _(v):
    counts = K.reach(shocked(v))
    return counts.select("scenario", F.expr("stack(3, 'moved', moved, 'held', held, 'unmoved', unmoved) as (kind, n)")).filter("n > 0")


@query("j13_distance_labels", f"select account, case when debt = 0 then 'none' when liquidatable then 'breached' when borrow_limit = 0 then 'never' else 'distance' end as label from {POSITIONS}")
def _(v):
    return J.presented(positions(v), v.table("customer").select(F.col("c_custkey").alias("account"), F.col("c_name").alias("name"))).select("account", F.col("state").alias("label"))


@query("l20_token_paths", """
with recursive walk as (select p_partkey as asset, p_partkey // 5 as root, 1 as steps from part where p_partkey > 0 union all select asset, root // 5, steps + 1 from walk where root > 0) select asset, max(steps)::int as steps from walk group by asset""")
def _(v):
    links = v.table("part").filter("p_partkey > 0").select(F.col("p_partkey").alias("asset"), F.expr("p_partkey div 5").alias("base"))
    return R.composition(links).select("asset", "steps")
