"""Scenario definitions as JSON files, read strictly: what a file says that isn't understood is an error, not a default.

A file holds one scenario or a list of them.  Factors are exact rationals; nothing is rounded when they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.exact import _over, _whole
from tidebook.sources.tables import Divergence

# Fields of each object, with those that must be there first; axes that hold for one asset or for all.
SCENARIO = ("id version label description path_assumption engines out_of_model", "shocks propagation market_realizations projection")
SHOCK = ("axis factor_num factor_den", "asset")
RESPONSE = ("asset chain_id responds_to", "symbol stable_snap base_stable_snap base_asset note")
AXIS = ("axis", "asset")
MARKET = ("asset chain_id market_over_oracle_wad", "symbol note")
PROJECTION = ("annual_delta_bps apy_delta_per_second_100e18 horizons_seconds", "note")
ASSET_AXES, GLOBAL_AXES, RATE_AXIS, STABLE_AXIS = r"stable_usd|asset_usd", r"eth_usd|[a-z0-9]+_eth_rate|borrow_apy", "borrow_apy", "stable_usd"
ADDRESS = "^(0[xX])?[0-9a-fA-F]{40}$"
SECONDS_PER_YEAR = 31_536_000

_AXIS = "struct<axis:string,asset:string>"
_TYPED = f"""struct<id:string,version:string,label:string,description:string,path_assumption:string,engines:array<string>,out_of_model:array<string>,
  shocks:array<struct<axis:string,asset:string,factor_num:bigint,factor_den:bigint>>,
  propagation:array<struct<asset:string,chain_id:bigint,symbol:string,responds_to:array<{_AXIS}>,stable_snap:boolean,base_stable_snap:boolean,base_asset:string,note:string>>,
  market_realizations:array<struct<asset:string,chain_id:bigint,symbol:string,market_over_oracle_wad:string,note:string>>,
  projection:struct<annual_delta_bps:bigint,apy_delta_per_second_100e18:string,horizons_seconds:array<bigint>,note:string>>"""


@dataclass(frozen=True)
class ScenarioSet:
    """Tables of a set of scenarios: their axes are keys `axis|asset`, addresses are in lower case with 0x.

    scenarios: (scenario, version, label, engines); shocks: (scenario, axis, num, den); responses: (scenario, chain, asset,
    axis, stable_snap, base_snap, base_asset); market: (scenario, chain, asset, ratio), a decimal string over 1e18;
    projections: (scenario, annual_bps, per_second, horizon).
    """

    scenarios: DataFrame
    shocks: DataFrame
    responses: DataFrame
    market: DataFrame
    projections: DataFrame


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw): the JSON text of each scenario of the files of a folder; null for text that is no JSON object or list."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("value"))
    raw = F.when(F.col("value").startswith("["), F.coalesce(F.from_json("value", "array<string>"), F.array(F.lit(None).cast("string")))).otherwise(F.array("value"))
    return files.select("file", F.explode(raw).alias("raw"))


def _hex(c: Column) -> Column:
    return F.coalesce(c.rlike(ADDRESS), F.lit(False))


def address(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit("0x"), F.regexp_replace(F.lower(c), "^0x", "")))


def axis_key(a: Column) -> Column:
    return F.concat_ws("|", a["axis"], F.coalesce(address(a["asset"]), F.lit("")))


def _bad_axis(a: Column) -> Column:
    """An axis that is unknown, or lacks its asset, or has one that it can't have."""
    own = F.coalesce(a["asset"], F.lit("")) != ""
    known = F.coalesce(a["axis"].rlike(f"^({ASSET_AXES}|{GLOBAL_AXES})$"), F.lit(False))
    return ~known | F.when(a["axis"].rlike(f"^({ASSET_AXES})$"), ~_hex(a["asset"])).otherwise(own)


def _fields_flaw(objects: Column, fields: tuple[str, str], where: str) -> list[Column]:
    """Codes of fields that are unknown and of such that are missing, of an array of maps from field to JSON text."""
    needed, more = fields[0].split(), fields[1].split()
    known = F.array(*map(F.lit, needed + more))
    unknown = F.exists(objects, lambda o: F.size(F.array_except(F.map_keys(o), known)) > 0)
    lacking = F.exists(objects, lambda o: F.size(F.array_except(F.array(*map(F.lit, needed)), F.map_keys(F.map_filter(o, lambda _, v: v.isNotNull())))) > 0)
    return [F.when(unknown, f"{where}: unknown field"), F.when(lacking, f"{where}: missing field")]


def _repeats(keys: Column) -> Column:
    return F.size(F.array_distinct(keys)) < F.size(keys)


def judged(raw: DataFrame) -> DataFrame:
    """Adds to (file, raw) the parsed scenario `s` and its flaws, those of form before those of content."""
    maps = lambda c, kind="array<map<string,string>>": F.coalesce(F.from_json(c, kind), F.array().cast("array<map<string,string>>"))
    top = raw.withColumn("o", F.from_json("raw", "map<string,string>")).withColumn("s", F.from_json("raw", _TYPED, {"mode": "PERMISSIVE"}))
    o = lambda name: F.col("o")[name]
    axes = F.flatten(F.transform(maps(o("propagation")), lambda p: maps(p["responds_to"])))
    # numbers and words where others are due become null in the typed form: what is there as text but not as value is malformed
    typed = F.col("s").isNotNull()
    broken = F.lit(False)
    for name in "engines out_of_model shocks propagation market_realizations projection".split():
        broken = broken | (o(name).isNotNull() & F.col(f"s.{name}").isNull())
    wrong = lambda objects, array, names: F.exists(F.arrays_zip(objects.alias("o"), F.col(f"s.{array}").alias("v")), lambda x: F.greatest(*(x["o"][n].isNotNull() & x["v"][n].isNull() for n in names), F.lit(False)))
    broken = broken | F.coalesce(wrong(maps(o("shocks")), "shocks", ["factor_num", "factor_den"]), F.lit(False)) | F.coalesce(wrong(maps(o("propagation")), "propagation", ["chain_id", "responds_to", "stable_snap", "base_stable_snap"]), F.lit(False))
    flaws = [F.when(F.col("o").isNull() | ~typed, "malformed"), *_fields_flaw(F.array("o"), SCENARIO, "scenario"), *_fields_flaw(maps(o("shocks")), SHOCK, "shocks"), *_fields_flaw(maps(o("propagation")), RESPONSE, "propagation")]
    flaws += [*_fields_flaw(axes, AXIS, "responds_to"), *_fields_flaw(maps(o("market_realizations")), MARKET, "market_realizations"), *_fields_flaw(F.when(o("projection").isNotNull(), F.array(F.from_json(o("projection"), "map<string,string>"))), PROJECTION, "projection")]
    flaws.append(F.when(broken, "wrong type"))
    return top.withColumn("form", F.array_compact(F.array(*flaws))).withColumn("flaws", F.when(F.size("form") > 0, F.col("form")).otherwise(F.array_compact(F.array(*_content_flaws())))).drop("o", "form")


def _content_flaws() -> list[Column]:
    s = lambda name: F.col(f"s.{name}")
    none = lambda name: F.coalesce(s(name), F.array())
    shocks, rows, market, p = none("shocks"), none("propagation"), none("market_realizations"), s("projection")
    blank = F.greatest(*(F.trim(F.coalesce(s(n), F.lit(""))) == "" for n in "id version label description path_assumption".split()))
    still = (F.size(shocks) == 0) & (F.size(market) == 0) & p.isNull()
    provided = F.flatten(F.transform(rows, lambda r: F.transform(r["responds_to"], axis_key)))
    base = lambda r: F.coalesce(r["base_asset"], F.lit("")) != ""
    snap = lambda r, n: F.coalesce(r[n], F.lit(False))
    one_stable = lambda r: (F.size(r["responds_to"]) == 1) & (r["responds_to"][0]["axis"] == STABLE_AXIS)
    bad_base = lambda r: ~_hex(r["base_asset"]) | (address(r["base_asset"]) == "0x" + "0" * 40) | (address(r["base_asset"]) == address(r["asset"]))
    disagrees = lambda r: snap(r, "base_stable_snap") & (address(r["base_asset"]) != address(r["responds_to"][0]["asset"]))
    key = lambda r: F.concat_ws("|", r["chain_id"].cast("string"), address(r["asset"]))
    per_year = _whole(10**16) * p["annual_delta_bps"].cast("decimal(19,0)")
    per_second = _over(_whole(per_year), _whole(SECONDS_PER_YEAR)).cast("string")
    positive = lambda c: F.coalesce(c.rlike(r"^\+?0*[1-9][0-9]*$"), F.lit(False))
    bad_projection = (p["annual_delta_bps"] <= 0) | (F.size(p["horizons_seconds"]) == 0) | F.exists(p["horizons_seconds"], lambda h: h <= 0) | ~positive(p["apy_delta_per_second_100e18"]) | (p["apy_delta_per_second_100e18"] != per_second)
    any_ = lambda rows, f: F.exists(rows, lambda r: F.coalesce(f(r), F.lit(False)))
    return [
        F.when(blank, "empty text"),
        F.when(F.size(none("engines")) == 0, "no engines"),
        F.when(F.size(none("out_of_model")) == 0, "nothing outside the model"),
        F.when(still, "moves nothing"),
        F.when(any_(rows, lambda r: ~_hex(r["asset"]) | (r["chain_id"] <= 0)), "propagation: no asset"),
        F.when(_repeats(F.transform(rows, key)), "propagation: asset twice"),
        F.when(any_(rows, lambda r: F.size(r["responds_to"]) == 0), "propagation: responds to nothing"),
        F.when(any_(rows, lambda r: snap(r, "stable_snap") & (snap(r, "base_stable_snap") | base(r))), "propagation: two snaps"),
        F.when(any_(rows, lambda r: snap(r, "base_stable_snap") & ~one_stable(r)), "propagation: no one stable base"),
        F.when(any_(rows, lambda r: base(r) & (bad_base(r) | disagrees(r))), "propagation: bad base"),
        F.when(any_(rows, lambda r: any_(r["responds_to"], _bad_axis)), "propagation: bad axis"),
        F.when(any_(shocks, _bad_axis), "shocks: bad axis"),
        F.when(_repeats(F.transform(shocks, axis_key)), "shocks: axis twice"),
        F.when(any_(shocks, lambda x: (x["factor_den"] <= 0) | (x["factor_num"] <= 0)), "shocks: factor not positive"),
        F.when(any_(shocks, lambda x: (x["axis"] != RATE_AXIS) & ~F.array_contains(provided, axis_key(x))), "shocks: nothing responds"),
        F.when(any_(market, lambda m: ~_hex(m["asset"]) | (m["chain_id"] <= 0)), "market_realizations: no asset"),
        F.when(_repeats(F.transform(market, key)), "market_realizations: asset twice"),
        F.when(any_(market, lambda m: ~positive(m["market_over_oracle_wad"])), "market_realizations: ratio not positive"),
        F.when(p.isNotNull() & bad_projection, "projection: values do not agree"),
    ]


def scenario_flaws(spark: SparkSession, path: str) -> DataFrame:
    """(file, scenario, flaws) of the scenarios of a folder that are refused; an id that occurs twice is a flaw of each."""
    rows = judged(definitions(spark, path)).select("file", F.col("s.id").alias("scenario"), "flaws")
    twice = rows.groupBy("scenario").count().where("count > 1 and scenario is not null").select("scenario", F.lit("id twice").alias("twice"))
    both = rows.join(twice, "scenario", "left").withColumn("flaws", F.array_compact(F.array_append("flaws", F.col("twice"))))
    return both.where(F.size("flaws") > 0).select("file", "scenario", "flaws")


def scenario_files(spark: SparkSession, path: str) -> ScenarioSet:
    """The scenarios of a folder of JSON files.  Any flaw in any of them is an error, as is a folder without scenarios."""
    bad = scenario_flaws(spark, path).orderBy("file", "scenario").first()
    if bad:
        raise Divergence(f"{bad.file}: scenario {bad.scenario}: {', '.join(bad.flaws)}")
    rows = judged(definitions(spark, path)).select(F.col("s.id").alias("scenario"), "s")
    if rows.isEmpty():
        raise Divergence("no scenarios")
    x = lambda name: rows.select("scenario", F.explode(f"s.{name}").alias("x"))
    responses = x("propagation").select(
        "scenario", F.col("x.chain_id").alias("chain"), address(F.col("x.asset")).alias("asset"), F.explode("x.responds_to").alias("a"), F.coalesce("x.stable_snap", F.lit(False)).alias("stable_snap"),
        F.coalesce("x.base_stable_snap", F.lit(False)).alias("base_snap"), address(F.col("x.base_asset")).alias("base_asset"),
    )
    p = rows.where("s.projection is not null").select("scenario", "s.projection.*")
    return ScenarioSet(
        rows.select("scenario", F.col("s.version").alias("version"), F.col("s.label").alias("label"), F.col("s.engines").alias("engines")),
        x("shocks").select("scenario", axis_key(F.col("x")).alias("axis"), F.col("x.factor_num").alias("num"), F.col("x.factor_den").alias("den")),
        responses.withColumn("axis", axis_key(F.col("a"))).select("scenario", "chain", "asset", "axis", "stable_snap", "base_snap", "base_asset"),
        x("market_realizations").select("scenario", F.col("x.chain_id").alias("chain"), address(F.col("x.asset")).alias("asset"), F.col("x.market_over_oracle_wad").alias("ratio")),
        p.select("scenario", F.col("annual_delta_bps").alias("annual_bps"), F.col("apy_delta_per_second_100e18").alias("per_second"), F.explode("horizons_seconds").alias("horizon")),
    )
