import copy
import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidebook.operators import stress
from tidebook.plans.bindings import Views
from tidebook.plans.catalog import QUERIES
from tidebook.plans.catalog_risk import factors as factors_of
from tidebook.sources import scenarios as S
from tidebook.sources.tables import Divergence

A, B, C = ("0x" + x * 40 for x in "aBc")

GOOD = {
    "id": "depeg", "version": "v1", "label": "l", "description": "d", "path_assumption": "p", "engines": ["debt"], "out_of_model": ["o"],
    "shocks": [{"axis": "stable_usd", "asset": A, "factor_num": 995, "factor_den": 1000}, {"axis": "eth_usd", "factor_num": 999999999999999999, "factor_den": 10**18}],
    "propagation": [
        {"asset": A, "chain_id": 10, "responds_to": [{"axis": "stable_usd", "asset": A}], "stable_snap": True, "note": "n"},
        {"asset": B, "chain_id": 10, "responds_to": [{"axis": "stable_usd", "asset": A}], "base_stable_snap": True, "base_asset": A},
        {"asset": C, "chain_id": 1, "symbol": "C", "responds_to": [{"axis": "eth_usd"}, {"axis": "x_eth_rate"}], "base_asset": B},
    ],
    "market_realizations": [{"asset": C, "chain_id": 1, "market_over_oracle_wad": "95" + "0" * 70}],
    "projection": {"annual_delta_bps": 200, "apy_delta_per_second_100e18": "63419583967", "horizons_seconds": [60, 3600]},
}


def write(folder, *texts):
    folder.mkdir(exist_ok=True)
    for i, t in enumerate(texts):
        (folder / f"{i}.json").write_text(t if isinstance(t, str) else json.dumps(t, indent=1))
    return str(folder)


def test_factors_are_exact(spark, tmp_path):
    other = copy.deepcopy(GOOD) | {"id": "other", "market_realizations": [], "projection": None}
    s = S.scenario_files(spark, write(tmp_path / "s", GOOD, [other]))
    assert sorted(map(tuple, s.shocks.where("scenario = 'depeg'").collect())) == [("depeg", "eth_usd|", 999999999999999999, 10**18), ("depeg", f"stable_usd|{A}", 995, 1000)]
    assert s.shocks.count() == 4 and s.responses.count() == 8 and s.scenarios.count() == 2
    assert sorted((r.asset, r.axis, r.stable_snap, r.base_snap, r.base_asset) for r in s.responses.where("scenario = 'other'").collect()) == sorted(
        [(A, f"stable_usd|{A}", True, False, None), (B.lower(), f"stable_usd|{A}", False, True, A), (C, "eth_usd|", False, False, B.lower()), (C, "x_eth_rate|", False, False, B.lower())]
    )
    assert [tuple(r) for r in s.market.collect()] == [("depeg", 1, C, "95" + "0" * 70)]
    assert sorted(tuple(r) for r in s.projections.collect()) == [("depeg", 200, "63419583967", 60), ("depeg", 200, "63419583967", 3600)]


def spoiled(change):
    out = copy.deepcopy(GOOD)
    change(out)
    return out


FLAWS = [
    (lambda o: o.update(more=1), "scenario: unknown field"), (lambda o: o.pop("label"), "scenario: missing field"), (lambda o: o["shocks"][0].update(factor=1), "shocks: unknown field"),
    (lambda o: o["shocks"][0].pop("factor_num"), "shocks: missing field"), (lambda o: o["shocks"][0].update(factor_num=0.8), "wrong type"), (lambda o: o["shocks"][0].update(factor_num=0), "shocks: factor not positive"),
    (lambda o: o["shocks"][1].update(factor_den=-1), "shocks: factor not positive"), (lambda o: o["shocks"].append(o["shocks"][0]), "shocks: axis twice"), (lambda o: o["shocks"][1].update(asset=A), "shocks: bad axis"),
    (lambda o: o["shocks"][0].update(asset=C), "shocks: nothing responds"), (lambda o: o["propagation"][0].update(typo=1), "propagation: unknown field"), (lambda o: o["propagation"][0].update(asset="0x12"), "propagation: no asset"),
    (lambda o: o["propagation"][0].update(chain_id=0), "propagation: no asset"), (lambda o: o["propagation"].append(o["propagation"][2] | {"asset": C.upper().replace("0X", "0x")}), "propagation: asset twice"),
    (lambda o: o["propagation"][2].update(responds_to=[]), "propagation: responds to nothing"), (lambda o: o["propagation"][0].update(base_asset=B), "propagation: two snaps"),
    (lambda o: o["propagation"][2].update(base_stable_snap=True), "propagation: no one stable base"), (lambda o: o["propagation"][1].update(base_asset=C), "propagation: bad base"), (lambda o: o["propagation"][2].update(base_asset=C), "propagation: bad base"),
    (lambda o: o["propagation"][2]["responds_to"].append({"axis": "moon"}), "propagation: bad axis"), (lambda o: o["propagation"][2]["responds_to"][0].update(why=1), "responds_to: unknown field"),
    (lambda o: o["market_realizations"][0].update(market_over_oracle_wad="-1"), "market_realizations: ratio not positive"), (lambda o: o["market_realizations"].append(o["market_realizations"][0]), "market_realizations: asset twice"),
    (lambda o: o["projection"].update(annual_delta_bps=201), "projection: values do not agree"), (lambda o: o["projection"].update(horizons_seconds=[0]), "projection: values do not agree"), (lambda o: o["projection"].update(x=1), "projection: unknown field"),
    (lambda o: o.update(engines=[]), "no engines"), (lambda o: o.update(out_of_model=[]), "nothing outside the model"), (lambda o: o.update(description=" "), "empty text"), (lambda o: o.update(shocks=[], market_realizations=[], projection=None), "moves nothing"),
]


def test_every_flaw_is_named(spark, tmp_path):
    folder = write(tmp_path / "bad", *(spoiled(c) | {"id": f"s{i}"} for i, (c, _) in enumerate(FLAWS)), "not json", '{"id": ')
    got = {r.file: r.flaws for r in S.scenario_flaws(spark, folder).collect()}
    for i, (_, want) in enumerate(FLAWS):
        assert want in got[f"{i}.json"], (i, want, got[f"{i}.json"])
    assert got[f"{len(FLAWS)}.json"][0] == got[f"{len(FLAWS) + 1}.json"][0] == "malformed"
    with pytest.raises(Divergence, match="factor not positive"):
        S.scenario_files(spark, write(tmp_path / "one", spoiled(FLAWS[5][0])))


def test_ids_are_unique_and_folders_not_empty(spark, tmp_path):
    with pytest.raises(Divergence, match="id twice"):
        S.scenario_files(spark, write(tmp_path / "twice", GOOD, GOOD))
    with pytest.raises(Divergence, match="no scenarios"):
        S.scenario_files(spark, write(tmp_path / "none", "[]"))


def test_shocks_round_once_and_transforms_follow(spark):
    rng = random.Random(5)
    axes = {f"a{i}": (rng.randint(1, 10**rng.choice([2, 18])), rng.randint(1, 10**rng.choice([2, 18]))) for i in range(4)} | {"near": (995, 1000), "edge": (99, 100)}
    assets = {k: rng.sample(list(axes), rng.randint(1, 3)) for k in range(60)} | {100: ["near"], 101: ["edge"], 102: ["near"], 103: ["edge"]}
    stable, over = {100, 101} | set(range(0, 60, 7)), {102, 103} | set(range(1, 60, 7))
    prices = {k: rng.randint(1, 10**12) for k in range(70)} | {100: 1_000_000, 101: 1_000_000, 102: 7_654_321, 103: 7_654_321}
    caps = {k: rng.randint(1, 10**12) for k in prices if k % 3 == 0}
    f = spark.createDataFrame([("s", a, n, d) for a, (n, d) in axes.items()], "scenario string, axis string, num long, den long")
    r = spark.createDataFrame([(k, a, k in stable, k in over) for k, own in assets.items() for a in own], "asset long, axis string, stable_snap boolean, base_snap boolean")

    def want(k, p):
        if k not in assets:
            return p, True, False, False, False
        factor = Fraction(1)
        for a in assets[k]:
            factor *= Fraction(*axes[a])
        snapped = based = False
        if k in over:
            base = int(10**6 * factor)
            based = 990_000 < base < 1_010_000
            after = p * (10**6 if based else base) // 10**6
        else:
            after = p * factor.numerator // factor.denominator
        if k in stable:
            snapped = 990_000 < after < 1_010_000
            after = 10**6 if snapped else after
        bound = k in caps and after > caps[k]
        return (caps[k] if bound else after), False, snapped, based, bound

    for kind in (int, str):
        p = spark.createDataFrame([(k, kind(v), kind(caps[k]) if k in caps else None) for k, v in prices.items()], f"asset long, price {'long' if kind is int else 'string'}, cap {'long' if kind is int else 'string'}")
        narrow = f if kind is str else f.where("num < 1000")  # so that prices stay within longs
        if kind is int:
            r_, keep = r.join(narrow.select("axis"), "axis"), {a for a in axes if axes[a][0] < 1000}
            saved, assets = assets, {k: [a for a in own if a in keep] for k, own in assets.items() if set(own) & keep}
        else:
            r_ = r
        for row in stress.shocked(p, r_, narrow).collect():
            assert (int(row.shocked), row.held_flat, row.snapped, row.base_snapped, row.cap_bound) == want(row.asset, prices[row.asset]), row
        if kind is int:
            assets = saved


def test_responses_of_a_scenario_count_in_it_alone(spark):
    prices = spark.createDataFrame([(1, 100), (2, 100)], "asset long, price long")
    responses = spark.createDataFrame([("s", 1, "x"), ("t", 1, "y"), ("t", 2, "z")], "scenario string, asset long, axis string").withColumns({"stable_snap": F.lit(False), "base_snap": F.lit(False)})
    factors = spark.createDataFrame([("s", "x", 1, 3), ("t", "y", 1, 2)], "scenario string, axis string, num long, den long")
    got = sorted((r.scenario, r.asset, r.shocked, r.held_flat) for r in stress.shocked(prices, responses, factors).collect())
    assert got == [("s", 1, 33, False), ("s", 2, 100, True), ("t", 1, 50, False), ("t", 2, 100, False)]


def test_rescaling_needs_one_shock_and_positive_factors(spark):
    factors = spark.createDataFrame([("one", "x", 9, 10), ("two", "x", 9, 10), ("two", "y", 1, 2)], "scenario string, axis string, num long, den long")
    grid = spark.createDataFrame([(0, 1, 1), (1, 995, 1000)], "grid long, num long, den long")
    got = sorted(map(tuple, stress.rescaled(factors, grid).collect()), key=str)
    assert got == sorted([("one", 0, "x", 1, 1, None), ("one", 1, "x", 995, 1000, None), ("two", None, None, None, None, "several_shocks")], key=str)
    with pytest.raises(Exception, match="not positive"):
        stress.rescaled(factors, spark.createDataFrame([(0, 0, 1)], "grid long, num long, den long")).collect()


def test_scaled_factors_of_all_shocks_and_grid_points(spark, sf):
    factors = spark.createDataFrame([("one", "x", 9, 10), ("two", "x", 3, 7), ("two", "y", 1, 2)], "scenario string, axis string, num long, den long")
    grid = spark.createDataFrame([(0, 0), (1, 50)], "grid long, percent long")
    got = sorted(map(tuple, stress.scaled(factors, grid).collect()))
    assert got == [("one", 0, "x", 1000, 1000), ("one", 1, "x", 950, 1000), ("two", 0, "x", 700, 700), ("two", 0, "y", 200, 200), ("two", 1, "x", 500, 700), ("two", 1, "y", 150, 200)]
    n = factors_of(Views(spark, sf)).count()
    assert n and QUERIES["k3_rescaled"](spark, sf).count() == 5 * n
