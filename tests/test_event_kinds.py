"""Every event kind of the survey (B4-B8) is read, and nothing registered is lost.

captured_logs.json has one log per kind of B4-B7 from the fixtures of the surveyed system (debt.withdraw_borrow_token and
debt.collateral_token_removed are synthetic there). Its captured configurator logs aren't at hand, so the logs of B8 are
built by the word places that its decoder states.
"""

import json
from pathlib import Path

import pytest

from tidebook.sources import events as E

SCHEMA = "engine string, block long, tx long, log_index long, topics array<binary>, data binary"


def word(n):
    return n.to_bytes(32, "big")


def read(spark, logs):
    """Fields by kind of (kind, topics after the first, data)."""
    topic0 = lambda kind: bytearray(kind.encode().ljust(32, b"\0")[:32])
    name = {kind: f"{i:02}" for i, (kind, _, _) in enumerate(logs)}
    rows = [("e", 1, 1, i, [topic0(name[kind]), *map(bytearray, topics)], bytearray(data)) for i, (kind, topics, data) in enumerate(logs)]
    registry = spark.createDataFrame([("e", topic0(n), kind) for kind, n in name.items()], "engine string, topic0 binary, kind string")
    return E.typed_events(spark.createDataFrame(rows, SCHEMA), registry)


A, B, C, D, S = ((i << 152) + 0xABC0 + i for i in range(1, 6))
hexed = lambda n: f"0x{n:040x}"
BIG, BLOB = (1 << 200) + 7, bytes(range(1, 41))
old_new = lambda name: ([A], [3, BIG], {"asset": hexed(A), f"old_{name}": "3", f"new_{name}": str(BIG)})
flag = lambda on: ([A], [on], {"asset": hexed(A), "enabled": "true" if on else "false"})
upgraded = ([A, B, C], [], {"asset": hexed(A), "proxy": hexed(B), "implementation": hexed(C)})
premium = ([], [9, (1 << 128) - 1], {"old_premium": "9", "new_premium": str((1 << 128) - 1)})
CONFIG = {
    "collateral_configuration_changed": ([A], [7700, 8000, 10500], {"asset": hexed(A), "ltv": "7700", "liquidation_threshold": "8000", "liquidation_bonus": "10500"}),
    "reserve_initialized": ([A, B], [C, D, S], {"asset": hexed(A), "atoken": hexed(B), "stable_debt_token": hexed(C), "variable_debt_token": hexed(D), "strategy": hexed(S)}),
    "emode_asset_category_changed": ([A], [0, 255], {"asset": hexed(A), "old_category": "0", "new_category": "255"}),
    "reserve_interest_rate_data_changed": ([A, S], None, {"asset": hexed(A), "strategy": hexed(S), "data": "0x" + BLOB.hex()}),
    "reserve_interest_rate_strategy_changed": ([A], [S, B], {"asset": hexed(A), "old_strategy": hexed(S), "new_strategy": hexed(B)}),
    "atoken_upgraded": upgraded,
    "variable_debt_token_upgraded": upgraded,
    "supply_cap_changed": old_new("supply_cap"),
    "borrow_cap_changed": old_new("borrow_cap"),
    "reserve_factor_changed": old_new("reserve_factor"),
    "debt_ceiling_changed": old_new("debt_ceiling"),
    "liquidation_protocol_fee_changed": old_new("fee"),
    "reserve_borrowing": flag(1),
    "reserve_flash_loaning": flag(0),
    "reserve_stable_rate_borrowing": flag(1),
    "borrowable_in_isolation_changed": ([], [A, 1], {"asset": hexed(A), "borrowable": "true"}),
    "siloed_borrowing_changed": ([A], [0, 1], {"asset": hexed(A), "old_state": "false", "new_state": "true"}),
    "flashloan_premium_total_updated": premium,
    "flashloan_premium_to_protocol_updated": premium,
    "upgraded": ([A], [], {"implementation": hexed(A)}),
}
blob = lambda at, n, body: word(at) + word(n) + body


def config_logs():
    data = lambda words: blob(32, len(BLOB), BLOB.ljust(64, b"\0")) if words is None else b"".join(map(word, words))
    return [(f"config.{k}", [word(t) for t in topics], data(words)) for k, (topics, words, _) in CONFIG.items()]


def test_every_configurator_kind(spark):
    got = {r.kind: r.fields for r in read(spark, config_logs()).collect()}
    assert got == {f"config.{k}": want for k, (_, _, want) in CONFIG.items()} and len(got) == 20


def test_captured_log_of_every_other_kind(spark):
    """Each word of a captured log is one field."""
    captured = json.loads((Path(__file__).parent / "captured_logs.json").read_text())
    assert {*captured} == {k for k in E.LAYOUTS if not k.startswith("config.")}
    raw = {k: ([bytes.fromhex(t[2:]) for t in x["topics"][1:]], bytes.fromhex(x["data"][2:])) for k, x in captured.items()}
    rows = read(spark, [(k, *x) for k, x in raw.items()]).collect()
    assert len(rows) == len(captured)
    number = lambda v: {"true": 1, "false": 0}[v] if v in ("true", "false") else int(v, 16 if v.startswith("0x") else 10)
    for r in rows:
        topics, data = raw[r.kind]
        words = [*topics, *(data[i : i + 32] for i in range(0, len(data), 32))]
        assert sorted(number(v) for v in r.fields.values()) == sorted(int.from_bytes(w, "big") for w in words), r.kind
    assert {r.kind: r.fields for r in rows}["debt.collateral_token_added"] == {"token": "0xdcb612005417dc906ff72c87df732e5a90d49e11"}


@pytest.mark.parametrize("kind,topics,data,says", [
    ("config.unheard_of", [], b"", "no layout"),
    ("debt.supplied", [A, B], word(1), "number of topics"),
    ("config.upgraded", [A, B], b"", "number of topics"),
    ("config.upgraded", [A], word(0), "another length"),
    ("config.emode_asset_category_changed", [A], word(0) + word(256), "wider than 8 bits"),
    ("config.flashloan_premium_total_updated", [], word(0) + word(1 << 128), "wider than 128 bits"),
    ("config.reserve_interest_rate_data_changed", [A, S], blob(64, 1, b"x".ljust(32, b"\0")), "not one value"),
    ("config.reserve_interest_rate_data_changed", [A, S], blob(32, 33, b"x".ljust(32, b"\0")), "not one value"),
    ("config.reserve_interest_rate_data_changed", [A, S], blob(32, 1, b"x".ljust(31, b"\0") + b"y"), "not one value"),
    ("config.reserve_interest_rate_data_changed", [A, S], blob(32, 1 << 255, b""), "not one value"),
])
def test_other_shapes_are_errors(spark, kind, topics, data, says):
    with pytest.raises(Exception, match=says):
        read(spark, [(kind, [word(t) for t in topics], data)]).collect()


def test_parameter_rows_of_the_configurator(spark):
    got = {r.kind: {k: v for k, v in r.asDict().items() if v is not None and k not in ("engine", "block", "tx", "log_index", "kind")} for r in E.config_param_rows(read(spark, config_logs())).collect()}
    assert got == {
        "config.collateral_configuration_changed": {"asset": hexed(A), "ltv": "7700", "liq_threshold": "8000", "liq_bonus": "10500"},
        "config.reserve_initialized": {"asset": hexed(A), "atoken": hexed(B), "variable_debt_token": hexed(D), "strategy": hexed(S)},
        "config.emode_asset_category_changed": {"asset": hexed(A), "emode_category": "255"},
    }


def test_display_catalogue_is_by_engine(spark):
    types = [("aave_v3_etherfi", "aave_liquidation_call"), ("aave_v3_etherfi", "atoken_mint"), ("debt_manager", "residue_zeroed"), ("debt_manager", "borrow"), ("debt", "borrow"), ("aave_v3_etherfi", "borrow")]
    rows = spark.createDataFrame([(e, i, 0, 0, t) for i, (e, t) in enumerate(types)], "engine string, tx long, log_index long, seq long, event_type string")
    got = [(r.shown, r.bookkeeping, r.unit) for r in E.displayed(rows).orderBy("tx").collect()]
    assert got == [("liquidation", False, "aave_scaled"), ("bookkeeping", True, "aave_scaled"), ("bookkeeping", True, "dm_normalized_debt"), ("borrow", False, "dm_normalized_debt"), ("debt", False, "token"), ("unclassified", False, "none")]
    assert [len(E.DISPLAY[e]) for e in ("aave_v3_etherfi", "debt_manager")] == [13, 13]
