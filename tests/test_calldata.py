import pytest

from tidebook.sources import calldata as C

SELECTORS = {"0a1b2c3d": 1, "4e5f6071": 0}


def w(n):
    return n.to_bytes(32)


def message(accounts, amounts):
    n = len(accounts)
    return w(64) + w(96 + 32 * n) + w(n) + b"".join(map(w, accounts)) + w(len(amounts)) + b"".join(map(w, amounts))


def call(m, selector="4e5f6071", offset=9 * 32):
    struct = b"".join(w(i) for i in range(5)) + w(offset) + w(offset + 32 + len(m)) + w(1) + w(2) + w(len(m)) + m + bytes(-len(m) % 32) + w(0)
    return bytes.fromhex(selector) + (w(32) + struct if selector == "4e5f6071" else w(8) + w(96) + w(96 + len(struct)) + struct + w(0))


GOOD = message([1, 2**160 - 1, 7], [5, 2**256 - 1, 0])
CASES = [
    (None, "no selector"), (b"\x0a", "no selector"), (b"\0" * 100, "unknown selector"), (bytes.fromhex("4e5f6071"), "bad offset"), (bytes.fromhex("4e5f6071") + w(2**255), "bad offset"),
    (call(GOOD, offset=33), "bad offset"), (call(GOOD, offset=64), "bad offset"), (call(GOOD)[:-64], "message out of range"), (call(GOOD, offset=2**40 // 32 * 32), "message out of range"),
    (call(b"\0" * 63), "short"), (call(w(96) + GOOD[32:]), "offset of accounts"), (call(w(64) + w(64) + GOOD[64:]), "offset of amounts"), (call(w(64) + w(96 + 96 + 32) + GOOD[64:]), "offset of amounts"),
    (call(w(64) + w(96) + w(2**200)), "too many"), (call(message([1, 2], [1])), "lengths differ"), (call(GOOD[:-1]), "short"), (call(GOOD + b"\0"), "trailing bytes"), (call(message([2**160], [1])), "dirty address"),
]


def test_calls_are_read_or_refused(spark):
    rows = [(i, x) for i, (x, _) in enumerate(CASES)] + [(100, call(GOOD)), (101, call(GOOD, "0a1b2c3d")), (102, call(message([], [])))]
    calls = spark.createDataFrame(rows, "tx long, input binary")
    assert {r.tx: r.flaw for r in C.refused(calls, SELECTORS).collect()} == {i: code for i, (_, code) in enumerate(CASES)}
    got = sorted(map(tuple, C.seeds(calls, SELECTORS).collect()))
    own = [(0, "0x" + "0" * 39 + "1", "5"), (1, "0x" + "f" * 40, str(2**256 - 1)), (2, "0x" + "0" * 39 + "7", "0")]
    assert got == [(tx, *x) for tx in (100, 101) for x in own]
    assert C.seeds(calls.limit(0), SELECTORS).count() == 0


@pytest.mark.parametrize("cut", range(0, 500, 7))
def test_no_cut_call_is_read(cut):
    whole = call(GOOD)
    with pytest.raises(C.Refused):
        C.seeds_of(C.message_of(whole[: max(0, len(whole) - 33 - cut)], {bytes.fromhex(k): v for k, v in SELECTORS.items()}))
