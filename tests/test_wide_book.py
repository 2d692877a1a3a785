import random

from tidebook.operators import wide_book as B

LEG = "account long, asset long, amount string, price string, unit string, threshold string, bonus_num string, bonus_den string, ratio string"


def test_liquidations_equal_whole_numbers_of_any_width(spark):
    rng = random.Random(1)
    big = lambda most: rng.randrange(1, 10 ** rng.randint(1, most))
    legs, debts = [], [(a, f"e{a % 2}", big(70)) for a in range(60)] + [(60, "e0", 0), (61, "e1", 5)]
    for a, _, debt in debts[:-1]:
        for k in range(rng.randint(0, 4)):
            legs.append((a, k, rng.choice([big(60), 0, debt]), big(20), 10 ** rng.choice([0, 6, 18]), rng.randrange(10**20), *rng.choice([(None, None), (10600, 10000), (10**20 + 7, 10**20)]), rng.choice([None, big(19)])))
    rows = [tuple(None if x is None else x if i < 2 else str(x) for i, x in enumerate(leg)) for leg in legs]
    rows.append((61, 1, "5", None, "1", "1", None, None, None))
    book = spark.createDataFrame(rows, LEG).repartition(3), spark.createDataFrame([(a, e, str(d)) for a, e, d in debts], "account long, engine string, debt string")
    got = {r.account: r for r in B.liquidations(*book).collect()}
    flat = {r.account: r for r in B.debt_positions(*book).collect()}
    totals = {}
    for a, engine, debt in debts[:-1]:
        own = [(x * p // u, t, n or 1, d or 1, 10**18 if r is None else r) for b, _, x, p, u, t, n, d, r in legs if b == a]
        total = sum(v for v, *_ in own)
        seizable = sum(min(v, debt * v * n // (total * d)) for v, _, n, d, _ in own if total)
        back, limit, real = sum(v * d // n for v, _, n, d, _ in own), sum(v * t // 10**20 for v, t, *_ in own), sum(v * r // 10**18 for v, *_, r in own)
        market = seizable * sum(v * r for v, *_, r in own) // (10**18 * total) if total else 0
        due = debt > limit
        want = (due, seizable, back, max(0, debt - back) if due else 0, real, market, max(0, seizable - market), max(0, debt - real))
        r = got[a]
        assert (r.liquidatable, *(int(r[c]) for c in ("seizable", "recoverable", "bad_debt", "realizable", "market", "shortfall", "market_bad_debt"))) == want and r.refusal is None
        assert (int(flat[a].collateral), int(flat[a].borrow_limit), flat[a].liquidatable) == (total, limit, due)
        if due:
            t = totals.setdefault(engine, [0, 0, 0, 0])
            totals[engine] = [t[0] + 1, t[1] + (want[-1] > 0), t[2] + want[-2], t[3] + want[-1]]
    assert got[61].refusal == flat[61].refusal == "missing_price" and got[61].seizable is None and got[61].bad_debt is None and flat[61].liquidatable is None
    sums = {r.engine: [r.liquidatable, r.insolvent, int(r.shortfall), int(r.market_bad_debt)] for r in B.shortfall(B.liquidations(*book)).collect()}
    assert sums == totals
