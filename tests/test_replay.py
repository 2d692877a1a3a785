from tidebook.operators.replay import replayed_causes

UNIT = 1_000_000


def causes(spark, states, legs, witnesses):
    out = replayed_causes(spark.createDataFrame(states, "case long, shares long, index long"), spark.createDataFrame(legs, "case long, asset long, amount long, price long, weight long"), spark.createDataFrame(witnesses, "case long, place long, kind string, asset long, x long, y long"))
    return {r.case: r for r in out.repartition(3).collect()}


def test_causes_hold_to_the_end(spark):
    states = [(c, 70, UNIT) for c in range(12)] + [(20, None, UNIT), (21, 70, 0)]
    legs = [(c, 1, 10, 10, 80) for c in range(12)]  # a limit of 80
    legs += [(9, 2, 5, None, 50), (20, 1, 10, 10, 80)]
    witnesses = [
        (0, 5, "index", None, UNIT, 2 * UNIT),  # the index flips it
        (1, 3, "borrow", None, 11, None), (1, 4, "repay", None, 5, None),  # flips, and back
        (2, 3, "borrow", None, 11, None), (2, 4, "repay", None, 5, None), (2, 9, "config", 1, 60, None),  # and again, by a setting
        (3, 1, "seizure", 1, 4, 20), (3, 2, "seizure", 1, 7, 0),  # 50 against 48; the second takes more than is there
        (4, 1, "seizure", 1, 1, 0), (4, 1, "seizure", 7, 1, 0),  # one write with an asset that the case lacks: nothing of it
        (5, 1, "price", 1, 1, None), (5, 2, "config", 8, 1, None),  # no writes of this case
        (6, 2, "repay", None, 100, None),  # more than the debt
        (7, 4, "index", None, 2 * UNIT, UNIT), (7, 2, "borrow", None, 1, None),  # eligible before, as the index was higher
        (8, 4, "index", None, 0, 2 * UNIT),  # an update that doesn't say what was
        (10, 1, "index", None, UNIT, None), (10, 2, "config", 1, 69, None), (None, 1, "borrow", None, 1, None), (99, 1, "borrow", None, 1, None),
    ]
    got = causes(spark, states, legs, witnesses)
    short = lambda r: (r.eligible_before, r.complete, r.proven, r.cause, r.kind, r.reversals, r.applied, r.notes)
    assert {c: short(r) for c, r in got.items()} == {
        0: (False, True, True, 5, "index", 0, 1, 0), 1: (False, True, False, None, None, 1, 2, 0), 2: (False, True, True, 9, "config", 1, 3, 0), 3: (False, True, True, 1, "seizure", 0, 1, 1),
        4: (False, True, False, None, None, 0, 0, 1), 5: (False, True, False, None, None, 0, 0, 0), 6: (False, True, False, None, None, 0, 1, 1), 7: (True, True, False, None, None, 1, 2, 0),
        8: (False, False, True, 4, "index", 0, 1, 1), 9: (False, False, False, None, None, 0, 0, 0), 10: (False, True, True, 2, "config", 0, 1, 1), 11: (False, True, False, None, None, 0, 0, 0),
        20: (None, False, False, None, None, 0, 0, 1), 21: (None, False, False, None, None, 0, 0, 1),
    }


def test_several_elements_are_one_write(spark):
    got = causes(spark, [(1, 100, UNIT)], [(1, 1, 10, 10, 50), (1, 2, 10, 10, 60)], [(1, 3, "seizure", 1, 2, 0), (1, 3, "seizure", 2, 1, 0), (1, 3, "seizure", 1, 3, 0)])
    assert (got[1].cause, got[1].applied, got[1].notes) == (3, 1, 0)


def test_empty_tables(spark):
    assert causes(spark, [], [], []) == {}
