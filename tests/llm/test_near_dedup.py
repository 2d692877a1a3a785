import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import WORD, ascii_lower, morse
from tidebook.llm import near_dedup
from tidebook.llm.near_dedup import band_keys, band_width, components, drop_duplicates, link_duplicates, registers, shingle_sets


TEXTS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int"


def plain(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall(ascii_lower(t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80), (1, 60)])
def test_equals_brute_force(hard, hard_rows, k, percent):
    want = plain([r[:2] for r in hard_rows if r[0] is not None], k, percent)
    rows = link_duplicates(hard, k, percent).collect()
    assert len(rows) == len(hard_rows)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_chain_and_large_group(spark):
    base = [f"w{i}" for i in range(120)]
    chain = [base[i : i + 100] for i in range(0, 21, 2)]  # neighbours are alike, the ends are not
    copies = [(1000 + i, " ".join(base[:99] + [f"end{i}"]), None, None, None, None, None) for i in range(150)]
    rows = [(i, " ".join(w), None, None, None, None, None) for i, w in enumerate(chain)] + copies
    want = plain([r[:2] for r in rows], 3, 85)
    got = {r.doc_id: r.component_id for r in link_duplicates(spark.createDataFrame(rows, TEXTS), 3, 85).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_kept_rows_keep_their_columns(hard, empty):
    kept = drop_duplicates(hard)
    assert kept.columns == hard.columns and 0 < kept.count() < hard.count()
    assert drop_duplicates(empty).count() == 0 and link_duplicates(empty).count() == 0


def test_edited_copies_of_one_text(spark):
    """Many variants around the threshold: parts, edits on edits, and texts that share one passage only."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = [base]
    for _ in range(160):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = rng.choice(["new", "word", f"x{rng.randrange(50)}"])
        texts.append(t)
    texts += [base[: rng.randint(40, 79)] for _ in range(30)]
    texts += [base[:30] + [f"y{i}_{j}" for j in range(25)] for i in range(30)]
    rows = [(i, " ".join(t), None, None, None, None, None) for i, t in enumerate(texts)]
    for k, percent in ((3, 85), (5, 80)):
        want = plain([r[:2] for r in rows], k, percent)
        got = {r.doc_id: r.component_id for r in link_duplicates(spark.createDataFrame(rows, TEXTS), k, percent).collect()}
        assert got == {d: c for d, (_, c) in want.items()}


def test_hubs_fall_into_slots(spark, monkeypatch):
    """A group of 300 near copies, with slots of 20 pairs, two rows that share a doc_id, and words that a weak hash confuses."""
    monkeypatch.setattr(near_dedup, "SLOT", 20)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: rng.randint(88, 100)], f"e{i % 40}"]), None, None, None, None, None) for i in range(300)]
    rows += [(300, morse[0], None, None, None, None, None), (301, morse[1], None, None, None, None, None)]
    want = plain([r[:2] for r in rows], 3, 85)
    got = link_duplicates(spark.createDataFrame([*rows, rows[3]], TEXTS), 3, 85).collect()
    assert len(got) == 303 and {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}


def test_bands_keep_the_chance():
    assert band_width(0.85) == 6 and band_width(0.8) == 5 and band_width(0.1) == 1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (4, 1), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_registers_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    for n, share in ((40, 0.85), (400, 0.85), (4000, 0.5)):
        same = []
        for _ in range(60):
            both = round(2 * n * share / (1 + share))
            pool = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n:]])
            ra, rb = registers([np.sort(a), np.sort(b)])
            same.append((ra == rb).mean())
        assert abs(np.mean(same) - share) < 0.04
    assert (registers([np.zeros(0, np.uint64)]) == 0xFFFF).all()


def test_short_texts_are_one_shingle_and_bands_differ():
    sets = shingle_sets(pa.array([None, "", "a", "a b", "a b c", "A b C", "a b c d"]), 3, key=5)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 1, 2]
    assert (sets[4] == sets[5]).all() and sets[3][0] != sets[4][0]
    keys = band_keys(registers(sets[2:]), 6)
    assert len(set(keys[0].tolist())) == keys.shape[1]
