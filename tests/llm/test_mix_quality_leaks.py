import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import WORD
from tidebook.llm import decontamination, mixing, quality


def shared_out(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mix_keeps_its_rules_and_sql_agrees(hard, hard_rows, monkeypatch):
    plan = mixing.planned(mixing.sized(hard)).collect()
    assert len(plan) == len(hard_rows)
    sizes = defaultdict(int)
    for r in hard_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = shared_out(sizes)
    key = lambda d, *more: (d is None, d or 0, *more)
    about = sorted((key(r[0], len(WORD.findall(r[1] or "")), sizes[r[3]], want[r[3]]) for r in hard_rows))
    assert [key(r.doc_id, r.size, r.source_size, pytest.approx(r.target)) for r in sorted(plan, key=lambda r: key(r.doc_id, r.size, r.source_size))] == about
    for r in plan:
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.ceil(rate) <= 3
    got = lambda rows: sorted(key(r.doc_id, r.size, r.source_size, r.target, r.copies * r.size) for r in rows)
    assert got(plan) == got(mixing.planned(mixing.sized(hard.repartition(7))).collect())
    monkeypatch.setattr(mixing, "CELL_ROWS", 1)  # smaller cells change nothing
    assert got(plan) == got(mixing.planned(mixing.sized(hard)).collect())
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    db.executemany("insert into documents values (?, ?, ?)", [(r[0], r[3], r[1]) for r in hard_rows])
    assert got(plan) == sorted(key(*r) for r in db.execute(mixing.OP8_SQL).fetchall())


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * int(math.exp(rng.gauss(4, 1))), rng.choice("aaabcdefg")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.planned(mixing.sized(docs)).join(docs.select("doc_id", "source"), "doc_id")
    for r in plan.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect():
        assert abs(r.taken / r.target - 1) < 0.05


def test_mixed_rows_and_empty_tables(hard, empty, monkeypatch):
    more = hard.withColumns({"target": F.lit(1.5), "source_size": F.lit("x"), "_size": F.lit(7), "row": F.col("doc_id"), "copies": F.lit(0), "a.b": F.lit("dot"), "_tag": F.lit(None).cast("string")})
    rows = mixing.mixed(more)
    assert rows.dtypes == more.dtypes
    got = rows.collect()
    assert len(got) == sum(r.copies for r in mixing.planned(mixing.sized(hard)).collect())
    assert {(r.target, r.source_size, r._size, r["a.b"]) for r in got} == {(1.5, "x", 7, "dot")} and all(r.row == r.doc_id for r in got)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mixed(more).collect())) == sorted(map(str, got))
    assert mixing.mixed(empty).count() == 0 and mixing.planned(mixing.sized(empty)).count() == 0


# ---- quality


def labelled(spark, n=400):
    rng = random.Random(9)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 90))) + "."
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, good().upper().replace(" ", "!! ") if bad else good()))
        labels.append((i, 0 if bad else 1, None))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = quality.documents_scored(docs, labels).collect()
    import zlib

    held = [(r.score, r.doc_id % 4 != 0) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(s >= quality.THRESHOLD) == y for s, y in held]) > 0.95 and all(0 <= s <= 1 for s, _ in held)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert len(kept & set(range(1, 400, 4))) > 95 and len(kept & set(range(0, 400, 4))) < 10


def test_each_row_is_kept_or_not_by_its_own_text(spark):
    docs, labels = labelled(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    more = spark.createDataFrame([(None, texts[4]), (None, texts[5]), (1, texts[8]), (8, texts[1])], docs.schema)
    kept = [(r.doc_id, r.text) for r in quality.keep_good(docs.union(more), labels).collect()]
    assert (None, texts[5]) in kept and (8, texts[1]) in kept and (1, texts[1]) in kept
    assert (None, texts[4]) not in kept and (1, texts[8]) not in kept and (8, texts[8]) not in kept


def test_every_row_has_a_score(spark, hard, hard_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (3, 7, 0), (None, 1, 0), (6, 0, 1), (6, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.documents_scored(hard, labels).collect()
    assert len(rows) == len(hard_rows) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (6, 7)}) == 1
    nothing = labels.limit(0)
    assert all(abs(r.score - 0.5) < 1e-6 for r in quality.documents_scored(hard, nothing).collect())
    assert quality.documents_scored(empty, labels).count() == 0 and quality.keep_good(empty, labels).count() == 0
    assert quality.keep_good(hard, labels).columns == hard.columns


def test_scores_equal_a_plain_model(spark):
    """Features, normal equations, ridge and calibration on whole arrays, without partial sums."""
    docs, labels = labelled(spark, 300)
    texts = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in texts}
    ids = sorted(texts)
    x = quality.statistics(pa.array([texts[d] for d in ids], pa.string())).astype(np.float32).astype(float)
    fit = np.array([fold[d] > 1 for d in ids])
    check = np.array([fold[d] == 1 for d in ids])
    y = np.array([label[d] for d in ids], float)
    rng = np.random.default_rng(7)
    directions = rng.normal(size=(quality.STATISTICS, quality.FEATURES)) / np.sqrt(quality.STATISTICS)
    phases = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    mean, scale = x[fit].mean(axis=0), np.sqrt(np.maximum((x[fit] ** 2).mean(axis=0) - x[fit].mean(axis=0) ** 2, 1e-12))
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ directions + phases) * np.sqrt(2 / quality.FEATURES)
    z = np.c_[z, np.ones(len(z))]
    penalty = np.r_[np.full(quality.FEATURES, quality.RIDGE * fit.sum() / quality.FEATURES), 1e-9]
    raw = z @ np.linalg.solve(z[fit].T @ z[fit] + np.diag(penalty), z[fit].T @ y[fit])
    bins = defaultdict(list)
    for r, t in zip(raw[check], y[check]):
        bins[math.floor((min(1.5, max(-0.5, r)) + 0.5) * (quality.BINS // 2))].append((r, t))
    points = [(*np.mean(bins[b], axis=0), len(bins[b])) for b in sorted(bins)]
    levels = quality.isotonic(np.array([p[1] for p in points]), np.array([float(p[2]) for p in points]))
    want = np.clip(0.999 * np.interp(raw, [p[0] for p in points], np.clip(levels, 1e-3, 1 - 1e-3)) + 0.001 / (1 + np.exp(-raw)), 0, 1)
    got = {r.doc_id: r.score for r in quality.documents_scored(docs, labels).collect()}
    assert np.allclose([got[d] for d in ids], want, atol=2e-3)


def test_isotonic_is_ascending_and_nearest():
    rng = np.random.default_rng(0)
    y, w = rng.random(40), rng.integers(1, 9, 40).astype(float)
    fit = quality.isotonic(y, w)
    assert (np.diff(fit) >= -1e-12).all()
    # the min-max formula
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    plain = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(fit, plain)


def test_statistics_do_not_depend_on_neighbours(hard_rows):
    texts = [r[1] for r in hard_rows]
    whole = quality.statistics(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert whole.shape == (len(texts), quality.STATISTICS) and np.allclose(whole, alone)


# ---- leaks


def plain_tiles(item, doc, least):
    """Greedy string tiling as first described: the longest unmarked match, then again."""
    a, b, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append((i, j, n))
        a[i : i + n] = b[j : j + n] = [True] * n


def test_tiling_equals_the_plain_version():
    rng = np.random.default_rng(6)
    for _ in range(60):
        item, doc = (rng.integers(0, 4, rng.integers(0, n)).astype(np.uint64) for n in (14, 30))
        assert decontamination.tile(item, doc, 3) == plain_tiles(item.tolist(), doc.tolist(), 3)


def test_tiling_of_repeated_tokens_stays_small():
    import tracemalloc

    item, doc = np.ones(1000, np.uint64), np.ones(1_000_000, np.uint64)
    doc[::50_000] = 2
    tracemalloc.start()
    assert decontamination.tile(item, doc, 3) == [(0, 1, 1000)]
    assert len(decontamination.tile(np.arange(1000, dtype=np.uint64) % 2, doc % 2, 3)) == 19
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_leaks_equal_a_plain_version(spark):
    """Reordered pieces of 3 to 8 tokens, chance overlaps, repeated tokens, and items shorter than a tile."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: text(rng.choice([1, 2, 3, 5, 24, 24, 40])) for k in range(30)}
    docs = {}
    for d in range(120):
        own = text(rng.randint(0, 60))
        if d % 2:
            item, piece = items[rng.randrange(30)], rng.randint(3, 8)
            pieces = [item[i : i + piece] for i in range(0, len(item), piece)]
            rng.shuffle(pieces)
            own = own[:10] + [t for p in pieces[: rng.randint(1, len(pieces))] for t in p] + own[10:]
        docs[d] = own
    want = []
    for d, own in docs.items():
        for k, item in items.items():
            tiles = plain_tiles(item, own, min(3, len(item)))
            if sum(n for _, _, n in tiles) >= math.ceil(0.8 * len(item) - 1e-9):
                want.append((d, k, len(tiles)))
    table = lambda rows, name: spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], f"{name} long, text string")
    found = decontamination.find_leaks(table(docs, "doc_id"), table(items, "item_id")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_tiles) for r in found) == sorted(want) and any(n > 2 for _, _, n in want)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_leaks_are_found(spark, hard, empty):
    words = ITEM.split()
    moved = " ".join(words[10:] + ["between"] + words[:10])
    docs = [(1, f"before {ITEM} after"), (2, f"x {moved.upper()}! y"), (3, " ".join(words[:9])), (4, None), (5, ""), (6, ITEM.replace(" ", ", ")), (6, ITEM), (None, ITEM), (7, "short one here"), (8, "beta alpha " * 9)]
    items = [(10, ITEM), (11, "short one"), (12, None), (13, ""), (None, ITEM), (14, "...")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = sorted((str(r.doc_id), r.item_id, r.n_tiles) for r in decontamination.find_leaks(docs, items).collect())
    assert rows == [("1", 10, 1), ("2", 10, 2), ("6", 10, 1), ("6", 10, 1), ("7", 11, 1), ("None", 10, 1)]
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, items).collect()) == [3, 4, 5, 8]
    assert decontamination.find_leaks(hard, items).count() == 0 and decontamination.without_leaks(hard, items).columns == hard.columns
    assert decontamination.find_leaks(empty, items).count() == 0 and decontamination.find_leaks(docs, items.limit(0)).count() == 0


def test_blocks_together_find_what_one_block_finds(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, decontamination.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, decontamination.find_leaks(docs, items).collect())) == one and one
