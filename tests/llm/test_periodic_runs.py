import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import WORD
from tidebook.llm.periodic_runs import WaveletTree, find_runs, op11_periodic_runs, runs_of


def plain_runs(words):
    """(start, length, period) by comparing words at every distance."""
    out = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.add((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_runs_of_many_small_sequences():
    rng = random.Random(2)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(0, 5)):
            words = []
            while len(words) < rng.randint(0, 60):
                unit = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 9))]
                words += (unit * 9)[: rng.randint(1, 6 * len(unit))]
            docs.append(words)
        bounds = np.cumsum([0] + [len(d) for d in docs])
        got = np.stack(runs_of(np.array(sum(docs, []), np.int64), bounds)).T.tolist()
        assert got == [[int(bounds[i]) + s, n, q] for i, d in enumerate(docs) for s, n, q in plain_runs(d)]


def test_range_successor():
    values = np.random.default_rng(3).permutation(77)
    tree = WaveletTree(values)
    left, right = np.array([0, 5, 30, 76, 10]), np.array([77, 40, 31, 77, 10])
    for bound in (0, 1, 50, 76, 77):
        assert tree.below(left, right, np.full(5, bound)).tolist() == [int((values[a:b] < bound).sum()) for a, b in zip(left, right)]
    for a, b in zip(left[:4], right[:4]):
        ranks = np.arange(b - a)
        assert tree.smallest(np.full(b - a, a), np.full(b - a, b), ranks).tolist() == sorted(values[a:b])


def test_equals_brute_force(hard, hard_rows):
    got = {}
    for r in find_runs(hard).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed))
    for doc_id, text, *_ in hard_rows:
        words = WORD.findall(text or "")
        if len(words) > 50_000:  # 300,000 times the same word
            assert got[doc_id] == [(len(words), [(0, len(words), 1)], "0")]
            continue
        runs = plain_runs(words) if len(words) < 2000 else []
        assert (len(words), runs, plain_collapse(words, runs)) in got[doc_id]
    assert sum(map(len, got.values())) == len(hard_rows)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 120))) for _ in range(150)] + [None, "", " \t ", "x " * 40 + "y x y x y x y x"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 1), (None, "z " * 9, None, None), (-5, "q r " * 12, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, g int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in op11_periodic_runs(spark, str(tmp_path)).collect())
    want = []
    for doc_id, text, *_ in rows:
        words = plain_tail(doc_id, WORD.findall(text or ""))
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want.append((doc_id is None, doc_id or 0, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapse(words, runs))))
    assert got == sorted(want)
    assert sum(w[2] > 0 for w in want) >= 10


def test_empty_table_and_bad_parameters(empty):
    assert find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        find_runs(empty, 6, 3)
    with pytest.raises(ValueError):
        find_runs(empty, 5, 4)
