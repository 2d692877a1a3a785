from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import WORD, morse
from tidebook.llm.substring_dedup import Repeats, remove_repeats
from tidebook.llm.textkit import fresh_key


def plain(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window,bucket", [(35, 2_000_000), (3, 50), (1, 10)])
def test_equals_brute_force(hard, hard_rows, window, bucket):
    rows = remove_repeats(hard, window, bucket).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, sum(s.end - s.start for s in r.removed), r.kept_text) for r in rows)
    want = sorted((r[0] is None, r[0] or 0, *p) for r, p in zip(hard_rows, plain([r[1] for r in hard_rows], window)))
    assert got == want


def test_intervals_are_maximal_and_disjoint(hard):
    for r in remove_repeats(hard, 5).collect():
        spans = [(s.start, s.end) for s in r.removed]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:])) and all(a < b for a, b in spans)


def test_empty_table_and_bad_window(empty):
    assert remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(empty, 0)


def test_only_null_texts(spark):
    rows = remove_repeats(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).collect()
    assert [(r.n_words, r.kept_text) for r in rows] == [(0, "")] * 3


def test_words_that_weak_hashes_confuse(spark):
    same = " ".join(f"w{i}" for i in range(34))
    rows = remove_repeats(spark.createDataFrame([(i, f"{same} {w}") for i, w in enumerate(morse)], "doc_id long, text string")).collect()
    assert [len(r.removed) for r in rows] == [0, 0]


def test_a_long_repetitive_text(spark):
    rows = remove_repeats(spark.createDataFrame([(1, "0 " * 500_000), (2, "0 " * 34)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed)) for r in rows) == [(1, 500_000, 500_000), (2, 34, 0)]


def test_second_hashes_tell_windows_apart():
    texts = ["a b c a b c x", "b c a q", None, "a b c"]
    table = pa.table({"text": texts})
    repeats = Repeats(table, 2, (fresh_key(), fresh_key()))
    everything = [tuple(t.split()[i : i + 2]) for t in texts if t for i in range(len(t.split()) - 1)]
    counts = Counter(everything)
    hit = np.ones(len(everything), bool)
    first, second, twice, pair = repeats.seconds(hit)
    assert len(first) == len(counts) == len(set(zip(first.tolist(), second.tolist())))
    assert [bool(twice[p]) for p in pair] == [counts[w] > 1 for w in everything]
    hit = repeats.first_answers(np.zeros(int((~repeats.twice).sum()), bool))
    assert hit.tolist() == [counts[w] > 1 for w in everything]
    *_, twice, pair = repeats.seconds(hit)
    assert twice[pair].all() and len(pair) == hit.sum()
