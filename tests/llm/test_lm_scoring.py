import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import WORD, ascii_lower, morse
from tidebook.llm import lm_scoring
from tidebook.llm.ngram_trie import Trie, build, log10_of, quantise
from tidebook.llm.textkit import fresh_key


def plain_scores(rows, learns):
    """(doc_id, tokens, known, base, score) of each row by counters of words, pairs and triples."""
    words = [(d, WORD.findall(ascii_lower(t or "")) + [None]) for d, t in rows]
    learned = [w for d, w in words if learns(d)]
    count = Counter(x for w in learned for x in w)
    n, v = sum(count.values()), len(count)
    twos, threes, befores = Counter(), Counter(), Counter()
    for w in learned:
        for a, b, c in zip([1, 0] + w, [0] + w, w):
            twos[b, c] += 1
            befores[b] += 1
            if a != 1:
                threes[a, b, c] += 1

    def log10s(a, b, c):
        p = (count[c] + 0.5) / (n + 0.5 * (v + 1))
        base = p
        p = (twos[b, c] + lm_scoring.PAIR * p) / (befores[b] + lm_scoring.PAIR)
        if a != 1:
            p = (threes[a, b, c] + lm_scoring.TRIPLE * p) / (twos[a, b] + lm_scoring.TRIPLE)
        return math.log10(base), math.log10(p)

    out = []
    for d, w in words:
        both = [log10s(a, b, c) for a, b, c in zip([1, 0] + w, [0] + w, w)]
        out.append((d is None, d or 0, len(w), sum(count[x] > 0 for x in w), sum(x for x, _ in both), sum(x for _, x in both)))
    return n, sorted(out)


def check(rows, n, want):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows)
    assert {r.train_tokens for r in rows} == {n}
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and abs(g[5] - w[5]) < 1e-3 * g[2]


def test_scores_equal_a_plain_model(hard, hard_rows):
    n, want = plain_scores([r[:2] for r in hard_rows], lambda d: d is not None and d % 3 != 1)
    check(lm_scoring.score_texts(hard, F.col("doc_id") % 3 != 1, bucket_tokens=500).collect(), n, want)


def test_words_that_weak_hashes_confuse_are_two(spark):
    rows = [(0, f"x {morse[0]}"), (1, f"x {morse[1]}"), (2, f"{morse[0]} {morse[1]} {morse[0]}")]
    n, want = plain_scores(rows, lambda d: d == 0)
    check(lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 0).collect(), n, want)


def test_frequent_contexts_are_split_alike(monkeypatch):
    """The tries of all buckets together answer alike, however contexts are split."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("aaaaabbbcdefgh"), 60)) for _ in range(20)]
    tokens = lm_scoring.Tokens(pa.table({"text": texts, "train": [i % 4 > 0 for i in range(20)]}), fresh_key())
    count = np.bincount(tokens.word[tokens.train], minlength=len(tokens.vocab))
    number = np.argsort(np.argsort(-count)).astype(np.uint64) + np.uint64(1)
    number[tokens.start] = 0
    found = []
    for split in (10**9, 100, 3):
        monkeypatch.setattr(lm_scoring, "SPLIT_CONTEXT", split)
        grams = lm_scoring.Grams(tokens, count, number, 16)
        request = grams.requests(16)
        groups = [pa.table({"chunk": [0], "bucket": [b]} | {c: pa.array([x[i]], pa.binary()) for c, x in request.items() if c != "bucket"}) for i, b in enumerate(request["bucket"])]
        replies = pa.concat_tables([lm_scoring.served(g, 1000.0, 10) for g in groups])
        pair, triple = lm_scoring.answers(replies, 1, "u2", "u2")
        pairs, triples = np.zeros(len(grams.u), np.int64), np.zeros(len(grams.w), np.int64)
        pairs[grams.pairs_asked], triples[grams.triples_by_node] = pair, triple
        times = lambda code: np.where(code > 0, np.rint(10 ** log10_of(code) * 1000 - 0.5), 0)
        assert (times(pairs) == grams.seen_pair).all() and (times(triples) == grams.seen_triple).all()
        found.append((pairs.tolist(), triples.tolist(), len(grams.bucket)))
    assert found[0][:2] == found[1][:2] == found[2][:2] and found[2][2] > found[0][2]


def test_no_training_rows_and_empty_table(hard, empty):
    rows = lm_scoring.score_texts(hard, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in rows)
    assert lm_scoring.score_texts(empty, F.lit(True)).count() == 0


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lm_scoring.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(3)
    bits = 12
    shift, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    first = np.unique(rng.integers(0, 1 << bits, 50).astype(np.uint64))
    pairs = np.unique(rng.integers(0, len(first) - 1, 3000).astype(np.uint64) << shift | rng.integers(0, 1 << bits, 3000).astype(np.uint64))
    triples = np.unique(rng.integers(0, len(pairs), 9000).astype(np.uint64) << shift | rng.integers(0, 1 << bits, 9000).astype(np.uint64))
    pair_codes, triple_codes = (rng.integers(1, 60000, len(x)).astype(np.uint16) for x in (pairs, triples))
    trie = Trie(build(first, pairs, pair_codes, triples, triple_codes, bits))
    assert (trie.find_first(first) == np.arange(len(first))).all() and (trie.find_first(np.setdiff1d(np.arange(1 << bits).astype(np.uint64), first)) == -1).all()
    rank, word = (pairs >> shift).astype(np.int64), pairs & low
    place, codes = trie.find_pair(rank, word)
    assert (place == np.arange(len(pairs))).all() and (codes == pair_codes).all()
    assert (trie.find_triple((triples >> shift).astype(np.int64), triples & low) == triple_codes).all()
    absent = np.setdiff1d(np.arange(len(first) << bits).astype(np.uint64), pairs)
    place, codes = trie.find_pair((absent >> shift).astype(np.int64), absent & low)
    assert (place == -1).all() and (codes == 0).all() and (trie.find_triple(place, absent & low) == 0).all()
    for r in range(len(first)):
        words, codes = trie.successors(r)
        assert (words == word[rank == r]).all() and (codes == pair_codes[rank == r]).all()
    none = Trie(build(*(np.zeros(0, np.uint64),) * 5, bits))
    assert none.find_pair(np.array([0, -1]), np.array([0, 9], np.uint64))[0].tolist() == [-1, -1]
    # a query reads its context's pointers: with those of another trie, the same words are not found
    moved = Trie(build(first, pairs, pair_codes, triples, triple_codes, bits))
    moved.begins, moved.thirds = (Trie(build(first, pairs[:0], pair_codes[:0], triples[:0], triple_codes[:0], bits)).begins,) * 2
    assert (moved.find_pair(rank, word)[0] == -1).all()
    # values are relative to their contexts, so a level spans far less than context << bits
    assert int(trie.triples.at(np.array([len(triples) - 1]))[0]) < len(pairs) << bits and trie.triples.width < bits
    x = np.array([0.0, -1.5, -9.25])
    assert np.abs(log10_of(quantise(x)) - x).max() < 1 / 4096
