"""Language-model scores of texts from corpus n-gram counts.

Chunks of documents ask buckets and are answered, twice: for the counts and numbers of their distinct words, and for the
probabilities of their distinct pairs and triples of words.  A bucket builds an Elias-Fano trie of what the training
rows hold and looks the requests of all chunks up in it.  The pairs of a frequent word, and the triples of two frequent
words, are split over buckets by their last word, so no bucket gets all that follows a frequent context; as the trie
holds joint probabilities, no bucket needs the rest of a context.

Model, with N training tokens of V kinds: p1(w) = (c + 0.5) / (N + 0.5 (V + 1)); after words u, v, with counts of the
training rows, p2(w | v) = (c(v w) + PAIR p1(w)) / (c(v) + PAIR) and p3(w | u v) = (c(u v w) + TRIPLE p2(w | v)) / (c(u v) + TRIPLE).
The trie holds (c + 0.5) / (N + 0.5 (V + 1)) of pairs and triples, quantised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm import textkit
from tidebook.llm.ngram_trie import Trie, build, log10_of, quantise
from tidebook.llm.shared import CHUNK_BYTES, bucket_count, chunked, growth, hash_buckets, materialize, pack, squeeze, unblob, unpack, unsqueeze

#: Weights of the lower order in counts, for pairs and triples; of those tried, they scored held-out texts well.
PAIR, TRIPLE = 50.0, 20.0
#: Word tokens that one bucket serves, about.
BUCKET_TOKENS = 700_000
#: Occurrences of a context from which what follows it is split over buckets.
SPLIT_CONTEXT = 100_000
#: Chunks of this operator grow less, as a task holds several numbers for each token of a chunk.
MAX_GROWTH = 4.0

_U = np.uint64
#: Beyond the values that words have before they are mixed.
START, END = textkit.mix(np.array([1 << 63, (1 << 63) + 1], _U))

OUT = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"
REPLY = "chunk long, kind int, bucket long, a binary, b binary"


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value in them; places take 4 bytes, as most memory is theirs."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


class Tokens:
    """The tokens of a chunk: words of each text, then one end.  vocab: sorted distinct hashes, with START."""

    def __init__(self, table: pa.Table, key: int):
        parts, counts = [], []
        for _, _, data, offsets in textkit.slices(table.column("text")):
            words = textkit.Words(data, offsets, lower=True, key=key)
            parts.append(np.insert(words.hash, words.bounds[1:], END))
            counts.append(words.counts + 1)
        self.counts = np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.vocab, place = _distinct(np.concatenate([*parts, [START]]))
        self.word, self.start = place[:-1], int(place[-1])
        self.end = int(np.searchsorted(self.vocab, END))
        train = table.column("train").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        self.train = np.repeat(train, self.counts)


class Grams:
    """The distinct pairs and triples of a chunk whose words are known, as nodes in the order of buckets.

    A node is a pair in one bucket; it asks for the pair itself, or for triples that begin with it, or both.  Words go by
    `local`, their rank among the numbers of the chunk's known words.
    """

    def __init__(self, tokens: Tokens, count: np.ndarray, number: np.ndarray, buckets: int):
        occurs = count.copy()
        occurs[tokens.start] = count[tokens.end]
        known = np.flatnonzero(occurs > 0)
        known = known[np.argsort(number[known])]
        self.number, self.occurs = number[known], occurs[known]
        local = np.full(len(occurs), -1, np.int32)
        local[known] = np.arange(len(known))
        m = np.int64(max(1, len(known)))
        word = local[tokens.word]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[tokens.first] = local[tokens.start]
        self.context = context
        # pairs, and for each token its pair or -1
        at = np.flatnonzero((word >= 0) & (context >= 0)).astype(np.int32)
        pairs, inverse = _distinct(context[at] * m + word[at])
        self.pair = np.full(len(word), -1, np.int32)
        self.pair[at] = inverse
        self.seen_pair = np.bincount(inverse[tokens.train[at]], minlength=len(pairs))
        self.u, self.v = (pairs // m).astype(np.int32), (pairs % m).astype(np.int32)
        del pairs, inverse
        # triples: the pair that ends before a token, and the token
        before = np.empty_like(self.pair)
        before[1:] = self.pair[:-1]
        before[tokens.first] = -1
        self.before = before
        at = np.flatnonzero((word >= 0) & (before >= 0)).astype(np.int32)
        triples, inverse = _distinct(before[at] * m + word[at])
        self.triple = np.full(len(word), -1, np.int32)
        self.triple[at] = inverse
        self.seen_triple = np.bincount(inverse[tokens.train[at]], minlength=len(triples))
        prefix, self.w = (triples // m).astype(np.int32), (triples % m).astype(np.int32)
        del triples, inverse, at, word
        # buckets
        spread = textkit.mix(self.number + _U(1))
        parts = -(-self.occurs[self.u] // SPLIT_CONTEXT)
        part = (spread[self.v] % parts.astype(_U)) * (parts > 1)
        pair_bucket = hash_buckets(textkit.mix(spread[self.u] + part), buckets).astype(np.int64)
        parts = -(-np.minimum(self.occurs[self.u], self.occurs[self.v]) // SPLIT_CONTEXT)[prefix]
        triple_bucket = pair_bucket[prefix]
        split = np.flatnonzero(parts > 1)
        both = textkit.mix(spread[self.u[prefix[split]]] ^ textkit.mix(spread[self.v[prefix[split]]]))
        triple_bucket[split] = hash_buckets(textkit.mix(both + spread[self.w[split]] % parts[split].astype(_U)), buckets)
        # nodes
        n = max(1, len(self.u))
        del parts, part, split, both, spread
        nodes, place = _distinct(np.concatenate([pair_bucket * n + np.arange(len(self.u)), triple_bucket * n + prefix]))
        del pair_bucket, triple_bucket, prefix
        self.bucket, self.of = (nodes // n).astype(np.int32), (nodes % n).astype(np.int32)
        self.asks_pair = np.zeros(len(nodes), bool)
        self.asks_pair[place[: len(self.u)]] = True
        node = place[len(self.u) :]
        self.triples_by_node = np.argsort(node, kind="stable").astype(np.int32)
        self.per_node = np.bincount(node, minlength=len(nodes))
        #: pairs and triples in the order in which they are asked for
        self.pairs_asked = self.of[self.asks_pair]

    def requests(self, buckets: int) -> dict[str, list]:
        """Per bucket that is asked: first words with their numbers of nodes, second words, flags, counts, third words."""
        cut = np.searchsorted(self.bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        ends = np.concatenate([[0], np.cumsum(self.per_node)])
        pairs_before = np.concatenate([[0], np.cumsum(self.asks_pair)])
        u, v = self.u[self.of], self.number[self.v[self.of]]
        seen_pair = self.seen_pair[self.pairs_asked].astype("u4")
        w, seen = self.number[self.w[self.triples_by_node]], self.seen_triple[self.triples_by_node].astype("u4")
        out: dict[str, list] = {"bucket": full.tolist()} | {c: [] for c in ("u", "nodes", "v", "flags", "seen_pair", "per_node", "w", "seen_triple")}
        for i in full:
            a, b = cut[i], cut[i + 1]
            first = np.flatnonzero(np.concatenate([[True], u[a + 1 : b] != u[a : b - 1]]))
            step = v[a:b].copy()
            step[1:] -= np.where(u[a + 1 : b] == u[a : b - 1], v[a : b - 1], _U(0))
            fields = {
                "u": self.number[u[a:b][first]], "nodes": np.diff(np.append(first, b - a)).astype("u4"), "v": step, "flags": np.packbits(self.asks_pair[a:b]),
                "seen_pair": seen_pair[pairs_before[a] : pairs_before[b]], "per_node": self.per_node[a:b].astype("u4"), "w": w[ends[a] : ends[b]], "seen_triple": seen[ends[a] : ends[b]],
            }
            for name, values in fields.items():
                out[name].append(squeeze(values))
        return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the places of all keys in them, and sums of counts."""
    values, place = _distinct(keys)
    return values, place, np.bincount(place, counts, len(values)).astype(np.int64)


def served(group: pa.Table, total: float, bits: int) -> pa.Table:
    """Answers of one bucket: builds the trie of the counts that the chunks send and looks up what they ask for."""
    kinds = {"u": "u8", "nodes": "u4", "v": "u8", "flags": "u1", "seen_pair": "u4", "per_node": "u4", "w": "u8", "seen_triple": "u4"}
    parts = {c: [unsqueeze(x, k) for x in group.column(c).to_pylist()] for c, k in kinds.items()}
    us, vs, asks = [], [], []
    for u, nodes, step, flags in zip(*(parts[c] for c in ("u", "nodes", "v", "flags")), strict=True):
        first = np.cumsum(nodes) - nodes
        run = np.cumsum(step)  # wraps around where a word's numbers begin anew
        us.append(np.repeat(u, nodes))
        vs.append(run - np.repeat(run[first] - step[first], nodes))
        asks.append(np.unpackbits(flags, count=len(step)).astype(bool))
    u, v, asked = np.concatenate(us), np.concatenate(vs), np.concatenate(asks)
    per_node, w, seen_triple = (np.concatenate(parts[c]) for c in ("per_node", "w", "seen_triple"))
    seen = np.zeros(len(u), np.int64)
    seen[asked] = np.concatenate(parts["seen_pair"])
    shift = _U(bits)
    first, rank = _distinct(u)
    keys, node, pair_counts = _summed(rank.astype(_U) << shift | v, seen)
    ask_keys, ask, triple_counts = _summed(np.repeat(node, per_node).astype(_U) << shift | w, seen_triple)
    # what the training rows hold: first words, pairs (also those that only triples begin with), triples
    held_triple = triple_counts > 0
    held = pair_counts > 0
    held[(ask_keys[held_triple] >> shift).astype(np.int64)] = True
    place = np.cumsum(held) - 1
    first_rank = (keys >> shift).astype(np.int64)
    has_first = np.zeros(len(first), bool)
    has_first[first_rank[held]] = True
    first_place = (np.cumsum(has_first) - 1).astype(_U)
    low = _U((1 << bits) - 1)
    pairs = first_place[first_rank[held]] << shift | (keys[held] & low)
    triples = place[(ask_keys[held_triple] >> shift).astype(np.int64)].astype(_U) << shift | (ask_keys[held_triple] & low)
    code = lambda n: np.where(n > 0, quantise(np.log10((n + 0.5) / total)), 0).astype(np.uint16)
    trie = Trie(build(first[has_first], pairs, code(pair_counts[held]), triples, code(triple_counts[held_triple]), bits))
    # every distinct pair and triple is looked up once
    pair_place, pair_code = trie.find_pair(trie.find_first(first)[first_rank], keys & low)
    triple_code = trie.find_triple(pair_place[(ask_keys >> shift).astype(np.int64)], ask_keys & low)
    pair_answers, triple_answers = pair_code[node[asked]], triple_code[ask]
    pair_ends, triple_ends = np.cumsum([len(x) for x in parts["seen_pair"]]), np.cumsum([len(x) for x in parts["w"]])
    a, b = (
        [squeeze(values[e - len(x) : e]) for e, x in zip(ends, sizes, strict=True)]
        for values, ends, sizes in ((pair_answers, pair_ends, parts["seen_pair"]), (triple_answers, triple_ends, parts["w"]))
    )
    return pa.table({"chunk": group.column("chunk"), "kind": pa.array([1] * len(a), pa.int32()), "bucket": group.column("bucket"), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def answers(replies: pa.Table, kind: int, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """What the buckets answered to a chunk, bucket after bucket."""
    rows = sorted((r for r in replies.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    return tuple(np.concatenate([np.zeros(0, k), *(unsqueeze(r[c], k) for r in rows)]) for c, k in (("a", a), ("b", b)))


def score_texts(docs: DataFrame, train: Column, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per input row: doc_id, train, n_tokens, n_known, base_score, score, train_tokens.

    The model learns from the rows where `train` is true (null: false) and scores all.  Words are lower-cased in
    A-Z; a null or empty text is one end token.  base_score is the unigram model's log10 probability, score the
    whole model's.  With no training rows all words are unknown.  Equal or null ids are no trouble.
    """
    spark = docs.sparkSession
    key, factor = textkit.fresh_key(), growth(docs, MAX_GROWTH)
    chunks = chunked(docs, int(CHUNK_BYTES * factor), train=F.coalesce(train, F.lit(False)))
    total = chunks.agg(F.sum(F.col("words") + F.col("docs"))).first()[0] or 0
    buckets = bucket_count(spark, total, int(bucket_tokens * factor))
    edges = np.arange(buckets + 1)
    blobs = chunks.select("chunk", "blob")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                tokens = Tokens(unblob(blob.as_py()), key)
                count = np.bincount(tokens.word[tokens.train], minlength=len(tokens.vocab)).astype("u4")
                cut = np.searchsorted(hash_buckets(tokens.vocab, buckets), edges)
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(full), chunk), pa.int64()), pa.array(full, pa.int64()), *(pa.array([pack(x[cut[i] : cut[i + 1]]) for i in full], pa.binary()) for x in (tokens.vocab, count))],
                    ["chunk", "bucket", "words", "counts"],
                )

    def sum_words(group: pa.Table) -> pa.Table:
        """Counts of the words of a bucket, and numbers: frequent words have small ones, START has 0."""
        words = [unpack(x, "u8") for x in group.column("words").to_pylist()]
        counts = np.concatenate([unpack(x, "u4") for x in group.column("counts").to_pylist()])
        distinct, place, sums = _summed(np.concatenate(words), counts)
        number = np.empty(len(distinct), _U)
        number[np.lexsort((distinct, -sums))] = np.arange(len(distinct), dtype=_U) * _U(buckets) + _U(group.column("bucket")[0].as_py() + 1)
        number[distinct == START] = 0
        ends, rows = np.cumsum([len(x) for x in words]), len(words)
        a, b = ([squeeze(x[place[e - len(own) : e]]) for e, own in zip(ends, words, strict=True)] for x in (sums.astype("u8"), number))
        once = lambda x: pa.array([int(x), *[0] * (rows - 1)], pa.int64())
        return pa.table(
            {
                "chunk": group.column("chunk"), "kind": pa.array([0] * rows, pa.int32()), "bucket": group.column("bucket"), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()),
                "n": once(sums.sum()), "v": once((sums > 0).sum()), "top": once(number[sums > 0].max() if sums.any() else 0),
            }
        )

    asked = blobs.mapInArrow(ask_words, "chunk long, bucket long, words binary, counts binary")
    vocab = materialize(asked.groupBy("bucket").applyInArrow(sum_words, f"{REPLY}, n long, v long, top long"), "vocabulary")
    n, v, top = (x or 0 for x in vocab.agg(F.sum("n"), F.sum("v"), F.max("top")).first())
    vocab = vocab.drop("n", "v", "top")
    bits, mass = max(1, top.bit_length()), n + 0.5 * (v + 1)

    def grams(table: pa.Table, replies: pa.Table) -> tuple[Tokens, np.ndarray, Grams]:
        tokens = Tokens(table, key)
        count, number = answers(replies, 0, "u8", "u8")
        if len(count) != len(tokens.vocab):
            raise RuntimeError("the answers do not fit the chunk")
        count = count.astype(np.int64)
        return tokens, count, Grams(tokens, count, number, buckets)

    def ask_grams(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for own, blob in zip(chunk.column("chunk").to_pylist(), chunk.column("blob").to_pylist(), strict=True):
            request = grams(unblob(blob), replies)[2].requests(buckets)
            full = request.pop("bucket")
            fields = {c: pa.array(x, pa.binary()) for c, x in request.items()}
            out.append(pa.table({"chunk": pa.array([own] * len(full), pa.int64()), "bucket": pa.array(full, pa.int64())} | fields))
        return pa.concat_tables(out)

    def look_up(group: pa.Table) -> pa.Table:
        return served(group, mass, bits)

    def score(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for blob in chunk.column("blob").to_pylist():
            table = unblob(blob)
            tokens, count, own = grams(table, replies)
            pair_code, triple_code = answers(replies, 1, "u2", "u2")
            if len(pair_code) != len(own.pairs_asked) or len(triple_code) != len(own.w):
                raise RuntimeError("the answers do not fit the chunk")
            times = lambda code: np.where(code > 0, np.maximum(10 ** log10_of(code) * mass - 0.5, 0), 0)
            pairs, triples = np.zeros(len(own.u) + 1), np.zeros(len(own.w) + 1)  # the last entry answers for -1
            pairs[own.pairs_asked] = times(pair_code)
            triples[own.triples_by_node] = times(triple_code)
            base = (count[tokens.word] + 0.5) / mass
            context = np.where(own.context >= 0, np.append(own.occurs, 0)[own.context], 0)
            p = (pairs[own.pair] + PAIR * base) / (context + PAIR)
            p = (triples[own.triple] + TRIPLE * p) / (pairs[own.before] + TRIPLE)
            add = lambda x: np.add.reduceat(x, tokens.first)
            out.append(
                pa.table(
                    {
                        "doc_id": table.column("doc_id"), "train": table.column("train"), "n_tokens": pa.array(tokens.counts, pa.int64()),
                        "n_known": pa.array(add((count > 0).astype(np.int64)[tokens.word]), pa.int64()),
                        "base_score": pa.array(add(np.log10(base))), "score": pa.array(add(np.log10(p))),
                    }
                )
            )
        return pa.concat_tables(out)

    fields = "chunk long, bucket long, u binary, nodes binary, v binary, flags binary, seen_pair binary, per_node binary, w binary, seen_triple binary"
    by_chunk = lambda df: df.groupBy("chunk")
    requests = by_chunk(blobs).cogroup(by_chunk(vocab)).applyInArrow(ask_grams, fields)
    replies = requests.groupBy("bucket").applyInArrow(look_up, REPLY)
    scored = by_chunk(blobs).cogroup(by_chunk(vocab.unionByName(replies))).applyInArrow(score, OUT)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of whole `documents` by a model of those whose crc32(doc_id as text) mod 5 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    out = score_texts(docs, ~F.coalesce(held_out, F.lit(False)))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
