"""Secret scans: patterns over whole texts, and a guess-cost model for values in credential contexts.

The model knows the words that guessers try first and, after them, those that stand in most documents of the corpus; both
in the order of their ranks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import textkit
from tidebook.llm.shared import materialize

KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Credential contexts beyond the fixed ones: more names, and any value without white space or quotes.
_CONTEXT = re.compile(r"""(?<![a-z0-9])(pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|auth|credentials?|access_?key|private_?key)["']?\x20*[:=]\x20*["']?([^\s"'<>]+)""", re.IGNORECASE | re.ASCII)
_NAMES = (b"pass", b"pwd", b"secret", b"token", b"api", b"auth", b"credential", b"key")

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True

#: Values from this many log10 guesses on count as secrets.
MIN_LOG10_GUESSES = 8.0

# Words that guessers try first, most common first.
WORDS = (
    "password admin welcome login master dragon monkey letmein football baseball shadow sunshine princess "
    "secret test user root guest default changeme hello love money freedom whatever trustno hunter summer "
    "winter spring autumn qwerty iloveyou superman batman computer internet server system public private "
    "example sample demo temp token access service account office company house family flower cookie orange "
    "purple silver golden black white green yellow blue red star light night power magic tiger eagle"
).split()
_LEET = str.maketrans("013457@$!", "oieastasi")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
# Rows of a keyboard; each is set half a key to the right of the one above.
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")


def _neighbours() -> dict[tuple[str, str], tuple[int, int]]:
    """The direction from a key to each key beside it, slanted rows taken into account."""
    at = {key: (r, c) for r, row in enumerate(_ROWS) for c, key in enumerate(row)}
    steps = ((0, 1), (0, -1), (-1, 0), (-1, 1), (1, -1), (1, 0))
    return {(a, b): (x[0] - r, x[1] - c) for a, (r, c) in at.items() for b, x in at.items() if (x[0] - r, x[1] - c) in steps}


_NEXT = _neighbours()
#: Keys that a walk may start from, and directions that it may take at each turn.
_KEYS, _WAYS = sum(map(len, _ROWS)), 4.5

#: Words of the corpus that the model knows, and documents that each must stand in at least.
CORPUS_WORDS, LEAST_DOCUMENTS = 20_000, 20
_LONGEST = 20
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123)]] = False


def ranks_of(words: list[str]) -> dict[str, int]:
    """Rank of each word: first WORDS, then the others in order."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}


_RANK = ranks_of([])
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


def _pool(c: str) -> float:
    """log10 of the characters a guesser tries in a brute-force place."""
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


def spans_of(value: str, ranks: dict[str, int] = _RANK) -> Iterator[tuple[int, int, float]]:
    """Spans that are cheaper to guess than by brute force: start, end, log10 of the guesses."""
    low = value.lower()
    plain = low.translate(_LEET)
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + _LONGEST) + 1):
            if rank := ranks.get(plain[i:j]):
                variants = (2 if value[i:j] != low[i:j] else 1) * (4 if low[i:j] != plain[i:j] else 1)
                yield i, j, math.log10(rank * variants)
        if m := _DATE.match(value, i):
            yield i, m.end(), math.log10(120 * (365 if m.end() - i > 4 else 1))
    i = 0
    while i < len(value):
        j = i + 1
        while j < len(value) and value[j] == value[i]:
            j += 1
        if j - i >= 3:
            yield i, j, _pool(value[i]) + math.log10(j - i)
        i = j
    i = 0
    while i < len(value) - 1:
        j, turns, way = i + 1, 0, None
        while j < len(value) and (step := _NEXT.get((low[j - 1], low[j]))):
            turns += step != way
            j, way = j + 1, step
        if j - i >= 3:
            yield i, j, math.log10(_KEYS * (j - i)) + turns * math.log10(_WAYS)
        i = max(j - 1, i + 1)
    for sign in (1, -1):
        i = 0
        while i < len(value) - 1:
            j = i + 1
            while j < len(value) and low[j] in _ALPHABET and ord(low[j]) - ord(low[j - 1]) == sign:
                j += 1
            if j - i >= 3:
                yield i, j, math.log10(2 * len(_ALPHABET) * (j - i))
            i = max(j - 1, i + 1)
    for size in (2, 3, 4):
        i = 0
        while i + 2 * size <= len(value):
            j = i + size
            while value[j : j + size] == value[i : i + size] and len(value[j : j + size]) == size:
                j += size
            if j - i >= 2 * size and len(set(value[i : i + size])) > 1:
                yield i, j, sum(map(_pool, value[i : i + size])) + math.log10((j - i) // size)
                i = j
            else:
                i += 1


def log10_guesses(value: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the least guesses over all segmentations of a value into words, dates, repeats, keyboard walks and
    brute-force spans; each change of segment doubles the guesses."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in spans_of(value, ranks):
        ends.setdefault(j, []).append((i, cost))
    turn = math.log10(2)
    free, brute = [0.0] * (len(value) + 1), [0.0] + [math.inf] * len(value)  # least cost, and of those that end in brute force
    for j in range(1, len(value) + 1):
        brute[j] = _pool(value[j - 1]) + min(brute[j - 1], free[j - 1] + turn * (j > 1))
        free[j] = min([brute[j], *(free[i] + cost + turn * (i > 0) for i, cost in ends.get(j, ()))])
    return free[-1]


def scan(text: str, ranks: dict[str, int] = _RANK) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text by start, then kind: (kind, start, end, log10 guesses of the value or None)."""
    found: list[tuple[str, int, int, float | None]] = []
    values = {}
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            found.append(("assign", m.start(), m.end(), log10_guesses(m[2], ranks)))
            values[m.start(2)] = m.end(2)
    found += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    at = 0
    while m := _CONTEXT.search(text, at):
        at = m.end()
        if values.get(m.start(2)) != m.end(2):
            if (cost := log10_guesses(m[2], ranks)) >= MIN_LOG10_GUESSES:
                found.append(("guess", m.start(2), m.end(2), cost))
            else:  # a cheap value may be the name of the next context
                at = m.start(2)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold a span: a credential name, AKIA, or 16 hexadecimal digits in a row."""
    low = textkit._LOWER[data].tobytes()
    out = np.zeros(len(offsets) - 1, bool)
    is_hex = np.concatenate([[False], _HEX_BYTE[data], [False]]).astype(np.int8)
    flips = np.flatnonzero(np.diff(is_hex))
    long_ = flips[::2][flips[1::2] - flips[::2] >= 16]
    ends = flips[1::2][flips[1::2] - flips[::2] >= 16]
    for a, b in zip(np.searchsorted(offsets, long_, "right") - 1, np.searchsorted(offsets, ends, "left"), strict=True):
        out[a:b] = True
    for name in (*_NAMES, b"akia"):
        at = low.find(name)
        while at >= 0:
            i = int(np.searchsorted(offsets, at, "right")) - 1
            out[i] = True
            at = low.find(name, max(at + 1, int(offsets[i + 1]) - len(name) + 1))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())])


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS, least: int = LEAST_DOCUMENTS) -> list[str]:
    """The words (3 to 20 letters A-Z, lower-cased) that stand in most documents, the most frequent first; ties by name.

    All documents are counted, but those in which a credential or a long hexadecimal number may stand: the words of secrets
    must not make them cheap.  A word stands in `least` documents or more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for _, _, data, offsets in textkit.slices(batch.column("text")):
                words = textkit.Words(data, offsets, lower=True, separators=_NO_LETTER)
                size = words.end - words.start
                text = np.repeat(np.arange(len(offsets) - 1), words.counts)
                own = np.flatnonzero((size >= 3) & (size <= _LONGEST) & ~suspects(data, offsets)[text])
                if not len(own):
                    continue
                hashes = words.hash[own]
                order = np.lexsort((text[own], hashes))
                h, t = hashes[order], text[own][order]
                new_word = np.concatenate([[True], h[1:] != h[:-1]])
                new_text = new_word | np.concatenate([[True], t[1:] != t[:-1]])
                n = np.bincount(np.cumsum(new_word) - 1, new_text).astype(np.int64)
                first = own[order[new_word]]
                for a, b, times in zip(words.start[first].tolist(), words.end[first].tolist(), n.tolist(), strict=True):
                    word = words.data[a:b].tobytes()
                    seen[word] = seen.get(word, 0) + times
            if len(seen) > 200_000:
                yield flush()
        if seen:
            yield flush()

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    counted = materialize(parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "corpus-words")
    # the count that the last word has, so that little more than `most` words are put in order
    levels = counted.groupBy("n").agg(F.count("*").alias("words")).withColumn("above", F.sum("words").over(Window.orderBy(F.desc("n"))) - F.col("words"))
    last = levels.filter(F.col("above") < most).agg(F.min("n")).first()[0]
    return [r.word for r in counted.filter(F.col("n") >= (last or 0)).orderBy(F.desc("n"), "word").limit(most).collect()]


def find_secrets(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id and secrets, an array of (kind, start, end, log10_guesses) with positions in code points, end exclusive.

    Kinds: assign (a credential name with a value of 12 or more), access (key ids), hex (16 or more digits), and
    guess: other values in credential contexts that take 10**8 guesses or more.  words: what the guess-cost model knows
    besides WORDS, most common first; corpus_words(docs) if none are given.  Null and empty texts have no secrets.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_of(corpus_words(docs) if words is None else words))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = []
            for first, end, data, offsets in textkit.slices(batch.column("text")):
                maybe = suspects(data, offsets)
                for i in range(end - first):
                    spans = scan(data[offsets[i] : offsets[i + 1]].tobytes().decode(), ranks.value) if maybe[i] else []
                    found.append([dict(zip(("kind", "start", "end", "log10_guesses"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(SPAN))], ["doc_id", "secrets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, secrets array<struct<kind:string,start:int,end:int,log10_guesses:double>>")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in whole `documents`: counts of the base kinds, a digest of their spans, and all spans."""
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("guess").alias("n_guess"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )
