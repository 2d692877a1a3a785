import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def _morse(n):
    """A Thue-Morse word of 2**n letters and its complement: alike for every polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


morse = _morse(10)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int, target double, source_size long, _size int, row long, doc string"


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty and blank texts, ties, repeated rows, copies, a very long text, odd characters, clashing columns."""
    rng = random.Random(5)
    vocabulary = [("".join(rng.choice("abcdeÉñß") for _ in range(rng.randint(1, 6)))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(60)
    base = text(200)
    near = base.split()
    near[50] = "changed"
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "one two", base, base, " ".join(near), text(20_000), f"{text(30)} {shared} {text(30)}", f"{shared} {text(10)}", f"{text(5)}\n{shared}", f"{shared} {shared}"]
    texts += ["UPPER upper Upper", "a\x85b\xa0c   d\x1ce ퟿ 中文 😀 é", "<|im_start|> <|endoftext|> it's IT'S we'll 12 34.5 --", "x" * 5000, "0 " * 300_000, "ab" * 300_000]
    texts += [text(rng.randint(1, 80)) for _ in range(30)]
    rows = [(i, t, "en", rng.choice(["s1", "s2", "é", None]), None, "c", 1, 0.5, 7, 7, i, "d") for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((None, base, *(None,) * 10))
    rows.append((None,) * 12)
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
