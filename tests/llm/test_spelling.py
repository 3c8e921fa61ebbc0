"""Spelling variants against edits tried one by one."""

import collections
import random
import zlib

import numpy as np
import pytest

from lodestream.llm import spelling

DOC = "doc_id long, text string, n string, word int"


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(counts, times=10):
    out = {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o.encode()), default=None)
        form = best if best is not None and n > 0 and counts[best] >= times * n else None
        out[w] = (form, n, len(others), counts[form] if form is not None else None)
    rows = set()
    for w, (form, n, k, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, k, form_n))
    return rows


def some_words(rng):
    """Words of few letters and their misspellings, anagrams, other scripts, and letters that share a column."""
    base = ["".join(rng.choice("abcdeéçÿz") for _ in range(rng.randrange(1, 9))) for _ in range(120)] + ["слово", "слова", "словa", "語", "語語", "", "a" * 3000, "a" * 3001, "b" + "a" * 2999, "À" * 7, "Æ" * 7, "ÀÀÀÀÀÀÆ"]
    words = dict.fromkeys(base)
    for w in base[:60]:
        i = rng.randrange(len(w) + 1)
        words |= dict.fromkeys([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÆ") + w[i:], w[:i] + rng.choice("xyÀ") + w[i + 1 :], "".join(reversed(w))])
    return {w: rng.choice([1, 2, 9, 10, 25, 100, 1000, 10_000]) for w in words}


@pytest.mark.parametrize("classes", [None, 2, 5])
def test_variants(spark, classes, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 7)
    monkeypatch.setattr(spelling, "CELLS", 50)
    counts = some_words(random.Random(classes or 0))
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
    got = spelling.group_variants(rows, classes=classes).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == plain(counts)


def test_nulls_repeats_and_empty_input(spark):
    rows = [("walking", 30), ("walking", 30), ("walkin", 6), ("walkng", None), (None, 5), ("talking", 60)]
    got = {tuple(r) for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == plain({"walking": 60, "walkin": 6, "walkng": 0, "talking": 60})
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_a_block_of_most_words_is_cut_into_tiles(spark):
    """Words of one block: the same letters, each word near the one with its first letter replaced by the other of its class."""
    words = sorted({"".join(random.Random(i).sample("abcdefgh" * 2, 8)) for i in range(6000)})
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = collections.Counter(r["word"] for r in spelling.links(rows, classes=2).select("word").collect())
    have = set(words)
    want = {w: sum(w[:i] + c + w[i + 1 :] in have for i in range(8) for c in "abcdefgh" if c != w[i]) for w in random.Random(1).sample(words, 300)}
    assert all(got[w] == k for w, k in want.items())


def test_gram_distances_never_exceed_two_for_one_edit():
    rng = np.random.default_rng(1)
    for _ in range(200):
        w = rng.choice([97, 98, 233, 255, 1078, 122], rng.integers(1, 12))
        i = rng.integers(len(w))
        for other in (np.insert(w, i, 224), np.where(np.arange(len(w)) == i, 65, w)):
            d = spelling.letter_counts(w[None]) - spelling.letter_counts(other[None])
            assert (d * d).sum() <= 2


def test_typed_words(spark):
    rng = random.Random(4)
    texts = [None, "", "short", "Éclairage ÉCLAIRAGE éclairage-wörterbuch", "x" * 100_000, "ABCDEFG abcdefg", "naïveté×fünfzig"] + [" ".join("".join(rng.choice("abcdefÀé") for _ in range(rng.randrange(5, 12))) for _ in range(50)) for _ in range(60)]
    rows = [(i if i != 5 else None, t, "n", 1) for i, t in enumerate(texts)]
    rows.append(rows[3])
    want = collections.Counter()
    import re

    for i, t, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            want[w] += len(w) >= 7
    got = {r["word"]: r["n"] for r in spelling.typed_words(spark.createDataFrame(rows, DOC)).collect()}
    assert got == +want
