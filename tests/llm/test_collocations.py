"""Collocations against counting by dictionaries, and the summaries against their guarantee."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestream.llm import collocations as co

DOC = "doc_id long, text string, lang string, phrase int, n int"


def counts_of(rows, longest):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, longest=3, least=10, most=2000):
    f, n = counts_of(rows, longest)
    out = set()
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if a >= least and " " in p}
        kept = []
        for p, a in cands.items():
            w = p.split(" ")
            score, _, l, r = min((1_000_000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k, c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w)))
            if not any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= 50 * a for q, b in cands.items()):
                kept.append((-score, -a, p.encode(), l, r))
        out |= {(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1)}
    return out


def some_rows(seed, size=400):
    rng = random.Random(seed)
    words = ["new", "york", "New", "city", "is", "a", "the", "é", "É", "中文", "\x00", "\x1c", " ", "it's"]
    seps = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", "\r", "!", " ? "]
    rows = [(rng.choice(["en", "en", "en", "fr", None]), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(30)))) for _ in range(size)]
    return rows + [("en", None), (None, ""), ("fr", " \t.,"), ("", "a b a b " * 9), ("en", "new york " * 30_000), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0, 0) for i, (lang, t) in enumerate(rows)], DOC)


@pytest.mark.parametrize(("longest", "least", "most"), [(3, 10, 2000), (3, 40, 5), (2, 10, 7), (4, 12, 2000)])
def test_collocations(spark, longest, least, most):
    rows = some_rows(longest)
    got = co.collocations(frame(spark, rows), longest=longest, least=least, most=most).collect()
    assert {tuple(r) for r in got} == plain(rows, longest, least, most) and len({(r["lang"], r["rank"]) for r in got}) == len(got)


def test_small_batches_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(co, "BATCH_BYTES", 300)
    monkeypatch.setattr(co, "PART_BYTES", 5_000)
    monkeypatch.setattr(co, "ROWS", 7)
    monkeypatch.setattr(co, "TASKS", 3)
    rows = some_rows(9, 250)
    f, n = counts_of(rows, 3)
    got = {(r["lang"], r["phrase"]): r["f"] for r in co.frequent_phrases(frame(spark, rows)).collect()}
    assert got == {(lang, p): k for lang, c in f.items() for p, k in [*c.items(), ("", n[lang])] if k >= 10}


def test_empty_table(spark):
    assert co.collocations(frame(spark, [])).collect() == []
    assert co.collocations(frame(spark, [("en", None), ("en", "once upon a time")])).collect() == []


def test_scores_pass_64_bits(spark):
    """1000000 a a is over 2^63 from 3,037,001 occurrences on."""
    text = "x y " * 400_000
    rows = [("en", text.strip() + ".")] * 8 + [("en", "x. y. " * 50_000)]
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in co.collocations(frame(spark, rows), longest=2).collect()}
    a, l = 3_200_000, 3_250_000
    assert got["x y"] == (a, l, l, 1_000_000 * a * a // (l * l))


def test_summaries_keep_what_is_frequent_however_they_are_merged():
    rng = random.Random(7)
    for _ in range(60):
        stream = [rng.choice("abcdefghij" if rng.random() < 0.5 else [f"r{i}" for i in range(300)]) for _ in range(rng.randrange(1, 900))]
        cuts = sorted(rng.randrange(len(stream) + 1) for _ in range(6))
        size = rng.choice([1, 3, 20, len(stream) // 10 + 1])
        some = []
        for a, z in zip([0, *cuts], [*cuts, len(stream)], strict=True):
            c = collections.Counter(stream[a:z])
            one = co.MisraGries(size)
            one.merge(pa.table({"phrase": pa.array(list(c), pa.large_string()), "n": pa.array(list(c.values()), pa.int64())}))
            some.append(one)
        rng.shuffle(some)
        while len(some) > 1:
            a, b = some.pop(), some.pop()
            a.merge(b.table)
            some.insert(0, a)
        left = dict(zip(some[0].table.column("phrase").to_pylist(), some[0].table.column("n").to_pylist(), strict=True))
        true = collections.Counter(stream)
        assert len(left) <= size
        assert all(0 <= k - left.get(p, 0) <= len(stream) / (size + 1) for p, k in true.items())


def test_exact_counts_drop_nothing_frequent():
    rng = np.random.default_rng(3)
    blobs, true = [], collections.Counter()
    for _ in range(40):
        c = collections.Counter(f"p{int(x)}" for x in rng.zipf(1.3, 400) % 5000)
        true.update(c)
        blobs.append(co.packed(pa.array(list(c), pa.large_string()), np.array(list(c.values()))))
    phrases, n = co.exact_counts(blobs, sum(true.values()), 10)
    assert dict(zip(phrases.to_pylist(), n.tolist(), strict=True)) == {p: k for p, k in true.items() if k >= 10}
