"""The corpus pipeline's run() against its stages done plainly, on rows with nulls, empty and long texts, copies, repeated rows and columns whose names clash; and on empty tables."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm_units import brute_components, prose
from tokenizers import Tokenizer

import corpus_pipeline
from lodestream.llm import toxicity
from lodestream.llm.queries import tokenizer_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _text int, score double"
RUDE = ["you idiot", "you stupid fool", "i will hurt you", "shut up idiot"]


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 0.5) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def some_rows(rng):
    texts = [prose(rng, rng.randrange(3, 60)) for _ in range(120)]
    texts += [f"{prose(rng, 8)}. {rng.choice(RUDE)}. {prose(rng, 5)}" for _ in range(150)]
    texts += [texts[3], texts[3], texts[7] + " more", None, "", None, " ", "word " * 6000, prose(rng, 3000)]
    near = texts[50].split() + prose(rng, 40).split()
    texts += [" ".join(near), " ".join([*near[:-1], "changed"]), " ".join(["changed", *near[1:]])]
    leak = prose(rng, 14)
    texts += [f"{prose(rng, 5)} {leak} {prose(rng, 5)}", leak.upper().replace(" ", "  , ")]
    return texts, leak


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def contaminated(text, items):
    w = words(text)
    for item in items:
        v = words(item)
        n = min(10, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1)):
            return True
    return False


def test_run_is_its_stages_done_plainly(spark, tmp_path):
    rng = random.Random(12)
    texts, leak = some_rows(rng)
    rows = list(enumerate(texts))
    toxic = {i for i, t in rows if t and any(r in t for r in RUDE)}
    labels = [(i, 1, int(i in toxic)) for i, _ in rows if i % 5]
    items = [("a", leak), ("b", None), ("c", "never there at all"), (None, "")]
    sf = tables(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet").filter(toxicity.in_learning_fold(F.col("doc_id"), 3, 1)))
    rejected = {r["doc_id"] for r in toxicity.score_toxicity(docs, learned).filter("predicted = 1").collect()}
    # what is planted is found, as far as so few labels go, and nothing clean is
    assert len(rejected & toxic) >= 0.5 * len(toxic) and not rejected - toxic
    left = [(i, t) for i, t in rows if i not in rejected]
    last = {}
    for i, t in left:
        last[t or ""] = i
    left = [(i, t) for i, t in left if last[t or ""] == i]
    groups = brute_components(dict(left))
    left = [(i, t) for i, t in left if groups[i][1] == i]
    left = [(i, t) for i, t in left if not contaminated(t, [t for _, t in items])]
    assert len(rows) - len(left) > len(rejected) + 5
    tokenizer = Tokenizer.from_file(tokenizer_files()["vocabulary"])
    want = set()
    for i, t in left:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        for k, (a, z) in enumerate(zip([0, *range(first, len(ids), 2048)], [*range(first, len(ids) + 1, 2048)], strict=True)):
            want.add((i, k, a, z - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:z]))))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= -(-sum(p[3] for p in want) // 2048) + 2


@pytest.mark.parametrize("n", [0, 3])
def test_empty_tables(spark, tmp_path, n):
    sf = tables(spark, tmp_path, [(i, f"text number {i} of few words") for i in range(n)], [], [])
    assert corpus_pipeline.run(spark, sf).count() == n
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.count() == n
