"""Corpus operators on small fixtures against brute force, with nulls, empty texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestream.llm import chat_events, components, decontaminate, exact_dedup, minhash, packing, pitman_yor, queries, repeated_windows, toxicity, url_rules, warc_zstd

DOC = "doc_id long, text string, source string, kept boolean"


def docs(spark, texts, start=0):
    """documents with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "s", True) for i, t in enumerate(texts, start)], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


# -- exact copies


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    rows = [(1, "a", "s", True), (2, "a", "s", True), (3, None, "s", True), (4, "", "s", True), (5, "A", "s", True), (5, "A", "s", True), (None, "a", "s", True)]
    got = sorted((tuple(r)[:4] for r in exact_dedup.exact_groups(spark.createDataFrame(rows, DOC), keep=keep).collect()), key=str)
    pick = min if keep == "min" else max
    want = []
    for i, t, *_ in rows:
        same = [j for j, u, *_ in rows if (u or "") == (t or "") and j is not None]
        size = sum((u or "") == (t or "") for _, u, *_ in rows)
        want.append((i, pick(same), size, i == pick(same)))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_groups(empty(spark)).collect() == []


def test_equal_hashes_of_different_texts_stay_apart(spark):
    rows = docs(spark, ["aa", "bb", "aa", "c"])
    got = {r["doc_id"]: (r["keep_id"], r["n_texts_of_hash"]) for r in exact_dedup.exact_groups(rows, content_hash=lambda t: F.length(t).cast("string")).collect()}
    assert got == {0: (0, 2), 1: (1, 2), 2: (0, 2), 3: (3, 1)}


def test_drop_exact_copies(spark):
    rows = [(1, "a", "s", True), (1, "a", "s", True), (2, "a", "t", True), (None, "a", "s", True)]
    got = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r["doc_id"] or 0, r["source"]) for r in got) == [(0, "s"), (1, "s")]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_drop_exact_copies_of_shared_ids(spark, keep):
    rows = [(5, "A", "s", True), (9, "A", "s", True), (5, "B", "s", True)]
    got = sorted((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_copies(spark.createDataFrame(rows, DOC), keep=keep).collect())
    assert got == ([(5, "A"), (5, "B")] if keep == "min" else [(5, "B"), (9, "A")])


def test_exact_groups_of_very_long_texts_and_clashing_columns(spark):
    t = "long text " * 60_000
    rows = spark.createDataFrame([(1, t, 0, "x"), (2, t, 0, "x"), (3, t + ".", 0, "x")], "doc_id long, text string, keep_id int, _sha string")
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_groups(rows).collect()) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(rows).collect()) == [1, 3]


# -- components


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "src long, dst long")).collect() == []


# -- near copies


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = prose(rng, 90).split()
        texts.append(" ".join(base))
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS).upper()
            texts.append(" ".join(w))
    texts += [None, "", "  \n", "one two", "One  TWO", "one two three four five", prose(rng, 4000)]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(dict(enumerate(texts)))


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_estimates_are_near_the_similarity(spark):
    rng = random.Random(7)
    base = prose(rng, 400).split()
    pairs = []
    for k in (0, 5, 15, 40, 200):
        w = list(base)
        for i in rng.sample(range(400), k):
            w[i] = f"x{i}"
        pairs.append((" ".join(base), " ".join(w)))
    sig = lambda t, n: minhash.packed_signatures(spark.createDataFrame([(i, x) for i, x in enumerate(t)], "rep long, text string")).select("rep", F.col("sig").alias(n))
    got = {r["rep"]: r["e"] for r in sig([a for a, _ in pairs], "a").join(sig([b for _, b in pairs], "b"), "rep").select("rep", minhash.estimate(F.col("a"), F.col("b")).alias("e")).collect()}
    h = minhash.WordHashes()
    for i, (a, b) in enumerate(pairs):
        x, y = minhash.shingle_set(a, h), minhash.shingle_set(b, h)
        both = np.intersect1d(x, y).size
        assert abs(got[i] - both / (len(x) + len(y) - both)) < 0.1


# -- decontamination


def test_contamination_against_windows(spark):
    rng = random.Random(11)
    items = [prose(rng, n) for n in (25, 14, 10, 6, 1)] + [None, "...", prose(rng, 25)]
    passage = items[0].upper().split()
    texts = [prose(rng, 60) + " " + ", ".join(passage[4:19]) + " " + prose(rng, 30), items[3] + "! " + items[3], items[1] + " " + items[1], " ".join(passage[:9]), None, "", items[7], "élan " + items[4], prose(rng, 3000)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for k, item in enumerate(items):
            x = split(item)
            n = min(10, len(x))
            for s in range(len(x) - n + 1 if x else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == x[s : s + n]:
                        hit |= set(range(at, at + n))
                        found.add(k)
        want[i] = (len(w), len(hit), sorted(map(str, found)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for per_block in (1000, 3):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs(spark, texts), bench, per_block=per_block).collect()}
        assert got == want
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, texts), bench).collect()}
    assert kept == {i for i, x in want.items() if not x[1]}


@pytest.mark.parametrize("item_id", [5, None])
def test_items_that_share_an_id_are_matched_apart(spark, item_id):
    rng = random.Random(31)
    items = [prose(rng, n) for n in (14, 12, 10, 4)]
    bench = spark.createDataFrame([(item_id, x) for x in items], "item_id long, text string")
    texts = ["before " + x + " after" for x in items] + [prose(rng, 30)]
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert got == {0: (14, True), 1: (12, True), 2: (10, True), 3: (4, True), 4: (0, False)}


def test_contamination_with_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.contamination(docs(spark, ["a b"]), bench).collect()] == [(2, 0, 0)]
    assert decontaminate.contamination(empty(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_contamination_of_texts_as_ids_and_empty_benchmark(spark):
    rows = spark.createDataFrame([("x1", "a b c"), ("x2", None)], "doc_id string, text string")
    for bench in ("item_id long, text string", "item_id string, text string"):
        none = spark.createDataFrame([], bench)
        assert decontaminate.drop_contaminated(rows, none).count() == 2
        assert decontaminate.index_matches(rows, none).dtypes[:2] == [("doc_id", "string"), ("item_id", none.dtypes[0][1])]


def test_contamination_of_null_and_repeated_ids(spark):
    rng = random.Random(41)
    item = prose(rng, 12)
    rows = spark.createDataFrame([(1, "x " + item), (1, "clean words"), (None, item), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in decontaminate.contamination(rows, bench).collect())
    assert got == [(0, 0, 0), (0, 12, 12), (1, 2, 0), (1, 13, 12)]
    assert sorted(r["doc_id"] or 0 for r in decontaminate.drop_contaminated(rows, bench).collect()) == [0, 0]


def test_contamination_by_a_repeated_word(spark):
    bench = spark.createDataFrame([(1, "to " * 10), (2, "to be to be to be to be to be")], "item_id long, text string")
    rows = docs(spark, ["to " * 300, "to be " * 40, "to be or not"])
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.contamination(rows, bench).collect()}
    assert got == {0: (300, ["1"]), 1: (80, ["2"]), 2: (0, [])}


def test_proximity_allows_words_between(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    rows = docs(spark, ["red very green blue", "blue green red", "red green blue", "red a b c d e f green blue"])
    got = {(r["doc_id"], r["kind"]) for r in decontaminate.index_matches(rows, bench, n=3, slop=1).collect()}
    assert got == {(0, "proximity"), (1, "proximity"), (2, "phrase")}


# -- repeated windows


def brute_repeats(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[s : s + n] for b in raw for s in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                gone[s : s + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("n, stretch", [(40, 34), (40, 5), (12, 3)])
def test_repeats_against_all_windows(spark, n, stretch):
    rng = random.Random(13)
    a, b = prose(rng, 40), prose(rng, 30)
    texts = [a, a, a[20:150] + " tail " + b, "head " + a[30:170], b + b, "x" * 100, "ab" * 60, "é" * 50, None, "", "short", prose(rng, 50), a[:60] + b[:60] + a[60:120], a.replace("alpha", "ALPHA")]
    rows = spark.createDataFrame([(None if i == 3 else i, t, "s", True) for i, t in enumerate(texts)], DOC)
    got = sorted(tuple(r)[1:4] + (r["kept_sha256"],) for r in repeated_windows.remove_repeats(rows, threshold=n, stretch=stretch).collect())
    assert got == sorted(brute_repeats(texts, n))


def brute_shares(texts, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    owners = collections.defaultdict(set)
    for i, w in enumerate(words):
        for s in range(len(w) - n + 1):
            owners[tuple(w[s : s + n])].add(i)
    return [any(len(owners[tuple(w[s : s + n])]) > 1 for s in range(len(w) - n + 1)) for w in words]


def passages():
    """Texts that share passages of up to 51 words, all below 400 bytes: in one place, spread over several, with other white space, in themselves alone."""
    rng = random.Random(29)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    p, q, r, few = fresh(51), fresh(50), fresh(60), fresh(12)
    return [
        f"{fresh(70)} {p} {fresh(30)}", f"{fresh(9)}\n{p.replace(' ', chr(10))} {fresh(80)}", f"{q} {fresh(40)}", f"{fresh(44)} {q}", f"{fresh(20)} {r} {fresh(7)} {r}", few, few, r + " end", fresh(200),
        " ".join([fresh(55)] * 2), f"{few} {fresh(60)}", p[:-1] + "Z " + fresh(60), "\u00a0".join(fresh(60).split()), None, "", " ", f"{fresh(3)} {p} {fresh(1)}", f"{fresh(33)} {few} {fresh(2)} {few} {fresh(9)}",
    ]


def test_shared_passages_below_the_byte_threshold_are_told(spark):
    texts = passages()
    rows = spark.createDataFrame([(i, t, "s", True) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in repeated_windows.remove_repeats(rows).collect()}
    assert [got[i]["shares_passage"] for i in range(len(texts))] == brute_shares(texts, 51)
    assert [i for i in got if got[i]["shares_passage"]] and not any(got[i]["n_removed"] for i in (0, 1, 16))
    assert [got[i]["shares_passage"] for i in (0, 1, 2, 3, 9)] == [True, True, False, False, False]


@pytest.mark.parametrize("n, gram", [(12, 4), (12, 12), (5, 2), (50, 16)])
def test_shared_passages_against_all_windows(spark, n, gram):
    texts = [t or "" for t in passages()]
    texts += [texts[0], texts[0][100:] + " x", "x x x x x x x x x x x x x x", "x y " * 20, "y x " * 9]
    texts = list(dict.fromkeys(texts))  # a name stands for a text
    want = {i for i, w in enumerate(brute_shares(texts, n)) if w}
    rows = spark.createDataFrame(list(enumerate(texts)), "name long, text string")
    assert {r["name"] for r in repeated_windows.sharing_texts(rows.union(rows.limit(3)), passage=n, gram=gram).collect()} == want


def test_words_are_hashed_by_their_bytes_alone():
    h = lambda t: repeated_windows.word_hashes(np.frombuffer(t.encode(), np.uint8)).tolist()
    assert h("aa b\tcé  aa\x0b\u00a0x") == h("aa") + h("b") + h("cé") + h("aa") + h("\u00a0x") and h("") == h(" \n") == []
    long = "q" * repeated_windows.SLICE
    assert h("aa b cé")[1:] == h(f"{long} b cé")[1:] and h(long) == h(f"{long} b")[:1] and h(f"{long}r") == h(f"  {long}r")
    assert h(f"{long}r {long}s")[0] == h(f"{long}r")[0] != h(f"r{long}")[0] and len(set(h(f"{long}r {long}s {long}"))) == 3


def test_long_texts_are_sampled_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 5000, np.uint8)
    whole = [np.concatenate(x) for x in zip(*repeated_windows.runs_of(data, 40, 12), strict=True)]
    monkeypatch.setattr(repeated_windows, "SLICE", 700)
    cut = [np.concatenate(x) for x in zip(*repeated_windows.runs_of(data, 40, 12), strict=True)]
    spread = lambda r: [p for p, a, z in zip(*r[1:], strict=True) for _ in range(a, z + 1)]
    assert spread(whole) == spread(cut) and len(spread(cut)) == 4961


def test_repeats_of_nothing(spark):
    assert repeated_windows.remove_repeats(empty(spark)).collect() == []


# -- packing


def test_tokens_by_either_way_agree():
    files = queries.tokenizer_files()
    ids = packing.Ids(**files)
    for t in ("Plain text, with CASE.", "naïve café über Straße ñandú", "tabs\t\tand\n\nlines  ", "don't we'll 12345 $%&", "x" * 5000, "a<|endoftext|>b", "日本語 text", "", " "):
        assert ids(t) == ids.plain.encode(t, add_special_tokens=False).ids
        if not packing.COMMON.search(t):
            assert ids.quick.encode_ordinary(t) == ids.plain.encode(t, add_special_tokens=False).ids


def test_pieces_and_places(spark):
    rng = random.Random(17)
    texts = [None, "", "word", prose(rng, 5000), prose(rng, 1200)] + [prose(rng, rng.randrange(1, 900)) for _ in range(60)]
    files = queries.tokenizer_files()
    plain = packing.Ids(files["vocabulary"], None, None)
    rows = packing.pack_documents(docs(spark, texts), docs_per_shard=25, **files).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids, at = plain(t or "") + [0], 0
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in pieces[1:])
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 2048) + 3 + 3
    assert packing.pack_documents(empty(spark), **files).collect() == []


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    first, _ = p.place(6)
    assert p.place(4) == (first, 6) and p.place(6)[0] == 1 and p.place(3) == (1, 6)


# -- toxicity


def test_composed_machine_marks_scope_and_targets():
    def run(classes):
        state = 0
        for c in classes:
            state = toxicity.MACHINE[state, c][1]
        return toxicity.pattern_of(state)

    assert [run(x) for x in ("I", "TOI", "NI", "NOOOOI", "RTI", "V", "VT", "OO", "NTI", "RNI")] == ["insult", "targeted insult", "negated insult", "insult", "reported insult", "threat", "targeted threat", "none", "negated insult", "negated insult"]


def labelled(spark, n=400):
    rng = random.Random(19)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = prose(rng, 40).split()
        if bad:
            words[rng.randrange(40)] = "grmblax" + rng.choice(["o", "um", "is"])
        rows.append(" ".join(words))
        labels.append((i, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_stems_score_unseen_texts(spark):
    rows, labels = labelled(spark)
    model = toxicity.learn(rows, labels.filter("doc_id % 3 <> 1"))
    assert any("grmblax".startswith(s) for s in model.stems)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_toxicity(rows, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(got[i][1] == truth[i] for i in truth) and all(0 <= s <= 1 for s, _ in got.values())
    kept = {r["doc_id"] for r in toxicity.drop_toxic(rows, model).collect()}
    assert kept == {i for i, y in truth.items() if not y}


def test_only_equal_texts_are_merged(spark, monkeypatch):
    seen = {}
    write = toxicity.written

    def watched(df, name, **options):
        out = write(df, name, **options)
        seen[name] = out[0]
        return out

    monkeypatch.setattr(toxicity, "written", watched)
    shared = " ".join(f"common{i}" for i in range(400))  # holds the least word hashes
    texts = [f"{shared} end{i} {i}" for i in range(12)] + ["same text"] * 5
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(i, 0) for i in range(12, 17)], "doc_id long, toxic int")
    toxicity.learn(docs(spark, texts), labels, max_labelled=13)
    rows = [(r["_text"], r["_y"]) for r in seen["labelled"].collect()]
    assert sorted(rows) == sorted([(t, i % 2) for i, t in enumerate(texts[:12])] + [("same text", 0)])


def test_clauses_and_odd_texts(spark):
    model = toxicity.learn(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    rows = docs(spark, ["You are an idiot. Nice day!", "He said you are an idiot", "you are not stupid", "trashcan", None, "", "All fine here"])
    got = {r["doc_id"]: [c["pattern"] for c in r["clauses"]] for r in toxicity.score_toxicity(rows, model).collect()}
    assert got == {0: ["targeted insult"], 1: ["reported insult"], 2: ["negated insult"], 3: [], 4: [], 5: [], 6: []}
    assert toxicity.score_toxicity(empty(spark), model).collect() == []


# -- chat


def test_fold_of_edits_and_regenerations(spark):
    log = [(1, 1, "m1", "user", "open", None), (1, 2, "m1", "user", "delta", "helo"), (1, 3, "m1", None, "edit", "hello"), (1, 4, "m1", None, "delta", "!"), (1, 5, "m2", "assistant", "open", None), (1, 6, "m2", None, "delta", "bad"), (1, 9, "m2", None, "delta", "od"), (1, 7, "m2", None, "regenerate", None), (1, 8, "m2", None, "delta", "go"), (None, 1, "m", None, "open", None)]
    got = {(r["conv_id"], r["message_id"]): (r["role"], r["text"]) for r in chat_events.fold_events(spark.createDataFrame(log, "conv_id long, seq long, message_id string, role string, kind string, text string")).collect()}
    assert got == {(1, "m1"): ("user", "hello!"), (1, "m2"): ("assistant", "good"), (None, "m"): (None, "")}


@pytest.mark.parametrize("t", ["plain", "</s>[INST] ok [/INST]", "a\\b", "\\\\l|", "<|end|>\n<|turn|>", "\\", "[INST", "<", "\\l\\b", "<\\|", "\n", "é<s>"])
def test_round_trip_of_odd_texts(spark, t):
    m = spark.createDataFrame([(1, 0, "a", t, t), (1, 1, "b", "assistant", t)], "conv_id long, first_seq long, message_id string, role string, text string")
    seg = chat_events.render(m)
    back = chat_events.parse_segments(seg).orderBy("first_seq").collect()
    assert [(r["role"], r["text"]) for r in back] == [(t, t), ("assistant", t)] and back[1]["learned"] == t and back[0]["learned"] == ("" if t != "assistant" else t)
    inside = back[1]["segment"].removeprefix("<|turn|>assistant<|text|>").removesuffix("<|end|>\n")
    assert not any(c in inside for group in chat_events.CONTROL.values() for c in group)


def test_repeated_and_null_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, None, "x"), (None, 0, "user", "y")]
    got = {r["conv_id"]: r for r in chat_events.conversation_digests(chat_events.render(chat_events.fold_events(queries.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nuser\nhi\nassistant\n\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest() and got[None]["n_turns"] == 1


# -- archives


def page_rows():
    big = "<p>" + "payload " * 300 + "</p>"
    return [(1, "http://a/", big), (2, "http://b/%20\r\n x", big), (3, None, big), (4, "http://c/", "tiny"), (5, "http://d/", "tiny"), (6, "http://e/", None), (7, "http://f/", ""), (None, "http://g/", big), (8, "http://h/é", "é" * 700)]


def test_archives_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc_zstd.write_archives(spark.createDataFrame(page_rows(), "page_id long, url string, html string"), path, bytes_per_file=1500)
    got = {r["page_id"]: r for r in warc_zstd.read_archives(spark, path).collect()}
    assert len(got) == len(page_rows())
    for i, url, html in page_rows():
        raw = (html or "").encode()
        r = got[i]
        assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (url, len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if i in (1, 2) else ("response", None))
        assert r["payload"] == (b"" if i in (1, 2) else raw)


def test_archives_of_large_pages_and_repeated_rows(spark, tmp_path):
    path = f"file://{tmp_path}/large"
    rows = [(i, "http://x/", str(i) * 40_000, 7, "z") for i in range(9)] + [(3, "http://x/", "3" * 40_000, 7, "z")]
    warc_zstd.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int, record_type string").coalesce(1), path, bytes_per_file=100_000)
    assert len(list((tmp_path / "large").glob("part-*"))) >= 3
    got = sorted((r["page_id"], r["record_type"], len(r["payload"])) for r in warc_zstd.read_archives(spark, path).collect())
    assert got == sorted((i, "response", 40_000) for i, *_ in rows)


def test_archives_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc_zstd.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_zstd.read_archives(spark, path).collect() == []


def test_reader_takes_the_dictionary_and_rejects_damage():
    import zstandard

    rows = [{"page_id": i, "url": "http://x/", "html": f"text {i} " * 40, "record_type": "response", "payload_digest": hashlib.sha1((f"text {i} " * 40).encode()).hexdigest(), "refers_to": None} for i in range(40)]
    frames = list(warc_zstd.frames_of(iter(rows)))
    assert frames[0][:4] == warc_zstd.DICTIONARY and len(frames[0]) > 1000
    archive = warc_zstd.EMPTY_FRAME.encode().join(frames)
    assert [r["payload"].decode() for r in warc_zstd.records_of(archive)] == [r["html"] for r in rows]
    packed = warc_zstd.DICTIONARY + len(z := zstandard.compress(frames[0][8:])).to_bytes(4, "little") + z
    assert len(list(warc_zstd.records_of(packed + b"".join(frames[1:])))) == 40
    for broken in (archive[:-9], archive + b"junk", b"".join(frames[1:]), frames[1][:0] + archive.replace(frames[5], frames[5][:-1] + b"\x00")):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc_zstd.records_of(broken))
    record = warc_zstd.encode_record(rows[0])
    for wrong in (record.replace(b"WARC/1.1", b"HTTP/1.1"), record[:-1], record.replace(b"text 0", b"text 9", 1), record.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(ValueError):
            warc_zstd.decode_record(wrong)


# -- url rules


def test_rules_and_aliases(spark):
    rules = spark.createDataFrame(queries.URL_RULES, url_rules.RULES)
    urls = ["http://x.net/", "http://x.net", "https://m.example.net/en/1", "https://EXAMPLE.com/de/2?q", "http://a.org/fr/1", "http://a.org/en", None, "no scheme", "http://evilnet/", "http://alias.io/a", "http://alias.io/b"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("http://alias.io/a", "http://x.net/"), ("http://alias.io/b", "http://mid.io/"), ("http://mid.io/", "http://a.org/fr/1"), ("http://mid.io/", "http://x.net/")], "src string, dst string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {
        0: ("x.net", "/", "net/", "block"), 1: ("x.net", "", None, "allow"), 2: ("m.example.net", "/en/1", "example.net/en/", "allow"), 3: ("example.com", "/de/2", "example.com/de/", "block"), 4: ("a.org", "/fr/1", "org/fr/", "allow"),
        5: ("a.org", "/en", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("evilnet", "/", None, "allow"), 9: ("alias.io", "/a", None, "allow"), 10: ("alias.io", "/b", None, "allow"),
    }
    with_links = {r["page_id"]: (r["verdict"], r["via"]) for r in url_rules.judge_urls(pages, rules, edges).collect()}
    assert with_links[0] == ("block", "rule") and with_links[9] == ("allow", "alias") and with_links[10] == ("allow", "alias")
    blocked = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, rules, edges.limit(1)).collect()}
    assert blocked[9] == "block"


def test_links_from_pages(spark):
    html = '<link rel="canonical" href="http://b/"><meta http-equiv="refresh" content="0; url=http://c/"><link rel=stylesheet href="http://d/">'
    pages = spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", None), (3, None, html)], "page_id long, url string, html string")
    assert {tuple(r) for r in url_rules.link_edges(pages).collect()} == {("http://a/", "http://b/"), ("http://a/", "http://c/")}


def test_relative_links_from_pages(spark):
    long = "x" * 5000
    html = [f'<link data-a="{long}" rel="canonical" href="../c?a=1&amp;b=2#top">', '<link rel=canonical href="//other/x">', '<meta http-equiv="refresh" content="0; url=/root">', "<link rel='canonical' href='page'>"]
    pages = spark.createDataFrame([(i, "http://h/a/b/p", x) for i, x in enumerate(html)], "page_id long, url string, html string")
    got = {r["dst"] for r in url_rules.link_edges(pages).collect()}
    assert got == {"http://h/a/c?a=1&b=2", "http://other/x", "http://h/root", "http://h/a/b/page"}


def test_decisions_reach_aliases_as_by_union_find(spark):
    rng = random.Random(47)
    hosts = ["x.net", "a.example.net", "example.com", "a.org", "plain.io", "m.example.com"]
    urls = sorted({f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'zz'])}/{rng.randrange(40)}" for _ in range(160)})
    target = {u: rng.choice(urls) for u in urls if rng.random() < 0.5}
    html = {u: rng.choice(['<link rel="canonical" href="{}">', '<meta http-equiv=refresh content="1;URL={}">']).format(v) for u, v in target.items()}
    pages = spark.createDataFrame([(i, u, html.get(u)) for i, u in enumerate(urls)] + [(999, urls[0], None), (1000, None, "<link rel=canonical href=http://x.net/>")], "page_id long, url string, html string")
    parent = {u: u for u in urls}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in target.items():
        parent[find(u)] = find(v)

    def own(u):
        host, path = u[7:].split("/", 1)[0], "/" + u[7:].split("/", 1)[1]
        fit = [(r, a) for a, r in queries.URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fit, key=lambda x: len(x[0]))[1] if fit else None

    groups = collections.defaultdict(set)
    for u in urls:
        groups[find(u)].add(own(u))
    said = lambda g: "allow" if "allow" in g else "block" if "block" in g else "allow"
    want = {i: own(u) or said(groups[find(u)]) for i, u in enumerate(urls)} | {999: own(urls[0]) or said(groups[find(urls[0])]), 1000: "allow"}
    rules = spark.createDataFrame(queries.URL_RULES, url_rules.RULES)
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, rules, url_rules.link_edges(pages)).collect()} == want
    clash = pages.selectExpr("*", "'x' as host", "1 as rule", "'y' as verdict")
    assert url_rules.judge_urls(clash, rules, url_rules.link_edges(clash)).count() == pages.count()
    assert url_rules.judge_urls(pages.limit(0), rules.limit(0), url_rules.link_edges(pages.limit(0))).collect() == []
    assert {r["verdict"] for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# -- language model


def test_base_and_counts(spark):
    rng = random.Random(23)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(60)] + [None, "", "unseenword again", "A a A"]
    learn = {i: i % 4 != 0 for i in range(len(texts))}
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, ws in words.items() if learn[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in pitman_yor.score_texts(docs(spark, texts), F.col("doc_id") % 4 != 0).collect()}
    assert len(got) == len(texts)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learn[i], len(ws), sum(w in c for w in ws), n)
        assert abs(r["base_score"] - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert np.isfinite(r["score"]) and r["score"] < 0


def partitions(n):
    """All ways to put customers 0 to n - 1 at tables."""
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for i in range(len(p)):
            yield [x + (j == i) for j, x in enumerate(p)]
        yield [*p, 1]


@pytest.mark.parametrize("d", [0.2, 0.75])
def test_stirling_numbers_against_all_partitions(d):
    for c in range(1, 8):
        want = collections.Counter()
        for p in partitions(c):
            want[len(p)] += np.prod([np.prod([k - d for k in range(1, n)]) for n in p])
        got = np.exp(pitman_yor.stirling(d)[c, 1 : c + 1])
        assert np.allclose(got, [want[t] for t in range(1, c + 1)])


def last_rows(d, wanted):
    """Rows of the recursion, one kept at a time."""
    row, t, out = np.full(max(wanted) + 1, -np.inf), np.arange(max(wanted) + 1), {}
    row[0] = 0.0
    for c in range(max(wanted)):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where((t <= c) & (c - d * t > 0), np.log(np.maximum(c - d * t, 1e-300)) + row, -np.inf)
            row = np.logaddexp(stay, np.concatenate([[-np.inf], row[:-1]]))
        if c + 1 in wanted:
            out[c + 1] = row[1 : c + 2].copy()
    return out


@pytest.mark.parametrize("d", [0.02, 0.1, 0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])
def test_numbers_of_many_customers_agree_with_the_recursion_for_every_number_of_tables(d):
    for c, row in last_rows(d, {1024, 3000, 10_000}).items():
        t = np.arange(1.0, c)
        wrong = np.abs(pitman_yor.stirling_far(np.full(len(t), float(c)), t, d) - row[:-1])
        assert wrong.max() < 0.011, (c, int(wrong.argmax()) + 1)


@pytest.mark.parametrize(("c", "d", "room", "p"), [(1024, 0.7, 1000.0, 0.3), (1025, 0.7, 1000.0, 0.3), (3000, 0.7, 200_000.0, 0.005), (3000, 0.8, 3000.0, 0.3), (2000, 0.75, 40.0, 0.001), (1500, 0.5, 5000.0, 0.9), (1100, 0.9, 10.0, 0.5), (4000, 0.75, 2e6, 0.02)])
def test_draws_of_many_customers_have_the_moments_of_their_conditional(c, d, room, p):
    w = last_rows(d, {c})[c] + np.cumsum(np.log(d * p * (room + np.arange(c))))
    w = np.exp(w - w.max())
    w /= w.sum()
    t = np.arange(1, c + 1)
    mean = (w * t).sum()
    deviation = np.sqrt((w * (t - mean) ** 2).sum())
    n = 4000
    got = pitman_yor.seat(np.full(n, c), np.full(n, room), np.full(n, p), d, (np.arange(n) + 0.5) / n)
    assert abs(got.mean() - mean) < 0.05 * deviation + 0.02 and abs(got.std() / deviation - 1) < 0.04, (got.mean(), mean, got.std(), deviation)


def test_seats_follow_their_conditional():
    rng = np.random.default_rng(3)
    d, room, p, n = 0.6, 4.0, 0.2, 20_000
    want = np.exp(pitman_yor.stirling(d)[6, 1:7]) * [np.prod([d * p * (room + j) for j in range(t)]) for t in range(1, 7)]
    t = pitman_yor.seat(np.full(n, 6), np.full(n, room), np.full(n, p), d, rng.random(n))
    assert np.abs(np.bincount(t, minlength=7)[1:] / n - want / want.sum()).max() < 0.015
    c = np.array([0, 1, 2, 5, 13, 500, 1024, 1025, 100_000, 10**9])
    t = pitman_yor.seat(c, np.full(len(c), 50.0), np.full(len(c), 0.1), 0.7, rng.random(len(c)))
    assert (t <= c).all() and (t[c > 0] >= 1).all() and t[0] == 0
    near, far = (pitman_yor.seat(np.full(3000, k), np.full(3000, 900.0), np.full(3000, 0.05), 0.7, rng.random(3000)) for k in (1024, 1025))
    assert abs(near.mean() / far.mean() - 1) < 0.02 and abs(near.std() / far.std() - 1) < 0.1


def test_scores_against_brute_force_with_fixed_seats(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(0, 40)) for _ in range(50)] + [None, "", "new alpha unseen beta", "alpha " * 30, "long " * 5000]
    learn = {i: i % 3 != 0 for i in range(len(texts))}
    models = []

    class Kept(pitman_yor.Model):
        def __init__(self, *args):
            super().__init__(*args)
            models.append(self)

    monkeypatch.setattr(pitman_yor, "Model", Kept)
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 700)  # several parts
    half = lambda c, room, p, d, u: np.minimum(c, (c + 1) // 2)
    got = {r["doc_id"]: r for r in pitman_yor.score_texts(docs(spark, texts), F.col("doc_id") % 3 != 0, draw=half).collect()}
    words = {i: ["<start>", *(t or "").encode().lower().split(), b""] for i, t in enumerate(texts)}
    c = collections.Counter((a, b) for i, ws in words.items() if learn[i] for a, b in zip(ws, ws[1:], strict=False))
    t = {k: (n + 1) // 2 for k, n in c.items()}
    customers, tables, c0 = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, b), n in c.items():
        customers[a] += n
        tables[a] += t[a, b]
        c0[b] += t[a, b]
    t0 = {w: (n + 1) // 2 for w, n in c0.items()}
    (d0, d1), (s0, s1) = models[0].g.discount, models[0].g.strength
    root = lambda w: (c0[w] - d0 * t0.get(w, 0) + (s0 + d0 * sum(t0.values())) / (len(c0) + 1)) / (s0 + sum(c0.values()))
    prob = lambda a, w: (c[a, w] - d1 * t.get((a, w), 0) + (s1 + d1 * tables[a]) * root(w)) / (s1 + customers[a])
    for i, ws in words.items():
        assert abs(got[i]["score"] - sum(np.log10(prob(a, b)) for a, b in zip(ws, ws[1:], strict=False))) < 1e-6 * max(1, len(ws))
    for a in ("<start>", b"alpha", b"never seen"):
        assert abs(sum(prob(a, w) for w in c0) + prob(a, b"unknown") - 1) < 1e-9


def test_models_of_nothing(spark):
    assert pitman_yor.score_texts(empty(spark), F.lit(True)).collect() == []
    rows = pitman_yor.score_texts(docs(spark, ["a b", None]), F.lit(False)).collect()
    assert len(rows) == 2 and all(r["held_out"] and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in rows)


def test_rare_words_name_restaurants(spark):
    # no word has a share of 1/200; only the word before tells the next one
    n = 300
    texts = [f"key{i} val{i}" for i in range(n)] * 3 + [f"key{i} val{i}" for i in range(20)] + [f"key{i} val{i + 1}" for i in range(20)]
    r = {x["doc_id"]: x for x in pitman_yor.score_texts(docs(spark, texts), F.col("doc_id") < 3 * n).collect()}
    assert all(r[3 * n + i]["score"] > r[3 * n + 20 + i]["score"] + 1 for i in range(20))


def test_repeated_partitions_are_scored_each_time(spark):
    rng = random.Random(6)
    one = docs(spark, [prose(rng, 20) for _ in range(10)])  # several partitions
    got = pitman_yor.score_texts(one.union(one), F.col("doc_id") % 3 != 0).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_tokens"], r["n_known"], round(r["score"], 9), round(r["base_score"], 9)))
    assert len(got) == 20 and len(by) == 10 and all(len(x) == 1 for x in by.values()) and all(next(iter(x))[0] == 21 for x in by.values())


def test_tokenizer_file_is_a_parameter():
    assert queries.tokenizer_files()["vocabulary"] == public_tokenizers.path("byte_bpe_50k.json")
