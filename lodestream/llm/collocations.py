"""Collocations: frequent phrases found by Misra-Gries summaries per hash partition, counted exactly, scored by their weakest cut.

Texts are counted in batches, each into runs of distinct phrases by the partition of their hash, so that a phrase with a third of all occurrences is one number of each batch.
A partition's runs are read twice, compressed as they are: the first pass merges them into a summary with more counters than the partition's mass (its occurrences)
divided by the threshold, in which no frequent phrase can be lost; the second counts exactly what the summary still holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, small_batches, written

#: Bytes of texts that a task counts at once, and that stand for a partition: its phrases and counters fit into some 100 MB.
BATCH_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: Tasks that share the partitions, at most; each takes its own one after the other.
TASKS = 10_000
#: Phrases that are merged or looked up at once.
ROWS = 1 << 19
#: A-Z lower-cased, tabs as spaces, and what ends a piece as a line end.
BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_POSITION = (np.random.default_rng(13).integers(0, 1 << 63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Ids from 1 of the words of texts, in order, with 0 wherever a piece ends; and the words by id, at 0 an empty one."""
    data = b"\n".join(texts).translate(BYTES).replace(b"\n", b" \n ") + b" \n "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    spaced = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    names = spaced.dictionary
    kind = np.ones(len(names), np.int64)
    size = pc.binary_length(names).to_numpy()
    for i in np.flatnonzero(size <= 2):
        kind[i] = {" ": -1, "\n ": 0}.get(names[int(i)].as_py(), 1)
    number = np.where(kind == 1, np.cumsum(kind == 1), kind)
    ids = number[spaced.indices.to_numpy()]
    words = names.filter(pa.array(kind == 1))
    return ids[ids >= 0], pa.concat_arrays([pa.array([""], pa.large_string()), pc.utf8_slice_codeunits(words, 0, -1)])


def phrase_counts(ids: np.ndarray, words: pa.Array, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(phrases, counts, hashes) of each number of words from 1 to longest: contiguous inside pieces, each phrase once."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)
    at = np.flatnonzero(ids)
    group = ids[at]  # of the phrase that begins at each place
    counts = np.bincount(group, minlength=len(words))
    of = [np.arange(len(words))]  # words of each distinct phrase
    for n in range(1, longest + 1):
        if n > 1:
            # one word more: phrases go on where the next word belongs to the piece
            ok = (at + n - 1 < len(ids)) & (ids[np.minimum(at + n - 1, len(ids) - 1)] > 0)
            at = at[ok]
            if not len(at):
                return
            keys, group, counts = np.unique(group[ok] * len(words) + ids[at + n - 1], return_inverse=True, return_counts=True)
            of = [w[keys // len(words)] for w in of] + [keys % len(words)]
        have = np.flatnonzero(counts) if n == 1 else slice(None)
        which = [w[have] for w in of]
        texts = words.take(pa.array(which[0])) if n == 1 else pc.binary_join_element_wise(*[words.take(pa.array(w)) for w in which], pa.scalar(" ", pa.large_string()))
        total = sum((hashes[w] * _POSITION[i] for i, w in enumerate(which)), np.zeros(len(which[0]), np.uint64))
        yield texts, counts[have], _mix(total)


def packed(phrases: pa.Array, counts: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([phrases, pa.array(counts, pa.int64())], ["phrase", "n"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blobs: list[bytes]) -> Iterator[pa.Table]:
    """The runs again, several at once up to about ROWS phrases."""
    some, rows = [], 0
    for blob in blobs:
        with pa.ipc.open_stream(blob) as reader:
            t = reader.read_all()
        some.append(t)
        rows += t.num_rows
        if rows >= ROWS:
            yield pa.concat_tables(some)
            some, rows = [], 0
    if some:
        yield pa.concat_tables(some)


class MisraGries:
    """At most `size` counters. Merging adds counters up, then lowers all by the largest that has no room, and drops those at zero. After a mass of m in all, a counter lacks at most m / (size + 1)."""

    def __init__(self, size: int):
        self.size = size
        self.table = pa.table({"phrase": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})

    def merge(self, counters: pa.Table) -> None:
        both = pa.concat_tables([self.table, counters.select(["phrase", "n"])]).group_by("phrase").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        if both.num_rows > self.size:
            n = both.column("n").to_numpy()
            least = np.partition(n, len(n) - self.size - 1)[len(n) - self.size - 1]
            left = pc.subtract(both.column("n"), pa.scalar(int(least), pa.int64()))
            both = pa.table({"phrase": both.column("phrase"), "n": left}).filter(pc.greater(left, 0))
        self.table = both.select(["phrase", "n"])


def exact_counts(blobs: list[bytes], mass: int, least: int) -> tuple[pa.Array, np.ndarray]:
    """Phrases of `least` occurrences or more in runs of that mass, with their numbers: a summary first, then a count of what it holds."""
    summary = MisraGries(mass // least + 1)
    for t in unpacked(blobs):
        summary.merge(t)
    held = summary.table.column("phrase").combine_chunks()
    held = held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks or [pa.array([], pa.large_string())])
    total = np.zeros(len(held), np.int64)
    for t in unpacked(blobs):
        at = pc.index_in(t.column("phrase"), value_set=held)
        found = pc.is_valid(at).to_numpy()
        np.add.at(total, pc.fill_null(at, 0).to_numpy()[found], t.column("n").to_numpy()[found])
    keep = total >= least
    return held.filter(pa.array(keep)), total[keep]


def frequent_phrases(docs: DataFrame, *, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to longest words with f >= least occurrences, overlaps included; the empty phrase stands for all words of its lang.

    Texts, A-Z lower-cased, are cut into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs; phrases stay inside pieces, their words are joined by one space.
    Null texts count as empty, a null lang as und; repeated rows count each time; other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            ids, words = word_ids(texts)
            seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
            n_words = np.array([np.count_nonzero(ids)])
            if not n_words[0]:
                return
            found = [(words[:1], n_words, np.zeros(1, np.uint64)), *phrase_counts(ids, words, longest)]
            phrases, counts = pa.concat_arrays([p for p, _, _ in found]), np.concatenate([c for _, c, _ in found])
            part = (_mix(np.concatenate([h for _, _, h in found]) ^ seed) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, counts, phrases = part[order], counts[order], phrases.take(pa.array(order))
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            for lo in range(0, len(spans), 64):
                some = spans[lo : lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[a] for a, _ in some], pa.int64()), pa.array([lang] * len(some), pa.string()), pa.array([counts[a:z].sum() for a, z in some], pa.int64()), pa.array([packed(phrases[a:z], counts[a:z]) for a, z in some], pa.binary())],
                    ["part", "lang", "mass", "run"],
                )

        held: dict[str, list[bytes]] = {}
        held_bytes = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                held_bytes += len(text) + 1
                if held_bytes >= BATCH_BYTES:
                    for one, texts in held.items():
                        yield from runs(one, texts)
                    held, held_bytes = {}, 0
        for one, texts in held.items():
            yield from runs(one, texts)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, blobs: list[bytes], mass: int) -> Iterator[pa.RecordBatch]:
            phrases, n = exact_counts(blobs, mass, least)
            for lo in range(0, len(n), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(n[lo : lo + ROWS]), pa.string()), phrases[lo : lo + ROWS].cast(pa.string()), pa.array(n[lo : lo + ROWS])], ["lang", "phrase", "f"])

        now, blobs, mass = None, [], 0
        for b in batches:
            for part, lang, m, run in zip(*(b.column(c).to_pylist() for c in ("part", "lang", "mass", "run")), strict=True):
                if (part, lang) != now:
                    if blobs:
                        yield from done(now, blobs, mass)
                    now, blobs, mass = (part, lang), [], 0
                blobs.append(run)
                mass += m
        if blobs:
            yield from done(now, blobs, mass)

    runs = rows.mapInArrow(count, "part long, lang string, mass long, run binary")
    tasks = min(parts, TASKS)
    dealt = runs.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(select, "lang string, phrase string, f long")


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, most: int = 2000, share: tuple[int, int] = (50, 100), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `most` phrases of 2 to longest words of each lang; texts, nulls and repeats as in frequent_phrases.

    Cut after its k-th word, a phrase of a occurrences has parts of l and r; floor(1000000 a a / (l r)) is least at its weakest cut (ties: the smallest k), which is its score, exact in
    38 digits. A phrase goes if it lies inside a longer frequent one that has share or more of its occurrences. Order: score, then a, descending, then the phrase's bytes. n: all words of the lang.
    """
    spark = docs.sparkSession
    found, path = written(frequent_phrases(docs, longest=longest, least=least, lang_col=lang_col, text_col=text_col), "frequent")
    words = F.split("phrase", " ")
    phrases = found.withColumns({"w": words, "k": F.when(F.col("phrase") == "", 0).otherwise(F.size(words))}).filter("k >= 2").select("lang", "phrase", F.col("f").alias("a"), "w", "k")
    parts = phrases.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = parts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    side = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    parts = parts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    squares = (wide("a") * wide("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    parts = parts.withColumns({"top": squares.cast("decimal(38,0)"), "bottom": (wide("l") * wide("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("top div bottom"))
    scored = parts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.score", "s.a", "s.l", "s.r")
    # what lies inside longer ones: each of their shorter parts of two words or more
    spans = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("n")) for n in range(2, longest) for i in range(1, longest - n + 2)]) if longest > 2 else None
    if spans is not None:
        inside = phrases.filter("k >= 3").select("lang", "a", "w", "k", F.explode(spans).alias("x")).filter("x.n < k and x.at + x.n - 1 <= k")
        inside = inside.groupBy("lang", F.array_join(F.slice("w", F.col("x.at"), F.col("x.n")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
        num, den = share
        scored = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (den * F.col("longer") < num * F.col("a"))).drop("longer")
    best = scored.withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")).filter(F.col("rank") <= most)
    best, _ = written(best, "collocations")
    total = found.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    out, _ = written(best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop_path(spark, path)
    return out
