"""b-bit MinHash near-duplicate detection over word shingles.

Each distinct shingle set gets minima over BANDED hash functions, and bands of them propose candidates. Sets that share a bucket get SLOTTED minima more, whose low
BITS bits are packed into signatures; matching slots, counted by bit counts and corrected for chance collisions, discard unlikely pairs; the others are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, small_batches, written
from .components import components

SHINGLE, BANDED, ROWS, SLOTTED, BITS, CACHE = 5, 128, 4, 768, 4, 1 << 18
SLOTS = 64 // BITS  # of a packed word
WORDS = SLOTTED // SLOTS
#: How far below the threshold an estimate may be before its pair is let go: over five standard deviations of the estimate at 0.75.
MARGIN = 0.085
#: Hubs of each bucket to which its sets are linked first, before all remaining pairs across components are looked at.
HUBS = 2
_RNG = np.random.default_rng(20240229)
FACTORS, SHIFTS = (_RNG.integers(0, 1 << 63, BANDED + SLOTTED, np.uint64) << np.uint64(1)) | np.uint64(1), _RNG.integers(0, 1 << 63, BANDED + SLOTTED, np.uint64)
POSITION = (_RNG.integers(0, 1 << 63, 64, np.uint64) << np.uint64(1)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; a text of fewer words is one shingle, without words none. Words are split at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    if len(h) < k:
        return _mix(np.array([(_mix(h + np.uint64(len(h))) * POSITION[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += h[i : i + n] * POSITION[i]
    return np.unique(_mix(total))


def minima(shingles: np.ndarray, which: slice) -> np.ndarray:
    """The least value of each of the hash functions over the set."""
    factors, shifts = FACTORS[which], SHIFTS[which]
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        part = (shingles[i : i + 256, None] * factors) + shifts
        np.minimum(low, (part ^ (part >> np.uint64(31))).min(axis=0), out=low)
    return low


def pack_bits(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into WORDS 64-bit words."""
    bits = _mix(low) & np.uint64((1 << BITS) - 1)
    return (bits.reshape(WORDS, SLOTS) << (np.arange(SLOTS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS minima; keys of different bands differ."""
    return _mix((low.reshape(-1, ROWS) * POSITION[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDED // ROWS, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_key, bands): a row per document row. set_key names the shingle set; bands are null for an empty set."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        names = ["_id", "n_shingles", "set_key", "bands"]
        for b in batches:
            size, key, bands = [], [], []
            for text in b.column("_text").to_pylist():
                s = shingle_set(text, hashes)
                size.append(len(s))
                if not len(s):
                    key.append(None), bands.append(None)
                    continue
                key.append(xxhash.xxh128_digest(s.tobytes()))
                bands.append(band_keys(minima(s, slice(0, BANDED))))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_shingles long, set_key binary, bands array<long>")


def packed_signatures(texts: DataFrame) -> DataFrame:
    """texts(rep, text) -> (rep, n_shingles, sig, bands): the packed low bits of SLOTTED minima, and the band keys."""
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t.as_py(), hashes) for t in b.column("text")]
            low = [minima(s, slice(0, BANDED + SLOTTED)) for s in sets]
            sig, bands = [pack_bits(x[BANDED:]).view(np.int64) for x in low], [band_keys(x[:BANDED]) for x in low]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["rep", "n_shingles", "sig", "bands"])

    return texts.mapInArrow(run, f"rep {kind}, n_shingles long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal slots, corrected for the 2^-BITS that agree by chance."""
    ones = sum(1 << (BITS * i) for i in range(SLOTS))
    low = F.lit(ones - (1 << 64) if ones >> 63 else ones)

    def differing(x: Column) -> Column:
        folded = reduce(lambda y, s: y.bitwiseOR(F.shiftrightunsigned(x, s)), range(1, BITS), x)
        return F.bit_count(folded.bitwiseAND(low))

    words = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    same = 1 - F.aggregate(words, F.lit(0), lambda n, x: n + differing(x)) / SLOTTED
    return (same - 2.0**-BITS) / (1 - 2.0**-BITS)


def confirm(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of pairs(a, b) of set representatives, those with den * intersection >= num * union, counted on the full sets.

    The texts of both sides meet at the pair, salted by it, and are made into sets again there: they are smaller than the sets.
    """
    num, den = threshold
    a = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = WordHashes(), None, None
        for batch in batches:
            ok = []
            ids = batch.column("a").to_pylist()
            for i, ta, tb in zip(ids, batch.column("ta"), batch.column("tb"), strict=True):
                if last != i:
                    last, left = i, shingle_set(ta.as_py(), hashes)
                right = shingle_set(tb.as_py(), hashes)
                both = np.intersect1d(left, right, assume_unique=True).size
                ok.append(den * both >= num * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (the smallest id reachable by links), kept (its own component_id).

    Rows with equal shingle sets form one class, and only one representative of each class takes part in the search, so copies cost
    nothing more. Inside a bucket of a band, representatives are first linked to hubs, the members that share most buckets with others; then every pair
    of the bucket that is still in two components is estimated, and confirmed if it may reach the threshold: no link that a
    band proposes is lost, and no pair is written that is known to be connected. With 32 bands of 4 rows a pair at 0.75 is proposed with probability 1 - 5e-6.

    Null, empty and blank texts have no shingles and stay alone. Rows with a null id get a null component and are kept, linking nothing.
    Repeated rows of one id share its component. An id is taken to name one text: where it names several, they share a component, and only one of them, whichever
    is met first, is compared with others. Empty input gives empty output.
    """
    spark = docs.sparkSession
    rows, _ = written(signatures(docs, id_col=id_col, text_col=text_col), "sig")
    live = rows.filter("_id is not null and set_key is not null")
    classes = live.groupBy("set_key").agg(F.min("_id").alias("rep"))
    reps = live.join(classes, "set_key").filter("_id = rep").select("rep", "bands").dropDuplicates(["rep"])
    buckets, buckets_path = written(reps.select("rep", F.explode("bands").alias("band")).distinct(), "buckets")
    crowded = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = buckets.join(crowded, "band")
    fame, fame_path = written(shared.groupBy("rep").agg(F.sum("n").alias("fame")), "fame")
    ranked = shared.join(fame, "rep")
    first = ranked.groupBy("band").agg(F.max(F.struct("fame", "rep")).alias("h0"))
    second = ranked.join(first, "band").filter(F.col("rep") != F.col("h0.rep")).groupBy("band").agg(F.max(F.struct("fame", "rep"))["rep"].alias("h1"))
    hubs = first.select("band", F.col("h0.rep").alias("h0")).join(second, "band")
    members, members_path = written(shared.select("band", "rep").join(hubs, "band"), "members")
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(fame.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    texts, texts_path = written(texts, "texts")
    light, light_path = written(packed_signatures(texts), "signatures")
    num, den = threshold

    def likely(pairs: DataFrame) -> DataFrame:
        p = pairs.join(light.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a").join(light.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b")
        long_enough = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
        return p.filter(long_enough & (estimate(F.col("sa"), F.col("sb")) >= num / den - MARGIN)).select("a", "b")

    def links(pairs: DataFrame) -> DataFrame:
        return confirm(pairs, texts, threshold)

    stars = reduce(DataFrame.unionByName, [members.select(F.least("rep", f"h{i}").alias("a"), F.greatest("rep", f"h{i}").alias("b")) for i in range(HUBS)])
    edges, _ = written(links(likely(stars.filter("a <> b").distinct())), "links")
    joined = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # what is left: pairs of one bucket in different components; a bucket wholly in one component has none
    placed = members.select("band", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    rest = placed.join(open_, "band").join(light, "rep").withColumn("earlier", F.slice("bands", F.lit(1), F.array_position("bands", F.col("band")).cast("int") - 1)).drop("bands")
    rest, rest_path = written(rest, "open")
    x, y = (rest.select("band", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "component", "n_shingles", "sig", "earlier")]) for side in "ab")
    near = (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b")) & (den * F.least("n_shingles_a", "n_shingles_b") >= num * F.greatest("n_shingles_a", "n_shingles_b"))
    # a pair counts in the first band it shares, and nowhere else
    near = near & ~F.arrays_overlap("earlier_a", "earlier_b") & (estimate(F.col("sig_a"), F.col("sig_b")) >= num / den - MARGIN)
    more = x.join(y, "band").filter(near).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    late, _ = written(links(more), "links")
    groups = components(edges.unionByName(late).select(F.col("a").alias("src"), F.col("b").alias("dst"))) if late.first() else joined
    for p in (buckets_path, fame_path, members_path, light_path, texts_path, rest_path):
        drop_path(spark, p)
    by_set = classes.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    component = F.when(F.col("_id").isNull(), F.col("_id")).otherwise(F.coalesce("component_id", "_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """docs with one document of each group, the one with the smallest id; every column stays, as do rows with a null id."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, threshold=threshold).filter("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
