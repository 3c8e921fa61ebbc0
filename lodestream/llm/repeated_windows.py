"""Removal of byte strings of a threshold length that occur twice, by a depth-limited radix sort of suffixes.

Only suffixes that can be equal to another through the threshold are ever ordered, digit by digit, the most significant first. The first digit of the window at a
suffix is its sample: the least-hashed gram of GRAM bytes inside it (two equal windows choose the same one). Neighbouring windows mostly share
their sample, so a run of them is one record. The second digit is the run's whole context. Records alone in their group drop out after
each digit; a context that occurs twice settles all of its windows at once; only where several contexts share a sample are single windows ordered, by the
next digits of their bytes. Groups that are equal through all digits are exactly the repeated windows.

Passages that different texts share are found in the same way over words instead of bytes: sample, context, then single windows of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, small_batches, written

THRESHOLD, GRAM = 400, 128
#: Words of the shortest shared passage ("over 50 words"), and of the grams that sample it.
PASSAGE, WORD_GRAM = 51, 16
#: Long texts are sampled in slices of so many bytes that overlap by the threshold; positions fit into the low POSITION_BITS of a sort key.
SLICE, POSITION_BITS = 1 << 18, 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


POWERS, INVERSES = _powers(_BASE, SLICE + 2 * THRESHOLD + 2), _powers(_INVERSE, SLICE + 2 * THRESHOLD + 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which hash(i, n) takes the hash of any string inside data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[: len(data)], out=out[1:])
    return out


def string_hashes(s: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-byte strings at the positions at."""
    return _mix((s[at + n] - s[at]) * INVERSES[at])


def runs_of(data: np.ndarray, threshold: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of a text: (sample hash, sample position, first and last window start) of its runs, in positions of the text."""
    width, mask = threshold - gram + 1, np.uint64((1 << POSITION_BITS) - 1)
    for lo in range(0, max(1, len(data) - threshold + 1), SLICE):
        part = data[lo : lo + SLICE + threshold - 1]
        if len(part) < threshold:
            return
        g = len(part) - gram + 1
        h = string_hashes(sums(part), np.arange(g), gram)
        key = (h & ~mask) | np.arange(g, dtype=np.uint64)
        pad = -g % width
        grid = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - threshold + 1
        at = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        yield h[at[first]], at[first] + lo, first + lo, last + lo


#: A record is a stretch of window starts first..last of one text: key holds the digit that all of its windows share, content all of its bytes.
RECORD = "doc binary, key long, content long, sample int, first int, last int"
#: Windows of a contested run are ordered next in stretches of so many.
STRETCH = 34


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def run_records(docs: DataFrame, *, threshold: int, gram: int) -> DataFrame:
    """The first two digits: a record for each run of windows with one sample. docs(doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                for keys, at, first, last in runs_of(np.frombuffer(raw, np.uint8), threshold, gram):
                    content = [_signed(xxhash.xxh3_64_intdigest(raw[a : z + threshold], seed=int(p - a))) for p, a, z in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
                    out.append((pa.array([doc] * len(at), pa.binary()), pa.array(keys.view(np.int64)), pa.array(content, pa.int64()), pa.array(at, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["doc", "key", "content", "sample", "first", "last"])

    return docs.mapInArrow(run, RECORD)


def settle(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One digit pass: (stretches doc, first, last whose content occurs again; one record for each content of the keys that have several).

    Both are sums that Spark begins on the map side, so copies in any number arrive as one row per task.
    """
    by_content = records.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "first", "last", "sample")).alias("rep"))
    by_content, _ = written(by_content, "digits")
    again = by_content.filter("n > 1").select("key", "content")
    repeated = records.join(again, ["key", "content"]).select("doc", "first", "last").distinct()
    several = by_content.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
    contested = by_content.join(several, "key", "left_semi").select("rep.doc", "rep.sample", "rep.first", "rep.last")
    return repeated, contested


def run_bytes(contested: DataFrame, docs: DataFrame, *, threshold: int) -> DataFrame:
    """(doc, sample, first, last, bytes) of contested runs, cut from their texts. Copies of a text give the run more than once, as they should."""
    # a table of its own, so that Spark can deal the many copies of a text out to several tasks
    runs, _ = written(contested.groupBy("doc").agg(F.collect_list(F.struct("sample", "first", "last")).alias("runs")), "contested")
    held = docs.join(runs, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, runs in zip(b.column("doc").to_pylist(), b.column("text"), b.column("runs").to_pylist(), strict=True):
                raw = text.as_py().encode()
                rows = [{"doc": doc, **r, "bytes": raw[r["first"] : r["last"] + threshold]} for r in runs]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc", pa.binary()), ("sample", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("bytes", pa.binary())]))

    return held.select("doc", "text", "runs").mapInArrow(cut, "doc binary, sample int, first int, last int, bytes binary")


def stretch_records(runs: DataFrame, *, threshold: int, stretch: int) -> DataFrame:
    """The next digits: records of up to `stretch` windows whose starts lie equally far before the sample; key is the bytes they all share, which depends on the distance alone."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                raw, a, z, p = r["bytes"], r["first"], r["last"], r["sample"]
                for j in range((p - z) // stretch, (p - a) // stretch + 1):
                    far, near = p - j * stretch - stretch + 1, p - j * stretch  # starts of this distance
                    lo, hi = max(a, far), min(z, near)
                    key = xxhash.xxh3_64_intdigest(raw[near - a : far + threshold - a], seed=j)
                    content = xxhash.xxh3_64_intdigest(raw[lo - a : hi + threshold - a], seed=near - hi)
                    out.append((r["doc"], _signed(key), _signed(content), p, lo, hi))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc", "key", "content", "sample", "first", "last"])

    return runs.mapInArrow(split, RECORD)


def window_records(stretches: DataFrame, runs: DataFrame, *, threshold: int) -> DataFrame:
    """The last digits: each window of the contested stretches by itself, named by 128 bits."""
    wanted = stretches.select("doc", "sample", F.col("first").alias("lo"), F.col("last").alias("hi"))
    held = runs.join(wanted, ["doc", "sample"]).filter("lo >= first and hi <= last").select("doc", "sample", "first", "bytes", "lo", "hi")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                raw, a = r["bytes"], r["first"]
                for s in range(r["lo"], r["hi"] + 1):
                    h = xxhash.xxh3_128_digest(raw[s - a : s - a + threshold])
                    out.append((r["doc"], int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), r["sample"], s, s))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc", "key", "content", "sample", "first", "last"])

    return held.mapInArrow(split, RECORD)


def repeated_windows(docs: DataFrame, *, threshold: int = THRESHOLD, gram: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """docs(doc, text), doc naming the text -> (doc, first, last): starts of windows of threshold bytes that occur more than once in all texts."""
    small_batches(docs.sparkSession)
    gram = gram or min(GRAM, max(1, threshold * GRAM // THRESHOLD))
    spark = docs.sparkSession
    records, records_path = written(run_records(docs, threshold=threshold, gram=gram), "runs")
    whole, contested = settle(records)
    whole, _ = written(whole, "repeated")
    runs, runs_path = written(run_bytes(contested, docs, threshold=threshold), "run-bytes")
    drop_path(spark, records_path)
    stretches, stretches_path = written(stretch_records(runs, threshold=threshold, stretch=min(stretch, threshold - gram + 1)), "stretches")
    parts, open_ = settle(stretches)
    parts, _ = written(parts, "repeated")
    windows, windows_path = written(window_records(open_, runs, threshold=threshold), "windows")
    drop_path(spark, runs_path)
    drop_path(spark, stretches_path)
    single, _ = settle(windows)
    single, _ = written(single, "repeated")
    drop_path(spark, windows_path)
    return whole.unionByName(parts).unionByName(single)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(data: np.ndarray) -> np.ndarray:
    r"""64-bit hashes of the words [^\x20\x09-\x0D]+ of a text's bytes, in order."""
    solid = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.zeros(0, np.uint64)
    if len(data) <= SLICE:  # the same sums, quicker
        s = sums(data)
        return _mix((s[edges[1::2]] - s[edges[::2]]) * INVERSES[edges[::2]])
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    weights = POWERS[place % SLICE]
    if lengths.max() > SLICE:
        weights = weights * (_mix((place // SLICE).astype(np.uint64)) | np.uint64(1))
    return _mix(np.add.reduceat((data[solid].astype(np.uint64) + np.uint64(1)) * weights, at))


def passage_runs(words: np.ndarray, passage: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of hashed words: their prefix sums, and sample hash, content hash, first and last window start of its runs, in positions of the slice."""
    for lo in range(0, max(1, len(words) - passage + 1), SLICE):
        part = words[lo : lo + SLICE + passage - 1]
        for keys, at, first, last in runs_of(part, passage, gram):
            s = sums(part)
            content = _mix((s[last + passage] - s[first]) * INVERSES[first] ^ _mix((at - first).astype(np.uint64)))
            yield s, keys, content, first, last


def passage_records(texts: DataFrame, *, passage: int, gram: int) -> DataFrame:
    """texts(name, text) -> (name, key, content): the sample and the whole context of each run of word windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, text in zip(b.column("name").to_pylist(), b.column("text"), strict=True):
                for _, keys, content, _, _ in passage_runs(word_hashes(np.frombuffer(text.as_py().encode(), np.uint8)), passage, gram):
                    content, at = np.unique(content, return_index=True)
                    out.append((np.full(len(at), name, np.int64), keys[at].view(np.int64), content.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["name", "key", "content"])

    return texts.mapInArrow(run, "name long, key long, content long")


def passage_windows(texts: DataFrame, *, passage: int, gram: int) -> DataFrame:
    """texts(name, text, keys) -> (name, key): each window of words by itself, of the runs with these samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text, wanted in zip(b.column("name").to_pylist(), b.column("text"), b.column("keys"), strict=True):
                wanted = wanted.values.to_numpy().view(np.uint64)
                for s, keys, _, first, last in passage_runs(word_hashes(np.frombuffer(text.as_py().encode(), np.uint8)), passage, gram):
                    mine = np.isin(keys, wanted)
                    lengths = (last - first + 1)[mine]
                    at = np.repeat(first[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
                    h = np.unique(string_hashes(s, at, passage)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), name, np.int64)), pa.array(h)], ["name", "key"])

    return texts.mapInArrow(run, "name long, key long")


def sharing_texts(texts: DataFrame, *, passage: int = PASSAGE, gram: int | None = None) -> DataFrame:
    """texts(name long, text), name naming the text -> (name): texts with a passage of so many words that a different text has, too.

    A context that several texts have settles all of them. Where contexts differ but share a sample, windows are compared one by one, unless all texts
    of the sample are settled already. A context stands there with one of its texts: if it has several, none of them is open.
    """
    small_batches(texts.sparkSession)
    gram = gram or min(WORD_GRAM, passage)
    spark = texts.sparkSession
    records, records_path = written(passage_records(texts, passage=passage, gram=gram), "passages")
    least, most = F.min("name").alias("a"), F.max("name").alias("z")
    contexts, contexts_path = written(records.groupBy("key", "content").agg(least, most), "contexts")
    settled, _ = written(records.join(contexts.filter("a < z").select("key", "content"), ["key", "content"], "left_semi").select("name").distinct(), "sharing")
    drop_path(spark, records_path)
    several = contexts.groupBy("key").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.count(F.lit(1)).alias("n")).filter("n > 1 and a < z").select("key")
    contested, contested_path = written(contexts.join(several, "key", "left_semi").select("key", "a", "z"), "contested")
    drop_path(spark, contexts_path)
    # a table of its own: its size is known when the join is planned, so a sample of many contexts isn't dealt to one task first
    open_, _ = written(contested.filter("a = z").join(settled.select(F.col("name").alias("a")), "a", "left_anti").select("key").distinct(), "open")
    wanted, wanted_path = written(contested.join(open_, "key", "left_semi").groupBy(F.col("a").alias("name")).agg(F.collect_set("key").alias("keys")), "wanted")
    drop_path(spark, contested_path)
    windows, windows_path = written(passage_windows(texts.join(wanted, "name").select("name", "text", "keys"), passage=passage, gram=gram), "passage-windows")
    drop_path(spark, wanted_path)
    again = windows.groupBy("key").agg(least, most).filter("a < z").select("key")
    late, _ = written(windows.join(again, "key", "left_semi").select("name").distinct(), "sharing")
    drop_path(spark, windows_path)
    return settled.unionByName(late).distinct()


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int | None = None, stretch: int = STRETCH, passage: int = PASSAGE) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256, shares_passage.

    Every byte inside a threshold-byte string that starts anywhere else too goes, judged on the input. Texts are named by
    their MD5 inside the job, so null and repeated ids are fine; equal texts of threshold bytes or more lose everything. Null
    and empty texts have no bytes. Removal may cut a character in two, hence kept is binary. Empty input gives empty output.
    shares_passage tells whether another row has `passage` consecutive words of this one, whatever their bytes; it removes nothing.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long_enough = named.filter(F.octet_length("text") >= 2 * passage - 1)
    sharing = sharing_texts(long_enough.select(F.xxhash64("doc").alias("name"), "text"), passage=passage)
    spans = repeated_windows(named.filter(F.octet_length("text") >= threshold).select("doc", "text"), threshold=threshold, gram=gram, stretch=stretch)
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    # equal texts share a passage, if their words are enough: remove() counts these
    copied = long_enough.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.xxhash64("doc")).join(sharing.withColumn("found", F.lit(True)), "name", "left").select("doc", (F.col("n") > 1).alias("copied"), F.col("found").isNotNull().alias("found")).filter("copied or found")
    # a table of its own, so that Spark can deal the many copies of a text out to several tasks
    facts, _ = written(spans.join(copied, "doc", "full_outer"), "facts")
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans, copied, found in zip(b.column("text"), *(b.column(c).to_pylist() for c in ("spans", "copied", "found")), strict=True):
                raw = text.as_py().encode()
                shares = bool(found or copied and len(word_hashes(np.frombuffer(raw, np.uint8))) >= passage)
                if not spans:
                    out.append((len(raw), 0, 0, raw, hashlib.sha256(raw).hexdigest(), shares))
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, [s["first"] for s in spans], 1)
                np.add.at(edge, [s["last"] + threshold for s in spans], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                starts = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((len(raw), int(gone.sum()), starts, kept, hashlib.sha256(kept).hexdigest(), shares))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()), strict=True))], ["_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "shares_passage"])

    out = named.join(facts, "doc", "left").select("_id", "text", "spans", "copied", "found").mapInArrow(remove, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, shares_passage boolean")
    return out.withColumnRenamed("_id", id_col)
