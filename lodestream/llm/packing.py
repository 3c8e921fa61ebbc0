"""Sum-of-squares packing of token sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Documents that one task packs: large enough that the bins still open at its end don't count.
DOCS_PER_SHARD = 32_768
#: Characters in which the quick and the plain way of tokenizing were found to agree; a text with any other goes the plain way.
COMMON = re.compile("[^\x00-ɏ‘-„…]|<\\|endoftext\\|>")


class Ids:
    """Token ids of texts by a file of the tokenizers library; where ranks of the same vocabulary are given, texts of common characters go through them, which is several times quicker."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.plain, self.quick = Tokenizer.from_file(vocabulary), None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.quick is None or COMMON.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


def token_pieces(docs: DataFrame, *, vocabulary: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and end_id, cut into pieces of capacity if longer; the first piece takes the remainder.

    Null counts as empty and is one piece of end_id alone. Rows are taken as they come: repeated rows give repeated pieces.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(vocabulary, ranks, pattern)
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(b.column("_text").to_pylist()):
                ids = np.array([*ids_of(text or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[a:z].tobytes()
                    rows.append((i, k, a, z - a, zlib.crc32(raw), *([ids[a:z]] if with_ids else [])))
            cols = list(zip(*rows, strict=True))
            arrays = [b.column("_id").take(pa.array(cols[0]))] + [pa.array(c, t) for c, t in zip(cols[1:5], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            arrays += [pa.array(cols[5], pa.list_(pa.int64()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return out.withColumnRenamed("_id", id_col)


class SumOfSquares:
    """Open bins by the gap that is left in them; a bin of each gap is as good as another, so only counts decide."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)  # by gap; full bins (gap 0) don't count
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset). Moving a bin from gap g to g - size changes the sum of squares by 2 (n[g - size] - n[g]) + 2, less where it fills up.

        A new bin opens only where no open one has room: measured, with the largest first, that leaves fewer bins than opening by the squares alone.
        """
        c, cap, never = self.count, self.capacity, np.iinfo(np.int64).max
        delta = 2 * (c[: cap + 1 - size] - c[size:]) + 2
        delta[0] = 1 - 2 * c[size]
        delta[c[size:] == 0] = never  # no such bin
        best = int(np.argmin(delta))
        if delta[best] == never:
            gap, b = cap, self.made
            self.made += 1
        else:
            gap = best + size
            b = self.bins[gap].pop()
            c[gap] -= 1
        if gap > size:
            self.bins[gap - size].append(b)
            c[gap - size] += 1
        return b, cap - gap


def pack(pieces: DataFrame, *, shards: int, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset. Pieces are dealt to shards by a hash of id and piece, and each shard packs its own, largest first.

    A shard holds a bounded number of narrow rows (choose shards by the number of documents); its sequences are numbered from
    shard << 40. Largest first, sum of squares leaves the small pieces for the last gaps. Rows that repeat get places of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        sizes = t.column("length").to_numpy()
        packer, places = SumOfSquares(capacity), np.zeros((len(sizes), 2), np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            places[i] = packer.place(int(sizes[i]))
        places[:, 0] += TaskContext.get().partitionId() << 40
        t = t.append_column("sequence_id", pa.array(places[:, 0])).append_column("offset", pa.array(places[:, 1]))
        yield from t.to_batches()

    dealt = pieces.repartition(shards, F.xxhash64(id_col, "piece", F.lit(11))).sortWithinPartitions(F.desc("length"), id_col, "piece")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, *, vocabulary: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 2048, docs_per_shard: int = DOCS_PER_SHARD, **columns) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most capacity tokens. An empty table gives an empty result."""
    shards = max(1, -(-docs.count() // docs_per_shard))
    pieces = token_pieces(docs, vocabulary=vocabulary, ranks=ranks, pattern=pattern, capacity=capacity, **columns)
    return pack(pieces, shards=shards, capacity=capacity, id_col=columns.get("id_col", "doc_id"))
