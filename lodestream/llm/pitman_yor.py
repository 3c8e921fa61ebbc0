"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling, and the scores it gives to texts.

Every word that precedes another names a restaurant; all restaurants share one parent, the root, whose base measure is uniform over the known words and one
unknown. Neither words nor restaurants have a bound. Texts are read once, into blocks of word numbers. Blocks ask parts for what the corpus says of their words
and pairs of words (`answered`), in packed lists, which are far smaller than a row for each word; nothing that grows goes through the driver or into a broadcast.

Seats are sampled dish by dish: the number of tables of a dish of c customers is drawn from its full conditional given all others, by generalized Stirling
numbers, whatever c is. The others' totals are those of the sweep before (the usual approximation of distributed Gibbs samplers). A customer that is alone with its dish
has one table in every sample, so sweeps go over the other dishes only. Each half of a sweep is a written table, a row for each part and the lists between parts.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, small_batches, written

#: Words of a block of texts, which one task scores at a time, and of the share of the corpus that a part of the look-ups stands for. Both numbers of blocks and of parts follow the corpus.
BLOCK_TOKENS, PART_TOKENS = 1 << 19, 1 << 22
FIRST_SWEEPS, BURN_IN, SAMPLES = 1, 1, 2
STRENGTH, DISCOUNT = 1.0, 0.75
#: Stirling numbers come from their recursion up to so many customers, and from sums and integrals beyond, which agree with it to a hundredth of a logarithm for every number of tables (tests hold both against each other).
EXACT = 1024
UNKNOWN, START, FIRST_WORD = 0, 1, 2
END = b""  # no word is empty


# -- numbers in little room


def shut(*columns: np.ndarray) -> bytes:
    """Equally long columns of numbers from 0 on, by byte planes, as many as a column needs, compressed."""
    wide = [max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1 for c in columns]
    planes = [np.ascontiguousarray(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(columns, wide, strict=True)]
    return bytes(wide) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def opened(data: bytes, n: int) -> list[np.ndarray]:
    """The n columns that shut() packed, as int64."""
    wide, raw = data[:n], zstandard.ZstdDecompressor().decompress(data[n:])
    rows, at, out = len(raw) // sum(wide), 0, []
    for w in wide:
        column = np.zeros((rows, 8), np.uint8)
        column[:, :w] = np.frombuffer(raw, np.uint8, w * rows, at).reshape(w, rows).T
        out.append(column.view("<i8").ravel())
        at += w * rows
    return out


def golden(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64 on unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """Random numbers of rows by their keys, so that neither the order of rows nor their tasks change a sample."""
    return (mixed(mixed(keys.astype(np.uint64) + golden(seed))) >> np.uint64(11)) * 2.0**-53


# -- the number of tables of a dish


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, less = np.asarray(x, float).copy(), 0.0
    for _ in range(7):
        less = less + np.log(x)
        x = x + 1
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - less


def digamma(x: np.ndarray) -> np.ndarray:
    x, less = np.asarray(x, float).copy(), 0.0
    for _ in range(6):
        less = less + 1 / x
        x = x + 1
    return np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - less


@lru_cache(2)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers S(c, t): the weight of all ways to seat c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 0)) + out[c], -np.inf)
            out[c + 1] = np.logaddexp(np.where(c - d * t > 0, stay, -np.inf), np.concatenate([[-np.inf], out[c, :-1]]))
    return out


def log_gamma_far(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x)


SERIES = np.arange(1, 61)
#: The ray on which the integral is taken, by the logarithm of the distance in deviations, and its direction.
RAY, TURN = np.linspace(-16, 8, 120), np.exp(1.25j)


def saddle(n: np.ndarray, t: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the generating function g(x) = ((1 - (1 - x)^d) / d)^t, where x^n comes from: y = -log(1 - x) at the saddle point of g(x) / x^(n + 1), the deviation there on x, log(n! / t! g(x)), and the saddle point's estimate of log S(n, t)."""
    lo, hi = np.full(len(n), 1e-12), np.full(len(n), 700.0)
    for _ in range(52):
        y = (lo + hi) / 2
        high = np.log(t * d / n) + np.log(-np.expm1(-y)) + y * (1 - d) - np.log(-np.expm1(-d * y)) > 0
        lo, hi = np.where(high, lo, y), np.where(high, y, hi)
    y = (lo + hi) / 2
    slope = 1 / np.expm1(y) + (1 - d) - d / np.expm1(d * y)
    spread = n * np.maximum(slope, 1e-300) * np.expm1(np.minimum(y, 690.0))
    x, m = -np.expm1(-y), n - t
    head = log_gamma(n + 1) - log_gamma(t + 1) + t * (np.log(-np.expm1(-d * y)) - np.log(d))
    # near n the power of x is small, and its factorial's own series is what the estimate lacks
    return y, x / np.sqrt(spread), head, head - n * np.log(x) - 0.5 * np.log(2 * np.pi * spread) - 1 / (12 * m) + 1 / (360 * m**3)


def stirling_far(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for large c, where 1 <= t <= c - 1 need not be whole; c and t are equally long.

    For few tables by the alternating sum of rising factorials of -j d, used where its terms have ended and none is so much larger than the sum that its digits are lost; for
    almost as many tables as customers by the saddle point; for all between by the integral of g(x) / x^(c + 1) from the saddle point on outwards, along a ray past the branch point at 1.
    """
    out = np.empty(len(t))
    for lo in range(0, len(t), 512):  # some MB of room
        n, k = c[lo : lo + 512], t[lo : lo + 512]
        with np.errstate(all="ignore"):
            first, x = log_gamma_far(n - d), SERIES * d
            terms = -x * np.sin(np.pi * x) / np.pi * np.exp(log_gamma_far(n[:, None] - x) - first[:, None] + log_gamma(x))
            terms *= np.cumprod((SERIES - 1 - k[:, None]) / SERIES, axis=1)
            total, size = terms.sum(axis=1), np.abs(terms)
            found = np.log(np.maximum(total, 1e-300)) + first - k * np.log(d) - log_gamma(k + 1)
            rest = np.flatnonzero(~((total > 1e-5 * size.max(axis=1)) & (size[:, -8:].max(axis=1) < 1e-9 * total)))
            if len(rest):
                n, k = n[rest], k[rest]
                y, wide, head, rough = saddle(n, k, d)
                at = -np.expm1(-y)
                far = wide[:, None] * np.exp(RAY)
                z = far * TURN
                g = k[:, None] * np.log((1 - np.exp(d * np.log(np.exp(-y)[:, None] - z))) / -np.expm1(-d * y)[:, None]) - (n[:, None] + 1) * np.log1p(z / at[:, None])
                area = (np.exp(g) * TURN * far).imag.sum(axis=1) * (RAY[1] - RAY[0]) / np.pi
                found[rest] = np.where((n - k < 0.1 * n) | ~(area > 0), rough, head - (n + 1) * np.log(at) + np.log(np.maximum(area, 1e-300)))
        out[lo : lo + 512] = found
    return out


def seat_far(n: np.ndarray, room: np.ndarray, p: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """seat() for many customers: the top of the weight is found by the rough estimate, then by parabolas through exact weights, and a number within six deviations of it is drawn."""
    rows = np.arange(len(n))
    flat = lambda f, t: f(np.repeat(n, t.shape[1]), t.ravel(), d).reshape(t.shape)
    roughly = lambda k, t, d: saddle(k, t, d)[3]
    rest = lambda t: log_gamma(room[:, None] + t) - log_gamma(room)[:, None] + t * np.log(d * p)[:, None]
    lo, hi = np.zeros(len(n)), np.log(n - 1)  # of the logarithm of t; the weight has one top
    for _ in range(3):
        grid = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, 13)
        t = np.exp(grid).clip(1, (n - 1)[:, None])
        best = (flat(roughly, t) + rest(t)).argmax(axis=1)
        lo, hi = grid[rows, np.maximum(best - 1, 0)], grid[rows, np.minimum(best + 1, 12)]
    top, wide = np.clip(np.exp((lo + hi) / 2), 1.0, n - 1), None
    for _ in range(5):
        h = np.clip(top * 0.02 if wide is None else wide / 2, 0.5, np.maximum(np.minimum(top - 1, n - 1 - top), 0.5))
        at = np.clip(top, 1 + h, n - 1 - h)
        t = np.stack([at - h, at, at + h], axis=1)
        w = flat(stirling_far, t) + rest(t)
        bend = np.maximum(-(w[:, 0] - 2 * w[:, 1] + w[:, 2]) / h**2, 1e-12)
        wide = 1 / np.sqrt(bend)
        top = np.clip(at + np.clip((w[:, 2] - w[:, 0]) / (2 * h * bend), -8 * wide, 8 * wide), 1.0, n - 1)
    grid = np.rint(top[:, None] + wide[:, None] * np.linspace(-6, 6, 97)).clip(1, (n - 1)[:, None])
    w = rest(grid)
    few = top < 300
    w[few] += stirling_far(np.repeat(n[few], 97), grid[few].ravel(), d).reshape(-1, 97)
    if not few.all():
        # what the rough estimate lacks is smooth where tables are many: it is worked out at every eighth place
        many, t = n[~few], grid[~few]
        rough = roughly(np.repeat(many, 97), t.ravel(), d).reshape(t.shape)
        exact = stirling_far(np.repeat(many, 13), t[:, ::8].ravel(), d).reshape(-1, 13)
        w[~few] += rough + np.stack([np.interp(x, x[::8], e - r[::8]) for x, e, r in zip(t, exact, rough, strict=True)])
    w[:, 1:][grid[:, 1:] == grid[:, :-1]] = -np.inf
    w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    return grid[rows, (w < u[:, None] * w[:, -1:]).sum(axis=1).clip(0, 96)].astype(np.int64)


def seat(c: np.ndarray, room: np.ndarray, p: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of c customers of a dish each, drawn by the random numbers u from their full conditional.

    t tables weigh S(c, t) times d p (room + j) for each j below t, where room is the restaurant's strength over d and all tables of other dishes, and p the parent's probability.
    """
    tables = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    values, first = np.unique(c[order], return_index=True)
    for n, a, z in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(c)], strict=True):
        if n < 2 or n > EXACT:
            continue
        s, step = stirling(d)[n, 1 : n + 1], max(1, (1 << 20) // n)
        for i in range(a, z, step):
            rows = order[i : min(z, i + step)]
            w = np.cumsum(np.log(room[rows, None] + np.arange(n)) + np.log(d * p[rows])[:, None], axis=1) + s
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            tables[rows] = 1 + (w < u[rows, None] * w[:, -1:]).sum(axis=1).clip(0, n - 1)
    far = np.flatnonzero(c > EXACT)
    for i in range(0, len(far), 256):
        k = far[i : i + 256]
        tables[k] = seat_far(c[k].astype(float), room[k], p[k], d, u[k])
    return tables


def strength_of(c: np.ndarray, t: np.ndarray, d: float, n: np.ndarray | None = None) -> float:
    """A level's strength from its restaurants' customers and tables (n restaurants have each pair): the mean of the sampler with one auxiliary Beta and t - 1 auxiliary Bernoulli variables a restaurant, until it settles. Prior: Gamma(1, 1)."""
    n = (np.ones(len(c)) if n is None else n)[c > 1]
    c, t = c[c > 1].astype(float), t[c > 1].astype(float)
    s = STRENGTH
    for _ in range(60):
        opened_ = (s / d * (digamma(s / d + t) - digamma(s / d + 1.0)) * n).sum()
        s = float(np.clip((1 + opened_) / (1 - ((digamma(s + 1.0) - digamma(s + c)) * n).sum()), 0.01, 1e6))
    return s


# -- blocks, and what they ask


def in_slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about BLOCK_TOKENS bytes of text, or of one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column("_text")), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < b.num_rows:
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BLOCK_TOKENS, "right")))
        yield b.slice(a, z - a)
        a = z


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, between ASCII white space, A-Z lower-cased, and how many each text has."""
    clean = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    lists = pc.ascii_split_whitespace(clean)
    n = np.where(pc.equal(clean, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    found = lists.flatten()
    return found.filter(pc.not_equal(found, "")), n


def block_of(block: int, held: list[tuple[pa.Array, pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """held: ids, learn, words and their numbers. A block numbers its words itself; the end of a text is the last of its words."""
    ids, learn = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
    words = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
    n = np.concatenate([h[3] for h in held]) + 1
    end = len(words.dictionary)
    flat = np.full(n.sum(), end)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(n) - 1] = True
    flat[~ends] = words.indices.to_numpy()
    learns = learn.to_numpy(zero_copy_only=False)
    counts = np.bincount(flat[np.repeat(learns, n)], minlength=end + 1)
    names = b"\n".join([*(x.encode() for x in words.dictionary.to_pylist()), END])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), one(ids), one(learn), one(pa.array(n, pa.int32())), *(pa.array([x], pa.binary()) for x in (zstandard.compress(names, 3), shut(counts), shut(flat)))], ["block", "ids", "learn", "length", "words", "n", "tokens"])


def blocks_of(docs: DataFrame, learn: Column, *, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, learn, length, words, n, tokens): texts as numbers into the block's own list of words, n of which stand in texts to learn from."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, total = count(TaskContext.get().partitionId() << 32), [], 0
        for b in batches:
            for part in in_slices(b):
                found, n = split_words(part.column("_text"))
                held.append((part.column("_id"), part.column("_learn"), found, n))
                total += len(found) + len(n)
                if total >= BLOCK_TOKENS:
                    yield block_of(next(number), held)
                    held, total = [], 0
        if held:
            yield block_of(next(number), held)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    return rows.mapInArrow(run, f"block long, ids array<{kind.simpleString()}>, learn array<boolean>, length array<int>, words binary, n binary, tokens binary")


def parts_of_words(words: list[bytes], parts: int) -> np.ndarray:
    return (np.array([xxhash.xxh64_intdigest(w, 3) for w in words], np.uint64) % np.uint64(parts)).astype(np.int64)


def parts_of_ids(ids: np.ndarray, parts: int) -> np.ndarray:
    """The start of texts goes with their end, so that its part is never empty."""
    return np.where(ids == START, parts_of_words([END], parts)[0], (ids - FIRST_WORD) % parts)


def parts_of_pairs(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def sliced(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that puts equal parts together, and (part, from, to) of each."""
    if not len(part):
        return np.zeros(0, np.int64), []
    # 16-bit numbers are sorted by radix
    order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True))


QUESTION = "part long, block long, data binary"


def questions(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["part", "block", "data"])


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Groups of rows that come in order of key."""
    now, held = None, []
    for b in batches:
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            if k[a] != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(k[a])
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def word_questions(blocks: DataFrame, parts: int) -> DataFrame:
    """Each block's words and counts, a list for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, n in zip(b.column("block").to_pylist(), b.column("words"), b.column("n"), strict=True):
                words, (n,) = zstandard.decompress(words.as_py()).split(b"\n"), opened(n.as_py(), 1)
                order, cuts = sliced(parts_of_words(words, parts))
                pick = order.tolist()
                yield questions([(p, block, len(x := shut(n[order[a:z]])).to_bytes(4, "little") + x + zstandard.compress(b"\n".join([words[i] for i in pick[a:z]]), 3)) for p, a, z in cuts])

    return blocks.select("block", "words", "n").mapInArrow(run, QUESTION)


def number_words(asked: DataFrame, parts: int) -> DataFrame:
    """Answers (part, block, data: number and count of each word that the block asked of the part), and for block -1 the counts of the part's known words, how many those are, and their customers.

    A part's words get numbers in order of their counts, dealt out like cards among the parts, so that frequent words have small ones. Words without a text to learn from are unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_key(batches, "part"):
            place, total, lists = defaultdict(count().__next__), np.zeros(0, np.int64), []
            for data in rows.column("data"):
                raw = data.as_py()
                size = int.from_bytes(raw[:4], "little")
                (n,) = opened(raw[4 : 4 + size], 1)
                at = np.fromiter(map(place.__getitem__, zstandard.decompress(raw[4 + size :]).split(b"\n")), np.int64, len(n))
                total = np.concatenate([total, np.zeros(len(place) - len(total), np.int64)])
                total[at] += n  # a list has a word once
                lists.append(at)
            order = np.argsort(-total, kind="stable")
            number = np.empty(len(total), np.int64)
            number[order] = np.arange(len(total)) * parts + part + FIRST_WORD
            number[total == 0] = UNKNOWN
            end = place.get(END, -1)
            known = total[order][total[order] > 0]
            out = [(part, -1, shut(known, (order == end)[: len(known)]), len(known), int(known.sum()))]
            out += [(part, block, shut(number[at], total[at]), 0, 0) for block, at in zip(rows.column("block").to_pylist(), lists, strict=True)]
            for i in range(0, len(out), 256):
                cols = list(zip(*out[i : i + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 2 else pa.int64()) for k, c in enumerate(cols)], ["part", "block", "data", "known", "customers"])

    return gathered(asked, parts).mapInArrow(run, f"{QUESTION}, known long, customers long")


def gathered(rows: DataFrame, parts: int, *more: str) -> DataFrame:
    return rows.repartition(parts, "part").sortWithinPartitions("part", *more)


def met(blocks: DataFrame, answers: DataFrame, into: int) -> DataFrame:
    """Blocks, each followed by its answers in order of their parts: rows(block, part, data, ..) where a block's own row has part -1."""
    own = blocks.withColumns({"part": F.lit(-1).cast("long"), "data": F.lit(None).cast("binary")})
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in blocks.schema if f.name != "block"]
    return own.unionByName(answers.filter("block >= 0").select("block", "part", "data", *nothing)).repartition(into, "block").sortWithinPartitions("block", "part")


NUMBERED = "block long, ids array<{0}>, learn array<boolean>, length array<int>, tokens binary, numbers binary, known array<int>, base array<double>, part long, data binary"


def pairs_of(tokens: np.ndarray, number: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word and of the one before it."""
    word = number[tokens]
    last = np.roll(word, 1)
    last[np.cumsum(length) - length] = START
    return word, last


def numbered(blocks: DataFrame, answers: DataFrame, parts: int, into: int) -> DataFrame:
    """Blocks with their words' numbers and counts, and each document's known words and base; beside them (part not null) the pairs of words that they ask each part for, with their customers."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    names = [x.split()[0] for x in NUMBERED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in by_key(batches, "block"):
            words = zstandard.decompress(rows.column("words")[0].as_py()).split(b"\n")
            (tokens,), length = opened(rows.column("tokens")[0].as_py(), 1), np.array(rows.column("length")[0].as_py())
            learn = np.array(rows.column("learn")[0].as_py())
            order, cuts = sliced(parts_of_words(words, parts))
            number, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for (_, a, z), data in zip(cuts, rows.column("data").slice(1), strict=True):
                number[order[a:z]], n[order[a:z]] = opened(data.as_py(), 2)
            starts = np.cumsum(length) - length
            known = np.add.reduceat((n > 0)[tokens].astype(np.int64), starts)
            base = np.add.reduceat(np.log10(n + 1.0)[tokens], starts)
            own = rows.slice(0, 1)
            none = lambda t: pa.nulls(1, t)
            plain = lambda c: own.column(c).combine_chunks()
            types = [plain(c).type for c in ("ids", "learn", "length")]
            yield pa.RecordBatch.from_arrays([plain("block"), plain("ids"), plain("learn"), plain("length"), plain("tokens"), pa.array([shut(number, n)], pa.binary()), pa.array([known], pa.list_(pa.int32())), pa.array([base], pa.list_(pa.float64())), none(pa.int64()), none(pa.binary())], names)
            keys, which, ok = asked_pairs(tokens, number, length)
            customers = np.bincount(which, np.repeat(learn, length)[ok], len(keys)).astype(np.int64)
            order, cuts = sliced(parts_of_pairs(keys, parts))
            keys, customers = keys[order], customers[order]
            for i in range(0, len(cuts), 512):
                some = cuts[i : i + 512]
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), *(pa.nulls(k, t) for t in (*types, pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()))), pa.array([p for p, *_ in some], pa.int64()), pa.array([shut(np.diff(keys[a:z] >> 32, prepend=0), keys[a:z] & LOW, customers[a:z]) for _, a, z in some], pa.binary())], names)

    return met(blocks, answers, into).mapInArrow(run, NUMBERED.format(kind))


def asked_pairs(tokens: np.ndarray, number: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct pairs (last << 32 | word) of known words, sorted, and which of them each word ends, for the words where both are known."""
    word, last = pairs_of(tokens, number, length)
    ok = (word != UNKNOWN) & (last != UNKNOWN)
    keys, which = np.unique(last[ok] << 32 | word[ok], return_inverse=True)
    return keys, which, ok


def counted(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that a part is asked for and their customers; and which pair each entry of the lists is, and where the lists end."""
    found = [opened(x.as_py(), 3) for x in lists]
    keys, which = np.unique(np.concatenate([np.cumsum(last) << 32 | word for last, word, _ in found]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for *_, n in found]), len(keys)).astype(np.int64), which, np.cumsum([len(n) for *_, n in found])


# -- sweeps


#: A part's state is a row whose block is -1: of pairs of two customers or more (keys, c, t, and the t of earlier samples; a: customers, b: pairs of two), or of words (n, whether it is
#: a text's end, tables, c0, t0; a: customers of the root, b: its tables, c: tables of the restaurant of text starts, d and e: dishes of one and of two customers). Other rows are lists between parts of pairs and of words.
STATE = QUESTION + ", a long, b long, c long, d long, e long"
LOW = (1 << 32) - 1


def state_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*[(*r, *(0,) * (8 - len(r))) for r in rows], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(cols)], ["part", "block", "data", "a", "b", "c", "d", "e"])


def ids_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a part's pairs, and where in them the first and the second word of each pair are."""
    last, word = keys >> 32, keys & LOW
    ids = np.unique(np.concatenate([last, word]))
    return ids, np.searchsorted(ids, last), np.searchsorted(ids, word)


def with_lists(part: int, keys: np.ndarray, c: np.ndarray, t: np.ndarray, kept: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """The state of a part of pairs, and what its words' parts need of it: by how many customers have no table of their own, as dishes of a restaurant and of the root."""
    yield state_rows([(part, -1, shut(np.diff(keys, prepend=0), c, t, *kept), int(c.sum()), int((c == 2).sum()))])
    ids, last, word = ids_of(keys)
    less = [np.bincount(x, c - t, len(ids)).astype(np.int64) for x in (last, word)]
    order, cuts = sliced(parts_of_ids(ids, parts))
    for i in range(0, len(cuts), 512):
        yield state_rows([(p, part, shut(np.diff(ids[k], prepend=0), *(x[k] for x in less))) for p, a, z in cuts[i : i + 512] for k in (order[a:z],)])


def begun(asked: DataFrame, parts: int) -> DataFrame:
    """The pairs of two customers or more, at tables that are a guess."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_key(batches, "part"):
            keys, c, *_ = counted(rows.column("data"))
            keys, c = keys[c > 1], c[c > 1]
            yield from with_lists(part, keys, c, np.maximum(1, c**0.7).astype(np.int64), [], parts)

    return gathered(asked, parts).mapInArrow(run, STATE)


@dataclass(frozen=True)
class Given:
    """What all parts share in a sweep. root: customers and tables of the root before it."""

    parts: int
    words: int
    starts: int
    discount: tuple[float, float] = (DISCOUNT,) * 2
    strength: tuple[float, float] = (STRENGTH,) * 2
    root: tuple[int, int] = (0, 0)


def seat_words(rows: DataFrame, g: Given, seed: int, draw: Callable, *, first: bool = False) -> DataFrame:
    """Words' totals by the lists of the pairs' parts, the root seated anew, and an answer to each list. rows(part, block, data): states and lists; at first the states are the counts that number_words() gives."""
    of_start = int(parts_of_ids(np.array([START]), g.parts)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in by_key(batches, "part"):
            blocks, data = group.column("block").to_pylist(), group.column("data")
            own = blocks[0] == -1
            n, end, *old = opened(data[0].as_py(), 2 if first else 5) if own else (np.zeros(0, np.int64),) * 2
            if first and part == of_start:
                n, end = np.append(n, g.starts), np.append(end, 0)  # the start of texts, a restaurant and no dish
            less = np.zeros((2, len(n)), np.int64)
            places = []
            for x in data.slice(int(own)):
                ids, of_last, of_word = opened(x.as_py(), 3)
                ids = np.cumsum(ids)
                at = np.where(ids == START, len(n) - 1, (ids - FIRST_WORD) // g.parts)
                less[0, at] += of_last  # a list has a word once
                less[1, at] += of_word
                places.append(at)
            tables, c0, start = np.where(end > 0, 0, n - less[0]), n - less[1], 0
            if part == of_start:
                c0[-1], start = 0, int(tables[-1])
            if first:
                t0 = np.minimum(c0, 1)
            else:
                (d, s), t = (g.discount[0], g.strength[0]), old[2]
                t0 = draw(c0, np.maximum(s / d + g.root[1] - t, 1e-6), np.full(len(n), 1.0 / (g.words + 1)), d, uniform(np.arange(len(n)).astype(np.uint64) * np.uint64(g.parts) + np.uint64(part), seed))
            yield state_rows([(part, -1, shut(n, end, tables, c0, t0), int(c0.sum()), int(t0.sum()), start, int((c0 == 1).sum()), int((c0 == 2).sum()))])
            for i in range(0, len(places), 512):
                yield state_rows([(b, part, shut(tables[at], c0[at], t0[at])) for b, at in zip(blocks[int(own) + i :], places[i : i + 512], strict=False)])

    return gathered(rows, g.parts, "block").mapInArrow(run, STATE)


def seat_pairs(rows: DataFrame, g: Given, seed: int, draw: Callable, *, keep: bool, samples_before: int) -> DataFrame:
    """Pairs seated anew, given their words' totals. rows(part, block, data): states and answers. keep: the tables before stay beside the new ones, as do those of samples_before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in by_key(batches, "part"):
            keys, c, t, *kept = opened(group.column("data")[0].as_py(), 3 + samples_before)
            keys = np.cumsum(keys)
            ids, last, word = ids_of(keys)
            totals = np.zeros((3, len(ids)), np.int64)
            order, cuts = sliced(parts_of_ids(ids, g.parts))
            for (_, a, z), data in zip(cuts, group.column("data").slice(1), strict=True):
                totals[:, order[a:z]] = opened(data.as_py(), 3)
            tables, c0, t0 = totals
            p0 = root_probability(c0, t0, g)
            d, s = g.discount[1], g.strength[1]
            new = draw(c, s / d + tables[last] - t, p0[word], d, uniform(mixed(keys.astype(np.uint64)), seed))
            yield from with_lists(part, keys, c, new, [*kept, t] if keep else kept, g.parts)

    return gathered(rows, g.parts, "block").mapInArrow(run, STATE)


def root_probability(c0: np.ndarray, t0: np.ndarray, g: Given) -> np.ndarray:
    d, s = g.discount[0], g.strength[0]
    return (c0 - d * t0 + (s + d * g.root[1]) / (g.words + 1)) / (s + g.root[0])


def let_go(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are written and no longer referred to; it does so when its driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Model:
    """Sweeps over written states: of pairs and of words, each half a sweep, which ask each other by lists."""

    def __init__(self, asked: DataFrame, answers: DataFrame, g: Given, seed: int, draw: Callable):
        self.spark, self.g, self.seed, self.draw, self.sweeps, self.samples = asked.sparkSession, g, seed, draw, 0, []
        self.pairs, self.pairs_path = written(begun(asked, g.parts), "pairs")
        self.words, self.words_path = written(seat_words(self.lists(self.pairs).unionByName(answers.filter("block = -1").select("part", "block", "data")), g, 0, draw, first=True), "words")
        self.read_root()

    @staticmethod
    def lists(frame: DataFrame) -> DataFrame:
        return frame.filter("block >= 0").select("part", "block", "data")

    @staticmethod
    def states(frame: DataFrame) -> DataFrame:
        return frame.filter("block = -1").select("part", "block", "data")

    def read_root(self) -> None:
        r = self.words.filter("block = -1").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "abcde"]).first()
        self.g, self.start, self.root_dishes = replace(self.g, root=(r["a"], r["b"])), r["c"], (r["d"], r["e"])

    def sweep(self, *, keep: bool = False) -> None:
        """All dishes seated anew, given the totals of the state before. keep: that state is a sample: the pairs hold its tables from now on, and its words stay."""
        self.sweeps += 1
        seed, before = self.seed * 1009 + self.sweeps * 2, [self.pairs_path]
        self.pairs, self.pairs_path = written(seat_pairs(self.states(self.pairs).unionByName(self.lists(self.words)), self.g, seed, self.draw, keep=keep, samples_before=len(self.samples)), "pairs")
        (self.samples if keep else before).append(self.words_path)
        self.words, self.words_path = written(seat_words(self.lists(self.pairs).unionByName(self.states(self.words)), self.g, seed + 1, self.draw), "words")
        self.read_root()
        self.drop(*before)

    def drop(self, *paths: str) -> None:
        for path in paths:
            drop_path(self.spark, path)
        let_go(self.spark)

    def estimate(self, tokens: int) -> None:
        """Discounts from the dishes with one and two customers, then strengths from a histogram of the restaurants' totals, in which numbers over 1,000 count by three digits."""
        r = self.pairs.filter("block = -1").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("c"), F.coalesce(F.sum("b"), F.lit(0)).alias("two")).first()
        of = lambda a, b: float(np.clip(a / (a + 2 * b), 0.1, 0.95)) if a + b else DISCOUNT
        discount = (of(*self.root_dishes), of(tokens - r["c"], r["two"]))

        def coarse(x: np.ndarray) -> np.ndarray:
            unit = 10 ** np.maximum(np.floor(np.log10(np.maximum(x, 1))).astype(np.int64) - 2, 0)
            return (x + unit // 2) // unit * unit

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column("data"):
                    n, end, tables, *_ = opened(data.as_py(), 5)
                    both, k = np.unique(np.stack([coarse(x[(n > 1) & (end == 0)]) for x in (n, tables)]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(k.astype(np.int64))], ["n", "tables", "k"])

        rows = self.states(self.words).select("data").mapInArrow(histogram, "n long, tables long, k long").groupBy("n", "tables").agg(F.sum("k").alias("k")).collect()
        level = strength_of(*(np.array([x[c] for x in rows], float) for c in ("n", "tables")), discount[1], np.array([x["k"] for x in rows], float))
        self.g = replace(self.g, discount=discount, strength=(strength_of(*(np.array([x]) for x in self.g.root), discount[0]), level))


def probability(c: np.ndarray, t: np.ndarray, n: np.ndarray, tables: np.ndarray, c0: np.ndarray, t0: np.ndarray, g: Given) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """What a word's probability is made of, by one sample: (own of a pair + rest of its restaurant * root of its word) / norm of the restaurant, as own, (rest, norm), root.

    A pair has c customers at t tables, a restaurant n customers and `tables`, a word c0 at t0 in the root.
    """
    d, s = g.discount[1], g.strength[1]
    return c - d * t, (s + d * tables, s + n), root_probability(c0, t0, g)


# -- scores


def answered(rows: DataFrame, parts: int, samples: int) -> DataFrame:
    """What the samples say of the pairs and words that blocks ask for, each in the order of the question: customers and each sample's tables of a pair; customers, then each sample's tables, c0 and t0 of a word.

    rows(part, block, data): questions, and before them (block below 0) the part's states. Parts from `parts` on are those of words, with a state for each sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in by_key(batches, "part"):
            blocks, data = group.column("block").to_pylist(), group.column("data")
            own = sum(b < 0 for b in blocks)
            lists = data.slice(own)
            if not len(lists):
                continue
            if part < parts:
                # a pair without a state has one customer, who has a table of its own, or none
                pairs, c, which, ends = counted(lists)
                values = [np.minimum(c, 1) for _ in range(samples + 1)]
                if own:
                    keys, c, t, *kept = opened(data[0].as_py(), samples + 2)
                    there = np.searchsorted(pairs, np.cumsum(keys))
                    for column, x in zip(values, (c, *kept, t), strict=True):
                        column[there] = x
                at = np.split(which, ends[:-1])
            else:
                found = [opened(x.as_py(), 5) for x in data.slice(0, own)]
                values = [np.where(found[0][1] > 0, 0, found[0][0]), *(f[k] for k in (2, 3, 4) for f in found)]
                at = [(np.cumsum(opened(x.as_py(), 1)[0]) - FIRST_WORD) // parts for x in lists]
            for i in range(0, len(at), 256):
                yield questions([(part, b, shut(*(x[k] for x in values))) for b, k in zip(blocks[own + i :], at[i : i + 256], strict=False)])

    return gathered(rows, 2 * parts, "block").mapInArrow(run, QUESTION)


def words_asked(blocks: DataFrame, parts: int) -> DataFrame:
    """The known words of each block, by their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, numbers in zip(b.column("block").to_pylist(), b.column("numbers"), strict=True):
                ids = np.unique(opened(numbers.as_py(), 2)[0])
                ids = ids[ids >= FIRST_WORD]
                order, cuts = sliced((ids - FIRST_WORD) % parts)
                ids = ids[order]
                yield questions([(parts + p, block, shut(np.diff(ids[a:z], prepend=0))) for p, a, z in cuts])

    return blocks.select("block", "numbers").mapInArrow(run, QUESTION)


def scored(blocks: DataFrame, answers: DataFrame, score: Callable, parts: int, into: int, samples: int, starts: tuple[int, ...]) -> DataFrame:
    """(_id, held_out, n_tokens, n_known, base, score) of each document. starts: the texts to learn from, then the tables of the restaurant of text starts in each sample."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "block"):
            (tokens,), length = opened(rows.column("tokens")[0].as_py(), 1), np.array(rows.column("length")[0].as_py())
            number, n = opened(rows.column("numbers")[0].as_py(), 2)
            learn = np.array(rows.column("learn")[0].as_py())
            given = dict(zip(rows.column("part").to_pylist()[1:], rows.column("data").slice(1), strict=True))
            keys, which, ok = asked_pairs(tokens, number, length)
            pair = np.zeros((len(keys), samples + 1), np.int64)
            order, cuts = sliced(parts_of_pairs(keys, parts))
            for p, a, z in cuts:
                pair[order[a:z]] = np.stack(opened(given[p].as_py(), samples + 1), axis=1)
            ids = np.unique(number)
            ids = ids[ids >= FIRST_WORD]
            of = np.zeros((len(ids) + 2, 3 * samples + 1), np.int64)  # unknown, text start, then the words
            of[1, 0], of[1, 1 : 1 + samples] = starts[0], starts[1:]
            order, cuts = sliced((ids - FIRST_WORD) % parts)
            for p, a, z in cuts:
                of[order[a:z] + 2] = np.stack(opened(given[parts + p].as_py(), 3 * samples + 1), axis=1)
            w, u = pairs_of(tokens, np.where(number >= FIRST_WORD, np.searchsorted(ids, number) + 2, number), length)
            p = np.zeros(len(tokens))
            for k in range(samples):
                own, rest, root = score(k, pair[:, 0], pair[:, 1 + k], of[:, 0], of[:, 1 + k], of[:, 1 + samples + k], of[:, 1 + 2 * samples + k])
                p[ok] += own[which] / (rest[1][u[ok]] * samples)
                p += (rest[0] / rest[1])[u] * (root / samples)[w]
            total = np.add.reduceat(np.log10(p), np.cumsum(length) - length)
            one = lambda c: rows.column(c).slice(0, 1).combine_chunks().flatten()
            yield pa.RecordBatch.from_arrays([one("ids"), pa.array(~learn), pa.array(length.astype(np.int64)), one("known").cast(pa.int64()), one("base"), pa.array(total)], ["_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return met(blocks, answers, into).mapInArrow(run, f"_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")


def score_texts(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, draw: Callable = seat) -> DataFrame:
    """Scores every row by a model of the rows for which learn holds.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score, both log10 probabilities of the whole text with its end, and
    perplexity by score. draw chooses the number of tables as seat() does. Null counts as an empty text, which is its end alone. Repeated rows and ids, null ids too, are scored, and learned from, each time. Without rows to learn
    from, both models are uniform over the one unknown word. Texts of any length are one row of a block. Empty input gives empty output.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks, blocks_path = written(blocks_of(docs, learn, id_col=id_col, text_col=text_col), "blocks")
    size = blocks.select(F.count(F.lit(1)).alias("blocks"), F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"), F.sum(F.size(F.filter("learn", lambda x: x))).alias("texts")).first()
    parts, into, texts = max(1, -(-(size["n"] or 0) // PART_TOKENS)), max(1, size["blocks"]), size["texts"] or 0
    answers, answers_path = written(number_words(word_questions(blocks, parts), parts), "numbers")
    let_go(spark)
    ready, ready_path = written(numbered(blocks.drop("n"), answers, parts, into), "numbered")
    asked, own = ready.filter("part is not null").select("part", "block", "data"), ready.filter("part is null").select("block", "ids", "learn", "length", "tokens", "numbers", "known", "base")
    known = answers.filter("block = -1").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("words"), F.coalesce(F.sum("customers"), F.lit(0)).alias("tokens")).first()
    drop_path(spark, blocks_path)
    let_go(spark)
    model = Model(asked, answers, Given(parts, known["words"], texts), seed, draw)
    model.drop(answers_path)
    for _ in range(FIRST_SWEEPS):
        model.sweep()
    model.estimate(known["tokens"])
    given, words, starts = [], [], []
    for k in range(BURN_IN + SAMPLES):
        model.sweep(keep=k > BURN_IN)
        if k >= BURN_IN:
            given.append(model.g)
            state = model.words.filter("block = -1")
            words.append(state.select((F.col("part") + parts).alias("part"), F.lit(len(words) - SAMPLES).cast("long").alias("block"), "data"))
            starts.append(model.start)
    rows = asked.unionByName(words_asked(own, parts)).unionByName(model.states(model.pairs))
    for w in words:
        rows = rows.unionByName(w)
    replies, _ = written(answered(rows, parts, SAMPLES), "answers")
    model.drop(model.pairs_path, model.words_path, *model.samples)

    def score(k: int, *columns: np.ndarray) -> tuple:
        return probability(*columns, given[k])

    out = scored(own, replies, score, parts, into, SAMPLES, (texts, *starts))
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(known["tokens"] + known["words"] + 1)))
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(known["tokens"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
