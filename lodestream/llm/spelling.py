"""Spelling variants: words one edit apart, found by Gram matrices of letter counts over blocks.

An edit of one letter changes the counts of letters by one (inserted, deleted) or two (replaced) in sum of squares. So words are dealt to blocks by their length and how
many letters of each class they hold, and only blocks that one edit can lead to meet. For each such pair of blocks, tile by tile, a matrix product of
the letter counts gives all squared distances; pairs of at most two are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_path, written

#: Words and letters of a tile at most, on average: blocks of more are cut by a hash. Products are made in strips of so many cells.
TILE, TILE_LETTERS, CELLS = 2048, 1 << 20, 1 << 21
#: Columns of the letter counts: a to z, and six that the other letters share. Sharing never makes a distance larger.
COLUMNS = 32
#: So many parts of a block meet its size separately, lest a block with a third of all words meet it in one task.
SALTS = 16


def columns_of(codes: np.ndarray) -> np.ndarray:
    """A letter's column, from its code point."""
    small = (codes >= 97) & (codes <= 122)
    return np.where(small, codes - 97, 26 + codes % (COLUMNS - 26)).astype(np.int64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """A row of counts for each word of a (words, length) matrix of code points, in floats that hold the products exactly."""
    n, length = codes.shape
    cells = np.arange(n)[:, None] * COLUMNS + columns_of(codes)
    return np.bincount(cells.ravel(), minlength=n * COLUMNS).reshape(n, COLUMNS).astype(np.float32 if length <= 2048 else np.float64)


def near_pairs(a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words that one inserted or replaced letter leads from a to b; b is None for pairs inside a. b's words have as many letters, or one more."""
    fa = letter_counts(a)
    b, fb = (a, fa) if b is None else (b, letter_counts(b))
    inside, na, nb = b is a, (fa * fa).sum(axis=1), (fb * fb).sum(axis=1)
    strip = max(1, CELLS // len(b))
    for lo in range(0, len(a), strip):
        distance = na[lo : lo + strip, None] + nb[None, :] - 2 * (fa[lo : lo + strip] @ fb.T)
        i, j = np.nonzero(distance <= 2)
        i += lo
        if inside:
            i, j = i[i < j], j[i < j]
        step = max(1, CELLS // max(1, b.shape[1]))
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            ok = one_edit(a[x], b[y])
            if ok.any():
                yield x[ok], y[ok]


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of words side by side, whether exactly one code point is replaced, or, where y is longer by one, inserted."""
    n = x.shape[1]
    if y.shape[1] == n:
        return (x != y).sum(axis=1) == 1
    front = np.logical_and.accumulate(x == y[:, :n], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= n


def blocked(words: DataFrame, classes: int) -> DataFrame:
    """words(word, n) with block: how many letters of each class a word holds. Their sum is its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("word").to_pylist()
            rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            counts = np.bincount(rows * classes + columns_of(codes_of("".join(texts))) % classes, minlength=len(texts) * classes)
            ends = np.arange(0, len(counts) + 1, classes, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(counts, pa.int32()))], ["word", "n", "block"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, block array<int>")


def neighbours(block: Column, classes: int) -> Column:
    """The blocks that one inserted or replaced letter leads to, of two that lead to each other one only; the block itself in front."""
    moved = lambda up, down: F.array(*[block[i] + F.lit((i == up) - (i == down)) for i in range(classes)])
    steps = [block, *[moved(i, -1) for i in range(classes)], *[moved(j, i) for i in range(classes) for j in range(i + 1, classes)]]
    return F.filter(F.array(*steps), lambda b: F.array_min(b) >= 0)


def links(words: DataFrame, *, classes: int | None = None) -> DataFrame:
    """(word, other, other_n): both directions of every pair of distinct words one edit apart. words(word, n), each word once.

    classes: of letters; more of them make blocks smaller and more numerous. By default their number follows the logarithm of the number of words, so
    that blocks stay small; any number gives the same pairs.
    """
    spark = words.sparkSession
    classes = classes or max(2, words.count().bit_length() // 3)
    keyed, keyed_path = written(blocked(words, classes), "blocked")
    length = F.aggregate("block", F.lit(0), lambda s, x: s + x)
    rows = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_LETTERS) / F.greatest(length, F.lit(1)))))
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n_words")).select("block", F.ceil(F.col("n_words") / rows).cast("int").alias("tiles"))
    sizes, sizes_path = written(sizes, "sizes")
    # merge: sizes grow with the vocabulary, and Spark doesn't see how much larger the repeated rows are than their files
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    cut = keyed.withColumn("salt", F.pmod(F.xxhash64("word", F.lit(5)), F.lit(SALTS)).cast("int")).join(salted, ["block", "salt"])
    cut = cut.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    own = F.sort_array(F.collect_list(F.struct("word", "n")))
    tiles = cut.groupBy("block", "tile").agg(own.alias("w")).select("block", "tile", F.array_join("w.word", "").alias("words"), F.col("w.n").alias("counts"))
    tiles, tiles_path = written(tiles, "tiles")
    asked = sizes.select("block", "tiles", F.explode(neighbours(F.col("block"), classes)).alias("to"))
    meet = asked.join(sizes.select(F.col("block").alias("to"), F.col("tiles").alias("to_tiles")).hint("merge"), "to")
    meet = meet.select("block", "to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "to_tiles").select("block", "tile", "to", F.explode(F.sequence(F.lit(0), F.col("to_tiles") - 1)).alias("to_tile"))
    meet = meet.filter((F.col("block") != F.col("to")) | (F.col("tile") <= F.col("to_tile")))
    other = tiles.select(F.col("block").alias("to"), F.col("tile").alias("to_tile"), F.col("words").alias("to_words"), F.col("counts").alias("to_counts"))
    both = meet.join(tiles.hint("merge"), ["block", "tile"]).join(other.hint("merge"), ["to", "to_tile"])
    same = (F.col("block") == F.col("to")) & (F.col("tile") == F.col("to_tile"))
    both = both.select("words", "counts", F.when(same, None).otherwise(F.col("to_words")).alias("to_words"), F.when(same, None).otherwise(F.col("to_counts")).alias("to_counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(words: str, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = np.asarray(counts.values)
            size = len(words) // len(n)
            return codes_of(words).reshape(len(n), size), n, np.array([words[i * size : (i + 1) * size] for i in range(len(n))], object)

        for b in batches:
            for words, counts, to_words, to_counts in zip(b.column("words"), b.column("counts"), b.column("to_words"), b.column("to_counts"), strict=True):
                codes, n, text = tile(words.as_py(), counts)
                to_codes, to_n, to_text = (None, n, text) if to_words.as_py() is None else tile(to_words.as_py(), to_counts)
                for i, j in near_pairs(codes, to_codes):
                    x, y = text[i], to_text[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y]), pa.string()), pa.array(np.concatenate([y, x]), pa.string()), pa.array(np.concatenate([to_n[j], n[i]]))], ["word", "other", "other_n"])

    out, _ = written(both.mapInArrow(run, "word string, other string, other_n long"), "near")
    for path in (keyed_path, sizes_path, tiles_path):
        drop_path(spark, path)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): where the chain of forms ends. Chains have no loops; each round doubles what a row has followed."""
    spark = forms.sparkSession
    now, path = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after, new_path = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_path(spark, path)
        path = new_path
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def group_variants(words: DataFrame, *, times: int = 10, classes: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words(word, n), each with its number of occurrences.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n (ties: the smallest in
    code-point order) if that n is at least times its own, else null; root: where following forms ends, the word itself if it has none. Rows that repeat a word
    are added up, null words dropped, a null n counts as 0, and a word of n 0 has no form; other columns are not kept. Empty words are near words of one letter. An empty table gives an empty result.
    times must be over 1, so that forms never lead in a circle.
    """
    spark = words.sparkSession
    words = words.filter("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    words, words_path = written(words, "words")
    near = links(words, classes=classes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), F.col("other").alias("form"))).alias("best"))
    formed = (F.col("n") > 0) & (-F.col("best.least") >= times * F.col("n"))
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.least")).alias("form_n"))
    rows, _ = written(rows, "formed")
    drop_path(spark, words_path)
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def typed_words(docs: DataFrame, *, least: int = 7, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of `least` letters or more occurs, with some letters left out.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where every divides h, the crc32 of id:word, the letter at h % length is left out. Null texts
    have no words, a null id counts as empty, repeated rows count each time. Occurrences are added up on the map side first.
    """
    run = F.explode(F.regexp_extract_all(text_col, F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0)))
    low = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), run.alias("w")).select("i", ascii_lower(F.col("w")).alias("w"))
    low = low.withColumn("h", F.crc32(F.concat_ws(":", "i", "w").cast("binary")))
    at = (F.col("h") % F.length("w")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w"))
    return low.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
