"""Benchmark decontamination over a stored positional inverted index, in DataFrame functions alone.

The index is a table of postings (row, term, pos) of the training texts, for the terms that the benchmark has; it is written in one pass over the texts, and
all that follows reads the index. A posting at position p of a term that a window has at offset o proposes the window at p - o: such offset-adjusted lists are
intersected, beginning with each window's rarest term by its count in the corpus, then the next rarest, then all others. What is left are the exact phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, drop_path, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A block of terms or windows that is sent to every task; a longer list goes over the index in several blocks.
TERMS_PER_BLOCK = 500_000


def word_list(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def windows_of(items: DataFrame, *, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, at, words): each n consecutive words of an item; an item of fewer words is one window, of none has none."""
    w = items.select(F.col(id_col).alias("item_id"), word_list(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - n, F.lit(0))
    return w.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item_id", "at", F.slice("w", F.col("at") + 1, n).alias("words"))


def blocks(rows: DataFrame, per_block: int, key: str = "term"):
    """rows in blocks of at most about per_block rows, by a hash of key, each small enough for a broadcast; their number is counted first."""
    n = rows.count()
    k = -(-n // per_block)
    for i in range(k):
        yield F.broadcast(rows if k == 1 else rows.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(k)) == i))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def build_index(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_block: int = TERMS_PER_BLOCK) -> tuple[DataFrame, list[str]]:
    """The stored index: (row, doc_id, term, pos), and where it lies. A posting names its document by row, which is unique even if doc_id is not; each document has one more row, whose term is null, with
    its doc_id and, as pos, its number of words. terms(term) are those that are indexed; beyond per_block of them, each block takes a pass over the texts of its own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), word_list(F.col(text_col)).alias("words"))
    every = rows.select("row", "doc_id", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "term"))
    nothing = F.lit(None).cast(docs.schema[id_col].dataType)
    ends, parts, paths = every.filter("term is null"), [], []
    for b in blocks(terms, per_block):
        # in the first block a document's own row comes along
        known = b.withColumn("known", F.lit(True))
        kept = every.join(known, "term", "left").filter("known" + " or term is null" * (not parts))
        part, path = written(kept.select("row", F.when(F.col("term").isNull(), F.col("doc_id")).otherwise(nothing).alias("doc_id"), "term", "pos"), "postings")
        parts.append(part), paths.append(path)
    if not parts:
        part, path = written(ends.select("row", "doc_id", "term", "pos"), "postings")
        parts, paths = [part], [path]
    return union_all(parts), paths


def ranked_windows(index: DataFrame, wins: DataFrame) -> DataFrame:
    """(words, ranks): each distinct list of words with its (tf, term, off) from the rarest term on, by the counts of the index. Windows with a term that no text has are left out."""
    tf = index.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    spots = wins.select("words").distinct().select("words", F.posexplode("words").alias("off", "term"))
    ranks = F.sort_array(F.collect_list(F.struct("tf", "term", "off"))).alias("ranks")
    found = spots.join(tf, "term").groupBy("words").agg(ranks)  # a window's own words: at most n
    return found.filter(F.size("ranks") == F.size("words")).select("words", "ranks")


def phrase_hits(index: DataFrame, windows: DataFrame, *, per_block: int = TERMS_PER_BLOCK) -> tuple[DataFrame, list[str]]:
    """(row, win, start) of exact occurrences: postings of each window's rarest term, moved by its offset, intersected with those of the next rarest and then of all other terms.

    windows(win, ranks). A join meets postings by (row, term, pos), so a common term of many texts is no group of its own. The lists to be kept are written first, as narrow rows:
    where their table is within spark.sql.autoBroadcastJoinThreshold, Spark sends it out; else it deals out the postings of the terms that are asked for.
    """
    posting = index.filter("term is not null").select("row", "term", "pos")
    by_rank = windows.select("win", F.size("ranks").alias("n"), F.posexplode("ranks").alias("rank", "r")).select("win", "n", "rank", "r.term", "r.off")
    begun = []
    for b in blocks(by_rank.filter("rank = 0").groupBy("term").agg(F.collect_list(F.struct("win", "off")).alias("wins")), per_block):
        near = posting.join(b, "term").select("row", "pos", F.explode("wins").alias("w"))
        begun.append(near.select("row", "w.win", (F.col("pos") - F.col("w.off")).alias("start")).filter("start >= 0"))
    if not begun:
        return posting.select("row", F.lit(0).cast("long").alias("win"), F.col("pos").alias("start")).limit(0), []
    starts, path = written(union_all(begun), "begun")
    paths = [path]

    def intersect(starts: DataFrame, ranks: Column) -> DataFrame:
        """Those of starts whose terms of these ranks stand where they should."""
        needed = by_rank.filter(ranks).select("win", "term", "off", F.count(F.lit(1)).over(Window.partitionBy("win")).alias("need"))
        asked, path = written(starts.join(needed, "win").select("row", "win", "start", "need", "term", (F.col("start") + F.col("off")).alias("pos")), "asked")
        paths.append(path)
        met = [posting.join(b, "term", "left_semi").join(asked, ["row", "term", "pos"]) for b in blocks(asked.select("term").distinct(), per_block)]
        short = starts.join(needed.select("win").distinct(), "win", "left_anti")
        if not met:
            return short
        whole = union_all(met).groupBy("row", "win", "start").agg(F.count(F.lit(1)).alias("met"), F.first("need").alias("need")).filter("met = need")
        return short.unionByName(whole.select("row", "win", "start"))

    second, path = written(intersect(starts, F.col("rank") == 1).select("row", "win", "start"), "second")
    paths.append(path)
    return intersect(second, F.col("rank") > 1).select("row", "win", "start"), paths


def proximity_hits(index: DataFrame, windows: DataFrame, *, slop: int, n: int, per_block: int = TERMS_PER_BLOCK) -> DataFrame:
    """(row, win, start) of places where all of a window's distinct words stand within a span of its length + slop words around a posting of its rarest term; start is the posting's position less the offset.

    Postings of the other terms meet the place in cells of `reach` positions, so a long text's repeated words don't meet each other in full.
    """
    posting = index.filter("term is not null").select("row", "term", "pos")
    reach = n - 1 + slop
    cell = lambda p: F.floor(p / (reach + 1)).cast("int")
    out = []
    for b in blocks(windows.groupBy(F.col("ranks")[0]["term"].alias("term")).agg(F.collect_list(F.struct("win", "words", F.col("ranks")[0]["off"].alias("off"))).alias("wins")), per_block):
        probe = posting.join(b, "term").select("row", F.col("pos").alias("p"), F.explode("wins").alias("w")).select("row", "p", "w.win", "w.words", "w.off")
        asked = probe.select("row", "p", "win", "words", "off", F.explode(F.array_distinct("words")).alias("term"))
        asked = asked.withColumn("cell", F.explode(F.array(cell(F.col("p")) - 1, cell(F.col("p")), cell(F.col("p")) + 1)))
        met = posting.withColumn("cell", cell(F.col("pos"))).join(asked, ["row", "term", "cell"]).filter(F.abs(F.col("pos") - F.col("p")) <= reach)
        # at most 2 * reach + 1 positions
        around = met.groupBy("row", "p", "win", "words", "off").agg(F.collect_set(F.struct("pos", "term")).alias("seen"))
        span, distinct = F.size("words") + slop, F.array_distinct("words")
        inside = lambda lo: F.size(F.array_distinct(F.transform(F.filter("seen", lambda s: (s["pos"] >= lo) & (s["pos"] < lo + span)), lambda s: s["term"])))  # noqa: E731, B023
        close = F.exists("seen", lambda s: inside(s["pos"]) == F.size(distinct))  # noqa: B023
        out.append(around.filter(close).select("row", "win", (F.col("p") - F.col("off")).alias("start")))
    return union_all(out) if out else posting.select("row", F.lit(0).cast("long").alias("win"), F.col("pos").alias("start")).limit(0)


def matches(docs: DataFrame, items: DataFrame, *, n: int, slop: int, id_col: str, text_col: str, item_id_col: str, item_text_col: str, per_block: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(hits, documents, paths): hits(row, item_id, at, start, length, kind), documents(row, doc_id, n_words) by the index that lies at paths."""
    wins, wins_path = written(windows_of(items, n=n, id_col=item_id_col, text_col=item_text_col), "windows")
    index, paths = build_index(docs, wins.select(F.explode("words").alias("term")).distinct(), id_col=id_col, text_col=text_col, per_block=per_block)
    windows, path = written(ranked_windows(index, wins).withColumn("win", F.monotonically_increasing_id()), "ranked")
    found, more = phrase_hits(index, windows, per_block=per_block)
    found = found.withColumn("kind", F.lit("phrase"))
    if slop:
        near = proximity_hits(index, windows, slop=slop, n=n, per_block=per_block).withColumn("kind", F.lit("proximity"))
        found = found.unionByName(near).groupBy("row", "win", "start").agg(F.min("kind").alias("kind"))
    # an id may be null or name several items, so the words tell windows apart
    hits = found.join(windows.select("win", "words"), "win").join(wins, "words").select("row", "item_id", "at", "start", F.size("words").alias("length"), "kind")
    ends = index.filter("term is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return hits, ends, [wins_path, path, *paths, *more]


def index_matches(docs: DataFrame, items: DataFrame, *, n: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", per_block: int = TERMS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, at, start, length, kind): where the item's window at word `at` occurs in the document.

    kind "phrase": the window's words stand at start, in order. With slop > 0 also "proximity": all of its distinct words stand within
    a span of length + slop words around the rarest one; start is then that posting's position less its offset.
    Windows with a word that the corpus never has cannot occur. Null ids and texts of items and documents are handled like any value: a null
    text has no words. Items that share an id are matched apart, and so are documents. Empty tables give no rows.
    """
    hits, ends, _ = matches(docs, items, n=n, slop=slop, id_col=id_col, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col, per_block=per_block)
    return hits.join(ends, "row").select("doc_id", "item_id", "at", "start", "length", "kind")


def contamination(docs: DataFrame, items: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", per_block: int = TERMS_PER_BLOCK) -> DataFrame:
    """One row per document row: id, n_words, n_hit (words inside any phrase match), n_items, items (sorted texts of ids), contaminated.

    Each row is judged by its own text, whatever its id. An item with a null id counts for n_hit, not for items. An empty items table leaves every count 0.
    """
    hits, ends, paths = matches(docs, items, n=n, slop=0, id_col=id_col, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col, per_block=per_block)
    hits, _ = written(hits, "hits")
    ends, _ = written(ends, "ends")
    for path in paths:
        drop_path(docs.sparkSession, path)
    # one row per matched word, then per document: sums that Spark begins on the map side
    covered = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    which = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = ends.join(covered.join(which, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows of which a word stands in an item's window; all columns stay, rows with a null id stay. Rows that share the id of a contaminated one go with it."""
    hit = index_matches(docs, items, n=n, id_col=id_col, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(hit, id_col, "left_anti")
