"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps words to classes: insult, threat, target, negation, report, other. Small transducers rewrite the class string of a
clause: negation marks insults and threats in its scope, reported speech marks those it introduces. The grammar then accepts a clause as a pattern.
Composed, they are one deterministic table. The weight of a pattern, and the insult words and stems beyond a few seeds, are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Fixed word lists of the grammar, by class.
SEEDS = {
    "insult": ("idiot", "idiots", "moron", "morons", "scum", "loser", "losers", "trash", "stupid", "pathetic", "worthless", "disgusting", "clown", "clowns"),
    "threat": ("kill", "hurt", "destroy", "hunt", "beat", "strangle", "murder"),
    "target": ("you", "your", "he", "she", "they", "them", "him", "her", "his", "this", "these", "those", "people", "who"),
    "negation": ("not", "never", "isn", "aren", "wasn", "weren", "don", "doesn", "didn", "nobody", "neither", "nor"),
    "report": ("said", "says", "called", "calls", "wrote", "writes", "quoted", "quotes", "claimed", "claims", "alleged", "reported"),
}
CLASSES = {"insult": "I", "threat": "V", "target": "T", "negation": "N", "report": "R"}
OTHER, SCOPE = "O", 3
#: Patterns with the weight that a unit of their words' evidence has before labels are seen.
PATTERNS = {"targeted insult": 0.9, "targeted threat": 0.9, "insult": 0.8, "threat": 0.3, "reported insult": 0.3, "reported threat": 0.1, "negated insult": 0.1, "negated threat": 0.0}
#: Evidence of a word whose share among toxic texts isn't known, by class, and the most that a word can have.
SEED_EVIDENCE, MOST_EVIDENCE = {"I": 5.0, "V": 0.5}, 10.0
#: The log odds of a text without a match before labels are seen, and how firmly all these priors hold.
PRIOR_BASE, RIDGE = -3.0, 1.0
#: Labelled rows that are read for learning, at most; which ones is a matter of their ids' hash.
MAX_LABELLED = 20_000
#: A stem is taken from this log ratio of its shares in toxic and clean texts on, if the texts that have it fit chance worse than their own shares by this log likelihood. Of all, the MAX_STEMS that fit worst.
MIN_RATIO, MIN_GAIN, MAX_STEMS, STEM_LENGTHS = 3.5, 14.0, 4000, (4, 5, 6, 7, 8)
#: Of a text's clauses, by strength, each counts this share of the one before: every clause counts, yet long texts don't add up chance matches without end.
NEXT_CLAUSE = 0.6
CLAUSE_END, WORD = re.compile(r"[.!?;:\n]"), re.compile(r"[^\W\d_]+")

Machine = dict[tuple[object, str], tuple[str, object]]  # (state, input) -> (output, state); every machine starts in state 0


def negation_machine() -> Machine:
    """I and V within SCOPE words after a negation become i and v."""
    marks = {"I": "i", "V": "v"}
    return {(s, c): (marks.get(c, c) if s else c, SCOPE if c == "N" else max(0, s - 1)) for s in range(SCOPE + 1) for c in "IVTNRO"}


def report_machine() -> Machine:
    """I and V after a word of reporting, in the same clause, become J and W."""
    marks = {"I": "J", "V": "W"}
    return {(s, c): (marks.get(c, c) if s else c, int(s or c == "R")) for s in (0, 1) for c in "IVivTNRO"}


def pattern_machine() -> Machine:
    """Accepts a clause: the state holds the strongest kind so far and whether a target was named."""
    kinds = "IVJWiv"  # by strength, as in PATTERNS
    rank = lambda k: kinds.find(k) if k else len(kinds)
    states = [0, *((k, t) for k in ("", *kinds) for t in (False, True))]

    def step(s: object, c: str) -> tuple[str, bool]:
        k, t = s or ("", False)
        return (c if c in kinds and rank(c) < rank(k) else k, t or c == "T")

    return {(s, c): ("", step(s, c)) for s in states for c in "IVJWivTNRO"}


def compose(first: Machine, second: Machine) -> Machine:
    """What second makes of first's output, as one machine over pairs of states."""
    table, todo, number = {}, [(0, 0)], {(0, 0): 0}
    inputs = {c for _, c in first}
    while todo:
        pair = todo.pop()
        for c in inputs:
            if (pair[0], c) in first:
                mid, a = first[pair[0], c]
                out, b = second[pair[1], mid]
                if (a, b) not in number:
                    number[a, b] = (a, b)
                    todo.append((a, b))
                table[number[pair], c] = (out, number[a, b])
    return table


def pattern_of(state: object) -> str:
    """The name of the pattern that the composed machine's last state stands for."""
    kind, target = state[1] or ("", False) if state else ("", False)
    name = {"I": "insult", "V": "threat", "J": "reported insult", "W": "reported threat", "i": "negated insult", "v": "negated threat", "": "none"}[kind]
    return f"targeted {name}" if target and kind in ("I", "V") else name


MACHINE = compose(compose(negation_machine(), report_machine()), pattern_machine())


@dataclass(frozen=True)
class Model:
    """stems: insult prefixes with the evidence behind each; weights: of the patterns; base: the log odds of a text without a match."""

    stems: dict[str, float]
    weights: dict[str, float]
    base: float


class Grammar:
    """A model made ready in a task: finds words that can start a pattern, then runs the machine on their clauses only."""

    def __init__(self, model: Model):
        self.model = model
        self.words = {w: CLASSES[k] for k, ws in SEEDS.items() for w in ws}
        self.lengths = sorted({len(s) for s in model.stems}, reverse=True)
        self.starts = ahocorasick.Automaton()
        for w in {*model.stems, *SEEDS["insult"], *SEEDS["threat"]}:
            self.starts.add_word(w, len(w))
        self.starts.make_automaton()

    def word_class(self, word: str) -> tuple[str, float]:
        """Class and evidence; of several stems that fit, the strongest counts. Words of negation, report and target stay what they are."""
        found = self.words.get(word, OTHER)
        if found in "NRT":
            return found, 0.0
        stems = self.model.stems
        learned = max((stems[word[:n]] for n in self.lengths if n <= len(word) and word[:n] in stems), default=0.0)
        return ("I", learned) if learned else (found, SEED_EVIDENCE.get(found, 0.0))

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of the clauses in which a word begins like an insult or a threat."""
        last = 0
        for end, n in self.starts.iter(text):
            at = end - n + 1
            if at < last or (at and text[at - 1].isalpha()):
                continue
            before = max(text.rfind(c, last, at) for c in ".!?;:\n") + 1
            after = CLAUSE_END.search(text, end)
            last_, last = last, after.start() if after else len(text)
            yield max(before, last_), last

    def matches(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, pattern, evidence) of every clause with a pattern; a word's evidence counts once in a text."""
        low, seen, out = (text or "").lower(), set(), []
        for a, b in self.clauses(low):
            state, evidence = 0, 0.0
            for w in WORD.findall(low, a, b):
                c, e = self.word_class(w)
                state = MACHINE[state, c][1]
                evidence += e if w not in seen else 0.0
                seen.add(w)
            if (name := pattern_of(state)) != "none":
                out.append((a, b, name, evidence))
        return out

    @staticmethod
    def evidence(found: list[tuple[int, int, str, float]]) -> dict[str, float]:
        """By pattern, over all clauses; ties of strength go by the pattern's name."""
        out = dict.fromkeys(PATTERNS, 0.0)
        for k, (_, _, p, e) in enumerate(sorted(found, key=lambda m: (-m[3], m[2]))):
            out[p] += e * NEXT_CLAUSE**k
        return out

    def score(self, found: list[tuple[int, int, str, float]]) -> float:
        z = self.model.base + sum(self.model.weights[p] * e for p, e in self.evidence(found).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps, held to the prior by RIDGE."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + RIDGE / 2 * ((w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * (w - prior))
        size = 1.0
        while loss(w + size * step) > now and size > 1e-6:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return w


def in_learning_fold(doc_id: Column, folds: int, held_out: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds != held_out


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from docs that have a label: stems first, then the patterns' weights with them. Without labelled rows the priors remain.

    At most max_labelled distinct labelled texts are used, so the list of their ids may be broadcast; equal texts of one label count once.
    """
    small_batches(docs.sparkSession)
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(labelled, id_col)
    # texts that differ, or whose labels do, are never merged; the limit counts what is left
    texts, _ = written(texts.groupBy("_text", "_y").agg(F.min(id_col).alias("_id")).select("_id", "_text", "_y"), "distinct-labelled")
    chosen = texts.select("_id", "_y").orderBy(F.xxhash64("_id", F.lit(2)), "_id", "_y").limit(max_labelled)
    sample = texts.join(F.broadcast(chosen), ["_id", "_y"], "left_semi").drop("_id")
    sample, _ = written(sample.repartition(8, F.xxhash64("_text")), "labelled")
    totals = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column("_text").to_pylist(), b.column("_y").to_pylist(), strict=True):
                words = set(WORD.findall(text.lower()))
                hit[int(y == 1)].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n} | {w for w in words if 3 < len(w) <= 16})
        names = list(hit[1])  # a stem that no toxic text of the task has cannot be a reason to take it, but counts against it
        names += [w for w in hit[0] if w not in hit[1]]
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([hit[1][w] for w in part], pa.int64()), pa.array([hit[0][w] for w in part], pa.int64())], ["stem", "toxic", "clean"])

    def counts(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(count, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic > 0")

    # the more toxic texts have a stem, the more it says that no clean one does
    unseen = F.least(F.lit(0.5), 4.0 / F.col("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + unseen) / (n0 + 1.0))
    share, base = F.col("toxic") / (F.col("toxic") + F.col("clean")), max(n1, 1) / max(n1 + n0, 2)
    gain = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)

    def stems_of(frame: DataFrame) -> dict[str, float]:
        strong = frame.withColumns({"ratio": ratio, "gain": gain}).filter((F.col("ratio") >= MIN_RATIO) & (F.col("gain") >= MIN_GAIN))
        # squared: one word that only toxic texts have says more than several that clean ones have too
        return {r["stem"]: min(float(r["ratio"]), MOST_EVIDENCE) ** 2 / MOST_EVIDENCE for r in strong.orderBy(F.desc("gain"), F.length("stem"), "stem").limit(MAX_STEMS).collect()}

    half = F.pmod(F.xxhash64("_text", F.lit(5)), F.lit(2)) == 0
    learned = [Model(stems_of(counts(rows)), PATTERNS, PRIOR_BASE) for rows in (sample.filter(half), sample.filter(~half))] if n1 else [Model({}, PATTERNS, PRIOR_BASE)] * 2
    prior = Model(stems_of(counts(sample)) if n1 else {}, PATTERNS, PRIOR_BASE)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = [Grammar(m) for m in learned]
        for b in batches:
            rows = []
            for t, first in zip(b.column("_text").to_pylist(), b.column("first").to_pylist(), strict=True):
                # a text's features come from stems that were learned without it
                grammar = grammars[1 if first else 0]
                rows.append(list(grammar.evidence(grammar.matches(t)).values()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("_y")], ["x", "_y"])

    seen = sample.withColumn("first", half).mapInArrow(features, "x array<double>, _y int").collect()  # at most max_labelled rows
    if not seen:
        return prior
    x = np.array([[1.0, *r["x"]] for r in seen])
    w = fit(x, np.array([float(r["_y"] == 1) for r in seen]), np.array([PRIOR_BASE, *PATTERNS.values()]))
    return Model(prior.stems, dict(zip(PATTERNS, w[1:].tolist(), strict=True)), float(min(w[0], 0.0)))


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document row: id, score in 0 to 1, predicted (1 from threshold on), clauses: start, end (characters), pattern and evidence of each match.

    Null and empty texts get the score of a text without a pattern. Repeated rows are scored alike. Extra columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        for b in batches:
            found = [grammar.matches(t) for t in b.column("_text").to_pylist()]
            clauses = pa.array([[{"start": s, "end": e, "pattern": p, "evidence": x} for s, e, p, x in f] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("evidence", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([grammar.score(f) for f in found], pa.float64()), clauses], ["_id", "score", "clauses"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, score double, clauses array<struct<start:long,end:long,pattern:string,evidence:double>>")
    return rows.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose text scores threshold or more; every column stays."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model)
        at = None
        for b in batches:
            at = b.schema.get_field_index(text_col) if at is None else at
            yield b.filter(pa.array([grammar.score(grammar.matches(t)) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
