"""Toxicity by nearest labelled examples.

Labelled rows are examples in an inverted index over TF-IDF vectors; a document's nearest
examples are found exactly by cosine, block by block of example numbers in order of the blocks'
upper bounds, until no block can hold a better one. Votes weighted by distance, calibrated on
labelled rows that are neither in the index nor in its statistics, give the score; the
neighbours are its evidence.

The vectors' space is the whole vocabulary of the examples. A term weighs its log inverse document
frequency over all documents, times how surely it goes with label 1 (the standard score of its two
shares among labelled rows, at least LEAST_WEIGHT, so that no term falls out): by TF-IDF alone a
document's nearest examples are those of its subject and its rarest words, of either label.

Labelled rows enter as samples with documented bounds, so the index has a bounded size whatever
the corpus and is broadcast. Every document is counted and scored whole.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import crc_fold, kept, saved

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the fit, rows of each label (expected): sampled in all, in the index, and for calibration. The rest of the sample counts for term weights, beside the index.
SAMPLED_PER_LABEL, INDEXED_PER_LABEL, CALIBRATION_PER_LABEL = 8_000, 1_000, 1_000
LEAST_WEIGHT, SURENESS = 1.0, 1.5
NEIGHBOURS, BLOCK, EVIDENCE = 30, 256, 3
#: Votes at the prior share that stand beside the neighbours' ones.
PRIOR_VOTES = 0.3
#: Rows at the prior share that stand beside calibration rows without a neighbour.
BLANK_ROWS = 10.0


class Vocabulary:
    """Known terms of whole texts."""

    def __init__(self, known: dict[str, int]):
        self.known = known

    def terms(self, text: str) -> list[int]:
        get = self.known.get
        return [i for w in WORD.findall(text.lower()) if (i := get(w)) is not None]


def strings(column) -> list[str]:
    """An Arrow string column, null as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(column, "").to_pylist()


class BlockMaxIndex:
    """Postings by term and block of neighbouring example numbers, with each block's largest weight of the term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int, block: int = BLOCK):
        """vectors: terms (numbers below ``size``) and weights of each example."""
        self.block, self.blocks = block, -(-len(vectors) // block)
        lengths = [len(t) for t, _ in vectors]
        number = np.repeat(np.arange(len(vectors)), lengths)
        term = np.concatenate([np.zeros(0, dtype=np.int64), *(t for t, _ in vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        by = np.lexsort((number, term))
        number, term, weight = number[by], term[by], weight[by]
        part = term * max(1, self.blocks) + number // block
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, dtype=np.int64)
        #: Of each part (term and block): its block, where its postings start, the largest weight; and of each term where its parts start.
        self.part_block = (part[first] % max(1, self.blocks)).astype(np.int32)
        self.starts = np.append(first, len(part)).astype(np.int32)
        self.most = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        self.terms = np.searchsorted(part[first] // max(1, self.blocks), np.arange(size + 1)).astype(np.int32)
        self.numbers, self.weights = number.astype(np.int32), weight

    @staticmethod
    def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of [start, end) ranges, and which range each is of."""
        n = end - start
        which = np.repeat(np.arange(len(n)), n)
        return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which], which

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k examples of the largest positive cosine, ties to the smaller number. Terms are sorted."""
        parts, which = self.ranges(self.terms[terms], self.terms[terms + 1])
        numbers, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        if not len(parts):
            return numbers, scores
        block, weight = self.part_block[parts], weights[which]
        bound = np.bincount(block, weight * self.most[parts], minlength=self.blocks)
        by = np.argsort(block, kind="stable")
        parts, weight = parts[by], weight[by]
        edge = np.searchsorted(block[by], np.arange(self.blocks + 1))
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(scores) == k and bound[b] < scores[-1] - 1e-9:
                break
            here, w = parts[edge[b] : edge[b + 1]], weight[edge[b] : edge[b + 1]]
            at, of = self.ranges(self.starts[here], self.starts[here + 1])
            s = np.round(np.bincount(self.numbers[at] - b * self.block, w[of] * self.weights[at], minlength=self.block), 12)
            least = scores[-1] if len(scores) == k else 0.0
            found = np.flatnonzero(s >= least if least > 0 else s > 0)
            numbers, scores = np.concatenate([numbers, found + b * self.block]), np.concatenate([scores, s[found]])
            top = np.lexsort((numbers, -scores))[:k]
            numbers, scores = numbers[top], scores[top]
        return numbers, np.minimum(scores, 1.0)


@dataclass
class Model:
    known: dict[str, int]
    weight: np.ndarray  # of each term
    index: BlockMaxIndex
    labels: np.ndarray
    ids: list
    share: float  # rows of label 0 to rows of label 1 that an example of each stands for, as a ratio
    prior: float
    line: tuple[float, float] = (0.0, 1.0)
    empty: float = 0.0

    def vector(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms and weights of unit length."""
        t, n = np.unique(np.array(terms, dtype=np.int64), return_counts=True)
        w = (1.0 + np.log(n)) * self.weight[t]
        length = math.sqrt(float((w * w).sum()))
        return (t, w / length) if length else (t[:0], w[:0])

    def near(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return self.index.search(*self.vector(terms), NEIGHBOURS)

    def vote(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the distance-weighted votes, with PRIOR_VOTES at the prior."""
        y, v = self.labels[numbers], cosines / (0.05 + (1.0 - cosines))
        toxic, clean = float(v[y == 1].sum()), self.share * float(v[y == 0].sum())
        return math.log((toxic + PRIOR_VOTES * self.prior) / (clean + PRIOR_VOTES * (1.0 - self.prior)))

    def score(self, numbers: np.ndarray, cosines: np.ndarray) -> float:
        if not len(numbers):
            return self.empty
        z = self.line[0] + self.line[1] * self.vote(numbers, cosines)
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of y on x by a few ridge-damped Newton steps; the slope stays positive."""
    x = np.clip(x, -50, 50)
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.array([0.0, 1.0])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (p - y)) + 1.0 * (beta - [0.0, 1.0])
        hessian = design.T @ (design * (w * p * (1 - p))[:, None]) + np.eye(2)
        beta = beta - np.linalg.solve(hessian, gradient)
    return (float(beta[0]), float(beta[1])) if beta[1] > 0.05 else (0.0, 1.0)


def bags_of(rows: DataFrame) -> list[tuple[object, int, dict[str, int]]]:
    """id, label, words with their counts of the index's examples (bounded), by id."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [Counter(WORD.findall(text.lower())) for text in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(b) for b in found], pa.list_(pa.string())), pa.array([list(b.values()) for b in found], pa.list_(pa.int32()))], names=["id", "y", "t", "n"])

    frame = rows.select("id", "y", "text")
    schema = StructType([*frame.schema.fields[:2], StructField("t", ArrayType(StringType())), StructField("n", ArrayType(IntegerType()))])
    out = [(r["id"], r["y"], dict(zip(r["t"], r["n"], strict=True))) for r in frame.mapInArrow(run, schema).collect()]
    return sorted(out, key=lambda x: (str(type(x[0])), x[0]))


def frequencies(rows: DataFrame, known: dict[str, int], classes: int) -> np.ndarray:
    """(classes, len(known) + 1): in how many rows of each class each known term is, and at the end the rows. rows: text, class (int)."""
    shared, token, width = rows.sparkSession.sparkContext.broadcast(known), uuid.uuid4().hex, len(known) + 1

    def count(batches):
        import pyarrow as pa

        vocabulary = kept("terms", token, lambda: Vocabulary(shared.value))
        total = np.zeros((classes, width), dtype=np.int64)
        for batch in batches:
            of = batch.column(1).to_numpy()
            sets = [set(vocabulary.terms(text)) for text in strings(batch.column(0))]
            for c in range(classes):
                mine = [t for t, k in zip(sets, of.tolist(), strict=True) if k == c]
                total[c] += np.bincount(np.fromiter(chain.from_iterable(mine), dtype=np.int64), minlength=width)
                total[c, -1] += len(mine)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    out = np.zeros(classes * width)
    # A row for each term of the examples' vocabulary, which is bounded.
    sums = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    shared.unpersist()
    return out.reshape(classes, width)


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> tuple[DataFrame, dict[int, int]] | None:
    """id, y, text, u (uniform in [0, 1) of the text): at most about per_label rows of each label with distinct texts; and the labelled rows of each label."""
    known = labels.filter(F.col(label_col).isin(0, 1) & (crc_fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).filter("id IS NOT NULL")
    total = {0: 0, 1: 0} | {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not total[0] + total[1]:
        return None
    share = {y: int(min(1.0, per_label / max(1, total[y])) * (1 << 30)) for y in total}
    few = known.filter(F.pmod(F.xxhash64("id", F.lit("example")), F.lit(1 << 30)) < F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    # At most about 2 * per_label rows of an id and a label, so they are broadcast and text is not shuffled.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").join(F.broadcast(few), "id")
    rows = rows.groupBy("text").agg(F.min("id").alias("id"), F.max("y").alias("y"))
    return rows.withColumn("u", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(1 << 30)) / F.lit(float(1 << 30))), total


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int = SAMPLED_PER_LABEL) -> Model | None:
    """None without a labelled row outside the held-out fold."""
    found = sampled(docs, labels, id_col, text_col, label_col, per_label)
    if found is None:
        return None
    total = found[1]
    rows = saved(found[0], "examples")
    n = {0: 0, 1: 0} | {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not n[0] + n[1]:
        return None
    # Of each label's sample a quarter at most is for calibration; of the rest as many as may are indexed, and all count.
    tuned = {y: min(0.25, CALIBRATION_PER_LABEL / max(1, n[y])) for y in n}
    listed = {y: min(1.0, INDEXED_PER_LABEL / max(1, n[y])) for y in n}
    by_label = lambda d: F.when(F.col("y") == 1, F.lit(d[1])).otherwise(F.lit(d[0]))
    learnt = rows.filter(F.col("u") >= by_label(tuned))
    seen = bags_of(learnt.filter(F.col("u") < by_label(tuned) + by_label(listed)))
    known = {t: i for i, t in enumerate(sorted({t for _, _, b in seen for t in b}))}
    shares = frequencies(learnt.select("text", "y"), known, 2)
    spread = frequencies(docs.select(text_col, F.lit(0)), known, 1)[0]
    idf = np.log((spread[-1] + 1.0) / (spread[:-1] + 1.0)) + 1e-6
    clean, toxic = shares[0, -1], shares[1, -1]
    z = np.zeros(len(known))
    if clean and toxic:
        both = shares[:, :-1].sum(axis=0) / (clean + toxic)
        z = (shares[1, :-1] / toxic - shares[0, :-1] / clean) / np.sqrt(both * (1 - both) * (1 / clean + 1 / toxic) + 0.5 * (1 / clean + 1 / toxic) / (clean + toxic))
    count = Counter(y for _, y, _ in seen)
    share = (total[0] / max(1, count[0])) / max(1e-9, total[1] / max(1, count[1]))
    prior = (total[1] + 0.5) / (total[0] + total[1] + 1.0)
    model = Model(known, idf * np.maximum(z, LEAST_WEIGHT) ** SURENESS, BlockMaxIndex([], len(known)), np.zeros(0), [], share, prior)
    # Examples alike in label, commonest word (so in language) and weightiest terms get neighbouring numbers: a block is good for few queries, and its bound says so.
    every = [(model.vector([known[t] for t, c in b.items() for _ in range(c)]), i, y, max(b, key=lambda t: (b[t], t), default="")) for i, y, b in seen]
    every.sort(key=lambda p: (p[2], p[3], p[0][0][np.lexsort((p[0][0], -p[0][1]))][:4].tolist()))
    model.index = BlockMaxIndex([p[0] for p in every], len(known))
    model.ids, model.labels = [p[1] for p in every], np.array([p[2] for p in every], dtype=np.int64)
    votes = calibration_votes(rows.filter(F.col("u") < by_label(tuned)), model)
    rate = {y: total[y] / max(1, sum(1 for _, v in votes if v == y)) for y in total}
    blank = [y for v, y in votes if v is None]
    a, b = (sum(rate[y] for y in blank if y == c) for c in (1, 0))
    model.empty = (a + BLANK_ROWS * prior) / (a + b + BLANK_ROWS)
    votes = [(v, y) for v, y in votes if v is not None]
    if len({y for _, y in votes}) == 2:
        y = np.array([float(y) for _, y in votes])
        w = np.where(y == 1, rate[1], rate[0])
        model.line = calibrate(np.array([v for v, _ in votes]), y, w / w.mean())
    return model


def calibration_votes(rows: DataFrame, model: Model) -> list[tuple[float | None, int]]:
    """Vote (None without a neighbour) and label of rows (bounded) that the model has not seen."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        vocabulary = Vocabulary(shared.value.known)
        for batch in batches:
            near = [shared.value.near(vocabulary.terms(data)) for data in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.vote(*x) if len(x[0]) else None for x in near], pa.float64()), batch.column(1)], names=["v", "y"])

    out = sorted(((r["v"], r["y"]) for r in rows.select("text", "y").mapInArrow(run, "v double, y int").collect()), key=str)
    shared.unpersist()
    return out


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLED_PER_LABEL) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, evidence (array of example id, similarity, toxic).

    Labels of the fold crc32(id) mod 5 = 0 are not read; labels that are null or neither 0 nor 1
    are left out; an id with both labels is toxic. Equal texts are one example, toxic if any copy
    is. Null text counts as empty; a document without a word of the index has no neighbours and
    scores what such labelled rows do. Without any label every score is 0. Repeated rows score
    alike. Other columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    held = crc_fold(F.col(id_col)) == 0
    model = fit(df, labels, id_col, text_col, label_col, per_label)
    shared, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    evidence = ArrayType(StructType([StructField("doc_id", LongType()), StructField("similarity", DoubleType()), StructField("toxic", IntegerType())]))
    source = df.select(F.col(id_col), held.alias("held_out"), F.col(text_col))
    schema = StructType([*source.schema.fields[:2], StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("evidence", evidence)])

    def run(batches):
        import pyarrow as pa

        scorer = kept("toxicity", token, lambda: Scorer(shared.value))
        for batch in batches:
            scores, proofs = [], []
            for data in strings(batch.column(2)):
                s, proof = scorer(data)
                scores.append(s)
                proofs.append(proof)
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(proofs, kind)],
                                             names=[id_col, "held_out", "score", "predicted", "evidence"])

    return source.mapInArrow(run, schema)


class Scorer:
    """Score and evidence of whole texts."""

    def __init__(self, model: Model | None):
        self.model = model
        self.vocabulary = Vocabulary(model.known) if model else None

    def __call__(self, text: str) -> tuple[float, list[dict]]:
        model = self.model
        if model is None:
            return 0.0, []
        numbers, cosines = model.near(self.vocabulary.terms(text))
        first = zip(numbers[:EVIDENCE].tolist(), cosines[:EVIDENCE].tolist(), strict=True)
        return model.score(numbers, cosines), [{"doc_id": int(model.ids[n]), "similarity": s, "toxic": int(model.labels[n])} for n, s in first]


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLED_PER_LABEL) -> DataFrame:
    """The rows of df that are not predicted toxic, with df's columns whatever their names; rows are judged where they are, none is shuffled.

    Nulls, empty texts, repeated rows and empty tables are as in score_toxicity; without any label all rows stay.
    """
    model = fit(df, labels, id_col, text_col, label_col, per_label)
    shared, token = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        scorer = kept("toxicity", token, lambda: Scorer(shared.value))
        for batch in batches:
            yield batch.filter(pa.array([scorer(text)[0] < 0.5 for text in strings(batch.column(at))], pa.bool_()))

    return df.mapInArrow(run, df.schema)
