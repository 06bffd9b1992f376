"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are a text's words and the beginnings of its words, hashed; a chi-square
test on a bounded sample of labelled rows chooses them, counted by Spark. The model
has one weight a feature, shared by all grades, and ordered thresholds:
``P(grade > k) = sigmoid(w . x - t_k)``. The result is the expected grade.

Labels only tell toxic rows from others. Grades above zero are derived: toxic rows
that hold more occurrences of toxic features than the median of toxic rows are severe
(2), the others mild (1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventframe.llm.letters import code_points, mixed, slabs, word_hashes
from eventframe.llm.texts import keep_rows, keyed, map_texts, work_table

BEGINNINGS = (4, 5, 6)
# Bounds of what is fitted: rows of each kind of label, features.
ROWS_PER_KIND = 3000
MAX_FEATURES = 2048
MIN_CHI = 20.0


def features_of(texts: list[str | None]):
    """For each group of texts: text number and feature of every occurrence, and words of each text."""
    for owners, pieces in slabs(texts):
        points, is_letter, begins = code_points(pieces)
        starts, lengths, words = word_hashes(points, is_letter)
        owner = np.array(owners)[np.searchsorted(begins, starts, side="right") - 1]
        of, found = [owner], [words]
        value = np.zeros(len(starts), np.uint64)
        for size in range(1, max(BEGINNINGS) + 1):
            long = lengths >= size
            owner, starts, lengths, value = owner[long], starts[long], lengths[long], value[long]
            value = value * np.uint64(0x100000001B3) + points[starts + size - 1]
            if size in BEGINNINGS:
                of.append(owner)
                found.append(mixed(value + np.uint64(size << 56)))
        yield np.concatenate(of), np.concatenate(found), np.bincount(of[0], minlength=len(texts))


@dataclass
class Model:
    """Sorted features, their weights and the ordered thresholds; no feature means nothing is known."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature number and count of the features that occur, and words of each text."""
        keys, words = [], np.zeros(len(texts), np.int64)
        for owner, found, many in features_of(texts):
            words += many
            if len(self.features):
                at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
                known = self.features[at] == found
                keys.append(owner[known] * len(self.features) + at[known])
        key, count = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
        size = max(len(self.features), 1)
        return key // size, key % size, count, words

    def above(self, texts: list[str | None]) -> np.ndarray:
        """``P(grade > k)`` of each text, one column for each k; 0 without a word."""
        rows, columns, count, words = self.counts(texts)
        scores = np.bincount(rows, self.weights[columns] * np.log1p(count), minlength=len(texts)) if len(rows) else np.zeros(len(texts))
        out = sigmoid(scores[:, None] - self.thresholds[None, :])
        out[words == 0] = 0
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int,
        steps: int = 800, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by Adam on the whole sample.

    Thresholds are a first one and gaps kept above zero, so their order holds at every step.
    """
    top, n = int(grades.max()), len(grades)
    share = [np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(top)]
    first = np.log(1 / share[0] - 1)
    rest = np.diff([np.log(1 / s - 1) for s in share])
    packed = np.concatenate([np.zeros(size), [first], np.log(np.maximum(rest, 0.1))])
    mean, square = np.zeros_like(packed), np.zeros_like(packed)
    picked = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(packed[size + 1 :])
        thresholds = packed[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, packed[columns] * values, minlength=n)
        above = np.hstack([np.ones((n, 1)), sigmoid(score[:, None] - thresholds), np.zeros((n, 1))])
        chance = np.maximum(above[picked, grades] - above[picked, grades + 1], 1e-9)
        slope = above * (1 - above)
        # d loss / d score is -(lower edge's slope - upper edge's slope) / chance
        lower, upper = slope[picked, grades] / chance, slope[picked, grades + 1] / chance
        d_score = -(lower - upper) / n
        d_threshold = np.array([lower[grades == k + 1].sum() - upper[grades == k].sum() for k in range(top)]) / n
        d_gaps = np.cumsum(d_threshold[::-1])[::-1][1:] * gaps
        slopes = np.concatenate([np.bincount(columns, d_score[rows] * values, minlength=size), [d_threshold.sum()], d_gaps])
        slopes[:size] += decay * packed[:size]
        mean = 0.9 * mean + 0.1 * slopes
        square = 0.999 * square + 0.001 * slopes**2
        packed -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return packed[:size], packed[size] + np.concatenate([[0.0], np.cumsum(np.exp(packed[size + 1 :]))])


def sample(docs: DataFrame, labels: DataFrame, rows_per_kind: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id, text, toxic`` of a hash-ordered choice of labelled rows of each kind.

    Several labels of one id count as the strongest. Rows of an id with different texts are rows
    of their own, rows that repeat an id and its text count once, and null ids and null
    texts are left out: at most twice ``rows_per_kind`` rows, whose keys are broadcast.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marked = marked.groupBy("id").agg((F.max("toxic") > 0).alias("toxic"))
    texts = keyed(docs, id_col, text_col).where("id is not null and text is not null").withColumn("row", F.xxhash64("text"))
    rows = work_table(texts.select("id", "row").distinct().join(marked, "id"), "toxicity-rows")
    # only the lower end of the draw goes on to be ranked, so no kind fills a task
    draw = F.xxhash64(F.lit(3), "id", "row").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    drawn = rows.join(F.broadcast(rows.groupBy("toxic").agg(F.count("*").alias("n"))), "toxic")
    drawn = drawn.select("id", "row", "toxic", draw.alias("draw")).where(draw * F.col("n") <= 4 * rows_per_kind)
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "id", "row")))
    chosen = ranked.where(F.col("place") <= rows_per_kind).select("id", "row", "toxic")
    return texts.join(F.broadcast(chosen), ["id", "row"]).dropDuplicates(["id", "row"]).drop("row")


def train(
    docs: DataFrame, labels: DataFrame, rows_per_kind: int = ROWS_PER_KIND, max_features: int = MAX_FEATURES,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """The model of a bounded sample. Without labelled rows of both kinds nothing is known."""
    nothing = Model(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    rows = work_table(sample(docs, labels, rows_per_kind, id_col, text_col, label_col), "toxicity-sample")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return nothing

    def present():
        def of(texts):
            out = [np.empty(0, np.int64)] * len(texts)
            for owner, found, _ in features_of(texts):
                order = np.argsort(owner, kind="stable")
                for n, part in zip(*_grouped(owner[order], found[order].view(np.int64))):
                    out[n] = np.union1d(out[n], part)
            return [pa.array(out, pa.list_(pa.int64()))]

        return of

    # the feature's document counts, and the chi-square of its table with the label
    held = map_texts(rows.select(F.col("toxic").alias("id"), "text"), "features array<bigint>", present)
    counted = held.select(F.col("id").cast("int").alias("toxic"), F.explode("features").alias("feature"))
    counted = counted.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    bad, good = float(sizes[True]), float(sizes[False])
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = (a * (good - b) - b * (bad - a)) ** 2 * (bad + good) / (bad * good * (a + b) * (bad + good - a - b))
    scored = counted.where(a + b < bad + good).select("feature", chi.alias("chi"), (a / bad > b / good).alias("toxic"))
    best = scored.where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "feature").limit(max_features).collect()
    if not best:
        return nothing
    chosen = sorted((int(np.int64(r.feature).view(np.uint64)), r.toxic) for r in best)
    model = Model(np.array([f for f, _ in chosen], np.uint64), np.zeros(len(chosen)), np.zeros(1))
    toxic = np.array([t for _, t in chosen])

    def chosen_counts():
        def of(texts):
            at, columns, count, words = model.counts(texts)
            return [pa.array(_lists(at, columns, len(texts)), pa.list_(pa.int64())),
                    pa.array(_lists(at, count, len(texts)), pa.list_(pa.int64())), pa.array(words, pa.int64())]

        return of

    # at most rows_per_kind * 2 rows of the chosen features that they hold
    vectors = map_texts(rows.select(F.struct("toxic", "id").alias("id"), "text"), "columns array<bigint>, counts array<bigint>, words bigint", chosen_counts)
    vectors = sorted(vectors.collect(), key=lambda r: (r["id"].toxic, str(r["id"].id), r["words"], r["columns"], r["counts"]))
    at = np.repeat(np.arange(len(vectors)), [len(r["columns"]) for r in vectors])
    columns = np.array([c for r in vectors for c in r["columns"]], np.int64)
    counts = np.array([c for r in vectors for c in r["counts"]], np.int64)
    is_toxic = np.array([r["id"].toxic for r in vectors])
    held = np.bincount(at, counts * toxic[columns], minlength=len(vectors))
    severe = is_toxic & (held > np.median(held[is_toxic]))
    grades = is_toxic.astype(np.int64) + severe
    model.weights, model.thresholds = fit(at, columns, np.log1p(counts), grades, len(chosen))
    return model


def _grouped(owner: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values split by owner, which is sorted."""
    if not len(owner):
        return [], []
    owners, begins = np.unique(owner, return_index=True)
    return owners.tolist(), np.split(values, begins[1:])


def _lists(owner: np.ndarray, values: np.ndarray, size: int) -> list[np.ndarray]:
    out = [np.empty(0, np.int64)] * size
    for n, part in zip(*_grouped(owner, values)):
        out[n] = part
    return out


def grade(docs: DataFrame, model: Model, reject_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, severity, toxic_share, grade, rejected`` of each row, from its whole text.

    ``severity`` is the expected grade, ``toxic_share`` the chance of any grade above 0,
    ``grade`` the likeliest one, and a row is rejected from ``toxic_share >= reject_from``
    on. Texts without a word, null among them, and all texts of a model without features
    have severity 0. Repeated rows and ids give a row each, a null id stays null, other
    columns are not read, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def of(texts):
            above = shared.value.above(texts)
            edges = np.hstack([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))])
            first = above[:, 0] if above.shape[1] else np.zeros(len(texts))
            likeliest = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
            return [pa.array(above.sum(axis=1), pa.float64()), pa.array(first, pa.float64()),
                    pa.array(likeliest, pa.int32()), pa.array(first >= reject_from, pa.bool_())]

        return of

    added = "severity double, toxic_share double, grade int, rejected boolean"
    return map_texts(keyed(docs, id_col, text_col), added, make).withColumnRenamed("id", id_col)


def without_rejected(docs: DataFrame, model: Model, reject_from: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are not rejected (see ``grade``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def of(texts):
            above = shared.value.above(texts)
            return (above[:, 0] < reject_from).tolist() if above.shape[1] else [True] * len(texts)

        return of

    return keep_rows(docs, text_col, make)
