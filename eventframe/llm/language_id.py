"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of two to four characters inside its words, with a
mark for a word's edge; each is hashed to a row of an embedding table. The average of
the rows goes through a linear layer and a softmax. Table and layer are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows; a part of
the sample that is kept back calibrates the scores (one temperature) and the score
below which a prediction is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventframe.llm.letters import code_points, slabs
from eventframe.llm.texts import keyed, map_texts, work_table

SIZES = (2, 3, 4)
BUCKETS = 1 << 16
WIDTH = 16
# Bounds of the training sample: rows of each label, rows of all (but one of each label at least), characters of each row.
ROWS_PER_LABEL = 1200
MAX_ROWS = 240_000
PIECE_CHARS = 400
UNKNOWN = "und"
# A table of so many labels is broadcast.
SMALL_LABELS = 10_000


def subwords(points: np.ndarray, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword, and the place where it begins."""
    places, buckets = [], []
    value = points.copy()
    inside = np.ones(len(points), bool)  # whether all characters between the first and the last are letters
    for size in range(2, max(SIZES) + 1):
        room = len(points) - size + 1
        if room <= 0:
            break
        if size > 2:
            inside = inside[:room] & is_letter[size - 2 : size - 2 + room]
        value = value[:room] * np.uint64(0x100000001B3) + points[size - 1 :]
        if size in SIZES:
            used = is_letter[:room] | is_letter[1 : room + 1] if size == 2 else inside
            at = np.flatnonzero(used[:room])
            hashed = (value[at] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
            places.append(at)
            buckets.append(hashed.astype(np.int64))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(places)


@dataclass
class Model:
    """Labels, each bucket's contribution to their scores, bias, temperature and rejection score."""

    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    rejected_below: float = 0.0

    def averages(self, texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Average row of ``table`` over each text's subwords, and their number."""
        total = np.zeros((len(texts), table.shape[1]))
        count = np.zeros(len(texts), np.int64)
        for owners, pieces in slabs(texts):
            points, is_letter, begins = code_points(pieces)
            buckets, places = subwords(points, is_letter)
            # a subword may begin with the mark before its text
            owner = np.array(owners)[np.searchsorted(begins, places + 1, side="right") - 1]
            count += np.bincount(owner, minlength=len(texts))
            for k in range(table.shape[1]):
                total[:, k] += np.bincount(owner, table[buckets, k], minlength=len(texts))
        return total / np.maximum(count, 1)[:, None], count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label and calibrated score of each text, and whether the score is accepted."""
        if self.labels and len(self.labels) <= self.embeddings.shape[1]:
            means, count = self.averages(texts, self.embeddings @ self.weights)
            logits = means + self.bias
        else:
            means, count = self.averages(texts, self.embeddings)
            logits = means @ self.weights + self.bias
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        shares = softmax(logits / self.temperature)
        best = shares.argmax(axis=1)
        scores = np.where(count > 0, shares[np.arange(len(texts)), best], 0.0)
        labels = [self.labels[b] if c else UNKNOWN for b, c in zip(best, count)]
        return labels, scores, (count > 0) & (scores >= self.rejected_below)


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = 6, least_steps: int = 800, rate: float = 2.0, batch: int = 32, seed: int = 7) -> Model:
    """A model from (label, text) rows; one in five calibrates. Without rows it knows no label."""
    labels = sorted({label for label, _ in rows})
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    model = Model(labels, embeddings, np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32))
    if not labels:
        return model
    examples = []
    for label, text in rows:
        points, is_letter, _ = code_points([text])
        buckets, _ = subwords(points, is_letter)
        if len(buckets):
            examples.append((labels.index(label), buckets))
    order = rng.permutation(len(examples))
    kept_back, learned = order[::5], np.setdiff1d(order, order[::5])
    if not len(learned):
        learned = order
    if not len(examples):
        return model
    model.weights[:] = rng.uniform(-0.1, 0.1, model.weights.shape)
    epochs = max(epochs, -(-least_steps * batch // max(len(learned), 1)))
    steps, done = epochs * -(-len(learned) // batch), 0
    for _ in range(epochs):
        learned = rng.permutation(learned)
        for begin in range(0, len(learned), batch):
            chosen = [examples[n] for n in learned[begin : begin + batch]]
            wanted = np.array([label for label, _ in chosen])
            sizes = np.array([len(b) for _, b in chosen])
            buckets = np.concatenate([b for _, b in chosen])
            means = np.add.reduceat(embeddings[buckets], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            slope = softmax(means @ model.weights + model.bias)
            slope[np.arange(len(chosen)), wanted] -= 1
            step = rate * (1 - done / steps)
            back = (slope @ model.weights.T) / sizes[:, None]
            each = np.repeat(np.arange(len(chosen)), sizes)
            touched, place = np.unique(buckets, return_inverse=True)
            for k in range(WIDTH):
                embeddings[touched, k] -= step * np.bincount(place, back[each, k])
            model.weights -= step / len(chosen) * (means.T @ slope).astype(np.float32)
            model.bias -= step / len(chosen) * slope.mean(axis=0).astype(np.float32)
            done += 1
    calibrate(model, [examples[n] for n in kept_back])
    return model


def calibrate(model: Model, examples: list[tuple[int, np.ndarray]], lost: float = 0.002) -> None:
    """The temperature of least log loss, and the score that right predictions reach but for ``lost``."""
    if not examples:
        return
    wanted = np.array([label for label, _ in examples])
    means = np.array([model.embeddings[b].mean(axis=0) for _, b in examples])
    logits = means @ model.weights + model.bias
    here = np.arange(len(wanted))
    losses = {t: -np.log(np.maximum(softmax(logits / t)[here, wanted], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(losses, key=losses.get))
    shares = softmax(logits / model.temperature)
    right = np.sort(shares.max(axis=1)[shares.argmax(axis=1) == wanted])
    if len(right):
        model.rejected_below = float(right[int(lost * len(right))])


def training_rows(
    docs: DataFrame, usable: Column, max_rows: int = MAX_ROWS, rows_per_label: int = ROWS_PER_LABEL,
    piece_chars: int = PIECE_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
) -> list[tuple[str, str]]:
    """The bounded sample: of every label a hash-ordered choice of rows, of each a run of
    characters at a place that the hash of its id and text decides.

    The more labels, the fewer rows of each, but one at least. Rows without a text or label are
    left out; rows that repeat an id and its text count once, a null id is an id like others,
    and an empty table gives an empty sample.
    """
    text, row_hash = F.col("text"), F.xxhash64(F.lit(5), "id", "text")
    rows = docs.where(usable).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")
    ).where("text is not null and label is not null")
    draw = row_hash.bitwiseAND((1 << 53) - 1) / float(1 << 53)
    counted = work_table(rows.groupBy("label").agg(F.approx_count_distinct(draw).alias("n")), "language-labels")
    labels = counted.count()
    if not labels:
        return []
    each = min(rows_per_label, max(1, max_rows // labels))
    # only the lower end of the draw goes on to be ranked, so no label fills a task; one row at least of a rare label
    kept = rows.join(F.broadcast(counted) if labels <= SMALL_LABELS else counted, "label").where(draw * F.col("n") <= 4 * each + 16)
    begin = F.pmod(F.xxhash64(F.lit(6), "id", "text"), F.greatest(F.length(text) - piece_chars, F.lit(0)) + 1).cast("int") + 1
    pieces = kept.select("label", draw.alias("draw"), F.substr(text, begin, F.lit(piece_chars)).alias("piece")).distinct()
    ranked = pieces.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("draw", "piece")))
    found = ranked.where(F.col("place") <= each).select("label", "piece").collect()
    return sorted((r.label, r.piece) for r in found)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, accepted`` of each row, from its whole text.

    A null text, one without a letter and every text of a model without labels get
    ``und``, score 0 and are not accepted. Repeated rows and ids give a row each, a null
    id stays null, other columns are not read, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def of(texts):
            labels, scores, accepted = shared.value.predict(texts)
            return [pa.array(labels), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]

        return of

    rows = map_texts(keyed(docs, id_col, text_col), "lang_pred string, score double, accepted boolean", make)
    return rows.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's fold is the one that nothing is learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
