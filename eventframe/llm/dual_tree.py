"""Ranked lexical search by dual trees: items against documents, whole batches pruned exactly.

Documents and items are sparse vectors over the items' terms. Both lie in hierarchies whose
nodes hold, per term, the largest value below them (coordinate maxima), so the product of two
nodes' maxima bounds every score between them. A walk over node pairs starts with the two
roots and drops a pair, with all documents and items below it, if its bound stays below the
weakest k-th score that any of its items has found so far. What is left is scored in full.

Documents with the same rare terms are brought together by a range shuffle, which keeps nodes'
maxima low. A first walk looks only into the most promising leaf of each batch for each item;
the k-th best scores over all batches, which no result can be below, are what the second walk
starts from in every task. So tasks hand on little more than the result.

All numbers are integers below 2**53, held exactly in doubles. Items go over the documents in
blocks of bounded size, each with one pass over the texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from eventframe.llm.byte_words import ALPHANUMERIC, binaries, token_slabs
from eventframe.llm.texts import work_table

# Bounds of one block of items: together they bound the table of weights that tasks hold.
BLOCK_ITEMS = 256
BLOCK_TERMS = 16_384
# A batch of documents, the unit of a tree, ends at so many documents or entries.
BATCH_DOCS = 4096
BATCH_ENTRIES = 1_000_000
LEAF = 16
FANOUT = 8


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, terms`` (distinct, sorted) per item; rows of one id are one item with the terms of all."""
    chosen = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([chosen.schema["item"], *StructType.fromDDL("terms array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w.decode() for s in token_slabs(t, ALPHANUMERIC) for w in s}) for t in binaries(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.string()))], ["item", "terms"])

    terms = chosen.mapInArrow(run, schema)
    return terms.select("item", F.explode("terms").alias("term")).groupBy("item").agg(F.array_sort(F.collect_set("term")).alias("terms"))


@dataclass
class Block:
    """Some items: their ids in order, their terms as numbers, and the numbers of all terms."""

    ids: list
    terms: list[list[int]]
    numbers: dict[str, int]


def blocks(items: DataFrame, most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """Items in blocks of at most ``most_items`` items and ``most_terms`` terms (an item that is larger: alone)."""
    block = Block([], [], {})
    # Ordered by terms, so that items that share terms share nodes; fetched in pieces.
    for row in items.orderBy("terms", "item").toLocalIterator(prefetchPartitions=False):
        if block.ids and (len(block.ids) == most_items or len(block.numbers) + len(row["terms"]) > most_terms):
            yield block
            block = Block([], [], {})
        block.ids.append(row["item"])
        block.terms.append([block.numbers.setdefault(t, len(block.numbers)) for t in row["terms"]])
    if block.ids:
        yield block


def document_terms(docs: DataFrame, block: Block) -> DataFrame:
    """``doc, n, terms, counts``: a document's number of terms, and those of the block with their occurrences."""
    schema = StructType([docs.schema["doc"], *StructType.fromDDL("n bigint, terms array<int>, counts array<bigint>").fields])
    numbers = docs.sparkSession.sparkContext.broadcast({t.encode(): n for t, n in block.numbers.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in binaries(batch.column("text")):
                seen, size = Counter(), 0
                for tokens in token_slabs(text, ALPHANUMERIC):
                    size += len(tokens)
                    seen.update(map(get, tokens))
                seen.pop(None, None)
                found = sorted(seen)
                sizes.append(size)
                terms.append(found)
                counts.append([seen[t] for t in found])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                pa.array(counts, pa.list_(pa.int64())),
            ], schema.names)

    return docs.mapInArrow(run, schema)


def weights(rows: DataFrame, documents: int, terms: int) -> np.ndarray:
    """The weight of every term of the block from the documents that hold it; 0 where none does."""
    out = np.zeros(terms)
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        out[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return out


@dataclass
class Level:
    """Sparse rows, one a node: term numbers and maxima between the nodes' offsets."""

    offsets: np.ndarray
    terms: np.ndarray
    maxima: np.ndarray

    def row(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.offsets[node], self.offsets[node + 1])
        return self.terms[part], self.maxima[part]

    def __len__(self) -> int:
        return len(self.offsets) - 1


def above(level: Level, fanout: int, width: int) -> Level:
    """The level over another one: each node has the maxima of ``fanout`` neighbours."""
    count = -(-len(level) // fanout)
    nodes = np.repeat(np.arange(len(level)) // fanout, np.diff(level.offsets))
    keys = nodes * width + level.terms
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], level.maxima[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    maxima = np.maximum.reduceat(values, first) if len(keys) else values
    nodes, terms = np.divmod(keys[first], width)
    return Level(np.searchsorted(nodes, np.arange(count + 1)), terms, maxima)


def tree(level: Level, leaf: int, fanout: int, width: int) -> list[Level]:
    """Levels from the rows up to one root."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(above(levels[-1], leaf if len(levels) == 1 else fanout, width))
    return levels


class Items:
    """The items' hierarchy: per level the weights of its nodes' terms, a column a node, roots last."""

    def __init__(self, block: Block, weight: np.ndarray):
        self.count, self.width = len(block.ids), len(weight)
        matrix = np.zeros((len(weight), self.count))
        for i, terms in enumerate(block.terms):
            matrix[terms, i] = weight[terms]
        # Term by node, so that a document node's terms pick rows.
        self.levels = [matrix]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FANOUT), axis=1))

    def weakest(self, least: np.ndarray) -> list[np.ndarray]:
        """Per level the lowest score that any item below a node still takes."""
        out = [least]
        while len(out) < len(self.levels):
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), FANOUT)))
        return out

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        found = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return found[found < self.levels[level - 1].shape[1]]


class Found:
    """The best documents of every item so far, in one task."""

    def __init__(self, items: int, count: int, least: np.ndarray | None):
        self.count = count
        self.least = np.ones(items) if least is None else np.maximum(least, 1)
        self.scores = [np.zeros(0)] * items
        self.docs: list[list] = [[] for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, docs: list) -> None:
        scores = np.concatenate([self.scores[item], scores])
        docs = self.docs[item] + docs
        order = sorted(range(len(docs)), key=lambda i: (-scores[i], docs[i] is None, docs[i] if docs[i] is not None else 0))[: self.count]
        self.scores[item], self.docs[item] = scores[order], [docs[i] for i in order]
        if len(order) == self.count:
            self.least[item] = max(self.least[item], self.scores[item][-1])


def _contributions(sizes: list[int], counts: np.ndarray, owners: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What one occurrence count gives before its term's weight, as the ranking defines it."""
    # Python's integers: a size times the documents may pass 64 bits.
    m = np.array([100 - 90 + 90 * n * documents // words for n in sizes], np.int64)[owners]
    return ((1_000_000_000 * counts) // (1000 * counts + 8 * m)).astype(np.float64)


def _walk(items: Items, levels: list[Level], docs: list, found: Found, best_leaf_only: bool) -> None:
    """All node pairs from the two roots on; ``found`` takes the scores of what is not pruned."""
    top = len(items.levels) - 1

    def score_leaf(first: int, last: int, chosen: np.ndarray) -> None:
        part = slice(levels[0].offsets[first], levels[0].offsets[last])
        terms, place = np.unique(levels[0].terms[part], return_inverse=True)
        rows = np.zeros((last - first, len(terms)))
        owners = np.repeat(np.arange(last - first), np.diff(levels[0].offsets[first : last + 1]))
        rows[owners, place] = levels[0].maxima[part]
        scores = rows @ items.levels[0][np.ix_(terms, chosen)]
        for column, item in enumerate(chosen):
            taken = np.flatnonzero(scores[:, column] >= found.least[item])
            if len(taken):
                found.add(int(item), scores[taken, column], [docs[first + i] for i in taken])

    def bounds(level: int, node: int, item_level: int, nodes: np.ndarray) -> np.ndarray:
        terms, maxima = levels[level].row(node)
        return maxima @ items.levels[item_level][np.ix_(terms, nodes)]

    if best_leaf_only:
        # For every item the leaf with the highest bound, all leaves' bounds in one go.
        leaves = min(1, len(levels) - 1)
        every = np.arange(items.count)
        high = np.array([bounds(leaves, n, 0, every) for n in range(len(levels[leaves]))])
        best = high.argmax(axis=0)
        for node in np.unique(best):
            size = LEAF if leaves else 1
            score_leaf(int(node) * size, min((int(node) + 1) * size, len(docs)), np.flatnonzero(best == node))
        return

    # Pairs wait as (document level, node, item level, item nodes).
    waiting = [(len(levels) - 1, 0, top, np.zeros(1, np.int64))]
    while waiting:
        level, node, item_level, nodes = waiting.pop()
        weakest = items.weakest(found.least)[item_level]
        high = bounds(level, node, item_level, nodes)
        nodes = nodes[high >= weakest[nodes]]
        if not len(nodes):
            continue
        # Both sides go down in turn, the higher one first.
        if item_level and (item_level >= level or level <= 1):
            waiting.append((level, node, item_level - 1, items.children(item_level, nodes)))
            continue
        if level <= 1:
            size = LEAF if level else 1
            score_leaf(node * size, min((node + 1) * size, len(docs)), nodes)
            continue
        below = [n for n in range(node * FANOUT, (node + 1) * FANOUT) if n < len(levels[level - 1])]
        # The most promising child is popped first, so that scores to beat rise early.
        below.sort(key=lambda n: bounds(level - 1, n, item_level, nodes).max())
        waiting.extend((level - 1, n, item_level, nodes) for n in below)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of a task in groups that one tree holds: ids, sizes, offsets, terms, counts."""
    held: list[pa.RecordBatch] = []
    rows = entries = 0

    def joined() -> tuple:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = [table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type) for c in ("terms", "counts")]
        sizes = np.diff(lists[0].offsets.to_numpy())
        offsets = np.r_[0, np.cumsum(sizes)]
        return (
            table.column("doc").to_pylist(), table.column("n").to_pylist(), offsets,
            lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy(),
        )

    for whole in batches:
        for first in range(0, whole.num_rows, 512):
            batch = whole.slice(first, 512)
            held.append(batch)
            rows, entries = rows + batch.num_rows, entries + len(batch.column("terms").flatten())
            if rows >= BATCH_DOCS or entries >= BATCH_ENTRIES:
                yield joined()
                held, rows, entries = [], 0, 0
    if rows:
        yield joined()


def walked(
    rows: DataFrame, block: Block, weight: np.ndarray, documents: int, words: int, count: int,
    least: np.ndarray | None = None,
) -> DataFrame:
    """``item`` (its number in the block), ``doc``, ``score`` of each task's best documents.

    Without ``least`` only the most promising leaf of each batch is looked into; with it (a
    score per item that no result is below) everything that can be a result is.
    """
    schema = StructType([*StructType.fromDDL("number int, score bigint").fields, StructField("doc", rows.schema["doc"].dataType)])
    shared = rows.sparkSession.sparkContext.broadcast((block, weight, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight, least = shared.value
        items, found = Items(block, weight), Found(len(block.ids), count, least)
        kind = None
        for docs, sizes, offsets, terms, counts in _batches(_typed(batches, kinds := [])):
            kind = kinds[0]
            owners = np.repeat(np.arange(len(docs)), np.diff(offsets))
            values = _contributions(sizes, counts, owners, documents, words)
            levels = tree(Level(offsets, terms, values), LEAF, FANOUT, items.width)
            _walk(items, levels, docs, found, least is None)
        numbers = [i for i, docs in enumerate(found.docs) for _ in docs]
        if numbers:
            scores = np.concatenate(found.scores).astype(np.int64)
            docs = pa.array([d for docs in found.docs for d in docs], kind)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(scores), docs], schema.names)

    return rows.mapInArrow(run, schema)


def _typed(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds.append(batch.column("doc").type)
        yield batch


def _ranked(hits: DataFrame, count: int) -> DataFrame:
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)


def search_block(docs: DataFrame, block: Block, count: int) -> DataFrame:
    """``number, rank, doc, score`` for the items of one block."""
    rows = work_table(document_terms(docs, block), "search-terms")
    documents, words = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(rows, documents, len(block.numbers))
    # Documents lie next to those whose rarest terms they share; ids spread those with the same ones.
    rare = rows.sparkSession.sparkContext.broadcast(weight)
    together = _with_lead(rows.where(F.size("terms") > 0), rare)
    together = together.repartitionByRange("lead", F.xxhash64("doc")).sortWithinPartitions("lead").drop("lead")
    together = work_table(together, "search-sorted")
    probe = _ranked(walked(together, block, weight, documents, words, count), count).where(F.col("rank") == count)
    least = np.ones(len(block.ids))
    for number, score in probe.select("number", "score").collect():
        least[number] = score
    return _ranked(walked(together, block, weight, documents, words, count, least), count)


def _with_lead(rows: DataFrame, weight) -> DataFrame:
    """Adds ``lead``: the document's four weightiest terms, weightiest first."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("lead array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = weight.value
        for batch in batches:
            lead = [sorted(t, key=lambda x: (-of[x], x))[:4] for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.list_(pa.int32()))], schema.names)

    return rows.mapInArrow(run, schema)


def search(
    docs: DataFrame, items: DataFrame, count: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Each item's ``count`` best documents with a score above 0: item id, ``rank``, document id, ``score``.

    Terms are runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. The score is
    the sum over the item's terms of the weight floor(1000 ln((2N + 2) / (2 df + 1))) times
    (10**9 tf) div (1000 tf + 8 m), where m = 10 + (90 n N) div L.

    Null texts have no terms; documents without terms count for nothing. Repeated documents are
    documents of their own, equal scores go by id (null last); items of one id are one item with
    the terms of all its rows, and an item without terms gets no rows. Columns beside id and text are not read.
    """
    given = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    terms = item_terms(items, item_col, item_text_col)
    spark, out = docs.sparkSession, None
    for block in blocks(terms, most_items, most_terms):
        ids = spark.createDataFrame(
            list(enumerate(block.ids)), StructType([*StructType.fromDDL("number int").fields, terms.schema["item"]])
        )
        hits = search_block(given, block, count).join(F.broadcast(ids), "number")
        hits = hits.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        kinds = [StructField("item_id", terms.schema["item"].dataType), *StructType.fromDDL("rank int").fields]
        kinds += [StructField("doc_id", given.schema["doc"].dataType), *StructType.fromDDL("score bigint").fields]
        return spark.createDataFrame([], StructType(kinds))
    return out
