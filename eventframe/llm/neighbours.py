"""Nearest neighbours by cosine: multiprobe p-stable hashing and exact distances.

Vectors are scaled to length one, where the nearest by cosine are the nearest by
distance. A table hashes a vector to a bucket by a few random projections, cut into
cells of equal width. The cells of a near vector are the query's own or close to it,
and since projections of a difference are normal, the chance of each bucket is known: a
query visits a table's buckets in the order of that chance until the tables together
reach the target. Candidates of all tables are ranked by their exact cosine.

Equal vectors are one entry with its smallest ids, so a vector that fills a third of the
table is hashed and compared once. Buckets are dealt to blocks by their hash, and blocks
of many entries or queries are cut into parts that meet pairwise; a part gives its best
few for each query and never a row for each pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import erf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventframe.llm.texts import work_table

TABLES = 6
PROJECTIONS = 6
WIDTH = 2.0
# Neighbours of this cosine or more are to be found with this chance.
NEAR_COSINE = 0.35
TARGET = 0.96
MOST_PROBES = 4096
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Hashing:
    """The random projections of all tables, fixed by the dimension and the seed."""

    dimension: int
    tables: int = TABLES
    projections: int = PROJECTIONS
    width: float = WIDTH
    near: float = NEAR_COSINE
    target: float = TARGET
    blocks: int = 1
    seed: int = 11

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Places of unit vectors on the projections, in cells: rows, tables, projections."""
        rng = np.random.default_rng(self.seed)
        lines = rng.standard_normal((self.dimension, self.tables * self.projections))
        shift = rng.uniform(0, self.width, self.tables * self.projections)
        return ((unit @ lines + shift) / self.width).reshape(len(unit), self.tables, self.projections)

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """A 64-bit key for each row of cell numbers."""
        key = np.zeros(cells.shape[:-1], np.uint64)
        for n in range(cells.shape[-1]):
            key = (key ^ cells[..., n].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def block(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(11)).astype(np.int64) % self.blocks

    def probes(self, place: np.ndarray) -> np.ndarray | None:
        """Buckets of one table, as cell numbers, from the likeliest on to hold a near vector.

        A near vector's projection is normal around the query's. Buckets come from a heap of
        choices of one cell for each projection, so only as many are made as are visited.
        """
        wanted = 1 - (1 - self.target) ** (1 / self.tables)
        spread = (2 - 2 * self.near) ** 0.5
        own = np.floor(place)
        choices = []
        for at, cell in zip(place.tolist(), own.tolist()):
            reach = int(4 * spread / self.width) + 1
            options = []
            for step in range(-reach, reach + 1):
                low, high = (cell + step - at) * self.width / spread, (cell + step + 1 - at) * self.width / spread
                options.append((0.5 * (erf(high / 2**0.5) - erf(low / 2**0.5)), cell + step))
            choices.append(sorted(options, reverse=True))
        first = float(np.prod([c[0][0] for c in choices]))
        heap, out, reached = [(-first, 0, (0,) * len(choices))], [], 0.0
        while heap and reached < wanted and len(out) < MOST_PROBES:
            chance, moved, picks = heapq.heappop(heap)
            reached -= chance
            out.append([choices[n][p][1] for n, p in enumerate(picks)])
            for n in range(moved, len(choices)):
                if picks[n] + 1 < len(choices[n]):
                    now, then = choices[n][picks[n]][0], choices[n][picks[n] + 1][0]
                    if then > 0:
                        heapq.heappush(heap, (chance / now * then, n, (*picks[:n], picks[n] + 1, *picks[n + 1 :])))
        # Stopped before the target: None, and the query is compared with all vectors instead.
        return np.array(out) if not heap or reached >= wanted else None


def _vectors(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # the largest component first, so that no square over- or underflows
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _index(entries: DataFrame, hashing: Hashing, kind: np.dtype) -> DataFrame:
    """``part, block, bucket`` (table, block, key) of every entry, with its ids and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = hashing.keys(np.floor(hashing.cells(_unit(_vectors(batch.column("vector"), kind)))))
                for number in range(hashing.tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), number, np.int32)), pa.array(hashing.block(keys[:, number])), pa.array(keys[:, number]), batch.column("ids"), batch.column("vector")],
                        ["number", "block", "bucket", "ids", "vector"],
                    )

    return entries.select("ids", "vector").mapInArrow(run, "number int, block long, bucket long, ids array<long>, vector binary")


def _visits(asked: DataFrame, hashing: Hashing, kind: np.dtype) -> DataFrame:
    """``number, block, buckets``: for each query and block the buckets that it visits there.

    A query that would visit more than ``MOST_PROBES`` buckets of a table gets no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = hashing.cells(_unit(_vectors(batch.column("vector"), kind)))
            rows = []
            for row, (query, vector) in enumerate(zip(batch.column("query").to_pylist(), batch.column("vector").to_pylist())):
                visited = [hashing.probes(places[row, number]) for number in range(hashing.tables)]
                if any(cells is None for cells in visited):
                    continue
                for number, cells in enumerate(visited):
                    keys = hashing.keys(cells)
                    blocks = hashing.block(keys)
                    for block in np.unique(blocks).tolist():
                        rows.append((number, block, keys[blocks == block], query, vector))
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["number", "block", "buckets", "query", "vector"])

    return asked.mapInArrow(run, "number int, block long, buckets array<long>, query long, vector binary")


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of rows to one vector, each computed alike whatever rows stand beside it."""
    dots = (vectors * query).sum(axis=1)
    return dots / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def best_of(vectors: np.ndarray, lowest: np.ndarray, query: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of largest cosine, ties to the smaller id, and their cosines."""
    scores = cosines(vectors, query)
    if len(scores) > keep:
        edge = -np.partition(-scores, keep - 1)[keep - 1]
        rows = np.flatnonzero(scores >= edge)
    else:
        rows = np.arange(len(scores))
    rows = rows[np.lexsort((lowest[rows], -scores[rows]))][:keep]
    return rows, scores[rows]


def _ranked(kind: np.dtype, keep: int):
    """For the entries and queries of one part: each query's best candidates in its buckets."""

    def of(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            entries = entries.sort_values("bucket", kind="stable")
            buckets = entries["bucket"].to_numpy()
            vectors = np.frombuffer(b"".join(entries["vector"]), kind).reshape(len(entries), -1).astype(np.float64)
            ids = entries["ids"].to_numpy()
            lowest = np.array([x[0] for x in ids])
            asked = np.frombuffer(b"".join(queries["vector"]), kind).reshape(len(queries), -1).astype(np.float64)
            for n, (query, visited) in enumerate(zip(queries["query"].to_numpy(), queries["buckets"])):
                visited = np.asarray(visited)
                begins, ends = np.searchsorted(buckets, visited, "left"), np.searchsorted(buckets, visited, "right")
                met = np.concatenate([np.arange(b, e) for b, e in zip(begins, ends) if e > b] or [np.empty(0, np.int64)])
                if len(met):
                    rows, scores = best_of(vectors[met], lowest[met], asked[n], keep)
                    out += [(query, s, list(ids[r])) for r, s in zip(met[rows], scores)]
        return pd.DataFrame(out, columns=["query", "score", "ids"])

    return of


def _usable(vector: Column) -> Column:
    """Whether a vector has only finite components and one that is not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame, count: int = 5, every: int = 50, tables: int = TABLES, projections: int = PROJECTIONS,
    width: float = WIDTH, near: float = NEAR_COSINE, target: float = TARGET, block_rows: int = BLOCK_ROWS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``count`` nearest of each row whose id is divisible by ``every``.

    Candidates are all rows but those of the query's own id. ``score`` is the cosine of the
    vectors as given, in double precision; nearest first, ties to the smaller id. A query
    that finds fewer than ``count`` in its buckets, or would have to visit more than
    ``MOST_PROBES`` of them to reach the target, is compared with all rows. Vectors that
    are null, zero or hold null or non-finite components, rows with a null id, and vectors
    of another length than most take no part. Rows that repeat an id and its vector count
    once; one id with several vectors asks for each and answers with its nearest. Other
    columns are not read, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    element = vectors.select(vector_col).schema[0].dataType.elementType.simpleString()
    kind = np.dtype(np.float32 if element == "float" else np.float64)
    cast = "array<float>" if element == "float" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(cast).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == sizes["size"])
    pack = _packed(kind)

    # The smallest ids of each distinct vector; the filter on the rank keeps as many before the shuffle.
    low = Window.partitionBy("vector").orderBy("id")
    lowest = rows.distinct().withColumn("place", F.row_number().over(low)).where(F.col("place") <= count + 1)
    grouped = lowest.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = work_table(pack(grouped), "vector-entries")
    asking = rows.where(F.col("id") % every == 0).distinct()
    asking = asking.withColumn("query", F.min("id").over(Window.partitionBy("vector")))
    asked = work_table(asking.where(F.col("id") == F.col("query")).select("query", "vector"), "vector-queries")
    asked_by = work_table(asking.select("id", "query"), "vector-askers")
    keep = count + 1

    blocks = -(-entries.count() // block_rows)
    hashing = Hashing(sizes["size"], tables, projections, width, near, target, max(1, blocks))
    index = work_table(_index(entries, hashing, kind), "vector-index")
    visits = work_table(_visits(pack(asked).select("query", "vector"), hashing, kind), "vector-visits")
    parts = lambda df, name: df.groupBy("number", "block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    cuts = parts(index, "parts").join(parts(visits, "asks"), ["number", "block"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(cuts, ["number", "block"]).select(
        "number", "block", "bucket", "ids", "vector", F.pmod(F.xxhash64("ids"), "parts").cast("int").alias("part"), spread("asks").alias("ask"))
    right = visits.join(cuts, ["number", "block"]).select(
        "number", "block", "buckets", "query", "vector", F.pmod(F.xxhash64("query"), "asks").cast("int").alias("ask"), spread("parts").alias("part"))
    place = ["number", "block", "part", "ask"]
    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(_ranked(kind, keep), "query long, score double, ids array<long>")
    found = work_table(_first(found, keep), "vector-found")

    # Queries whose buckets held too few or were too many, against all entries in blocks.
    held = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= keep)
    short = work_table(asked.join(held, "query", "left_anti"), "vector-short")
    if short.limit(1).count():
        everything = entries.select(F.lit(0).cast("long").alias("bucket"), "ids", "vector", F.pmod(F.xxhash64("ids"), F.lit(max(1, blocks))).cast("int").alias("part"))
        cut = max(1, -(-short.count() // block_rows))
        everything = everything.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(cut - 1))))
        all_of = pack(short).select("query", "vector", F.array(F.lit(0).cast("long")).alias("buckets"), F.pmod(F.xxhash64("query"), F.lit(cut)).cast("int").alias("ask"),
                                    F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))).alias("part"))
        exact = everything.groupBy("part", "ask").cogroup(all_of.groupBy("part", "ask")).applyInPandas(_ranked(kind, keep), "query long, score double, ids array<long>")
        found = found.join(short, "query", "left_anti").unionByName(_first(exact, keep))

    answers = asked_by.join(found, "query").where(F.col("vec_id") != F.col("id"))
    best = answers.groupBy("id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def _first(found: DataFrame, keep: int) -> DataFrame:
    """``query, vec_id, score``: the best ``keep`` candidates of all parts and tables."""
    merged = found.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")


def _packed(kind: np.dtype):
    """Replaces the array of components by its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("vector")
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)
                rest = [batch.column(n) for n in batch.schema.names if n != "vector"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([row.tobytes() for row in flat], pa.binary())], [*(n for n in batch.schema.names if n != "vector"), "vector"])

    def of(df: DataFrame) -> DataFrame:
        others = [f for f in df.schema if f.name != "vector"]
        names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
        return df.mapInArrow(run, f"{names}, vector binary")

    return of
