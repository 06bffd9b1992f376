"""SimHash fingerprints, links by pivot distance tables, and their components.

A table holds the Hamming distance of every distinct fingerprint to many reference
fingerprints. By the triangle inequality two fingerprints within ``k`` bits differ
by at most ``k`` in every coordinate, so a pair whose largest coordinate difference
is above ``k`` is discarded; survivors are verified bit by bit. Pairs to look up in
the table come from equal blocks: of ``k + 2`` blocks at least two are equal in any
two fingerprints within ``k`` bits. Blocks shared by too many fingerprints to pair
are linked exactly without pairs: two fingerprints lie within ``k`` bits if and only
if they meet in a fingerprint that is ``k / 2`` bits (rounded up and down) from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from eventframe.llm.components import components
from eventframe.llm.texts import keyed, map_texts, work_table

SEED = 42
PIVOTS = 24
PAIRED_ROWS = 256
PART_BYTES = 1 << 20
# Fixed value: the white space that separates words.
WHITE = regex.compile(rb"[\x20\x09-\x0D]")


def _parts(data: bytes) -> Iterator[bytes]:
    """A text cut at white space into parts of about a megabyte."""
    at = 0
    while len(data) - at > PART_BYTES:
        found = WHITE.search(data, at + PART_BYTES)
        if not found:
            break
        yield data[at : found.start()]
        at = found.end()
    yield data[at:] if at else data


def fingerprint(text: str, size: int = 3) -> int:
    """The 64-bit SimHash over all word shingles, repeats included; 0 without a word."""
    above, shingles, kept = np.zeros(64, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for part in _parts(text.encode("utf-8", "surrogatepass").lower()):  # lower() of bytes is A-Z only
        words = kept + part.split()  # as is the white space of split()
        if len(words) < size:
            kept = words
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths).tolist()
        values = [hashed(joined[a:b], SEED) for a, b in zip(begins, ends[size - 1 :].tolist())]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        above += bits.sum(axis=0, dtype=np.int64)
        shingles += len(values)
        kept = words[len(words) - size + 1 :]
    if not shingles:
        if not kept:
            return 0
        value = hashed(b" ".join(kept), SEED)
        return value
    return int(np.packbits(2 * above > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint of each row as a signed long; null is a text without words."""

    def make():
        def of(texts):
            values = np.array([fingerprint(t or "", size) for t in texts], np.uint64)
            return [pa.array(values.view(np.int64))]

        return of

    return map_texts(keyed(docs, id_col, text_col), "fp bigint", make)


def references(count: int) -> list[int]:
    """Fixed reference fingerprints: hashes of their numbers, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(n.to_bytes(4, "little"), SEED)).view(np.int64)) for n in range(count)]


def _with_table(nodes: DataFrame, pivots: int) -> DataFrame:
    """Adds the row of the pivot table: the distances to all references."""
    distances = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("tinyint") for r in references(pivots)]
    return nodes.withColumn("distances", F.array(*distances))


def _blocks(bits: int) -> list[int]:
    """Masks of the pairs of ``bits + 2`` blocks of the 64 bits, as signed longs."""
    count = bits + 2
    edges = [64 * n // count for n in range(count + 1)]
    masks = [sum(1 << b for b in range(low, high)) for low, high in zip(edges, edges[1:])]
    return [int(np.uint64(a | b).view(np.int64)) for a, b in combinations(masks, 2)]


def _near(x: Column, y: Column, bits: int) -> Column:
    """Whether no coordinate of two rows of the table differs by more than ``bits``."""
    return F.forall(F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), lambda d: d <= bits)


def _around(bits: int) -> list[int]:
    """All patterns of at most ``bits`` set bits, as signed longs."""
    out = [sum(1 << b for b in chosen) for n in range(bits + 1) for chosen in combinations(range(64), n)]
    return [int(np.uint64(x).view(np.int64)) for x in out]


def links(nodes: DataFrame, bits: int = 2, pivots: int = PIVOTS, paired: int = PAIRED_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints whose components are those of all
    pairs within ``bits`` bits. ``nodes`` has each fingerprint once, as ``fp``."""
    tabled = _with_table(nodes.select("fp"), pivots)
    masks = F.lit(_blocks(bits)).cast("array<bigint>")
    blocked = tabled.select("fp", "distances", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("block", "value"))
    blocked = work_table(blocked, "fingerprint-blocks")
    shared = blocked.groupBy("block", "value").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = work_table(shared, "fingerprint-shared")

    few = blocked.join(shared.where(F.col("rows") <= paired), ["block", "value"])
    x, y = few.alias("x"), few.alias("y")
    same = (F.col("x.block") == F.col("y.block")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.fp") < F.col("y.fp"))
    pairs = x.join(y, same & _near(F.col("x.distances"), F.col("y.distances"), bits))
    pairs = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    # Blocks of many fingerprints: everything near one meets it half way. ``bits`` odd: one side goes further.
    many = blocked.join(shared.where(F.col("rows") > paired), ["block", "value"], "left_semi").select("fp").distinct()
    half, rest = bits // 2, bits - bits // 2
    spots = [("left", half), ("right", rest)] if half != rest else [("both", half)]
    met = None
    for side, reach in spots:
        patterns = F.lit(_around(reach)).cast("array<bigint>")
        part = many.select("fp", F.lit(side).alias("side"), F.explode(F.transform(patterns, lambda p: F.col("fp").bitwiseXOR(p))).alias("spot"))
        met = part if met is None else met.unionByName(part)
    if half == rest:
        low = met.groupBy("spot").agg(F.min("fp").alias("low"), F.count("*").alias("rows")).where("rows > 1")
        stars = met.join(low, "spot").where("fp > low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    else:
        low = met.groupBy("spot").agg(
            F.min(F.when(F.col("side") == "left", F.col("fp"))).alias("low"), F.max(F.when(F.col("side") == "right", 1)).alias("other")
        ).where("low is not null and other = 1")
        stars = met.join(low, "spot").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars)


def _grouped(docs: DataFrame, size: int, bits: int, pivots: int, paired: int, id_col: str, text_col: str) -> DataFrame:
    """``id, fp, root, component_id`` of each row; ``root`` is a fingerprint that names the component."""
    marked = work_table(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = work_table(marked.groupBy("fp").agg(F.min("id").alias("low")), "fingerprint-classes")
    roots = components(links(nodes, bits, pivots, paired))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(rooted.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(
    docs: DataFrame, size: int = 3, bits: int = 2, pivots: int = PIVOTS, paired: int = PAIRED_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id_col, fingerprint, component_id`` of each row.

    ``fingerprint`` is the SimHash of the text's word shingles (16 hexadecimal digits);
    texts without a word, null among them, have fingerprint zero and are linked like
    others. Fingerprints within ``bits`` bits are linked; ``component_id`` is the smallest
    id that can be reached. Repeated rows and ids give a row each; null ids are never the
    smallest, and a component of null ids alone has a null id. Other columns are not
    read, an empty table gives no rows.
    """
    kind = docs.select(id_col).schema[0].dataType
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _grouped(docs, size, bits, pivots, paired, id_col, text_col).select(
        F.col("id").cast(kind).alias(id_col), digits.alias("fingerprint"), F.col("component_id").cast(kind).alias("component_id")
    )


def one_of_each(
    docs: DataFrame, size: int = 3, bits: int = 2, pivots: int = PIVOTS, paired: int = PAIRED_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which each component keeps one.

    It keeps the row of its smallest id (see ``near_duplicates``), any one of them where rows
    repeat an id; a component of null ids alone keeps one row as well.
    """
    rows = work_table(_grouped(docs, size, bits, pivots, paired, id_col, text_col), "near-duplicates")
    is_first = F.col("id").eqNullSafe(F.col("component_id"))
    ids = rows.groupBy("id").agg(F.count("*").alias("rows"), F.max(is_first).alias("first")).where("first")
    ids = work_table(ids.select(F.col("id").alias("__id"), "rows"), "kept-ids")
    mine = F.col(id_col).eqNullSafe(F.col("__id"))
    once = docs.join(ids.where("rows = 1").hint("merge"), mine, "left_semi")

    # Rows that repeat an id are told apart by their fingerprints, and one is kept for each component.
    often = docs.join(ids.where("rows > 1"), mine, "left_semi")
    marked_schema = StructType([*often.schema.fields, StructField("__fp", LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t or "", size) for t in batch.column(text_col).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], marked_schema.names)

    first = rows.where(is_first).select(F.col("id").alias("__id"), F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    told = often.mapInArrow(mark, marked_schema)
    told = told.join(first, mine & (told["__fp"] == first["__fp"])).drop(first["__fp"])
    kept = told.dropDuplicates([id_col, "__root"]).select(*docs.columns)
    return once.unionByName(kept)
