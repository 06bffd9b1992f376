"""Token ids in training order: binary shards of fixed stride.

Every document's tokens are cut into sequences of equal length. Sequence ``i`` in the
order of the input goes to the global slot that a keyed Feistel permutation gives it;
the permutation is of a power of four, and a value beyond the number of sequences walks
on along its cycle until it falls below. A shard holds a range of slots as records of
equal size, so the record of a slot is found by a multiplication, a reader goes on from
any slot, and reading the shards one after the other is reading in training order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from eventframe.llm.bpe_codec import encoded
from eventframe.llm.bpe_machine import Encoder
from eventframe.llm.texts import cut, keyed, shared_dir, work_table

LENGTH = 128
RECORDS = 65_536
KEY = 20_240_229
ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of ``0 .. size - 1``."""

    size: int
    key: int = KEY

    @property
    def half_bits(self) -> int:
        return max(1, (max(self.size - 1, 1).bit_length() + 1) // 2)

    def _round(self, half: np.ndarray, number: int) -> np.ndarray:
        seed = (self.key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF
        mixed = (half ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return (mixed ^ mixed >> np.uint64(31)) & np.uint64((1 << self.half_bits) - 1)

    def _once(self, value: np.ndarray, back: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half_bits), np.uint64((1 << self.half_bits) - 1)
        left, right = value >> bits, value & mask
        for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(left, number), left
            else:
                left, right = right, left ^ self._round(right, number)
        return left << bits | right

    def _walk(self, values: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(values.astype(np.uint64), back)
        while (beyond := np.flatnonzero(out >= self.size)).size:
            out[beyond] = self._once(out[beyond], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """The slot of each sequence number."""
        return self._walk(numbers, back=False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The sequence number in each slot."""
        return self._walk(slots, back=True)


def _tokens(docs: DataFrame, path: str, length: int) -> DataFrame:
    """``task, first, id, count, tokens``: each document's tokens as bytes, and the number of its
    first sequence among those of its task. Documents without tokens are left out."""
    plain = docs.select("id", "text").where("text <> ''")
    names = StructType.fromDDL("task int, first long").fields
    schema = StructType([*names, plain.schema["id"], *StructType.fromDDL("count long, tokens binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = Encoder.of(path), 0
        task, kind = TaskContext.get().partitionId(), kind_of(encoder.merges.size)
        for batch in cut(batches):
            firsts, counts, rows = [], [], []
            for arrays in encoded(encoder, batch.column("text").to_pylist()):
                tokens = np.concatenate(list(arrays)).astype(kind)
                firsts.append(first)
                counts.append(len(tokens))
                rows.append(tokens.tobytes())
                first += -(-len(tokens) // length)
            if rows:
                columns = [pa.array(np.full(len(rows), task, np.int32)), pa.array(firsts, pa.int64()), batch.column("id"), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(run, schema)


def kind_of(vocabulary: int) -> str:
    """Two little-endian bytes a token where they suffice, else four."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


@dataclass
class Output:
    """A written folder: shards, their table and the table of all sequences."""

    folder: str
    size: int
    length: int
    records: int
    kind: str
    shards: DataFrame
    sequences: DataFrame

    def read(self, first: int, count: int) -> np.ndarray:
        """Records of ``count`` slots from ``first`` on, by seeking: a reader that stopped goes on here."""
        system, root = fs.FileSystem.from_uri(self.folder)
        stride, out = self.length * np.dtype(self.kind).itemsize, []
        slot, end = first, min(first + count, self.size)
        while slot < end:
            shard, at = divmod(slot, self.records)
            take = min(end - slot, self.records - at)
            with system.open_input_file(f"{root}/{name_of(shard)}") as file:
                file.seek(at * stride)
                out.append(np.frombuffer(file.read(take * stride), self.kind))
            slot += take
        return np.concatenate(out or [np.empty(0, self.kind)]).reshape(-1, self.length)


def name_of(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _written(folder: str, size: int, length: int, records: int, kind: str, filler: int, names: list[str]):
    """Writes one shard from its pieces and gives the rows of its sequences in the order of slots."""

    def of(pieces: pa.Table) -> pa.Table:
        shard = pieces.column("shard")[0].as_py()
        first, count = shard * records, min(records, size - shard * records)
        body = np.full((count, length), filler, kind)
        unpack = zstandard.ZstdDecompressor()
        places, parts, held = [], [], []
        for many, packed in zip(pieces.column("many").to_pylist(), pieces.column("packed").to_pylist()):
            data = unpack.decompress(packed)
            steps, part, n_tokens = np.frombuffer(data, np.int32, 3 * many).reshape(3, many)
            places.append(np.cumsum(steps))
            parts.append(part)
            held.append(n_tokens)
            body[places[-1]] = np.frombuffer(data, kind, offset=12 * many).reshape(-1, length)
        system, root = fs.FileSystem.from_uri(folder)
        # a repeated attempt writes the same bytes; only whole files get the final name
        part = f"{root}/.{name_of(shard)}.{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(part) as file:
            file.write(body.tobytes())
        system.move(part, f"{root}/{name_of(shard)}")
        order = np.argsort(np.concatenate(places))
        ids = pa.chunked_array([pieces.column("ids").combine_chunks().flatten()]).take(pa.array(order))
        parts, held = (pa.array(np.concatenate(x)[order]) for x in (parts, held))
        return pa.table([pa.array(first + np.arange(count)), ids, parts, held], names)

    return of


def materialise(
    docs: DataFrame, path: str, folder: str | None = None, length: int = LENGTH, records: int = RECORDS, key: int = KEY,
    id_col: str = "doc_id", text_col: str = "text",
) -> Output:
    """Writes the tokens of all texts in training order and gives the tables of what was written.

    A text gives as many sequences as its tokens fill, the last one padded with the
    first special token (0 if there is none); null and empty texts give none. Sequences
    count in the order in which Spark reads the rows, which for the same files and
    settings is the same. Repeated rows and ids are sequences of their own, null ids stay
    null, other columns are not read, an empty table gives no shard.

    ``sequences``: ``slot, shard, offset, id_col, part, n_tokens``; ``offset`` is the byte at
    which the record begins in its shard.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-shards-{spark.sql('select uuid()').first()[0]}"
    merges = Encoder.of(path).merges
    kind, filler = kind_of(merges.size), min(merges.special.values(), default=0)
    tokens = _tokens(keyed(docs, id_col, text_col), path, length)
    rows = work_table(tokens, "tokens", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "6"})
    sequences = F.ceil(F.col("count") / length)
    # one row a task
    ends = sorted((r.task, r.end) for r in rows.groupBy("task").agg(F.max(F.col("first") + sequences).alias("end")).collect())
    size = sum(end for _, end in ends)
    starts = dict(zip([task for task, _ in ends], np.cumsum([0, *(end for _, end in ends)]).tolist()))
    shared = spark.sparkContext.broadcast((starts, Permutation(max(size, 1), key)))

    def numbered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot of every sequence of a batch, its row and its part."""
        starts, permutation = shared.value
        tasks, firsts = batch.column("task").to_numpy(), batch.column("first").to_numpy()
        many = -(-batch.column("count").to_numpy() // length)
        row = np.repeat(np.arange(len(many)), many)
        part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return permutation.slots(np.array([starts[t] for t in tasks.tolist()])[row] + firsts[row] + part), row, part

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            if not batch.num_rows:
                continue
            slots, row, part = numbered(batch)
            body = np.full((len(slots), length), filler, kind)
            at = 0
            for data in batch.column("tokens").to_pylist():
                ids = np.frombuffer(data, kind)
                many = -(-len(ids) // length)
                body[at : at + many].reshape(-1)[: len(ids)] = ids
                at += many
            held = np.minimum(batch.column("count").to_numpy()[row] - part * length, length).astype(np.int32)
            order = np.argsort(slots)
            shards, begins = np.unique(slots[order] // records, return_index=True)
            groups = np.split(order, begins[1:])
            ends = pa.array([0, *np.cumsum([len(g) for g in groups]).tolist()], pa.int32())
            ids = pa.ListArray.from_arrays(ends, batch.column("id").take(pa.array(row[order])))
            # places as steps, parts, tokens held and the records: columns that compress well, packed together
            packed = [
                pack.compress(np.stack([np.diff(slots[g] - s * records, prepend=0), part[g], held[g]]).astype(np.int32).tobytes() + body[g].tobytes())
                for s, g in zip(shards.tolist(), groups)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array([len(g) for g in groups], pa.int64()), pa.array(packed, pa.binary()), ids], piece_schema.names
            )

    id_type = rows.schema["id"].dataType
    piece_schema = StructType([*StructType.fromDDL("shard long, many long, packed binary").fields, StructField("ids", ArrayType(id_type))])
    row_schema = StructType([*StructType.fromDDL("slot long").fields, StructField(id_col, id_type), *StructType.fromDDL("part int, n_tokens int").fields])
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    dealt = rows.select("task", "first", "id", "count", "tokens").mapInArrow(pieces, piece_schema)
    write = _written(folder, size, length, records, kind, filler, row_schema.names)
    written = work_table(dealt.groupBy("shard").applyInArrow(write, row_schema), "token-sequences", compression="zstd")
    shard, stride = F.expr(f"slot div {records}"), length * np.dtype(kind).itemsize
    written = written.select("slot", shard.alias("shard"), (F.col("slot") % records * stride).alias("offset"), id_col, "part", "n_tokens")
    shards = written.groupBy("shard").agg(F.min("slot").alias("first_slot"), F.count("*").alias("records"))
    return Output(folder, size, length, records, kind, shards, written)


def digests(output: Output) -> DataFrame:
    """Every sequence with the hash of its record (``record_crc32``) as it is read back from the shard."""
    folder, length, kind, records = output.folder, output.length, output.kind, output.records
    schema = StructType([*output.sequences.schema.fields, StructField("record_crc32", LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = length * np.dtype(kind).itemsize
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            hashes: list[int] = []
            slots = batch.column("slot").to_numpy()
            # rows lie as their shard was written: runs of slots are read in one go
            breaks = np.flatnonzero((np.diff(slots) != 1) | (slots[1:] % records == 0)) + 1
            for run in np.split(slots, breaks) if len(slots) else ():
                shard, at = divmod(int(run[0]), records)
                with system.open_input_file(f"{root}/{name_of(shard)}") as file:
                    file.seek(at * stride)
                    data = memoryview(file.read(len(run) * stride))
                hashes += [zlib.crc32(data[n * stride : (n + 1) * stride]) for n in range(len(run))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64())], schema.names)

    return output.sequences.mapInArrow(of, schema)
