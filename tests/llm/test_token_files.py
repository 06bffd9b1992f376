"""Permutation, shards and resumed reads against the library's tokens."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventframe.llm import queries, token_files
from eventframe.llm.texts import table
from eventframe.llm.token_files import Permutation

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097, 65537])
def test_permutation(size):
    numbers = np.arange(size)
    one, two = Permutation(size, 1), Permutation(size, 2)
    assert sorted(one.slots(numbers).tolist()) == list(range(size))
    assert (one.numbers(one.slots(numbers)) == numbers).all()
    if size >= 1000:
        assert (one.slots(numbers) == two.slots(numbers)).mean() < 0.01
        assert abs(np.corrcoef(numbers, one.slots(numbers))[0, 1]) < 0.1


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in pairs], "doc_id long, text string, slot int, id string").repartition(3)


def test_shards(spark, tmp_path):
    rnd = random.Random(1)
    library = Tokenizer.from_file(PATH)
    pairs = [(n, " ".join(rnd.choice(["alpha", "beta", "Über", "x1"]) for _ in range(rnd.randrange(1, 90)))) for n in range(150)]
    pairs += [(None, "no id"), (7, None), (8, ""), (9, "same row"), (9, "same row"), (10, "long " * 900)]
    out = token_files.materialise(docs_of(spark, pairs), PATH, str(tmp_path / "shards"), length=16, records=64)
    rows = sorted(token_files.digests(out).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(out.size))
    wanted = []
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted += [(i is None, i, part, ids[16 * part : 16 * part + 16]) for part in range(-(-len(ids) // 16))]
    records = out.read(0, out.size)
    got = [(r.doc_id is None, r.doc_id, r.part, records[r.slot][: r.n_tokens].tolist()) for r in rows]
    assert sorted(got) == sorted(wanted)
    for r in rows:
        assert (records[r.slot][r.n_tokens :] == 50256).all() and r.record_crc32 == zlib.crc32(records[r.slot].tobytes())
        assert (r.shard, r.offset) == (r.slot // 64, r.slot % 64 * 32)
    # the same rows, read on from any slot
    for first in (0, 63, 64, out.size - 5):
        assert (out.read(first, 70) == records[first : first + 70]).all()
    shards = sorted(out.shards.collect())
    assert [s.first_slot for s in shards] == list(range(0, out.size, 64)) and sum(s["records"] for s in shards) == out.size
    # another key gives another order of the same sequences
    other = token_files.materialise(docs_of(spark, pairs), PATH, str(tmp_path / "other"), length=16, records=64, key=5)
    again = other.read(0, other.size)
    assert sorted(map(bytes, again)) == sorted(map(bytes, records)) and (again != records).any()


def test_empty_tables(spark):
    for pairs in ([], [(1, None), (2, "")]):
        out = token_files.materialise(docs_of(spark, pairs), PATH)
        assert out.size == 0 and token_files.digests(out).count() == 0 and out.read(0, 9).shape == (0, token_files.LENGTH)


def test_query(spark, sf_dir):
    rows = queries.op5_token_files(spark, sf_dir).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    library = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    size = token_files.LENGTH
    for r in rows:
        part = ids[r.doc_id][r.part * size : (r.part + 1) * size]
        assert r.n_tokens == len(part) and r.record_crc32 == zlib.crc32(np.array(part + [50256] * (size - len(part)), "<u2").tobytes())
    assert len(rows) == sum(-(-len(x) // size) for x in ids.values())
