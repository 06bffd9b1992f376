"""Sharding, line removal, fingerprints and components against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from eventframe.llm import line_dedup, sharding, simhash
from eventframe.llm.components import components

SCHEMA = "doc_id long, text string, source string, size string, shard int, fp string, line_hash int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y", 2) for i, t, s in rows], SCHEMA).repartition(5)


def shards_by_hand(rows, shards):
    """Sizes laid end to end in the order of CRC, id hash and id; a record is where it begins."""
    size = lambda t: len((t or "").encode()) + 16
    total = sum(size(t) for _, t, _ in rows)
    return total, size


@pytest.mark.parametrize("shape", ["mixed", "one text", "repeats", "few", "empty"])
def test_shards(spark, shape):
    rnd = random.Random(shape)
    words = ["a", "bb", "ccc é", "", None]
    if shape == "mixed":
        rows = [(i, "w" * rnd.randrange(400), "s") for i in range(2000)] + [(None, None, "s"), (7, "long" * 5000, "s")]
    elif shape == "one text":
        rows = [(i, "the same text" * 9, "s") for i in range(3000)] + [(i, f"t{i}", "s") for i in range(50)]
    elif shape == "repeats":
        rows = [(5, "again", "s")] * 4000 + [(None, None, "s")] * 300 + [(i, "again", "s") for i in range(200)]
    else:
        rows = [(i, words[i], "s") for i in range(5)] if shape == "few" else []
    got = sharding.shard_documents(docs_of(spark, rows), shards=8).collect()
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    total, size = shards_by_hand(rows, 8)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), crc(t)) for i, t, _ in rows)
    slots, held = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max((size(t) for _, t, _ in rows), default=0)
    assert all(0 <= s < 8 and abs(held[s] - total / 8) <= most for s in held)
    # equal texts lie in neighbouring shards, and each one's shards follow their order
    if got:
        order = sorted(got, key=lambda r: (r.shard, r.slot))
        crcs = [-1 if r.text_crc32 is None else r.text_crc32 for r in order]
        assert crcs == sorted(crcs)


def test_overfull_ranges_are_subdivided(spark):
    rows = [(i, "hot", "s") for i in range(4000)] + [(i, f"cold {i}", "s") for i in range(400)]
    records = sharding._records(docs_of(spark, rows), "doc_id", "text").withColumn("bytes", F.col("size") * F.col("n"))
    total = records.agg(F.sum("bytes")).first()[0]
    numbered, ranges = sharding.ranged(records, total, 64, draws=2)
    found = ranges.orderBy("group", "range").collect()
    assert all(a.high < b.low for a, b in zip(found, found[1:])) and sum(r.rows for r in found) == len(rows)
    assert max(r.bytes for r in found) <= 2 * total / 64 and len({r.group for r in found}) > 4
    assert numbered.groupBy("group", "range").count().count() == len(found)


def test_lines(spark):
    common, rare, short = "subscribe to our newsletter", "seen on three sites only", "too short"
    rows = []
    for i in range(12):
        rows.append((i, f"own words of document {i}, long enough to stay\n {common} \n{short}\n{rare if i < 3 else 'x'}\nend {i} of it all", f"s{i % 6}"))
    rows += [(20, None, "s1"), (21, "", "s1"), (22, common, "s9"), (23, f"{common}\nbody of a page that is of another site, kept", None),
             (24, f"{common}\n\nbody of a page that is of another site, kept", "s0"), (24, f"{common}\n\nbody of a page that is of another site, kept", "s0"), (None, "a\n", None)]
    docs = docs_of(spark, rows)
    got = sorted((r.doc_id is None, r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.without_boilerplate(docs, min_sites=5).collect())
    sites, pages = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if len(line.strip(" ")) >= 12 and s is not None:
                sites[line.strip(" ")].add(s)
                pages[line.strip(" ")].add(t)
    bad = {x for x, s in sites.items() if len(s) >= 5 and len(pages[x]) >= 5}
    assert bad == {common}
    wanted = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        stays = [x for x in lines if x.strip(" ") not in bad]
        wanted.append((i is None, i, None if t is None else "\n".join(stays), len(lines), len(lines) - len(stays)))
    assert got == sorted(wanted)
    assert line_dedup.without_boilerplate(docs_of(spark, [])).count() == 0


def test_short_pages_lose_boilerplate_and_copies_keep_their_text(spark):
    rows = [(n, f"page {n}\nsubscribe to our newsletter", f"s{n}") for n in range(12)] + [(20, "subscribe to our newsletter\nhi", "s1")]
    rows += [(30 + n, "a whole text\nthat many sites have copied", f"s{n}") for n in range(15)]
    docs = docs_of(spark, rows).withColumns({n: F.lit("clash") for n in ("__text", "__drop", "line_hash", "sites")})
    got = {r.doc_id: r.text for r in line_dedup.without_boilerplate(docs).collect()}
    assert got == {n: f"page {n}" for n in range(12)} | {20: "hi"} | {30 + n: rows[13][1] for n in range(15)}


@pytest.mark.parametrize("min_sites", [3, 20, 60])
def test_line_spread_is_exact(spark, min_sites):
    rnd = random.Random(4)
    rows = [(n, f"line number {k} of the test\n{n}", f"site {s}") for n, (k, s) in enumerate((k, s) for k in range(70) for s in rnd.sample(range(500), k) * 2)]
    got = {r.line_hash for r in line_dedup.boilerplate(docs_of(spark, rows), min_sites, precision=8).collect()}
    texts = spark.createDataFrame([(f"line number {k} of the test",) for k in range(min_sites, 70)], "t string").select(F.xxhash64("t"))
    assert got == {r[0] for r in texts.collect()}


def fingerprint_by_rule(text, size=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_fingerprints(monkeypatch, part):
    monkeypatch.setattr(simhash, "PART_BYTES", part)
    rnd = random.Random(2)
    texts = ["", " \n", "One", "ÀB c", "a\x85b c d", "x" * 50 + " y z"] + [" ".join(rnd.choice(["The", "cat", "sat", "É", "on\t", "\x0b"]) for _ in range(rnd.randrange(60))) for _ in range(200)]
    assert [simhash.fingerprint(t) for t in texts] == [fingerprint_by_rule(t) for t in texts]


def by_brute_force(values, bits):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(set)
    for v in values:
        groups[find(v)].add(v)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("bits,paired", [(1, 256), (2, 256), (2, 4), (3, 4), (0, 256)])
def test_links(spark, bits, paired):
    rnd = random.Random(bits)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = {rnd.getrandbits(64) for _ in range(60)}
    for base in [rnd.getrandbits(64) for _ in range(4)] + [0]:
        for _ in range(60):
            v = base
            for _ in range(rnd.randrange(6)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    values = sorted(signed(v) for v in values)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    found = defaultdict(set)
    for r in components(simhash.links(nodes, bits, paired=paired)).collect():
        found[r.root].add(r.node)
    assert sorted(sorted(g) for g in found.values()) == by_brute_force(values, bits)


def test_near_duplicates_on_odd_rows(spark):
    rnd = random.Random(5)
    base = " ".join(rnd.choice("abcdefgh") * 3 for _ in range(300))
    rows = [(9, base, "s"), (4, base.upper(), "s"), (4, base, "s"), (6, base.replace("aaa", "zzz"), "s"), (None, base, "s"),
            (8, None, "s"), (3, "", "s"), (2, "alone in the world", "s"), (None, "nobody at all here", "s")]
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, rows)).collect())
    prints = {i: format(fingerprint_by_rule(t), "016x") for i, (_, t, _) in enumerate(rows)}
    wanted_ids = [4, 4, 4, 6, 4, 3, 3, 2, None]
    assert got == sorted((r[0] is None, r[0], prints[i], wanted_ids[i]) for i, r in enumerate(rows))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 400), (400, 500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
