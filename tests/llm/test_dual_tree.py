"""Ranked search against the formula for every pair, with trees, blocks and batches of many sizes."""

import math
import random
import re

import pytest

from eventframe.llm import dual_tree
from eventframe.llm.queries import ORACLES, op12_ranked_search
from tests.compare import connect, problems


def terms(text):
    return [m.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            for m in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def by_rule(docs, items, count):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    total, words = len(held), sum(len(t) for _, t in held)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, wanted in asked.items():
        weight = {}
        for term in wanted:
            df = sum(term in t for _, t in held)
            weight[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
        scored = []
        for doc, found in held:
            m = 100 - 90 + 90 * len(found) * total // words
            score = sum(
                weight[t] * (1_000_000_000 * found.count(t) // (1000 * found.count(t) + 8 * m)) for t in wanted if t in found
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        out |= {(item, n, doc, -score) for n, (score, _, doc) in enumerate(sorted(scored)[:count], 1)}
    return out


def made(seed, docs=300, items=23):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["Été", "中文", "X1"]

    def text():
        return rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary[: rnd.choice([10, 40, 123])]) for _ in range(rnd.randrange(0, 40)))

    rows = [(n, text()) for n in range(docs)]
    rows += [(docs + n, rows[7][1]) for n in range(40)] + [(None, rows[9][1]), (5000, None), (5001, ""), (5002, "...")]
    return rows, [(n, text()) for n in range(items)] + [(99, None), (100, ""), (3, "w1 w2 W3")]


@pytest.mark.parametrize("seed, most_items, most_terms, batch", [(1, 256, 16_384, 4096), (2, 5, 30, 40), (3, 1, 1, 513)])
def test_every_pair(spark, monkeypatch, seed, most_items, most_terms, batch):
    monkeypatch.setattr(dual_tree, "BATCH_DOCS", batch)
    docs, items = made(seed)
    found = dual_tree.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"), 10, most_items=most_items, most_terms=most_terms,
    )
    assert {tuple(r) for r in found.collect()} == by_rule(docs, items, 10)


def test_pruning_drops_batches(spark, monkeypatch):
    """Most leaves are never scored when a few documents are far ahead."""
    import numpy as np

    block = dual_tree.Block([0], [[0, 1]], {"a": 0, "b": 1})
    scored = []
    items = dual_tree.Items(block, np.array([5.0, 7.0]))
    plain = dual_tree.Found.add
    monkeypatch.setattr(dual_tree.Found, "add", lambda self, i, s, d: (scored.append(len(d)), plain(self, i, s, d)))
    count = 4000
    values = np.where(np.arange(count) < 32, 100.0, 1.0)
    levels = dual_tree.tree(dual_tree.Level(np.arange(count + 1), np.arange(count) % 2, values), dual_tree.LEAF, dual_tree.FANOUT, 2)
    found = dual_tree.Found(1, 10, None)
    dual_tree._walk(items, levels, list(range(count)), found, False)
    assert found.docs[0] == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19] and sum(scored) <= 2 * dual_tree.LEAF


def test_table(spark, sf_dir):
    assert problems(op12_ranked_search(spark, sf_dir), connect(sf_dir), ORACLES["op12_ranked_search"]) == []


def test_empty_repeated_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "c", "x")], "doc_id long, text string, terms string")
    items = spark.createDataFrame([("i", "A", 1), ("j", "zz", 1)], "item_id string, text string, doc int")
    rows = sorted(tuple(r) for r in dual_tree.search(docs, items).collect())
    assert [(r[0], r[1], r[2]) for r in rows] == [("i", 1, 1), ("i", 2, 1)] and rows[0][3] == rows[1][3]
    for some, others in ((docs.limit(0), items), (docs, items.limit(0))):
        empty = dual_tree.search(some, others)
        assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 200_000 + "needle " + "x" * 5_000_000), (2, "needle")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "needle")], "item_id long, text string")
    assert {tuple(r) for r in dual_tree.search(docs, items).collect()} == by_rule([tuple(r)[:2] for r in docs.collect()], [(1, "needle")], 10)
