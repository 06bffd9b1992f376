"""Benchmark passages: verification against the edit-distance table, recall on edited copies, odd rows."""

import random

import numpy as np

from eventframe.llm import decontamination, queries
from eventframe.llm.decontamination import Items, best_of, words_of
from eventframe.llm.texts import table

VOCABULARY = [f"w{n}" for n in range(400)]


def prose(rnd, size):
    return [rnd.choice(VOCABULARY) for _ in range(size)]


def least_edits(item, window):
    """Edits of the item to the nearest part of the window, by the full table."""
    row = [0] * (len(window) + 1)
    for n, word in enumerate(item, 1):
        row, old = [n], row
        for m, other in enumerate(window, 1):
            row.append(min(old[m - 1] + (word != other), old[m] + 1, row[-1] + 1))
    return min(row)


def edited(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        if kind == 0:
            out[at] = "changed"
        elif kind == 1:
            out.insert(at, "added")
        else:
            del out[at]
    return out


def test_edits_equal_the_table():
    rnd = random.Random(1)
    for _ in range(300):
        item = [rnd.choice("abc") for _ in range(rnd.randrange(1, 70))]
        window = edited(rnd, [rnd.choice("abc") for _ in range(5)] + item, rnd.randrange(10))[: rnd.randrange(90)]
        items = Items([(0, " ".join(item))])
        row = next(items.rows_of([" ".join(window)]))
        assert items.edits(0, row.tolist()) == least_edits(item, window)


def test_recall_on_edited_copies():
    rnd = random.Random(2)
    rows = [(n, " ".join(prose(rnd, rnd.randrange(12, 60)))) for n in range(80)]
    items = Items(rows)
    assert items.recall >= decontamination.RECALL
    found = total = 0
    for number, (_, text) in enumerate(rows):
        words = words_of(text)
        for _ in range(4):
            copy = edited(rnd, words, items.allowed(number))
            doc = prose(rnd, 50) + copy + prose(rnd, 50)
            held = best_of(items, [" ".join(doc)])[0]
            total += 1
            found += number in held
            if number in held:
                assert least_edits(words, doc) <= held[number] <= items.allowed(number)
    assert found >= 0.95 * total


def test_nothing_beyond_the_threshold():
    rnd = random.Random(3)
    rows = [(n, " ".join(prose(rnd, 30))) for n in range(30)]
    items = Items(rows)
    docs = [prose(rnd, 60) + edited(rnd, words_of(t), 14) + prose(rnd, 60) for _, t in rows]
    for doc, held in zip(docs, best_of(items, [" ".join(d) for d in docs])):
        for number, edits in held.items():
            assert least_edits(words_of(rows[number][1]), doc) <= edits <= items.allowed(number)


def test_long_text_and_blocks(monkeypatch):
    monkeypatch.setattr(decontamination, "WINDOWS", 64)
    rnd = random.Random(4)
    rows = [(n, " ".join(prose(rnd, 25))) for n in range(9)]
    text = " ".join(" ".join(prose(rnd, 100)) + " " + t for _, t in rows)
    assert best_of(Items(rows), [text, "", None, rows[3][1]]) == [{n: 0 for n in range(9)}, {}, {}, {3: 0}]


def test_items_at_the_beginning_of_texts():
    """A walk from the filler must not stand for the next text, nor report the one before."""
    rnd = random.Random(6)
    rows = [(n, " ".join(prose(rnd, rnd.randrange(40, 56)))) for n in range(100)]
    items = Items(rows)
    texts = [x for _, t in rows for x in (" ".join(["clean"] * rnd.randrange(5, 90)), t + " " + " ".join(prose(rnd, rnd.randrange(60))))]
    texts += [x for _, t in rows for x in ("", t)]
    assert best_of(items, texts) == [x for n in range(100) for x in ({}, {n: 0})] * 2


def test_recall_of_short_items_among_long_ones():
    rnd = random.Random(7)
    lengths = [8, 9, 10, 12, 15, 16, 20] * 3 + [rnd.randrange(40, 70) for _ in range(200)]
    rows = [(n, " ".join(prose(rnd, size))) for n, size in enumerate(lengths)]
    items = Items(rows)
    assert items.recall >= decontamination.RECALL and min(items.recalls) == 8
    for number, (_, text) in enumerate(rows[:21]):
        copies = [edited(rnd, words_of(text), items.allowed(number)) for _ in range(60)]
        found = best_of(items, [" ".join(prose(rnd, 9) + c + prose(rnd, 9)) for c in copies])
        assert sum(number in held for held in found) >= 0.95 * len(copies)


def odd(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, item_id int, id string")


def test_odd_rows(spark, monkeypatch):
    rnd = random.Random(5)
    one, two = " ".join(prose(rnd, 20)), " ".join(prose(rnd, 40))
    bench = spark.createDataFrame([(1, one), (2, two), (3, None), (4, ""), (5, "!!"), (6, "very short"), (7, one)], "item_id long, text string")
    filler = " ".join(prose(rnd, 30))
    docs = odd(spark, [(1, f"{filler} {one.upper().replace(' ', '  ')}. {filler}"), (1, f"{filler} {one}"), (2, None), (3, ""), (4, filler),
                       (None, f"{two}, and more"), (5, "a VERY short text"), (6, "very long short text"), (7, filler[:90] + one[: len(one) // 2])])
    got = sorted((r.doc_id is None, r.doc_id, r.item_id, r.edits, r.similarity) for r in decontamination.leaks(docs, bench).collect())
    wanted = [(False, 1, 1, 0, 1.0)] * 2 + [(False, 1, 7, 0, 1.0)] * 2 + [(False, 5, 6, 0, 1.0), (True, None, 2, 0, 1.0)]
    assert got == sorted(wanted)
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 30)
    assert sorted((r.doc_id is None, r.doc_id, r.item_id, r.edits, r.similarity) for r in decontamination.leaks(docs, bench).collect()) == sorted(wanted)
    kept = decontamination.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7]
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.without_leaks(docs, bench.limit(0)).count() == 9
    assert decontamination.leaks(odd(spark, []), bench).count() == 0


def test_query_finds_all_unchanged_items(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, sf_dir).collect()}
    items = [(r.item_id, " ".join(words_of(r.text))) for r in table(spark, sf_dir, "benchmark").collect()]
    for r in table(spark, sf_dir, "documents").collect():
        text = f" {' '.join(words_of(r.text))} "
        assert {(r.doc_id, i) for i, words in items if f" {words} " in text} <= got


def test_items_of_five_to_seven_words_may_have_an_edit():
    rnd = random.Random(9)
    rows = [(n, " ".join(prose(rnd, 4 + n % 4))) for n in range(40)]
    items = Items(rows)
    assert {items.allowed(n) for n in range(40) if n % 4} == {1} and {items.allowed(n) for n in range(0, 40, 4)} == {0}
    for number, (_, text) in enumerate(rows):
        for _ in range(10):
            doc = prose(rnd, 9) + edited(rnd, words_of(text), items.allowed(number)) + prose(rnd, 9)
            held = best_of(items, [" ".join(doc)])[0]
            assert held.get(number) == least_edits(words_of(text), doc) if number % 4 else number in held
