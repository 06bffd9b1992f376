"""Collocations against counts of every n-gram, collisions and odd rows."""

import random
import re
from collections import Counter

import pytest

from eventframe.llm import collocations
from eventframe.llm.queries import ORACLES, op13_collocations
from tests.compare import connect, problems


def by_rule(docs, least, share, top):
    counts, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = set()
    for lang, grams in counts.items():
        frequent = {g: a for g, a in grams.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in frequent.items():
            inside = any(
                len(h) > len(g) and 100 * f >= share * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, f in frequent.items()
            )
            if not inside:
                score, _, left, right = min(
                    (1000 * a * total[lang] // (grams[g[:k]] * grams[g[k:]]), k, grams[g[:k]], grams[g[k:]]) for k in range(1, len(g))
                )
                kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def made(seed, rows=400):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "é", "中", "d'e", "x-y", "rare1", "rare2", "rare3"]

    def text():
        return "".join(
            rnd.choice(words[: rnd.choice([3, 6, 10])]) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " "])
            for _ in range(rnd.randrange(0, 30))
        )

    return [(rnd.choice(["en", "en", "fr", None, "und"]), text()) for _ in range(rows)] + [(None, None), ("en", ""), ("zz", None), ("en", "...")]


@pytest.mark.parametrize("seed, least, share, top, bits", [(1, 20, 100, 2000, (1 << 25, 1 << 27)), (2, 5, 80, 7, (64, 64)), (3, 1, 100, 50, (256, 1024)), (4, 30, 100, 2000, (64, 1 << 20))])
def test_every_ngram(spark, seed, least, share, top, bits):
    docs = made(seed)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = collocations.collocations(df, least=least, share=share, top=top, word_bits=bits[0], pair_bits=bits[1])
    assert {tuple(r) for r in got.collect()} == by_rule(docs, least, share, top)


def test_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH_WORDS", 3)
    monkeypatch.setattr(collocations, "FLUSH_WINDOWS", 20)
    docs = made(4)
    got = collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), least=10)
    assert {tuple(r) for r in got.collect()} == by_rule(docs, 10, 100, 2000)


def test_table(spark, sf_dir):
    assert problems(op13_collocations(spark, sf_dir), connect(sf_dir), ORACLES["op13_collocations"]) == []


def test_words_that_share_a_key(spark, monkeypatch):
    """Under the first seed two words have one key; the next seed is taken."""
    plain = collocations._seed
    rows = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    counted = collocations.word_counts

    def clashing(texts, salt):
        found = counted(texts, salt)
        return found.replace(dict.fromkeys([r.key for r in found.where("word in ('a', 'b')").collect()], 7), subset=["key"]) if salt == 0 else found

    monkeypatch.setattr(collocations, "word_counts", clashing)
    known, salt = collocations.vocabulary(rows, 1)
    assert salt == 1 and known.where("word is not null").count() == 3 and plain("en", 0) != plain("en", 1)


def test_odd_rows(spark):
    rows = [("en", "p q " * 60, 1), ("en", "p q " * 60, 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "lang string, text string, words int")
    assert {tuple(r) for r in collocations.collocations(df).collect()} == by_rule([r[:2] for r in rows], 100, 100, 2000)
    empty = collocations.collocations(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_very_long_text(spark, monkeypatch):
    # Cut into slabs inside a run of words; windows run on over the cut.
    rows = [("en", "one two three four five " * 1000 + "y" * 5_000_000 + " one two")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in collocations.collocations(df).collect()} == by_rule(rows, 100, 100, 2000)
