"""Licence templates against regular expressions over the words, and odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from eventframe.llm import license_scan as scan
from eventframe.llm.queries import op11_license_scan
from eventframe.llm.texts import table


def normal(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def pattern(template):
    """A template as a regular expression over words that each end with a space."""
    out, last = "", 0
    for mark in scan._MARKUP.finditer(template):
        out += "".join(f"{w} " for w in normal(template[last : mark.start()]))
        last = mark.end()
        if mark[1] == "beginOptional":
            out += "(?:"
        elif mark[1] == "endOptional":
            out += ")?"
        else:
            match = re.search('match="([^"]*)"', mark[2])[1]
            free = re.fullmatch(r"\.\{(\d+),(\d+)\}", match)
            choices = "|".join("".join(f"{w} " for w in normal(c)) for c in match.split("|"))
            out += f"(?:[^ ]+ ){{{free[1]},{free[2]}}}" if free else f"(?:{choices})"
    return out + "".join(f"{w} " for w in normal(template[last:]))


def by_rule(text):
    """What a document's row should hold; every place is tried with every template."""
    words = normal(text)
    joined = "".join(f"{w} " for w in words)
    starts = [m.start() for m in re.finditer(r"[^ ]+ ", joined)]
    number = {at: n for n, at in enumerate([*starts, len(joined)])}
    base, labels, covered = [], set(), set()
    for is_base, table_of in ((True, {v: k for k, v in scan.PHRASES.items()}), (False, scan.TEMPLATES)):
        for label, template in table_of.items():
            compiled = re.compile(pattern(template))
            for at in starts:
                # the longest of all ways to match
                ends = [e for e in number if e > at and compiled.fullmatch(joined, at, e)] if compiled.match(joined, at) else []
                if ends:
                    labels.add(label)
                    covered.update(range(number[at], number[max(ends)]))
                    if is_base:
                        base.append((number[at], label))
    return (
        len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), len(covered) / len(words) if words else 0.0,
    )


CASES = [
    None, "", "...", "MIT LICENSE", "mit-license mit license", "Released under the terms of the MIT License.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "Permission to use, copy, and distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "licensed under the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
    "License, or (at your option) any later version", "gnu general public gnu general public license", "CC BY-SA 4.0 International",
    "cc by cc by-nc 4.0", "licensed under a Creative Commons Attribution Share Alike 4.0 International License",
    "licensed under a Creative Commons Attribution one two three four five 4.0 License", "émit license", "mit licensé",
    scan.TEMPLATES["bsd-2-clause"].replace("<<beginOptional>>", "").replace("<<endOptional>>", ""),
]


def plain(template):
    return re.sub(r'<<var;.*?original="([^"]*)".*?>>', r"\1", re.sub("<<(begin|end)Optional>>", "", template))


@pytest.fixture(scope="module")
def cases():
    return [*CASES, *map(plain, scan.TEMPLATES.values()), *[plain(t) + " and more" for t in scan.TEMPLATES.values()]]


def rows_of(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_rules(spark, cases):
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = rows_of(scan.digests(scan.scan(docs)))
    assert got == {n: by_rule(text) for n, text in enumerate(cases)}
    for n, label in enumerate(scan.TEMPLATES, len(CASES)):
        assert label in got[n][5].split(",")


def test_table(spark, sf_dir):
    rows = rows_of(op11_license_scan(spark, sf_dir))
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert rows == {k: by_rule(v) for k, v in texts.items()}
    assert any(r[1] for r in rows.values())


def test_whole_texts():
    automaton = scan.compile_templates({"t": 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d <<var;match=".{1,2}">> e'}, {})
    for text, wanted in {
        "a d x e": True, "A, b d x-y e": True, "a b c d e e": True, "a c d x e": False, "a b d e": False, "a d x y z e": False, "z a d x e": False,
    }.items():
        assert automaton.accepts(text) == (["t"] if wanted else []), text


@pytest.mark.parametrize("template", [
    "a <<beginOptional>>b", "a<<endOptional>>", 'a <<var;name="x">>', "<<beginOptional>>a<<endOptional>>", "", '<<var;match=".{0,3}">> a',
])
def test_templates_that_mean_nothing_are_refused(template):
    with pytest.raises(ValueError):
        scan.compile_templates({"t": template}, {})


def test_odd_rows(spark, monkeypatch):
    long = "x " * 300_000 + "mit license " + "y" * 5_000_000 + " apache license"
    rows = [(1, "mit license", "z"), (1, "mit license", "z"), (None, None, "z"), (3, long, "z"), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, passages string").withColumn("id", F.lit("clash"))
    got = sorted(scan.digests(scan.scan(docs)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) for r in got] == [
        (1, 2, 1, 0, 0), (1, 2, 1, 0, 0), (3, 300_005, 2, 300_000, 300_003), (4, 0, 0, None, None), (None, 0, 0, None, None),
    ]
    assert scan.digests(scan.scan(docs.limit(0))).collect() == []


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(scan, "MOST_STATES", 3)
    automaton = scan.compile_templates()
    for _ in range(3):
        assert automaton.accepts(plain(scan.TEMPLATES["mit-text"])) == ["mit-text"]
    assert len(automaton.sets) <= 500
