"""The pipeline's stages against plain rules, on the given tables and on odd rows."""

import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from eventframe.llm import simhash
from eventframe.llm.decontamination import words_of
from eventframe.llm.texts import table, work_table

from tests.llm.test_native import by_brute_force, fingerprint_by_rule


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage got and gave."""
    docs, out = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, work_table(stage(spark, docs, sf_dir), "test")
        out[name] = given.collect(), docs.collect(), given.columns, docs.columns
    return out


def test_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
    for name in names[:-1]:
        given, kept, before, after = stages[name]
        assert before == after and {r.doc_id for r in kept} <= {r.doc_id for r in given} and kept


def test_toxic_documents_go(spark, sf_dir, stages):
    given, kept, *_ = stages["toxicity"]
    toxic = {r.doc_id for r in table(spark, sf_dir, "labels").where("toxic = 1").collect()}
    clean = {r.doc_id for r in table(spark, sf_dir, "labels").where("toxic = 0").collect()}
    stays = {r.doc_id for r in kept}
    # the smallest table has eleven toxic labels
    assert len(toxic - stays) >= 0.5 * len(toxic) and len(clean & stays) >= 0.97 * len(clean)
    texts = {r.doc_id: r for r in given}
    assert all(texts[r.doc_id] == r for r in kept)


def test_lines(stages):
    given, kept, *_ = stages["line_dedup"]
    sites, pages = defaultdict(set), defaultdict(set)
    for r in given:
        for line in r.text.split("\n"):
            if len(line.strip(" ")) >= 12:
                sites[line.strip(" ")].add(r.source)
                pages[line.strip(" ")].add(r.text)
    boilerplate = {x for x in sites if len(sites[x]) >= 10 and len(pages[x]) >= 10}
    after = {r.doc_id: r for r in kept}
    assert len(after) == len(given)
    for r in given:
        wanted = "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in boilerplate)
        assert after[r.doc_id].text == wanted and after[r.doc_id].n_chars == len(wanted)


def test_one_of_each_group_stays(stages):
    given, kept, *_ = stages["simhash"]
    prints = {r.doc_id: fingerprint_by_rule(r.text) for r in given}
    lowest = defaultdict(list)
    for i, f in prints.items():
        lowest[f].append(i)
    names = {f: f for f in lowest}
    for group in by_brute_force(sorted(lowest), 2):
        names |= {f: group[0] for f in group}
    groups = defaultdict(list)
    for i, f in prints.items():
        groups[names[f]].append(i)
    assert sorted(r.doc_id for r in kept) == sorted(min(g) for g in groups.values())


def test_leaks_go(spark, sf_dir, stages):
    given, kept, *_ = stages["decontamination"]
    items = [" ".join(words_of(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    held = {r.doc_id for r in given if any(f" {x} " in f" {' '.join(words_of(r.text))} " for x in items)}
    stays = {r.doc_id for r in kept}
    assert not held & stays and len(stays) >= len(given) - len(held) - 0.02 * len(given)


def test_tokens(spark, sf_dir, stages):
    given, kept, *_ = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in given}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in given}
    assert {tuple(r) for r in kept} == {(i, len(x), sha(",".join(map(str, x))), sha(texts[i])) for i, x in ids.items()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r) for r in kept}


def test_groups_of_odd_rows(spark):
    base = " ".join(f"word{n % 7}" for n in range(80))
    rows = [(1, base), (1, base), (1, "something else of its own"), (2, base), (None, base), (None, "only here"), (None, "only here"), (3, None), (3, ""), (4, "  ")]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, root string, fp int")
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, (r.text or "").strip()) for r in kept) == sorted(
        [(False, 1, base), (False, 1, "something else of its own"), (True, None, "only here"), (False, 3, "")]
    )
    assert kept[0].__fields__ == docs.columns and simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_and_empty_tables(spark, tmp_path, number):
    name, stage = corpus_pipeline.STAGES[number]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, None, 1), (None, 1, 0), (2, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, None, None, None, None), (None, "", "x", None, 0), (2, "word " * 5000, None, "s", 9), (2, "word " * 5000, None, "s", 9), (None, None, None, None, None)]
    some, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    got = stage(spark, some, str(tmp_path)).count()
    assert got == (2 if name == "simhash" else 5) and stage(spark, none, str(tmp_path)).count() == 0
