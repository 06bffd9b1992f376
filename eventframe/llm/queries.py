"""Registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventframe.llm import (
    bpe_codec, collocations, decontamination, dual_tree, language_id, license_scan, line_dedup, neighbours, sharding, simhash,
    token_counts, token_files, toxicity,
)
from eventframe.llm.texts import table

BYTE_BPE = "byte_bpe_50k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected toxicity grade of every document, and whether it is rejected."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.training_rows(docs, ~language_id.held_out()))
    predicted = language_id.predict(docs, model)
    return predicted.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more sources carry."""
    return line_dedup.without_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "text", "n_lines", "n_removed"
    )


OP4_SQL = f"""
WITH lines AS (
    SELECT doc_id, source, md5(text) AS whole, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM documents
), boilerplate AS (
    SELECT trim(line, ' ') AS kept FROM lines WHERE length(trim(line, ' ')) >= {line_dedup.MIN_CHARS}
    GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES} AND count(DISTINCT whole) >= {line_dedup.MIN_SITES}
), marked AS (
    SELECT doc_id, line, place, trim(line, ' ') IN (SELECT kept FROM boilerplate) AS bad FROM lines
), cleaned AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad,
           coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT bad), '') AS clean
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, d.source, CASE WHEN n_bad > 0 THEN clean ELSE text END AS text,
       CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_bad, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN cleaned USING (doc_id)
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in training order: every sequence's slot, and its record as written."""
    output = token_files.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return token_files.digests(output)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage, edits allowed."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of three-word shingles, linked within two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, bits=2)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), count=5, every=50)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and licence templates in every document."""
    return license_scan.digests(license_scan.scan(table(spark, sf_dir, "documents")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for every benchmark item."""
    return dual_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), count=10)


OP12_SQL = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), sizes AS (
    SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), whole AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), found AS (
    SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM found GROUP BY term), whole
), parts AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS part
    FROM found JOIN weights USING (term) JOIN sizes USING (doc_id), whole
), scored AS (
    SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), total AS (
    SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang
), places AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), grams AS (
    SELECT lang, words[i : i + k - 1] AS words, count(*) AS f FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
    WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT g.lang, g.words, g.f AS a, k, p.f AS l, s.f AS r, n, CAST((1000 * CAST(g.f AS HUGEINT) * n) // (CAST(p.f AS HUGEINT) * s.f) AS BIGINT) AS score
    FROM grams g, (SELECT unnest([1, 2, 3, 4]) AS k) JOIN grams p ON p.lang = g.lang AND p.words = g.words[1:k]
    JOIN grams s ON s.lang = g.lang AND s.words = g.words[k + 1 :] JOIN total t ON t.lang = g.lang
    WHERE k < len(g.words)
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inside AS (
    SELECT lang, words[i : i + k - 1] AS words, max(f) AS longest
    FROM grams, (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest([1, 2, 3, 4]) AS i)
    WHERE k < len(words) AND i + k - 1 <= len(words) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.words = b.words
      WHERE longest IS NULL OR 100 * longest < 100 * a)
QUALIFY rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_neighbours": op10_neighbours,
    "op11_license_scan": op11_license_scan,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op12_ranked_search": OP12_SQL, "op13_collocations": OP13_SQL}
