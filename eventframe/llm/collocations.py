"""Collocations by top-order marginalisation: only the longest windows are counted.

Every word of a piece leads one window of five word columns, padded where the piece ends.
One Spark ``ROLLUP`` over the five columns counts the windows, in the tasks before they are
shuffled, and sums them to all shorter prefixes: the prefix of k words occurs as often as the
windows that begin with it, and no prefix at all stands for all words of a language. So no
n-gram of a shorter order is ever formed.

A phrase is no more frequent than its rarest word or pair of neighbouring words. These are
counted first, and a word or pair below the least frequency ends a window as the end of a
piece does. Tasks know the frequent ones by two bit filters of fixed size; what slips through
is counted like any other, so the filters decide only how much is pruned.

Word columns hold 64-bit hashes. Where two words of a language share one, which the word
counts tell, everything is done again with another seed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventframe.llm.byte_words import BREAK, PIECES, Numbers, binaries, token_slabs
from eventframe.llm.letters import mixed
from eventframe.llm.texts import work_table

LONGEST = 5
LEAST = 100
SHARE = 100
TOP = 2000
NO_LANGUAGE = "und"
WORD_BITS = 1 << 25
PAIR_BITS = 1 << 27
# What stands in place of a word's number.
END, RARE = -1, -2
# A task hands on its words or windows when it holds so many.
FLUSH_WORDS = 500_000
FLUSH_WINDOWS = 1_000_000
BROADCAST_ROWS = 10_000

WORD_COLUMNS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _seed(lang: str, salt: int) -> int:
    return xxhash.xxh64_intdigest(lang, salt)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    return docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))


def word_counts(texts: DataFrame, salt: int) -> DataFrame:
    """``lang, key, word, count`` of each task's words."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            counter.pop(BREAK, None)
            seed, words = _seed(lang, salt), list(counter)
            keys = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(words), pa.string()), pa.array(keys, pa.int64()),
                pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(counter.values()), pa.int64()),
            ], ["lang", "key", "word", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), binaries(batch.column("text"))):
                for tokens in token_slabs(text, PIECES):
                    counts[lang].update(tokens)
                if len(counts[lang]) > FLUSH_WORDS or len(counts) > 1000:
                    yield from rows(counts)
                    counts.clear()
        yield from rows(counts)

    return texts.mapInArrow(run, "lang string, key bigint, word string, count bigint")


def vocabulary(texts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Words of at least that frequency (``lang, key, word``), and the seed under which no two words share a key."""
    salt = 0
    while True:
        # One shuffle serves both groupings.
        words = word_counts(texts, salt).repartition("lang", "key").groupBy("lang", "key", "word").agg(F.sum("count").alias("total"))
        keys = words.groupBy("lang", "key").agg(
            F.sum("total").alias("total"), F.count("*").alias("_words"), F.first("word").alias("word")
        )
        known = work_table(keys.where((F.col("total") >= least) | (F.col("_words") > 1)), "collocation-words")
        if known.where("_words > 1").isEmpty():
            return known.select("lang", "key", "word"), salt
        salt += 1


def _bits(places: DataFrame, bits: int) -> np.ndarray:
    """One bit per row's ``place``; at most ``bits`` / 64 numbers reach the driver."""
    found = places.select(
        F.shiftrightunsigned("place", 6).alias("number"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
    ).groupBy("number").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(max(bits // 64, 1), np.uint64)
    out[found.column("number").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return out


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) != 0


def _place(keys: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    return keys & np.uint64((bits if isinstance(bits, int) else len(bits) * 64) - 1)


def _pair_keys(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A hash of each word and its successor; of no meaning where either is a break."""
    return mixed(keys[numbers[:-1]] * np.uint64(0x9E3779B97F4A7C15) + keys[numbers[1:]])


def _groups(
    batches: Iterator[pa.RecordBatch], words_with: np.ndarray, salt: int
) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Words of a task's texts by language, in pieces of bounded size: ``lang, keys, numbers``.

    ``numbers`` index the keys; ``END`` stands for the end of a piece, ``RARE`` for a rare word.
    """
    words: dict[str, Numbers] = {}
    numbers: dict[str, list[np.ndarray]] = defaultdict(list)
    held: Counter = Counter()

    def group(lang: str) -> tuple[str, np.ndarray, np.ndarray]:
        known, seed = words.pop(lang), _seed(lang, salt)
        keys = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, len(known))
        frequent = _has(words_with, _place(keys, words_with))
        frequent[known[BREAK]] = False
        every = np.concatenate(numbers.pop(lang))
        every = np.where(frequent[every], every, np.where(every == known[BREAK], END, RARE))
        del held[lang]
        return lang, keys, every

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), binaries(batch.column("text"))):
            known = words.setdefault(lang, Numbers())
            stop = np.array([known[BREAK]], np.int32)
            for tokens in token_slabs(text, PIECES):
                numbers[lang].append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
                held[lang] += len(tokens)
            numbers[lang].append(stop)
            held[lang] += 1
            if held[lang] > FLUSH_WINDOWS:
                yield group(lang)
            elif held.total() > 4 * FLUSH_WINDOWS:
                for other in list(numbers):
                    yield group(other)
    for lang in list(numbers):
        yield group(lang)


def frequent_pairs(texts: DataFrame, words_with: np.ndarray, salt: int, least: int, bits: int) -> np.ndarray:
    """Bits of the places at which pairs of neighbouring words occur ``least`` times together.

    Every frequent pair's bit is set; a rare one's is if its place is shared by enough others.
    """
    shared = texts.sparkSession.sparkContext.broadcast(words_with)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, numbers in _groups(batches, shared.value, salt):
            both = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
            places, counts = np.unique(_place(_pair_keys(keys, numbers)[both], bits), return_counts=True)
            for first in range(0, len(places), 100_000):
                part = slice(first, first + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(places[part].view(np.int64)), pa.array(counts[part])], ["place", "count"])

    counted = texts.mapInArrow(run, "place bigint, count bigint").groupBy("place").agg(F.sum("count").alias("count"))
    return _bits(counted.where(F.col("count") >= least), bits)


def _windows(numbers: np.ndarray, joined: np.ndarray, size: int) -> np.ndarray:
    """Rows of word numbers, a window per word, padded with -1; a rare word's window is all padding.

    ``joined``: whether a word and its successor may share a window.
    """
    begins = np.flatnonzero(numbers != END)
    rows = np.full((len(begins), size), -1, numbers.dtype)
    goes_on = np.concatenate([joined, np.zeros(1, bool)])
    left = np.flatnonzero(numbers[begins] >= 0)
    rows[left, 0] = numbers[begins[left]]
    for i in range(1, size):
        left = left[goes_on[begins[left] + i - 1]]
        rows[left, i] = numbers[begins[left] + i]
    return rows


def lead_windows(
    texts: DataFrame, words_with: np.ndarray, pairs_with: np.ndarray, salt: int, size: int = LONGEST
) -> DataFrame:
    """``lang, w1 .. w5``: the padded longest window of every word."""
    columns = WORD_COLUMNS[:size]
    shared = texts.sparkSession.sparkContext.broadcast((words_with, pairs_with))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_with, pairs_with = shared.value
        for lang, keys, numbers in _groups(batches, words_with, salt):
            joined = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
            joined &= _has(pairs_with, _place(_pair_keys(keys, numbers), pairs_with))
            found = _windows(numbers, joined, size)
            for first in range(0, len(found), 100_000):
                part = found[first : first + 100_000]
                arrays = [pa.array(keys.view(np.int64)[part[:, i]], pa.int64(), mask=part[:, i] < 0) for i in range(size)]
                lead = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(part), np.int32)))
                yield pa.RecordBatch.from_arrays([lead, *arrays], ["lang", *columns])

    kinds = ", ".join(f"{c} bigint" for c in columns)
    return texts.mapInArrow(run, f"lang string, {kinds}")


def phrases(windows: DataFrame, least: int, size: int = LONGEST) -> DataFrame:
    """``lang, words, total`` of every phrase of at least that frequency, summed up from the windows.

    The row without words has the number of all words of a language.
    """
    columns = WORD_COLUMNS[:size]
    summed = windows.rollup("lang", *columns).agg(F.count("*").alias("total"), F.grouping_id().alias("_rolled"))
    # Rolled up to k words; a prefix that ends in padding is the shorter phrase, which has a row of its own.
    whole = F.col("_rolled") == 2**size - 1
    for order, column in enumerate(columns, 1):
        whole |= (F.col("_rolled") == 2 ** (size - order) - 1) & F.col(column).isNotNull()
    words = F.array_compact(F.array(*columns)).alias("words")
    return summed.where(whole).select("lang", words, "total").where((F.col("total") >= least) | (F.size("words") == 0))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table that is counted to be small; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _decimal(c: Column | str) -> Column:
    return F.col(c).cast("decimal(17,0)") if isinstance(c, str) else c.cast("decimal(17,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text",
    word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS,
) -> DataFrame:
    """Each language's best phrases of two to five words: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z count as a-z. Pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. ``n`` counts a
    language's words, ``a`` a phrase's occurrences (at least ``least``); the cut into ``l`` and ``r``
    with the lowest score 1000 a n / (l r) counts. A phrase within a longer one that has ``share``
    percent of its occurrences or more is left out. Numbers are exact: products are decimals of 38 digits.

    Null texts count as empty, a null language is ``und``, repeated rows count as often as they occur,
    ties go to the phrase that is first in UTF-8, other columns are not read, an empty table gives
    no rows. ``word_bits`` and ``pair_bits`` (powers of two, 64 at least) are the sizes of the filters.
    """
    texts = _texts(docs, lang_col, text_col)
    known, salt = vocabulary(texts, least)
    words_with = _bits(known.select(F.col("key").bitwiseAND(word_bits - 1).alias("place")), word_bits)
    pairs_with = frequent_pairs(texts, words_with, salt, least, pair_bits)
    found = work_table(phrases(lead_windows(texts, words_with, pairs_with, salt), least), "collocation-phrases")

    longer = found.where(F.size("words") >= 2)
    cuts = longer.select("lang", "words", F.col("total").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "*", F.slice("words", F.lit(1), F.col("k")).alias("_first"),
        F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("_rest"),
    )
    totals = found.where(F.size("words") == 0).select("lang", F.col("total").alias("n"))
    left = found.select("lang", F.col("words").alias("_first"), F.col("total").alias("l"))
    right = found.select("lang", F.col("words").alias("_rest"), F.col("total").alias("r"))
    scored = cuts.join(left, ["lang", "_first"]).join(right, ["lang", "_rest"]).join(_small(totals), "lang")
    score = F.call_function(
        "div", F.lit(1000).cast("decimal(4,0)") * _decimal("a") * _decimal("n"), _decimal("l") * _decimal("r")
    )
    best = scored.withColumn("score", score).groupBy("lang", "words").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("_cut")
    ).select("lang", "words", "_cut.*")

    # What lies in a longer phrase lies in one that is longer by a word and at least as frequent as that one.
    inner = F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1)))
    covering = longer.where(F.size("words") >= 3).select("lang", inner.alias("words"), "total")
    covering = covering.groupBy("lang", "words").agg(F.max("total").alias("_longer"))
    kept = best.join(covering, ["lang", "words"], "left").where(
        F.coalesce(F.lit(100) * F.col("_longer") < F.lit(share) * F.col("a"), F.lit(True))
    ).drop("_longer")

    spelled = kept.select("lang", "words", F.posexplode("words").alias("_at", "key")).join(
        known.select("lang", "key", "word"), ["lang", "key"]
    ).groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_spelled"))
    named = kept.join(spelled, ["lang", "words"]).withColumn("phrase", F.concat_ws(" ", "_spelled.word"))
    in_order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return named.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
