"""Benchmark passages in documents, found by an edit-distance embedding and verified exactly.

Texts are rows of words. The CGK embedding of a row is a random walk over it: step i
writes down the word it stands on and moves on by a random bit of the step and the
word. Two rows within a few edits walk together again after each edit, so their
embeddings agree in most places: edit distance has become Hamming distance. A table
samples a few places of one walk; rows whose sampled words agree are candidates. Every
word of a document starts a window, and an item is entered at every fourth of its words,
so that an edit near its beginning does not hide it. Tables are added until simulated
copies of the items, edited as much as the threshold allows, are found with the target
recall on average. Items of a length that is still below the target, mostly short ones,
are found by seeds instead: cut into one part more than the edits allowed, a copy has one
part unchanged, so none is lost. A candidate window of the item's size is verified by the
exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from eventframe.llm.letters import slabs
from eventframe.llm.texts import keep_rows, keyed, map_texts

SIMILARITY = 0.8
RECALL = 0.95
STEPS = 20
PLACES = 7
STRIDE = 4
MOST_TABLES = 64
# Simulated copies of each length class, fewer of long items.
COPIES = 400
# Items of fewer words are too short to walk and are found by seeds.
LEAST_WORDS = 8
# Bound of what is broadcast at a time; more items go over the documents in several passes.
BLOCK_WORDS = 1_000_000
WINDOWS = 1 << 20
WORD = regex.compile(r"\w+")


@dataclass
class Table:
    """One random walk and the places sampled of it, with the items' entries.

    ``known[n]`` holds the sorted keys of the first n + 1 places, so a window is given up
    at the first place that fits no item.
    """

    bits: np.ndarray
    places: list[int]
    known: list[np.ndarray] = field(default_factory=list)
    entries: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def walk(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows, among those that start at ``at``, which agree with some entry, and their keys."""
        size = np.int64(self.bits.shape[1])
        here, key, alive, level = at, np.zeros(len(at), np.int64), np.arange(len(at)), 0
        for step in range(self.places[-1] + 1):
            word = words[here]
            if step == self.places[level]:
                key = _extended(key, word, size)
                found = self.known[level]
                near = np.minimum(np.searchsorted(found, key), len(found) - 1)
                stays = (found[near] == key) & (word > 0) if len(found) else np.zeros(len(key), bool)
                alive, key, here, word = alive[stays], key[stays], here[stays], word[stays]
                level += 1
            here = here + self.bits[step][word]
        return at[alive], key

    def enter(self, entries: Sequence[tuple[int, int, np.ndarray]]) -> None:
        """Makes these the table's entries: item, place in it, and the words from there on."""
        keys: list[list[int]] = [[] for _ in self.places]
        size = np.int64(self.bits.shape[1])
        self.entries = {}
        for number, begin, row in entries:
            at, key, level, partial = 0, np.zeros(1, np.int64), 0, []
            for step in range(self.places[-1] + 1):
                if at >= len(row):
                    break
                if step == self.places[level]:
                    key = _extended(key, row[at : at + 1], size)
                    partial.append(int(key[0]))
                    level += 1
                at += int(self.bits[step][row[at]])
            if level == len(self.places):
                for n, k in enumerate(partial):
                    keys[n].append(k)
                self.entries.setdefault(partial[-1], []).append((number, begin))
        self.known = [np.unique(np.array(k, np.int64)) for k in keys]


def _extended(key: np.ndarray, word: np.ndarray, size: np.int64) -> np.ndarray:
    """The key with one more word; it wraps for large vocabularies, which only adds candidates."""
    with np.errstate(over="ignore"):
        return key * (size | 1) + word


def _length_class(words: int) -> int:
    """Items are simulated by their length, those of 64 words and more by its power of two."""
    return words if words < 64 else 1 << words.bit_length() - 1


def _joined(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in one row of words, with gaps that no walk crosses, and where each begins and ends."""
    gap = np.zeros(STEPS + 1, np.int32)
    sizes = np.array([len(row) for row in rows])
    begins = np.cumsum(sizes + len(gap)) - sizes - len(gap)
    return np.concatenate([x for row in rows for x in (row, gap)]), begins, begins + sizes


def _places(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each beginning up to its end."""
    return np.concatenate([np.arange(b, e) for b, e in zip(begins.tolist(), ends.tolist())])


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Items:
    """Benchmark items as rows of word numbers, and the tables to find them."""

    def __init__(self, rows: Sequence[tuple[object, str | None]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 1):
        self.ids, self.numbers, self.items, self.short = [], {}, [], {}
        self.similarity = similarity
        for item_id, text in rows:
            words = words_of(text)
            if words:
                row = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int32)
                if not self._edits_of(len(row)):
                    # Too short for any edit: looked up as they are.
                    self.short.setdefault(int(row[0]), []).append((len(self.ids), row))
                self.ids.append(item_id)
                self.items.append(row)
        self.masks = [self._masks(row) for row in self.items]
        self.longest = max(map(len, self.items), default=0)
        self.tables: list[Table] = []
        self.recalls: dict[int, float] = {}
        long = [n for n, row in enumerate(self.items) if len(row) >= LEAST_WORDS]
        if long:
            self._build(long, recall, np.random.default_rng(seed))
        middle = [n for n, row in enumerate(self.items) if len(row) < LEAST_WORDS and self.allowed(n)]
        self.tables += self._seeds(middle)
        self.recalls |= {_length_class(len(self.items[n])): 1.0 for n in middle}

    def _build(self, long: list[int], recall: float, rng: np.random.Generator) -> None:
        """Draws tables until the recall is reached on average, then looks up by seeds the lengths that are below it."""
        classes: dict[int, list[int]] = {}
        for n in long:
            classes.setdefault(_length_class(len(self.items[n])), []).append(n)
        copies = {c: self._copies(members, rng) for c, members in classes.items()}
        missed = {c: np.ones(len(rows), bool) for c, rows in copies.items()}
        drawn: list[Table] = []
        while len(drawn) < MOST_TABLES:
            bits = rng.integers(0, 2, (STEPS, len(self.numbers) + 1), dtype=np.int64)
            table = Table(bits, sorted(rng.choice(STEPS, PLACES, replace=False).tolist()))
            table.enter(self._entries(long))
            drawn.append(table)
            for c, rows in copies.items():
                missed[c][missed[c]] = ~self._found(table, [x for x, m in zip(rows, missed[c]) if m])
            self.recalls = {c: float(1 - m.mean()) for c, m in missed.items()}
            if sum(self.recalls[c] * len(x) for c, x in classes.items()) >= recall * len(long):
                break
        # a class must reach the target by two standard errors of its simulation
        below = {c for c, r in self.recalls.items() if r - 2 * (r * (1 - r) / len(copies[c])) ** 0.5 < recall}
        walked = [n for c, members in classes.items() if c not in below for n in members]
        if walked:
            for table in drawn:
                table.enter(self._entries(walked))
            self.tables += drawn
        self.tables += self._seeds([n for c in below for n in classes[c]])
        self.recalls |= dict.fromkeys(below, 1.0)

    @property
    def recall(self) -> float:
        """The least recall of any length class."""
        return min(self.recalls.values(), default=1.0)

    def _entries(self, members: Sequence[int]) -> list[tuple[int, int, np.ndarray]]:
        """Item, place and words of what the tables enter."""
        return [(n, begin, self.items[n][begin:]) for n in sorted(members) for begin in range(0, len(self.items[n]), STRIDE)]

    def _seeds(self, members: Sequence[int]) -> list[Table]:
        """Tables that find every copy: of an item cut into one part more than it is allowed edits, one part is unchanged.

        A walk that moves at each step and samples every place reads a part as it is.
        """
        parts: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for n in sorted(members):
            row, count = self.items[n], self.allowed(n) + 1
            cuts = [len(row) * k // count for k in range(count + 1)]
            for begin, end in zip(cuts, cuts[1:]):
                parts.setdefault(end - begin, []).append((n, begin, row[begin:end]))
        out = []
        for size, entries in sorted(parts.items()):
            out.append(Table(np.ones((size, len(self.numbers) + 1), np.int64), list(range(size))))
            out[-1].enter(entries)
        return out

    def _copies(self, members: Sequence[int], rng: np.random.Generator) -> list[tuple[int, np.ndarray]]:
        """Simulated copies of items, edited as much as the threshold allows, between other words."""
        mean = sum(len(self.items[n]) for n in members) / len(members)
        count = int(min(COPIES, max(COPIES // 20, COPIES * 200 / mean)))
        return [(n, _edited(self.items[n], self.allowed(n), rng, len(self.numbers))) for n in rng.choice(members, count)]

    def allowed(self, number: int) -> int:
        """Edits that the threshold allows an item."""
        return self._edits_of(len(self.items[number]))

    def _edits_of(self, words: int) -> int:
        return int((1 - self.similarity) * words + 1e-9)

    def _found(self, table: Table, copies: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Whether the table finds each copy, all of them walked in one row of words."""
        found = np.zeros(len(copies), bool)
        if copies:
            joined, begins, ends = _joined([row for _, row in copies])
            at, keys = table.walk(joined, _places(begins, ends))
            for copy, key in zip(np.searchsorted(ends, at, side="right").tolist(), keys.tolist()):
                if not found[copy]:
                    found[copy] = any(copies[copy][0] == n for n, _ in table.entries.get(key, ()))
        return found

    @staticmethod
    def _masks(row: np.ndarray) -> dict[int, int]:
        masks: dict[int, int] = {}
        for n, word in enumerate(row.tolist()):
            masks[word] = masks.get(word, 0) | 1 << n
        return masks

    def edits(self, number: int, window: Sequence[int]) -> int:
        """The least edit distance (in words) of the item to any part of the window.

        One bit a word of the item: the column of the distance table moves up or down by one
        from row to row, and whole columns are computed with a few operations.
        """
        masks, size = self.masks[number], len(self.items[number])
        full, last = (1 << size) - 1, 1 << size - 1
        up, down, score = full, 0, size
        best = size
        for word in window:
            same = masks.get(word, 0)
            level = (((same & up) + up) ^ up) | same | down
            rises, falls = down | ~(level | up) & full, up & level
            if rises & last:
                score += 1
            if falls & last:
                score -= 1
            # the first row is 0 everywhere: a match may begin at any word of the window
            rises, falls = rises << 1 & full, falls << 1 & full
            up, down = falls | ~(level | rises) & full, rises & level
            best = min(best, score)
        return best

    def verified(self, number: int, window: np.ndarray) -> int | None:
        """The edits of an item against a window, None beyond the threshold."""
        allowed, masks, words = self.allowed(number), self.masks[number], window.tolist()
        if sum(w in masks for w in words) < len(self.items[number]) - allowed:
            return None
        edits = self.edits(number, words)
        return edits if edits <= allowed else None

    def rows_of(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """Each text as numbers of the items' words, 0 for other words."""
        rows: list[list[np.ndarray]] = [[] for _ in texts]
        get = self.numbers.get
        for owners, pieces in slabs(texts):
            for owner, piece in zip(owners, pieces):
                words = words_of(piece)
                rows[owner].append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
        for parts in rows:
            yield np.concatenate(parts) if parts else np.empty(0, np.int32)


def _edited(row: np.ndarray, edits: int, rng: np.random.Generator, words: int) -> np.ndarray:
    """A copy with so many words replaced, added or taken away."""
    out = row.tolist()
    for _ in range(edits):
        at, kind, word = int(rng.integers(len(out))), int(rng.integers(3)), int(rng.integers(words + 1))
        if kind == 0:
            out[at] = word
        elif kind == 1:
            out.insert(at, word)
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.int32)


def located(items: Items, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text number, item number, place and edits of every verified window of texts in one row of words.

    Text n stands from ``begins[n]`` up to ``ends[n]``, with gaps behind (see ``_joined``). No window starts in the filler
    between texts, and none is verified beyond the text in which it starts.
    """
    inside = _places(begins, ends)

    def owners(at: np.ndarray) -> list[int]:
        """The texts of places inside texts; an empty text ends before the place."""
        return np.searchsorted(ends, at, side="right").tolist()

    for first in range(0, len(inside), WINDOWS):
        starts = inside[first : first + WINDOWS]
        tried: set[tuple[int, int, int]] = set()
        for table in items.tables:
            at, keys = table.walk(words, starts)
            for begin, key, text in zip(at.tolist(), keys.tolist(), owners(at)):
                for number, offset in table.entries.get(key, ()):
                    allowed = max(items.allowed(number), 1)
                    low = (begin - offset) // allowed * allowed
                    if (text, number, low) not in tried:
                        tried.add((text, number, low))
                        window = words[max(int(begins[text]), low - allowed) : min(int(ends[text]), low + len(items.items[number]) + 2 * allowed)]
                        edits = items.verified(number, window)
                        if edits is not None:
                            yield text, number, begin, edits
        if items.short:
            at = starts[np.isin(words[starts], list(items.short))]
            for begin, text in zip(at.tolist(), owners(at)):
                for number, row in items.short[int(words[begin])]:
                    if np.array_equal(words[begin : begin + len(row)], row):
                        yield text, number, begin, 0


def best_of(items: Items, texts: Sequence[str | None]) -> list[dict[int, int]]:
    """For each text the items that it holds, by number, with their least edits."""
    out: list[dict[int, int]] = [{} for _ in texts]
    rows = list(items.rows_of(texts))
    if rows and items.items:
        joined, begins, ends = _joined(rows)
        for text, number, _, edits in located(items, joined, begins, ends):
            best = out[text]
            best[number] = min(edits, best.get(number, edits))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, similarity: float, recall: float) -> Iterator[Items]:
    """The items in blocks of bounded size, each with its tables; one block for all but large tables."""
    rows = keyed(benchmark, id_col, text_col).where("text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        yield Items(sorted(((r["id"], r["text"]) for r in part), key=lambda r: (str(r[0]), r[1])), similarity, recall)


def leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``id_col, item_col, edits, similarity``: the items that each document holds.

    An item is held if some part of the document's words is within ``1 - similarity`` of its
    words in edits (similarity is 1 - edits / words); items that this allows no edit, at 0.8
    those of fewer than five words, only unchanged. Words are runs of letters, digits and underscores in lower case. A document
    and item give one row, with the least edits seen, for each row of the document. Null,
    empty and wordless texts and items hold nothing and are held by nothing; repeated rows,
    ids and items give a row each; null ids stay null; other columns are not read.
    """
    spark, out = docs.sparkSession, None
    plain = keyed(docs, id_col, text_col)
    kind = benchmark.select(item_col).schema[0].dataType
    for items in item_blocks(benchmark, item_col, item_text_col, similarity, recall):
        shared = spark.sparkContext.broadcast(items)

        def make(shared=shared):
            cell = pa.list_(pa.struct([("number", pa.int32()), ("edits", pa.int32())]))
            return lambda texts: [pa.array([[{"number": n, "edits": e} for n, e in sorted(x.items())] for x in best_of(shared.value, texts)], cell)]

        found = map_texts(plain, "found array<struct<number:int,edits:int>>", make)
        found = found.select("id", F.explode("found").alias("found")).select("id", "found.number", "found.edits")
        names = StructType([StructField("number", IntegerType()), StructField("item", kind), StructField("words", IntegerType())])
        known = spark.createDataFrame([(n, i, len(row)) for n, (i, row) in enumerate(zip(items.ids, items.items))], names)
        part = found.join(F.broadcast(known), "number").select(
            F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", (1 - F.col("edits") / F.col("words")).alias("similarity")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        return plain.limit(0).select(F.col("id").alias(id_col), F.lit(None).cast(kind).alias(item_col), F.lit(0).alias("edits"), F.lit(0.0).alias("similarity"))
    return out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no item (see ``leaks``)."""
    for items in item_blocks(benchmark, item_col, item_text_col, similarity, recall):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        docs = keep_rows(docs, text_col, lambda shared=shared: lambda texts: [not x for x in best_of(shared.value, texts)])
    return docs
