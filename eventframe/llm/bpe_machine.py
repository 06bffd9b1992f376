"""Byte-level BPE compiled to finite-state machines.

Two machines, both run over numpy arrays:

* ``Splitter``: the pre-tokenizer pattern as a deterministic automaton over
  character classes. Its transitions mark token starts. Texts are cut into
  chunks of equal length, every chunk gets its state map (entry state to exit
  state), the maps compose in a parallel prefix scan, and a last pass with the
  then known entry states writes the marks.
* ``Transducer``: the merge list as a deterministic transducer over bytes whose
  transitions emit tokens. Its states are determinised when first met. Beyond a
  bound those that several slices of text have met are kept and the others
  dropped, so memory does not grow with the text.

The transducer rests on two properties of a merge list in which a rule comes
after the rules that make its two parts (checked when it is compiled):

* A row of tokens is the encoding of its bytes if every two neighbours are the
  encoding of theirs, so only neighbours have to be compared.
* All encodings of the prefixes of a word form a tree. Tokens up to the last
  common ancestor of the starts at which a token may still begin are stable, no
  text behind them changes them, and they are emitted at once. What is not yet
  stable lies within ``Merges.lookahead`` bytes, a figure of the merge list.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import regex
from tokenizers import Tokenizer

# Fixed value: the pre-tokenizer's pattern, as the public byte-level BPE defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SLICE_CHARS = 1 << 19
STATE_BOUND = 250_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself where
    it is printable, else the next free letter from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Merges:
    """The merge list: bytes, parts and ranks of each token, and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is not a byte-level BPE")
        if spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path} changes texts before they are split, or skips merges")
        letters = byte_letters()
        names = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*names.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for name, token in names.items():
            if name not in self.special:
                self.bytes[token] = bytes(letters[c] for c in name)
        for name, token in self.special.items():
            self.bytes[token] = name.encode()
        self.single = {self.bytes[names[c]][0]: names[c] for c in letters if c in names}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        made = {token: -1 for token in self.single.values()}
        for rank, rule in enumerate(spec["model"]["merges"]):
            left, right = rule if isinstance(rule, list) else rule.split(" ")
            a, b, whole = names[left], names[right], names[left + right]
            if a not in made or b not in made or whole in made:
                raise ValueError(f"rule {rank} comes before its parts or makes a token twice")
            self.rank[a, b] = rank
            self.parts[whole] = (a, b)
            made[whole] = rank
        self.made = made
        # (token, rank of the rule that joins it to a larger part) down the right and left edge
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._fits: dict[int, bool] = {}
        self.whole = [t for t in made if t not in self.parts or not self._crossed(*self.parts[t], top=False)]
        self.lookahead = self._lookahead()
        self._right.clear()
        self._left.clear()

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        memo = self._left if side == 0 else self._right
        if token not in memo:
            edge, joined, at = [], float("inf"), token
            while True:
                edge.append((at, joined))
                if at not in self.parts:
                    break
                joined = self.made[at]
                at = self.parts[at][side]
            memo[token] = edge
        return memo[token]

    def _crossed(self, a: int, b: int, top: bool = True) -> bool:
        """Whether a rule joins the end of ``a`` to the start of ``b`` while both are built.

        Rules apply in order of rank, equal ranks from the left, so a rule across the
        border applies if it comes before the rule that takes its left part away and not
        after the one that takes its right part away.
        """
        for x, x_taken in self._edge(a, 1):
            for y, y_taken in self._edge(b, 0):
                rank = self.rank.get((x, y))
                if rank is not None and rank < x_taken and rank <= y_taken and (top or (x, y) != (a, b)):
                    return True
        return False

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a, b`` is the encoding of their bytes."""
        key = a * self.size + b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            if len(self._right) + len(self._left) > 50_000:
                self._right.clear()
                self._left.clear()
            known = self._fits[key] = not self._crossed(a, b)
        return known

    def _lookahead(self) -> int:
        """Bytes behind which a token no longer changes, whatever follows.

        More text moves a token border only by a chain of rules of growing rank, in which
        the token that one rule takes stands at the left edge of the next rule's right part.
        The longest such chain bounds how far left a change reaches.
        """
        reach: dict[int, int] = {}
        furthest = 0
        for (a, b), _ in sorted(self.rank.items(), key=lambda rule: -rule[1]):
            moved = len(self.bytes[a]) + reach.get(a, 0)
            furthest = max(furthest, moved)
            for token, _ in self._edge(b, 0):
                if reach.get(token, 0) < moved:
                    reach[token] = moved
        return furthest + max(len(self.bytes[t]) for t in self.made)


class Transducer:
    """The merge list as a deterministic byte transducer.

    A state holds, for each start at which a token may still begin, its place among the
    prefixes of tokens and the tokens from the last stable one up to it. A transition
    reads a byte, emits the tokens that became stable and leads on; a final state emits
    the rest. ``emitted`` and ``last`` annotate transitions and states with token counts.
    """

    START = 0

    def __init__(self, merges: Merges, bound: int = STATE_BOUND):
        self.merges, self.bound = merges, bound
        self.child: dict[int, int] = {}
        token_at, inner = [-1], [True]
        for token in merges.whole:
            node = 0
            for byte in merges.bytes[token]:
                key = node << 8 | byte
                inner[node] = True
                node = self.child.setdefault(key, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
                    inner.append(False)
            token_at[node] = token
        self.token_at, self.inner = token_at, inner
        self.drops = 0
        self._begin()

    def _begin(self) -> None:
        self.states: dict[bytes, int] = {}
        self.configs: list[bytes] = []
        self.out_ids: dict[tuple[int, ...], int] = {(): 0}
        self.out_list: list[tuple[int, ...]] = [()]
        self.rest = np.zeros(1024, np.int32)
        # whether the slice at hand has met a state, and how many slices have
        self.met = np.zeros(1024, bool)
        self.visits = np.zeros(1024, np.int32)
        self.cells = Cells()
        self._counts, self.flat = np.empty(0, np.int64), np.empty(0, np.int32)
        self._state(-1, ((0, ()),))

    def _out(self, tokens: tuple[int, ...]) -> int:
        known = self.out_ids.get(tokens)
        if known is None:
            known = self.out_ids[tokens] = len(self.out_ids)
            self.out_list.append(tokens)
        return known

    def _state(self, before: int, starts: Sequence[tuple[int, tuple[int, ...]]]) -> int:
        packed = [before]
        for node, tokens in starts:
            packed += (node, len(tokens), *tokens)
        config = array("i", packed).tobytes()
        known = self.states.get(config)
        if known is None:
            known = self.states[config] = len(self.configs)
            self.configs.append(config)
            if known == len(self.rest):
                self.rest, self.met, self.visits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rest, self.met, self.visits))
            self.rest[known] = self._out(starts[-1][1])
        return known

    def _starts(self, state: int) -> tuple[int, list[tuple[int, tuple[int, ...]]]]:
        packed = array("i", self.configs[state]).tolist()
        starts, at, size = [], 1, len(packed)
        while at < size:
            end = at + 2 + packed[at + 1]
            starts.append((packed[at], tuple(packed[at + 2 : end])))
            at = end
        return packed[0], starts

    def _compile(self, state: int, byte: int) -> None:
        """Add the transition of ``state`` on ``byte``."""
        before, starts = self._starts(state)
        fits, child, token_at, inner = self.merges.fits, self.child, self.token_at, self.inner
        kept, path = [], None
        for node, tokens in starts:
            at = child.get(node << 8 | byte)
            if at is None:
                continue
            token = token_at[at]
            if path is None and token >= 0:
                last = tokens[-1] if tokens else before
                if last < 0 or fits(last, token):
                    path = (*tokens, token)
            if inner[at]:
                kept.append((at, tokens))
        kept.append((0, path))
        common = min(len(tokens) for _, tokens in kept)
        for _, tokens in kept:
            k = 0
            while k < common and tokens[k] == path[k]:
                k += 1
            common = k
        stable = path[:common]
        rest = [(node, tokens[common:]) for node, tokens in kept]
        # the token before the first unstable one matters only where a start follows it directly
        before = -1 if all(tokens for _, tokens in rest) else stable[-1] if stable else before
        self.cells.add(state << 8 | byte, self._state(before, rest), self._out(stable))

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """One transition: the target and the tokens emitted."""
        key = state << 8 | byte
        found = self.cells.get(key)
        if found is None:
            self._compile(state, byte)
            found = self.cells.get(key)
        return found[0], self.out_list[found[1]]

    def rest_of(self, state: int) -> tuple[int, ...]:
        """What a word that ends here still emits."""
        return self.out_list[self.rest[state]]

    def fresh(self, state: int) -> int:
        """The same state, after the rare ones have been dropped if the tables are over the bound."""
        if len(self.configs) <= self.bound:
            return state
        config = self._starts(state)
        self._drop()
        return self._state(*config)

    def _drop(self) -> None:
        """Keep the states that at least two slices have met, at most three quarters of the bound, and what lies between them."""
        self.drops += 1
        many = len(self.configs)
        visits, configs, outs, cells, rest = self.visits[:many], self.configs, self.out_list, self.cells, self.rest[:many]
        order = np.argsort(-visits, kind="stable")[: self.bound * 3 // 4]
        keep = np.zeros(many, bool)
        keep[order[visits[order] > 1]] = True
        keep[self.START] = True
        kept = np.flatnonzero(keep)
        number = np.cumsum(keep) - 1
        used = np.flatnonzero(cells.keys >= 0)
        used = used[keep[cells.keys[used] >> 8] & keep[cells.target[used]]]
        keys, target, out = cells.keys[used], cells.target[used], cells.out[used]
        told = np.unique(np.concatenate([[0], out, rest[kept]]))
        self._begin()
        self.configs = [configs[n] for n in kept.tolist()]
        self.states = {config: n for n, config in enumerate(self.configs)}
        self.out_list = [outs[n] for n in told.tolist()]
        self.out_ids = {tokens: n for n, tokens in enumerate(self.out_list)}
        size = max(1024, 2 * len(kept))
        self.rest, self.met, self.visits = np.zeros(size, np.int32), np.zeros(size, bool), np.zeros(size, np.int32)
        self.rest[: len(kept)] = np.searchsorted(told, rest[kept])
        self.visits[: len(kept)] = visits[kept] // 2  # what is no longer met goes in time
        self.cells.fill(number[keys >> 8] << 8 | keys & 255, number[target], np.searchsorted(told, out))

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of all outputs, and where each one's tokens begin in ``flat``."""
        new = self.out_list[len(self._counts) :]
        if new:
            self._counts = np.concatenate([self._counts, np.array([len(x) for x in new], np.int64)])
            self._begins = np.cumsum(self._counts) - self._counts
            self.flat = np.concatenate([self.flat, np.array([t for x in new for t in x], np.int32)])
        return self._counts, self._begins

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Output numbers of all words: one a byte, then the final one, word after word.

        All words are read in step, byte by byte, the longer ones longer; transitions that
        are met for the first time are compiled between two steps.
        """
        if len(self.configs) > self.bound:
            self._drop()
        longest = int(lengths.max())
        order = np.argsort((longest - lengths).astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")
        at, left = starts[order], lengths[order]
        places = np.cumsum(lengths + 1) - (lengths + 1)
        to = places[order]
        written = np.zeros(int(lengths.sum()) + len(lengths), np.int32)
        state = np.zeros(len(order), np.int64)
        # how many words are longer than j bytes, for each j
        alive = np.searchsorted(-left, -np.arange(longest), side="left")
        for j in range(longest):
            k = int(alive[j])
            if k < 4 and longest - j > 64:
                self._alone(data, at[:k], left[:k], to[:k], state[:k], written, j)
                break
            key = state[:k] << 8 | data[at[:k] + j]
            cell = self.cells.find(key)
            while (new := np.flatnonzero(cell < 0)).size:
                for c in np.unique(key[new]).tolist():
                    self._compile(c >> 8, c & 255)
                cell = self.cells.find(key)  # all, as the table may have grown
            written[to[:k] + j] = self.cells.out[cell]
            state[:k] = self.cells.target[cell]
            self.met[state[:k]] = True
        self.visits += self.met
        self.met[:] = False
        written[to + left] = self.rest[state]
        return written

    def _alone(self, data, at, left, to, state, written, j) -> None:
        """The rest of the few longest words, one after the other."""
        for n in range(len(at)):
            here = int(state[n])
            for i, byte in enumerate(data[at[n] + j : at[n] + left[n]].tolist(), j):
                move = self.cells.get(here << 8 | byte)
                if move is None:
                    self._compile(here, byte)
                    move = self.cells.get(here << 8 | byte)
                here, written[to[n] + i] = move
            state[n] = here


class Cells:
    """The transitions met so far: key (state and byte) to target and output, in open addressing."""

    def __init__(self, bits: int = 16):
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.target = np.zeros(1 << bits, np.int32)
        self.out = np.zeros(1 << bits, np.int32)

    def _home(self, key):
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def add(self, key: int, target: int, out: int) -> None:
        if 2 * self.count >= len(self.keys):
            used = np.flatnonzero(self.keys >= 0)
            self.fill(self.keys[used], self.target[used], self.out[used])
        at, last = self._home(key), len(self.keys) - 1
        while self.keys[at] >= 0:
            at = at + 1 & last
        self.keys[at], self.target[at], self.out[at] = key, target, out
        self.count += 1

    def fill(self, keys: np.ndarray, target: np.ndarray, out: np.ndarray) -> None:
        """Hold these different transitions only, at most a quarter full."""
        self._make(max(16, int(4 * len(keys)).bit_length()))
        self.count = len(keys)
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while left.size:
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several at one place one stays
            won = free[self.keys[at[free]] == keys[free]]
            self.target[at[won]], self.out[at[won]] = target[won], out[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = at[left] + 1 & len(self.keys) - 1

    def get(self, key: int) -> tuple[int, int] | None:
        """Target and output of one transition."""
        at, last = self._home(key), len(self.keys) - 1
        while (found := self.keys[at]) != key:
            if found < 0:
                return None
            at = at + 1 & last
        return int(self.target[at]), int(self.out[at])

    def find(self, key: np.ndarray) -> np.ndarray:
        """Where each key lies, -1 if it has not been met."""
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
        found = self.keys[at]
        bad = np.flatnonzero(found != key)
        while bad.size:
            missing = found[bad] < 0
            at[bad[missing]] = -1
            bad = bad[~missing]
            at[bad] = at[bad] + 1 & len(self.keys) - 1
            found[bad] = self.keys[at[bad]]
            bad = bad[found[bad] != key[bad]]
        return at


# Character classes of the splitter. Fixed order: the letters that end a contraction, the rest.
ENDS, R, V, L, E, LETTER, NUMBER, QUOTE, OTHER, SPACE, WHITE, END = range(12)
CLASSES = 12


def character_classes(path: str) -> np.ndarray:
    """The class of every code point.

    Characters that Python's own tables do not know yet are looked up in the library's
    pre-tokenizer, whose Unicode version is another than that of ``regex``.
    """
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, number in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for run in regex.finditer(pattern, every):
            points = np.frombuffer(run[0].encode("utf-32-le"), np.uint32)
            table[points] = number
    recent = [c for c in np.flatnonzero(table != OTHER).tolist() if unicodedata.category(chr(c)) == "Cn"]
    table[recent] = OTHER
    split = Tokenizer.from_file(path).pre_tokenizer
    for letter, number in (("a", LETTER), ("1", NUMBER)):
        found = split.pre_tokenize_str("\n".join(f"{letter}{chr(c)}{letter}" for c in recent))
        cuts = {begin for _, (begin, _) in found}
        for n, c in enumerate(recent):
            if 4 * n + 1 not in cuts and 4 * n + 2 not in cuts:
                table[c] = number
    for letters, number in (("stmd", ENDS), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", SPACE)):
        for letter in letters:
            table[ord(letter)] = number
    return table


class Splitter:
    """The pre-tokenizer as an automaton whose transitions mark token starts.

    States: the text's start, runs of letters, numbers and other characters, a quote
    that may begin a contraction, the quote with a first letter of a longer one, a
    contraction that is complete, and white space by length (one, more) and last
    character (a space joins the next run). Mark 1: a token starts at the character
    read; mark 2: one starts at the character before it.
    """

    START, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, DONE, SPACE1, WHITE1, SPACE2, WHITE2 = range(13)
    STATES = 13
    CHUNK = 256
    TAIL = 16

    def __init__(self, path: str):
        self.classes = character_classes(path)
        self.step = np.zeros((self.STATES, CLASSES), np.uint8)
        self.mark = np.zeros((self.STATES, CLASSES), np.uint8)
        for state in range(self.STATES):
            for kind in range(CLASSES):
                self.step[state, kind], self.mark[state, kind] = self._move(state, kind)

    def _first(self, kind: int, joined: bool = False) -> int:
        if kind <= LETTER:
            return self.LETTERS
        if kind == QUOTE:
            return self.OTHERS if joined else self.QUOTED
        return {NUMBER: self.NUMBERS, OTHER: self.OTHERS, SPACE: self.SPACE1, WHITE: self.WHITE1, END: self.START}[kind]

    def _move(self, state: int, kind: int) -> tuple[int, int]:
        white = kind in (SPACE, WHITE)
        if state in (self.QUOTED_R, self.QUOTED_V, self.QUOTED_L):
            if kind == (L if state == self.QUOTED_L else E):
                return self.DONE, 0
            step, mark = self._move(self.LETTERS, kind)
            return step, mark | 2
        if kind == END:
            return self.START, 1
        if state in (self.SPACE1, self.WHITE1, self.SPACE2, self.WHITE2):
            if white:
                return (self.SPACE2 if kind == SPACE else self.WHITE2), 0
            before = 2 if state in (self.SPACE2, self.WHITE2) else 0
            if state in (self.SPACE1, self.SPACE2):
                return self._first(kind, joined=True), before
            return self._first(kind), before | 1
        if state == self.QUOTED:
            if kind in (ENDS, R, V, L):
                return {ENDS: self.DONE, R: self.QUOTED_R, V: self.QUOTED_V, L: self.QUOTED_L}[kind], 0
            if kind in (QUOTE, OTHER):
                return self.OTHERS, 0
        same = {self.LETTERS: kind <= LETTER, self.NUMBERS: kind == NUMBER, self.OTHERS: kind in (QUOTE, OTHER)}
        if same.get(state):
            return state, 0
        return self._first(kind), 1

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Where tokens start among code points; ``END`` class points end a text.

        ``points`` holds classes, one a character.
        """
        n, width = len(points), self.CHUNK
        count = -(-n // width)
        padded = np.full(count * width, END, np.uint8)
        padded[:n] = points
        # one row a step, one column a chunk
        kinds = np.ascontiguousarray(padded.reshape(count, width).T)
        step, mark = self.step.ravel(), self.mark.ravel()
        entry = self._entries(kinds)
        marks = np.empty((width, count), np.uint8)
        state = entry
        for j in range(width):
            cell = state * np.uint8(CLASSES) + kinds[j]
            marks[j] = mark[cell]
            state = step[cell]
        marks = marks.T.ravel()
        begins = (marks[:n] & 1).astype(bool)
        begins[:-1] |= (marks[1:n] & 2).astype(bool)
        return begins

    def _maps(self, kinds: np.ndarray) -> np.ndarray:
        """The state map of every column: one row for each entry state."""
        step = self.step.ravel()
        maps = np.repeat(np.arange(self.STATES, dtype=np.uint8)[:, None], kinds.shape[1], axis=1)
        for row in kinds:
            maps = step[maps * np.uint8(CLASSES) + row]
        return maps

    def _entries(self, kinds: np.ndarray) -> np.ndarray:
        """The entry state of every chunk, from a parallel prefix scan over their state maps."""
        width, count = kinds.shape
        # a chunk whose last characters lead all states to one has a constant map whatever comes before
        maps = self._maps(kinds[width - self.TAIL :])
        if not (maps == maps[0]).all():
            maps = self._maps(kinds)
        reach = 1
        while reach < count:  # maps[:, i] leads from the entry of chunk i - reach + 1 to the exit of i
            maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].astype(np.intp), axis=0)
            reach *= 2
        entry = np.zeros(count, np.uint8)
        entry[1:] = maps[self.START, :-1]
        return entry


class Encoder:
    """Splitter and transducer together, over batches of texts."""

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.splitter = Splitter(path)
        self.machine = Transducer(self.merges)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of a vocabulary file, compiled once in each worker."""
        key = os.path.realpath(path)
        if key not in cls._known:
            cls._known[key] = cls(path)
        return cls._known[key]

    def _pieces(self, texts: Sequence[str]) -> tuple[list[str], list[int], list[int]]:
        """Texts cut at special strings: pieces, the text of each, the special token behind it."""
        pieces, owner, behind = [], [], []
        for n, text in enumerate(texts):
            at = 0
            if self.special is not None:
                for found in self.special.finditer(text) if any(s in text for s in self.merges.special) else ():
                    pieces.append(text[at : found.start()])
                    owner.append(n)
                    behind.append(self.merges.special[found[0]])
                    at = found.end()
            pieces.append(text[at:] if at else text)
            owner.append(n)
            behind.append(-1)
        return pieces, owner, behind

    def words(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of the pieces in a row, start and length of each word in them, and its piece."""
        sizes = np.array([len(p) + 1 for p in pieces])
        ends = np.cumsum(sizes) - 1
        joined = "\n".join(pieces) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.splitter.classes[points]
        kinds[ends] = END
        begins = self.splitter.starts(kinds)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) == len(points):
            at = np.flatnonzero(begins)
        else:
            # a character starts at every byte that does not continue one
            at = np.flatnonzero((data & 0xC0) != 0x80)[begins]
        lengths = np.diff(at, append=len(data))
        is_end = np.zeros(len(points), bool)
        is_end[ends] = True
        real = ~is_end[begins]
        piece = np.cumsum(is_end[begins]) - is_end[begins]
        return data, at[real], lengths[real], piece[real]

    def stream(self, text: str) -> Iterator[list[int]]:
        """The tokens of one text as soon as they are stable, in constant memory.

        A character waits for the next one, which may start a word before it; a byte's
        tokens wait at most for the merge list's lookahead.
        """
        step, mark = self.splitter.step.tolist(), self.splitter.mark.tolist()
        machine, flat = self.machine, []
        at = 0
        for found in [*(self.special.finditer(text) if self.special else ()), None]:
            end = found.start() if found else len(text)
            state, here, waiting = self.splitter.START, machine.START, b""
            for n in range(at, end + 1):
                kind = END if n == end else int(self.splitter.classes[ord(text[n])])
                marks = mark[state][kind]
                state = step[state][kind]
                if marks & 2:
                    flat += machine.rest_of(here)
                    here = machine.START
                for byte in waiting:
                    here, tokens = machine.move(here, byte)
                    flat += tokens
                if marks & 1:
                    flat += machine.rest_of(here)
                    here = machine.START
                waiting = text[n].encode("utf-8", "surrogatepass") if n < end else b""
                if len(flat) > 1 << 14:
                    yield flat
                    flat = []
                    here = machine.fresh(here)
            if found:
                flat.append(self.merges.special[found[0]])
                at = found.end()
        yield flat

    def tokens(self, text: str) -> Iterator[np.ndarray]:
        """The tokens of one long text, part after part."""
        for part in parts(text):
            if len(part) > 2 * SLICE_CHARS:
                for tokens in self.stream(part):
                    yield np.array(tokens, np.int32)
            else:
                yield self.encode([part])[0]

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        """Tokens of each text, from the counts on the transitions alone."""
        pieces, owner, behind = self._pieces(texts)
        data, starts, lengths, piece = self.words(pieces)
        total = np.bincount(owner, np.array(behind) >= 0, minlength=len(texts)).astype(np.int64)
        if len(starts):
            written = self.machine.run(data, starts, lengths)
            emitted = self.machine.outputs()[0][written]
            places = np.cumsum(lengths + 1) - (lengths + 1)
            words = np.add.reduceat(emitted, places)
            total += np.bincount(np.array(owner)[piece], words, minlength=len(texts)).astype(np.int64)
        return total

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens in a row, and the number of each text."""
        pieces, owner, behind = self._pieces(texts)
        data, starts, lengths, piece = self.words(pieces)
        owner, behind = np.array(owner), np.array(behind)
        per_piece = np.zeros(len(pieces), np.int64)
        tokens = np.empty(0, np.int32)
        if len(starts):
            written = self.machine.run(data, starts, lengths)
            counts, begins = self.machine.outputs()
            emitted = counts[written]
            places = np.cumsum(lengths + 1) - (lengths + 1)
            per_piece = np.bincount(piece, np.add.reduceat(emitted, places), minlength=len(pieces)).astype(np.int64)
            busy = np.flatnonzero(emitted)
            first, many = begins[written[busy]], emitted[busy]
            ends = np.cumsum(many)
            offset = np.arange(int(ends[-1])) - np.repeat(ends - many, many)
            tokens = self.machine.flat[np.repeat(first, many) + offset]
        marked = behind >= 0
        if marked.any():
            at = np.cumsum(per_piece)[marked]
            tokens = np.insert(tokens, at, behind[marked])
            per_piece = per_piece + marked
        return tokens, np.bincount(owner, per_piece, minlength=len(texts)).astype(np.int64)


# A letter or digit before white space: a word border whatever stands before or behind it,
# and never inside a special string.
BORDER = regex.compile(r"[A-Za-z0-9](?=[ \t\n\r])")


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters together; a longer text is alone."""
    begin = total = 0
    for n, text in enumerate(texts):
        if total and total + len(text) > chars:
            yield begin, n
            begin, total = n, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def parts(text: str, chars: int = SLICE_CHARS) -> Iterator[str]:
    """A long text cut at sure word borders; a part is longer only where none comes."""
    at = 0
    while len(text) - at > chars:
        found = BORDER.search(text, at + chars)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]
