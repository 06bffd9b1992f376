"""BPE encoding and decoding as streaming machines.

Encoding is a transducer with bounded lookahead: the merge list's sufficient
lookahead (``Merges.lookahead``) bounds the bytes whose tokens may still change,
and the transducer emits tokens as soon as they are stable, so a text needs
constant memory beside itself. Decoding joins the tokens' bytes and reads them
with an incremental byte-to-text machine that holds at most three bytes of an
unfinished character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventframe.llm.bpe_machine import SLICE_CHARS, Encoder, slices
from eventframe.llm.texts import keyed, map_texts


class TextDecoder:
    """UTF-8 bytes to text, piece by piece; broken sequences become U+FFFD."""

    def __init__(self):
        self.tail = b""

    def feed(self, data: bytes) -> str:
        """The text that is sure, whatever comes next."""
        data = self.tail + data
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte >= 0xC0:
                width = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if width > back and self._may_go_on(data[-back:]):
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        """What an unfinished character gives at the end."""
        tail, self.tail = self.tail, b""
        return tail.decode("utf-8", "replace")

    @staticmethod
    def _may_go_on(head: bytes) -> bool:
        """Whether some character begins with these bytes."""
        lead = head[0]
        if not 0xC2 <= lead <= 0xF4:
            return False
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
        return len(head) < 2 or low <= head[1] <= high


def encoded(encoder: Encoder, texts: Sequence[str]) -> Iterator[Iterable[np.ndarray]]:
    """For each text its tokens, as arrays in a row; one for all but very long texts."""
    for begin, end in slices(texts):
        if end - begin == 1 and len(texts[begin]) > 2 * SLICE_CHARS:
            yield encoder.tokens(texts[begin])
        else:
            tokens, counts = encoder.encode(texts[begin:end])
            for row in np.split(tokens, np.cumsum(counts)[:-1]):
                yield (row,)


def decoded(encoder: Encoder, arrays: Iterable[Sequence[int]]) -> Iterator[str]:
    """The text of token arrays, piece by piece."""
    machine, of = TextDecoder(), encoder.merges.bytes
    for tokens in arrays:
        yield machine.feed(b"".join(map(of.__getitem__, tokens)))
    yield machine.finish()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: the tokens of each row; no tokens for null and the empty text.

    Repeated rows and ids give a row each, a null id stays null, other columns are not read.
    """

    def make():
        encoder = Encoder.of(path)

        def of(texts):
            rows = [np.concatenate(list(x)) for x in encoded(encoder, [t or "" for t in texts])]
            return [pa.array(rows, pa.list_(pa.int32()))]

        return of

    return map_texts(keyed(docs, id_col, text_col), "ids array<int>", make).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` of each row's tokens; null tokens give a null text, unknown ones an error."""

    def make():
        encoder = Encoder.of(path)
        return lambda ids: [pa.array([None if x is None else "".join(decoded(encoder, [x])) for x in ids], pa.string())]

    narrow = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("text"))
    return map_texts(narrow, "text string", make).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: each text encoded and decoded again.

    The hashes are of the decimal ids joined by commas and of the decoded text in UTF-8.
    Null counts as the empty text. Repeated rows and ids give a row each, a null id stays null.
    """

    def make():
        encoder = Encoder.of(path)
        decimal = [str(n) for n in range(encoder.merges.size)]

        def of(texts):
            counts, ids, backs = [], [], []
            for arrays in encoded(encoder, [t or "" for t in texts]):
                count, comma, machine = 0, "", TextDecoder()
                id_hash, text_hash = hashlib.sha256(), hashlib.sha256()
                for tokens in arrays:
                    row = tokens.tolist()
                    if row:
                        id_hash.update((comma + ",".join(map(decimal.__getitem__, row))).encode())
                        comma = ","
                    count += len(row)
                    piece = machine.feed(b"".join(map(encoder.merges.bytes.__getitem__, row)))
                    text_hash.update(piece.encode())
                text_hash.update(machine.finish().encode())
                counts.append(count)
                ids.append(id_hash.hexdigest())
                backs.append(text_hash.hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids), pa.array(backs)]

        return of

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_texts(keyed(docs, id_col, text_col), added, make).withColumnRenamed("id", id_col)
