"""Words of whole texts as bytes: one table per byte, then a split at white space.

UTF-8 keeps ASCII bytes apart from the bytes of other characters, so classes of ASCII
characters can be told byte by byte and no text has to be decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

# No UTF-8 text holds this byte; it stands for the end of a piece.
BREAK = b"\xff"
SLAB_BYTES = 1 << 22

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _table(blank: bytes, ends: bytes = b"") -> bytes:
    return bytes(32 if b in blank else BREAK[0] if b in ends else _LOWER[b] for b in range(256))


# Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
ALPHANUMERIC = _table(bytes(b for b in range(128) if not chr(b).isalnum()))
# Words are what stands between spaces and tabs; these marks and line ends end a piece.
PIECES = _table(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")

_EDGE = re.compile(rb"[\x20\xff]")


def binaries(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of a column as UTF-8, one at a time."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def token_slabs(text: bytes | None, table: bytes, size: int = SLAB_BYTES) -> Iterator[list[bytes]]:
    """The lower-case words of a text, and ``BREAK`` where a piece ends, in lists of about ``size`` bytes.

    A text is cut between words only, so one word is never in two lists. Null counts as empty.
    """
    whole = (text or b"").translate(table)
    at = 0
    while at < len(whole):
        found = _EDGE.search(whole, at + size) if len(whole) - at > size else None
        end = found.start() if found else len(whole)
        yield whole[at:end].replace(BREAK, b" \xff ").split()
        at = end


class Numbers(dict):
    """Numbers words from 0 as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number
