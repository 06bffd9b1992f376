"""Encoded record text: base64 of gzip, zlib or plain JSON lines.

Inflating has no built-in expression, so packed texts go through an Arrow
batch function; plain ones stay in the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What an encoded text starts with.
GZIP_PREFIX = "H"
ZLIB_PREFIX = "eJ"
PLAIN_PREFIX = "ey"


# The batch functions are local to a maker, so they travel to executors with
# the plan and need no installed package there.


def _unpacker():
    @F.pandas_udf(T.StringType())
    def unpack(texts: pd.Series) -> pd.Series:
        import base64
        import zlib

        def one(text):
            if text is None:
                return None
            try:
                # 32 lets zlib recognise either header.
                return zlib.decompress(base64.b64decode(text), zlib.MAX_WBITS | 32).decode("utf-8", "replace")
            except (ValueError, zlib.error):
                return None

        return texts.map(one)

    return unpack


def _packer(window: int, level: int):
    @F.pandas_udf(T.StringType())
    def pack(texts: pd.Series) -> pd.Series:
        import base64
        import zlib

        def one(text):
            if text is None:
                return None
            packer = zlib.compressobj(level, zlib.DEFLATED, window)
            return base64.b64encode(packer.compress(text.encode()) + packer.flush()).decode()

        return texts.map(one)

    return pack


# Non-deterministic only for the optimizer: a filter on the result must not
# move below it and unpack every record a second time.
unpack = _unpacker().asNondeterministic()
pack_zlib = _packer(15, 6)
pack_zlib_best = _packer(15, 9)
pack_gzip = _packer(31, 6)


def pack_plain(text: Column) -> Column:
    """Unwrapped base64 (the built-in breaks lines at 76 characters)."""
    return F.regexp_replace(F.base64(F.encode(text, "utf-8")), r"\s", "")


def is_packed(data: Column) -> Column:
    return data.startswith(GZIP_PREFIX) | data.startswith(ZLIB_PREFIX)


def is_plain(data: Column) -> Column:
    return data.startswith(PLAIN_PREFIX)


def decoded(data: Column, raw: bool = False) -> Column:
    """Text of an encoded record; other texts are null, or themselves when ``raw``."""
    other = data if raw else F.lit(None).cast("string")
    # The batch function sees null for texts it has nothing to do with.
    packed = unpack(F.when(is_packed(data), data))
    plain = F.decode(F.try_to_binary(data, F.lit("base64")), "utf-8")
    return F.when(is_packed(data), packed).when(is_plain(data), plain).otherwise(other)
