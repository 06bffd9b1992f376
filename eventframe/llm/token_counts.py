"""Token counts from a compiled tokenizer.

The pre-tokenizer and the merge list become deterministic machines
(``bpe_machine``): the splitter's chunk state maps compose in a parallel prefix
scan, the transducer's transitions carry the number of tokens they emit, and a
text's count is the sum over its transitions and the final states of its words.
No token is ever written down.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventframe.llm.bpe_machine import SLICE_CHARS, Encoder, slices
from eventframe.llm.texts import keyed, map_texts


def counts_of(encoder: Encoder, texts: list[str]) -> list[int]:
    """The token count of each text; memory is bounded by a slice, not by a batch or a text."""
    out: list[int] = []
    for begin, end in slices(texts):
        if end - begin == 1 and len(texts[begin]) > 2 * SLICE_CHARS:
            out.append(sum(len(tokens) for tokens in encoder.tokens(texts[begin])))
        else:
            out += encoder.counts(texts[begin:end]).tolist()
    return out


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of each row.

    Null counts as the empty text: no bytes, no tokens. Repeated rows and ids give a row
    each, a null id stays null, other columns are not read. An empty table gives no rows.
    """

    def make():
        encoder = Encoder.of(path)
        return lambda texts: [pa.array(counts_of(encoder, [t or "" for t in texts]), pa.int64()),
                              pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())]

    counted = map_texts(keyed(docs, id_col, text_col), "n_tokens bigint, n_bytes bigint", make)
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
