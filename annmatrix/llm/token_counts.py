"""Token counts by compiled finite-state transducers (see bpe.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_arrow, text_of, tokenizer_path


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_tokens and over_limit (more than limit tokens) of each whole text.

    tokenizer: a file's name among the public tokenizers, or its path, which
    every executor must be able to open.  Rows are neither moved nor joined:
    repeated rows give repeated results, a null text counts as empty (0 tokens),
    an empty table gives an empty one, further columns are not read.  A text is
    taken in blocks cut where a word is sure to start, so a task holds one text
    and a block's arrays, whatever the text's length.
    """
    name = tokenizer

    def make():
        path = name if "/" in name else tokenizer_path(name)
        t = bpe.load(path)

        def each(cols):
            texts = cols["text"].to_pylist()
            counts, _ = t.encode(texts, False)
            return {"doc_id": cols["doc_id"], "n_bytes": [len(x.encode()) for x in texts], "n_tokens": counts, "over_limit": counts > limit}

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_arrow(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
