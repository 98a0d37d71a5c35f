"""Token counts of documents under a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding of a rank file, loaded once in a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """The columns of ``documents`` other than the text, and ``tokens``; null and empty texts have 0.

    The whole text is encoded. Special-token strings in a text are ordinary text.
    """
    keep = [c for c in documents.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema) + ", tokens bigint"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            out = pdf[keep].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield out

    return documents.select(*keep, F.col(text)).mapInPandas(count, schema)


def source_key(source: Column) -> Column:
    """One spelling of a source name: lower case, words joined by underscores; blank is null."""
    s = F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s\h_-]+", " "))), " ", "_")
    return F.when(s != "", s)
