"""Name and text functions for SQL."""

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators.matching import part_similarity, score


def register(spark: SparkSession) -> list[str]:
    """Register Arrow-batched functions: name_norm, name_tokens, entity_tokens, part_similarity, name_score, name_reason."""
    from sievework.session import ship

    ship(spark)

    def norm(s: pd.Series) -> pd.Series:
        return s.map(text.norm_text)

    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda x: list(text.tokens_text(x)))

    def entity(s: pd.Series) -> pd.Series:
        return s.map(lambda x: list(text.entity_tokens_text(x)))

    def parts(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([part_similarity(x, y) if x and y else 0.0 for x, y in zip(a, b)])

    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(text.tokens_text(x), text.tokens_text(y))[0] for x, y in zip(a, b)])

    def reason(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(text.tokens_text(x), text.tokens_text(y))[1] for x, y in zip(a, b)])

    made = {"name_norm": (norm, "string"), "name_tokens": (tokens, "array<string>"), "entity_tokens": (entity, "array<string>"), "part_similarity": (parts, "double"), "name_score": (scored, "double"), "name_reason": (reason, "string")}
    for name, (fn, kind) in made.items():
        spark.udf.register(name, F.pandas_udf(fn, kind))
    return sorted(made)
