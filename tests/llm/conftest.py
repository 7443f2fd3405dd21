from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def texts(spark):
    """Documents from (id, text) rows, with columns whose names operators use inside."""

    def build(rows, parts=3):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for name in ("mark", "n", "label", "chunk", "score", "class"):
            df = df.withColumn(name, F.lit("x"))
        return df.repartition(parts)

    return build


#: Nulls, empty and blank texts, repeated rows, ties, a long text, other scripts, special token strings.
AWKWARD = [
    (None, None), (None, "null id"), (1, ""), (2, " \n\t "), (3, "Same words here now ok"), (3, "Same words here now ok"),
    (4, "same  words\nhere now ok"), (5, "it's we'LL <|endoftext|>x  <|startoftext|>"), (6, "漢字 ÀÉ é Σ İ ﬁ 😀😀 \x1c a b"),
    (7, "word " * 9000), (-8, "x"), (1 << 40, "a b c d e f g h i j k l"),
]


@pytest.fixture(scope="module")
def awkward(texts):
    return texts(AWKWARD)
