"""Documents that try the operators; import `make_docs` for the fixture."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


#: Names that the operators use inside.
CLASHING = "_id _mark _row _doc_id _pick _hash _gone copy size bands bits root bucket kmer near place piece kept spans chunk own freq phrase tag q code".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) or (id, text, lang); extra columns have names that the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        return frame.selectExpr("*", "'x' AS fp", "1 AS mark", "'y' AS words", "2 AS part", "3 AS row", "4 AS shard", "5 AS n", "'z' AS hash", *[f"{i} AS {name}" for i, name in enumerate(CLASHING)])

    return make


#: Nulls, empty and blank texts, repeated rows, one id with two texts, ties, a very long text.
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one two three four five six seven eight nine ten eleven twelve"),
    (4, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "quite another text under the same number"),
    (None, "a text without a number"),
    (None, None),
    (6, "Ünïcode Wörter ÉTÉ naïve 東京 tower 😀 emoji"),
    (7, "lorem ipsum dolor sit amet " * 20_000),
    (8, "x"),
    (-3, "negative numbers are numbers"),
]
