"""Vector columns: cosine similarity, reading and writing of vector literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsontext import parsed

# Members of a payload object that may hold the vector, in order of preference.
PAYLOAD_MEMBERS = ("embedding", "vector", "data")
# JSON texts of values that count as absent when choosing among the members.
_EMPTY_JSON = ("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")
_NUMBER_TYPES = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """1 − cosine distance in double precision; NaN when a vector has length zero, null when a side is null."""
    similarity = F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(similarity, F.lit(float("nan"))))


def parse_vector(payload: Column) -> Column:
    """array<double> from a vector literal, a JSON list, or an object holding the list; null when unusable."""
    value = parsed(payload)
    members = [F.try_variant_get(value, f"$.{m}", "variant") for m in PAYLOAD_MEMBERS]
    chosen = F.coalesce(*[F.when(~F.to_json(m).isin(*_EMPTY_JSON), m) for m in members])
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    listed = F.when(is_object, chosen).otherwise(value)
    first = F.schema_of_variant(F.try_variant_get(listed, "$[0]", "variant"))
    vector = F.try_variant_get(listed, "$", "array<double>")
    usable = first.rlike(_NUMBER_TYPES) & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return F.when(usable, vector)


def ingest_vectors(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Split embedding payloads into (rows with `embedding` and `embedding_dims`, rejected rows)."""
    read = df.withColumn("embedding", parse_vector(F.col(payload)).cast("array<float>"))
    good = read.where(F.col("embedding").isNotNull()).drop(payload).withColumn("embedding_dims", F.size("embedding"))
    bad = read.where(F.col("embedding").isNull()).drop("embedding")
    return good, bad


def vector_literal(vector: Column) -> Column:
    """Text literal with eight decimals per component: [0.10000000,…]."""
    parts = F.transform(vector, lambda x: F.format_string("%.8f", x.cast("double")))
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def export_vectors(df: DataFrame, vector: str = "embedding", out: str = "literal") -> DataFrame:
    """Replace a vector column by its text literal, for consumers that load vectors as text."""
    return df.withColumn(out, vector_literal(F.col(vector))).drop(vector)
