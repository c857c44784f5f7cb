"""Column functions on numeric vectors; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def parse_vector(text: Column) -> Column:
    """Numbers separated by white space or commas; empty tokens are skipped."""
    tokens = F.filter(F.split(text, r"\s+|,"), lambda t: t != "")
    return F.transform(tokens, lambda t: t.cast("double"))


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(vec: Column) -> Column:
    """Each row divided by its Euclidean norm; a zero row becomes NaN."""
    return F.transform(vec, lambda x: F.when(norm(vec) > 0, F.try_divide(x, norm(vec))).otherwise(F.lit(NAN)))


def normalise(df: DataFrame, vec: str = "vec") -> DataFrame:
    """``df`` with the vector column normalised; the norm is computed once a row."""
    n = F.col("_norm")
    unit = F.transform(vec, lambda x: F.when(n > 0, F.try_divide(x, n)).otherwise(F.lit(NAN)))
    return df.withColumn("_norm", norm(F.col(vec))).withColumn(vec, unit).drop("_norm")


def log1p_vector(vec: Column) -> Column:
    return F.transform(vec, F.log1p)


def slice_columns(vec: Column, start: int, end: int) -> Column:
    """Components start .. end - 1, from 0."""
    return F.slice(vec, start + 1, end - start)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def no_nan(x: Column) -> Column:
    """NaN as null, so that it never is a minimum or maximum."""
    return F.when(~F.isnan(x), x)


def decimals(token: Column) -> Column:
    """Digits after the point of a number's text; none without a point."""
    return F.coalesce(F.length(F.get(F.split(token, r"\."), F.lit(1))), F.lit(0))
