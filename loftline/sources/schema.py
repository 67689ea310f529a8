"""Schema components of sources: fingerprints and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(components: DataFrame) -> DataFrame:
    """(source_id, fingerprint): the first 16 digits of the SHA-256 of the components as JSON with sorted keys."""
    names = sorted(c for c in components.columns if c != "source_id")
    text = F.to_json(F.struct(*names))
    return components.select("source_id", F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def long_form(components: DataFrame) -> DataFrame:
    names = sorted(c for c in components.columns if c != "source_id")
    return components.unpivot("source_id", names, "field", "value")


def differences(components: DataFrame, base: str) -> DataFrame:
    """(source_id, field, value, expected) where a source differs from the base source; nulls equal each other."""
    rows = long_form(components)
    wanted = rows.where(F.col("source_id") == base).select(F.col("field").alias("f"), F.col("value").alias("expected"))
    found = rows.join(F.broadcast(wanted), F.col("field") == F.col("f"))  # as many rows as a source has fields
    return found.where(~F.col("value").eqNullSafe(F.col("expected"))).select("source_id", "field", "value", "expected")


def gate(components: DataFrame, base: DataFrame, expected: set[str]) -> DataFrame:
    """(source_id, differing, confounders, verdict): whether a source may be compared with the one row of base.

    The experiment may change the expected fields alone. `incomparable` where either side has no known field at all, `identical` without
    differences, `confounded` where another field differs, else `valid`. Nulls equal each other. The base has the columns of components.
    """
    names = sorted(c for c in components.columns if c != "source_id")
    other = base.select(*[F.col(c).alias(f"__{c}") for c in names]).limit(1)
    rows = components.crossJoin(F.broadcast(other))  # with one row
    differ = {c: (~F.col(c).eqNullSafe(F.col(f"__{c}"))).cast("int") for c in names}
    total = lambda fields: sum((differ[c] for c in fields), F.lit(0))
    known = lambda mark: F.coalesce(*[F.col(f"{mark}{c}").cast("string") for c in names]).isNotNull()
    out = rows.select("source_id", total(names).alias("differing"), total([c for c in names if c not in expected]).alias("confounders"), (known("") & known("__")).alias("__known"))
    verdict = F.when(~F.col("__known"), "incomparable").when(F.col("differing") == 0, "identical").when(F.col("confounders") > 0, "confounded").otherwise("valid")
    return out.withColumn("verdict", verdict).drop("__known")
