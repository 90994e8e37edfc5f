"""Readable labels for units and transformations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import TRANSFORMATIONS


def transformation_name(code: str = "transformation") -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, text in TRANSFORMATIONS.items():
        out = out.when(F.col(code) == key, F.lit(text))
    return out.otherwise(
        F.raise_error(F.concat(F.lit("unknown transformation: "), F.col(code))).cast("string")
    )


def transformed_unit(
    units: str = "units", code: str = "transformation", frequency: str = "frequency"
) -> Column:
    """Unit of a series after its transformation."""
    u, c, f = F.col(units), F.col(code), F.col(frequency)
    # The labels shown for each kind of unit.
    return (
        F.when(u == "Index", F.lit("Index"))
        .when((c == "chg") & u.contains("%"), F.lit("Ppt. change"))
        .when(c == "chg", F.lit("Level change"))
        .when((c == "pch") & (f == "m"), F.lit("MoM %"))
        .when((c == "pca") & (f == "q"), F.lit("QoQ AR %"))
        .otherwise(F.concat(u, F.lit(" ["), c, F.lit("]")))
    )
