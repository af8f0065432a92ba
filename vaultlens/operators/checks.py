"""EXT-04, SET-06, AGG-09: self-checks: (pos, name, command, output, code, error) -> validity of each and of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.states import check_valid


def judged(checks: DataFrame) -> DataFrame:
    return checks.select("pos", "command", check_valid(F.col("name"), F.col("output"), F.col("code")).alias("isValid"), "error").orderBy("pos")


def all_valid(checks: DataFrame) -> DataFrame:
    return judged(checks).agg(F.coalesce(F.bool_and("isValid"), F.lit(True)).alias("valid"))
