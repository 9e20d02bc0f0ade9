"""Checks of outputs: the prediction file's contract and equality of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: At most three candidates of plain codes and scores from 0 to 1.
PLAIN = r"^(?:[0-9A-Za-z_-]+:(?:0\.[0-9]{1,9}|1\.0{1,9})(?:\|(?!\z)|\z)){0,3}\z"
DECISIONS = ("auto", "review", "reject")


def prediction_violations(rows: DataFrame, lines: DataFrame, prefix: Column | None = None) -> DataFrame:
    """(line_id, violation): every rule that a row of predictions breaks, and every line without one.

    ``prefix``: what item codes of a line's tenant begin with, if codes tell tenants apart.
    """
    # by the line from the start, so that they lie where the join needs them
    known = lines.select(F.col("line_id").cast("string").alias("line_id"), "tenant").repartition("line_id").distinct()
    given = rows.withColumns({"times": F.count(F.lit(1)).over(Window.partitionBy("line_id")), "given": F.lit(True)})
    joined = given.join(known, "line_id", "full")
    score, parts = F.expr("try_cast(confidence AS double)"), F.filter(F.split("candidates", r"\|"), lambda x: x != "")

    def bad_part(x: Column) -> Column:
        value = F.regexp_extract(x, r"^(.*):([^:]*)$", 2).try_cast("double")
        return (F.regexp_extract(x, r"^(.*):([^:]*)$", 1) == "") | value.isNull() | F.isnan(value) | (value < 0) | (value > 1)

    # most lists are told to be in order without being taken apart
    plain = F.coalesce(F.col("candidates").rlike(PLAIN), F.lit(False))
    auto = F.col("decision") == "auto"
    tests = {
        "duplicate_line": F.col("times") > 1,
        "unknown_line": F.col("tenant").isNull(),
        "bad_decision": ~F.col("decision").isin(*DECISIONS),
        "bad_confidence": score.isNull() | F.isnan(score) | (score < 0) | (score > 1),
        "auto_without_item": auto & (strip(F.col("item_code")) == ""),
        "item_without_auto": ~auto & (strip(F.col("item_code")) != ""),
        "blank_reason": strip(F.col("reason_code")) == "",
        "too_many_candidates": ~plain & (F.size(parts) > 3),
        "bad_candidate": ~plain & F.exists(parts, bad_part),
    }
    if prefix is not None:
        codes = F.array_union(F.transform(parts, lambda x: F.regexp_extract(x, r"^(.*):([^:]*)$", 1)), F.filter(F.array("item_code"), lambda x: x != ""))
        tests["foreign_item"] = F.exists(codes, lambda x: ~x.startswith(prefix))
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    violations = F.when(F.col("given").isNull(), F.array(F.lit("missing_line"))).otherwise(broken)
    return joined.select("line_id", F.explode(violations).alias("violation"))


def different_rows(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Rows that one result has more often than the other, doubles rounded, with the side and how much more often; empty if the results are equal."""

    columns = sorted(a.columns)

    def counted(df: DataFrame, sign: int) -> DataFrame:
        rounded = df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).alias(c) for c, t in sorted(df.dtypes)))
        return rounded.groupBy(*columns).agg((sign * F.count(F.lit(1))).alias("_more"))

    both = counted(a, 1).union(counted(b, -1)).groupBy(*columns).agg(F.sum("_more").alias("_more")).where("_more <> 0")
    return both.select(*columns, F.when(F.col("_more") > 0, "first").otherwise("second").alias("side"), F.abs("_more").alias("times"))


def same_rows(a: DataFrame, b: DataFrame, digits: int = 6) -> bool:
    return different_rows(a, b, digits).isEmpty()
