"""File sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """A UTF-8 file with a header, all cells text, blank for missing; quotes are doubled inside cells.

    Columns go by position, so a byte-order mark before the first name does no harm.
    """
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.fillna("")


def read_catalogues(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One catalogue file for each tenant, tagged with it."""
    parts = [read_csv(spark, path, schemas.CATALOGUE).withColumn("tenant", F.lit(tenant)) for tenant, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_customer_sku_map(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CUSTOMER_SKU_MAP)


def read_uom_reference(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.UOM_REFERENCE)


def read_order_lines(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    return read_csv(spark, path, schemas.ORDER_LINES_LABELLED if labelled else schemas.ORDER_LINES)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PREDICTIONS)


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """The chosen columns as text with a header; missing values become blank cells."""
    names = list(fields or df.columns)
    df.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in names)).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    write_csv(df, path, schemas.PREDICTIONS.names)


def write_json_result(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, one file per partition."""
    df.write.mode("overwrite").json(path)


def read_json_result(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, compressed or not."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def result_document(df: DataFrame, elapsed_s: float) -> str:
    """A report's whole result as one JSON document with columns, time and rows; large results go to ``write_json_result``."""
    rows = [list(r) for r in df.toLocalIterator()]
    return json.dumps({"columns": df.columns, "elapsed_s": elapsed_s, "rows": rows}, default=str)


def relation(spark: SparkSession, source: str | Callable[[SparkSession, str], DataFrame], sf_dir: str = "", args: dict | None = None) -> DataFrame:
    """A relation from SQL text with named parameters, or from a function of (spark, folder)."""
    return spark.sql(source, args=args) if isinstance(source, str) else source(spark, sf_dir)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables of a folder as temporary views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table_columns(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, data_type) of all views and tables of the session's catalogue."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def copy_rows(df: DataFrame, path: str, where: Column | None = None, partition_by: Sequence[str] = ()) -> int:
    """Write the rows that satisfy a condition; returns how many there are."""
    (df if where is None else df.where(where)).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def report_slice(ledger: dict[str, DataFrame], first: str, last: str) -> dict[str, DataFrame]:
    """The rows that a report from ``first`` to ``last`` reads: events also of the day before."""
    def by_day(df: DataFrame, begin: Column) -> DataFrame:
        return df.where((F.col("created_at") >= begin) & (F.col("created_at") < F.date_add(F.lit(last).cast("date"), 1)))

    start = F.lit(first).cast("date")
    return {**ledger, "order_line": by_day(ledger["order_line"], start), "match_event": by_day(ledger["match_event"], F.date_sub(start, 1))}


def write_ledger(ledger: dict[str, DataFrame], path: str) -> None:
    """The ledger laid out for the report: events and lines in folders by day, sorted by tenant inside files, in place of indexes."""
    for name, df in ledger.items():
        if name in ("order_line", "match_event"):
            daily = df.withColumn("day", F.to_date("created_at"))
            daily.repartition("day", "tenant_id").sortWithinPartitions("day", "tenant_id").write.mode("overwrite").partitionBy("day").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def plan_of(df: DataFrame) -> str:
    """The physical plan of a relation, as text: what a reader of indexes and query plans looks at here."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
