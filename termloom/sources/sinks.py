"""File sinks. Every writer is a distributed job; part files share one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_CSV = {"header": "true", "escape": '"', "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write with a header, doubling embedded quotes and keeping edge spaces."""
    df.write.mode(mode).options(**_CSV).csv(path)


def read_csv_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read back a file set written by `write_csv`."""
    return spark.read.schema(schema).options(**{**_CSV, "emptyValue": ""}).csv(path)


def write_report(path: str, header: DataFrame, **datasets: DataFrame) -> None:
    """A report folder: the metadata row next to one CSV folder per dataset."""
    write_csv(header, f"{path}/header", "overwrite")
    for name, df in datasets.items():
        write_csv(df, f"{path}/{name}", "overwrite")
