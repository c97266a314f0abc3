"""Database sinks through Spark's JDBC writer, and the layout of the rows they land.

No driver for any of the databases is part of PySpark, so what runs without one is the landed frame
(``landing_rows``) and the writer options (``jdbc_options``); the write is Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows per insert batch.
BATCH_ROWS = 10_000
CLICKHOUSE_BATCH_ROWS = 100_000

# JDBC driver classes by URL scheme.
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver",
    "sqlite": "org.sqlite.JDBC",
}


def sink_stream_of_changes(df: DataFrame, time: int) -> DataFrame:
    """Rows as insertions at ``time``: adds ``time BIGINT, diff SMALLINT``."""
    return df.withColumn("time", F.lit(time).cast("bigint")).withColumn("diff", F.lit(1).cast("smallint"))


def jdbc_options(url: str, table: str, batchsize: int = BATCH_ROWS, writers: int | None = None) -> dict[str, str]:
    scheme = url.removeprefix("jdbc:").split(":", 1)[0]
    options = {"url": url, "dbtable": table, "batchsize": str(batchsize)}
    if scheme in DRIVERS:
        options["driver"] = DRIVERS[scheme]
    if writers is not None:
        options["numPartitions"] = str(writers)
    if scheme == "postgresql":
        options["reWriteBatchedInserts"] = "true"
    if scheme == "mysql":
        options["rewriteBatchedStatements"] = "true"
    if scheme == "sqlserver":
        options["useBulkCopyForBatchInsert"] = "true"
    return options


def landing_rows(df: DataFrame, time: int = 0, changes: bool = True) -> DataFrame:
    """The rows as the target table holds them."""
    return sink_stream_of_changes(df, time) if changes else df


def sink_jdbc_replace(
    df: DataFrame, url: str, table: str, batchsize: int = BATCH_ROWS, writers: int | None = None, time: int = 0
) -> None:
    """Replace the table; at most ``writers`` connections insert at the same time."""
    landing_rows(df, time).write.format("jdbc").options(**jdbc_options(url, table, batchsize, writers)).mode(
        "overwrite"
    ).save()


def sink_clickhouse(df: DataFrame, url: str, table: str, batchsize: int = CLICKHOUSE_BATCH_ROWS) -> None:
    options = jdbc_options(url, table, batchsize)
    options["createTableOptions"] = "ENGINE = MergeTree ORDER BY tuple()"
    landing_rows(df).write.format("jdbc").options(**options).mode("overwrite").save()


def with_ingestion_time(df: DataFrame) -> DataFrame:
    """Adds the designated ``timestamp`` column: when the rows were ingested."""
    return df.withColumn("timestamp", F.current_timestamp())


def sink_questdb(df: DataFrame, url: str, table: str) -> None:
    """Append rows stamped with their ingestion time."""
    with_ingestion_time(df).write.format("jdbc").options(**jdbc_options(url, table)).mode("append").save()


def sink_single_writer(df: DataFrame, url: str, table: str, batchsize: int = BATCH_ROWS) -> None:
    """For a database that admits one writer.

    The upstream work stays parallel: it is staged by all tasks first and only the insert itself is
    one connection, streaming over the staged rows.  More executors cannot make that part faster.
    """
    from tallyflow.session import settle

    sink_jdbc_replace(settle(df), url, table, batchsize, writers=1)
