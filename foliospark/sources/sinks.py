"""Writers, and the reader of what they publish."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch_id bigint, run string, published_at timestamp, tables map<string,string>"


def write_extractions(tables: dict[str, DataFrame], target: str, jdbc: dict[str, str] | None = None,
                      mode: str = "append") -> None:
    """Write the stored tables below ``target`` as parquet or, with ``jdbc`` options, to tables of those names."""
    for name, df in tables.items():
        if jdbc:
            df.write.format("jdbc").options(**jdbc, dbtable=name).mode(mode).save()
        else:
            df.write.mode(mode).parquet(f"{target}/{name}")


def publish(tables: dict[str, DataFrame], target: str, batch_id: int) -> None:
    """Write all tables of a batch below ``target`` so that readers see all of them or none.

    Each run writes into folders of its own; only then one manifest row names them. A run that ends before leaves nothing that ``published``
    reads, and of several runs of a batch the last one counts, so a batch that is replayed is there once.
    """
    if not tables:
        return
    run = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    folders = {name: f"{name}/batch={batch_id}/run={run}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{target}/{folders[name]}")
    row = spark.createDataFrame([(batch_id, run, folders)], "batch_id bigint, run string, tables map<string,string>")
    row.select("batch_id", "run", F.current_timestamp().alias("published_at"), "tables").coalesce(1).write.mode("append").json(f"{target}/_manifests")


def manifests(spark: SparkSession, target: str) -> DataFrame:
    """The run that counts of every published batch: ``(batch_id, run, tables)``."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{target}/_manifests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], MANIFEST)
    last = F.max_by(F.struct("run", "tables"), F.struct("published_at", "run")).alias("m")
    return rows.groupBy("batch_id").agg(last).select("batch_id", "m.run", "m.tables")


def published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table as its manifests say, with ``batch`` and ``run``. The driver reads one short row for each batch, no data."""
    folders = [f"{target}/{r['folder']}" for r in manifests(spark, target).select(F.element_at("tables", F.lit(name)).alias("folder")).collect() if r["folder"]]
    if not folders:
        raise ValueError(f"nothing is published as {name}")
    return spark.read.option("basePath", f"{target}/{name}").parquet(*folders)


def write_status(events: DataFrame, target: str) -> None:
    """Append status events; the current state is folded on read."""
    events.write.mode("append").parquet(target)


def write_state(state: DataFrame, target: str) -> None:
    """A snapshot of the folded state, one folder per status: a lookup by status reads only its folder."""
    state.write.mode("overwrite").partitionBy("status").parquet(target)


def write_report(df: DataFrame, path: str) -> None:
    """A small metric, report or manifest table as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
