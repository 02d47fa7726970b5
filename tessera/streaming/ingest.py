"""Coverage documents as a stream, merged into a keyed table. An extension: merging by maximum, and of condition
detail by union or poisoning, gives the same numbers whatever the order and batches of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import merge
from tessera.sources import xml

STATE = ("path", "line", "hits", "raw_cov", "raw_tot", "poisoned", "conds")
#: Versions of the table that stay: readers of the one before the last are not cut off.
KEPT = 2


def versions(spark: SparkSession, table: str) -> list[int]:
    """The table's complete versions, oldest first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(table)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in store.listStatus(top)] if store.exists(top) else []
    done = [p for p in names if p.getName().startswith("v=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The merged lines of the table's last version."""
    return merge.merged_lines(spark.read.parquet(f"{table}/v={versions(spark, table)[-1]}").select(*STATE))


def rejected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, problem of malformed documents (path, xml)."""
    for batch in batches:
        told = [(path, xml.problem(data)) for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        bad = [(path, p) for path, p in told if p]
        yield pa.RecordBatch.from_arrays([pa.array([path for path, _ in bad], pa.string()), pa.array([p for _, p in bad], pa.string())], ["path", "problem"])


def merge_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, name: str = "*.xml") -> StreamingQuery:
    """Reads new documents of the folder once each and keeps table (Parquet folders) the merged raw facts.

    Each batch merges into the last complete version of the table and writes the next; a batch that is
    repeated, or read again after its checkpoint was lost, changes nothing, because merging twice is merging
    once. Malformed documents are merged no further and stand in rejected/ with what is wrong with them.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", name).load(folder)
    docs = files.select("path", F.col("content").alias("xml"))

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()
        bad = batch.mapInArrow(rejected, "path string, problem string").persist()
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(f"{table}/rejected/batch={number}")
        good = batch.join(bad, "path", "left_anti")
        # every document is a report of its own; only paths are numbered in one place
        numbers = good.select("path").distinct().withColumn("report_ord", F.row_number().over(Window.orderBy("path")))
        facts = merge.line_facts(xml.scan(xml.parsed(good.join(numbers, "path").select("report_ord", "xml"))).lines)
        new = merge.merged_lines(facts).select(*STATE)
        have = versions(session, table)
        if have:
            old = session.read.parquet(f"{table}/v={have[-1]}").select(*STATE)
            new = merge.merged_lines(old.unionByName(new)).select(*STATE)
        new.write.mode("overwrite").parquet(f"{table}/v={have[-1] + 1 if have else 0}")
        for old_version in have[: 1 - KEPT]:
            path = session._jvm.org.apache.hadoop.fs.Path(f"{table}/v={old_version}")
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
        bad.unpersist()
        batch.unpersist()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
