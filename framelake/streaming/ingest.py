"""Appending to a log: batches, streams with each batch exactly once, following and copying a log."""

from __future__ import annotations

import hashlib
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framelake.functions.codec import RECORD_HEADER
from framelake.operators.log import assign_seq, reject_oversize
from framelake.sources.framelog import committed, last_seq, latest, register


def append(df: DataFrame, path: str, order: str, schema_seq: int = 1, most_bytes: int | None = None, **options: str) -> tuple[int, int] | None:
    """Number the rows (order, payload, perhaps schema_seq) after what the log has and commit them as one batch.

    One append at a time per log, like the log's single writer: of two at once, one fails and leaves
    nothing.  ``most_bytes``: a quota; a batch whose records have more is refused before anything is
    written.  Returns the range of numbers.
    """
    spark = df.sparkSession
    register(spark)
    if most_bytes is not None:
        size = df.select(F.sum(F.octet_length("payload") + RECORD_HEADER)).first()[0] or 0
        if size > most_bytes:
            raise ValueError(f"the batch has {size} bytes, the quota is {most_bytes}")
    before = last_seq(path)
    numbered = assign_seq(reject_oversize(df), order, before)
    schema = F.col("schema_seq") if "schema_seq" in df.columns else F.lit(schema_seq)
    # within a file numbers ascend, and files are committed in the order of their numbers
    out = numbered.select("seq", schema.cast("long").alias("schema_seq"), "payload").repartitionByRange("seq").sortWithinPartitions("seq")
    out.write.format("framelog").mode("append").options(**options).save(path)
    after = last_seq(path)
    return (before + 1, after) if after > before else None


def ingest(stream: DataFrame, path: str, order: str, checkpoint: str, schema_seq: int = 1, **trigger) -> StreamingQuery:
    """Append a stream micro-batch by micro-batch, each exactly once: the manifest that publishes a batch also
    keeps its number, so a batch repeated after a failure is found there and skipped."""
    name = hashlib.sha256(os.path.abspath(checkpoint).encode()).hexdigest()[:16]

    def commit(batch: DataFrame, number: int) -> None:
        if latest(path)[1].get("streams", {}).get(name, -1) < number:
            append(batch, path, order, schema_seq, stream=name, batch=str(number))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The log as a stream of records."""
    register(spark)
    reader = spark.readStream.format("framelog")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def replicate(spark: SparkSession, source: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``target`` a copy of ``source``, numbers and schema numbers included; each batch exactly once."""
    name = hashlib.sha256(os.path.abspath(checkpoint).encode()).hexdigest()[:16]

    def commit(batch: DataFrame, number: int) -> None:
        if latest(target)[1].get("streams", {}).get(name, -1) < number:
            out = batch.select("seq", "schema_seq", "payload").repartitionByRange("seq").sortWithinPartitions("seq")
            out.write.format("framelog").mode("append").options(stream=name, batch=str(number)).save(target)

    return follow(spark, source).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def backup(path: str, target: str) -> list[str]:
    """Copy a log's committed files, and after them its manifests, to a new folder.  Restoring is the same the
    other way.  The files never change, so this is one state of the log even while it is written to."""
    os.makedirs(target)
    manifests = sorted(n for n in os.listdir(path) if n.endswith(".manifest"))
    files = [os.path.basename(p) for p in committed(path)]
    for n in [*files, *manifests]:
        shutil.copyfile(os.path.join(path, n), os.path.join(target, n))
    return files
