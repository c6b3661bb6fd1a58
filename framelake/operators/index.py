"""Lookups by value and by sequence number, schemas in the log, migration, and merging of files."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.codec import frames_in
from framelake.functions.schema import Schema, SchemaError
from framelake.sources.framelog import RECORDS, arrow, log_files, opener, register

SCHEMA_FLAG = 0  # the schema number of records that are schemas themselves


def index_bucket(records: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Search buckets in summary: per value the count and range of sequence numbers.

    The numbers themselves stay rows (see ``index_entries``): a value that a third of all
    records share would not fit one array.
    """
    return records.groupBy(value.alias(name)).agg(F.count("*").alias("n_seq"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def index_entries(records: DataFrame, value: Column, name: str = "value", n: int | None = None) -> DataFrame:
    """The index as a table sorted by (value, seq), for Parquet's row-group statistics to prune."""
    entries = records.select(value.alias(name), "seq")
    dealt = entries.repartitionByRange(n, name, "seq") if n else entries.repartitionByRange(name, "seq")
    return dealt.sortWithinPartitions(name, "seq")


def search(entries: DataFrame, value: object, name: str = "value") -> DataFrame:
    return entries.where(F.col(name) == F.lit(value)).select("seq")


def save_index(records: DataFrame, value: Column, path: str, name: str = "value", n: int | None = None) -> None:
    """The index as Parquet files that are sorted by (value, seq)."""
    index_entries(records, value, name, n).write.parquet(path)


def search_saved(spark: SparkSession, path: str, value: object, name: str = "value") -> DataFrame:
    """Numbers of the records with a value, from a saved index: the filter reaches the files' statistics."""
    return search(spark.read.parquet(path), value, name)


def seq_map(records: DataFrame, n: int | None = None) -> DataFrame:
    """Where each record's frame begins in the log, by number; ``records`` as the framelog source gives them."""
    places = records.select(F.col("seq").cast("decimal(20,0)").alias("seq"), "frame_off")
    return (places.repartitionByRange(n, "seq") if n else places.repartitionByRange("seq")).sortWithinPartitions("seq")


def fetch(spark: SparkSession, log: str, seq_map: DataFrame, seqs: list[int]) -> DataFrame:
    """Records of a log by number: their frames' places from a (saved) map, and of the log these frames alone."""
    register(spark)
    wanted = [int(s) for s in seqs]
    offsets = sorted({r[0] for r in seq_map.where(F.col("seq").isin(wanted)).select("frame_off").collect()})  # no more than numbers asked for
    files, begins = log_files(log), []
    for f in files:
        begins.append(begins[-1] + files[len(begins) - 1].bytes if begins else 0)
    places = [(f"{log}/{files[k].name}", files[k].name, begins[k], o - begins[k], files[k].bytes) for o in offsets for k in [bisect.bisect_right(begins, o) - 1]]
    table = spark.createDataFrame(places, "path string, name string, base long, offset long, bytes long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                get = opener(p["path"], p["bytes"])
                size = int.from_bytes(get(p["offset"], 4), "little")
                frame, _, _ = frames_in(np.frombuffer(get(p["offset"], size), np.uint8))
                yield from arrow(p["name"], p["base"], 0, "records", iter([(p["offset"], frame, None)]))

    return table.mapInArrow(read, RECORDS).where(F.col("seq").isin(wanted)).drop("frame_no")


def seq_lookup(records: DataFrame, seqs: list[int], seq: str = "seq") -> DataFrame:
    """Records by number: an equality filter on a stored column, which reaches the scan."""
    return records.where(F.col(seq).isin(*seqs))


def schema_payload(name: str, declaration: str, version: int = 0) -> bytes:
    """A schema as the payload of a record, whose schema number is SCHEMA_FLAG.  Refused if it cannot be used."""
    Schema.from_json(name, declaration)
    return json.dumps({"name": name, "version": version, "declaration": json.loads(declaration)}).encode()


def schemas_in(records: DataFrame) -> DataFrame:
    """(schema_seq, schema, version, declaration): the schemas that a log holds; a schema's number is its record's."""
    text = F.col("payload").cast("string")
    return records.where(F.col("schema_seq") == SCHEMA_FLAG).select(
        F.col("seq").alias("schema_seq"), F.get_json_object(text, "$.name").alias("schema"), F.get_json_object(text, "$.version").cast("int").alias("version"), F.get_json_object(text, "$.declaration").alias("declaration"),
    )


def data_in(records: DataFrame) -> DataFrame:
    """The records of a log that are no schemas."""
    return records.where(F.col("schema_seq") != SCHEMA_FLAG)


def check_migration(old: Schema, new: Schema, key: str | None = None) -> None:
    """A schema's name stays, its version grows, and its primary key never changes."""
    if old.name != new.name:
        raise SchemaError(f"{old.name} cannot become {new.name}")
    if new.version <= old.version:
        raise SchemaError(f"version {new.version} does not follow {old.version}")
    types = [{f.name: f.type for f in s.fields} for s in (old, new)]
    if key is not None and (key not in types[0] or types[0][key] != types[1].get(key)):
        raise SchemaError(f"the primary key {key} must not change")


def migrate(df: DataFrame, old: Schema, new: Schema, key: str | None = None) -> DataFrame:
    """Rows of one version as rows of a later one: fields that are new are null, and so must be nullable; fields
    that are gone go; others are cast, and a value that has no counterpart is an error."""
    check_migration(old, new, key)
    had = {f.name for f in old.fields}
    out = []
    for f, wanted in zip(new.fields, new.struct().fields, strict=True):
        if f.name not in had and not f.type.nullable:
            raise SchemaError(f"{f.name} is new and cannot be null")
        out.append((F.col(f"`{f.name}`") if f.name in had else F.lit(None)).cast(wanted.dataType).alias(f.name))
    moved = df.select(*out)
    bad = new.violations()
    checked = moved.withColumn("__bad", bad)
    first = new.fields[0].name if new.fields else None
    if first is None:
        return moved
    error = F.raise_error(F.concat(F.lit("does not fit: "), F.array_join("__bad", ", ")))
    return checked.withColumn(first, F.when(F.size("__bad") == 0, F.col(f"`{first}`")).otherwise(error.cast(new.struct().fields[0].dataType))).drop("__bad")


def latest_per_key(records: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Of every key the record with the greatest number, as a table whose primary key it is; null keys are none."""
    row = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    return records.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def schema_resolve(records: DataFrame, schemas: DataFrame, most_mb: int = 64) -> DataFrame:
    """Records with the schema they were written under (latest version by name is not implied).

    The catalog is broadcast only if its measured size is under ``most_mb``.
    """
    size = schemas.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return records.join(F.broadcast(schemas) if size < most_mb * 1_000_000 else schemas, "schema_seq", "left")


def compact(logs: list[DataFrame], n: int | None = None) -> DataFrame:
    """Sealed logs merged into one, in ranges of sequence numbers that are sorted inside.

    Logs of different versions keep all columns of any; a record found in several logs stays once, each
    of its columns as in the last log that has a value there.
    """
    out = logs[0].withColumn("__log", F.lit(0))
    for i, log in enumerate(logs[1:], 1):
        out = out.unionByName(log.withColumn("__log", F.lit(i)), allowMissingColumns=True)
    columns = [c for c in out.columns if c != "__log"]
    latest = [F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("__log"))).alias(c) for c in columns if c != "seq"]
    out = (out.groupBy("seq").agg(*latest) if latest else out.select("seq").distinct()).select([F.col(f"`{c}`") for c in columns])
    return (out.repartitionByRange(n, "seq") if n else out.repartitionByRange("seq")).sortWithinPartitions("seq")
