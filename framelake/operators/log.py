"""The log as DataFrames: records, transactions, frames, and what is visible of them.

``records``: seq, txn, payload or rec_len, ...; ``frames``: frame_no (dense, in file order),
frame_len, min_seq, max_seq, crc_ok, ...  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.functions.codec import FRAME_CHECKSUM, FRAME_HEADER, FRAME_MIN, RECORD_HEADER, RECORD_MAX
from framelake.operators import ordering


def record_size(payload: Column) -> Column:
    """Bytes of a record with this payload."""
    return (RECORD_HEADER + F.octet_length(payload)).cast("long")


def within_limit(size: Column) -> Column:
    """Whether a record of this size is one the format allows."""
    return size <= RECORD_MAX


def fits(payload: Column) -> Column:
    """Whether a payload keeps its record within the format's limit."""
    return within_limit(record_size(payload))


def reject_oversize(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Fail the job at the first payload over the limit."""
    checked = F.when(fits(F.col(payload)) | F.col(payload).isNull(), F.col(payload)).otherwise(F.raise_error(F.lit("record over the storage limit")))
    return df.withColumn(payload, checked)


def assign_seq(df: DataFrame, order: str, resume_after: int = 0, n: int | None = None) -> DataFrame:
    """Dense sequence numbers in the order of a unique column, going on after those given before."""
    return ordering.dense_numbers(df, order, "seq", resume_after + 1, n)


def txn_summary(records: DataFrame, txn: str = "txn", rec_len: str = "rec_len") -> DataFrame:
    """Each transaction's range of sequence numbers, count of records, and length as a frame."""
    return records.groupBy(txn).agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("n_records"), (F.lit(FRAME_MIN) + F.sum(rec_len)).cast("long").alias("frame_len"))


def txn_columns(records: DataFrame, txn: str = "txn") -> DataFrame:
    """Every record with its transaction's first sequence number and count of records."""
    whole = Window.partitionBy(txn)
    return records.withColumns({"txn_id": F.min("seq").over(whole), "txn_cnt": F.count("*").over(whole)})


def frame_layout(frames: DataFrame, order: str = "frame_no", n: int | None = None) -> DataFrame:
    """``frame_off``: where each frame starts in its log."""
    return ordering.running_sum(frames, order, "frame_len", "frame_off", n)


def scan_valid_prefix(frames: DataFrame, scan_key: str = "max_seq", ok: Column | None = None, order: str = "frame_no", *, diagnostics: bool = False) -> DataFrame:
    """The frames before the first that is damaged or whose key does not increase.

    ``scan_key``: max_seq, or min_seq for logs whose writer compared least numbers.
    ``diagnostics``: keep all frames and say in ``scanned`` and ``stop_reason`` what became of each.
    """
    key = F.col(scan_key)
    late = lambda before: F.coalesce(~(key > F.coalesce(before, F.lit(0))), F.lit(True))
    damaged = ~(ok if ok is not None else F.lit(True))
    out = ordering.walk(frames, order, previous={"__last_key": scan_key}, stop=lambda before: damaged | late(before["__last_key"]))
    scanned = F.col(ordering.STOP).isNull() | (F.col(order) < F.col(ordering.STOP))
    if diagnostics:
        reason = F.when(damaged, "damaged").when(late(F.col("__last_key")), "order")
        return out.withColumns({"stop_reason": reason, "scanned": scanned}).drop("__last_key", ordering.STOP)
    return out.where(scanned).drop("__last_key", ordering.STOP)


def visible(frames: DataFrame, watermark: int) -> DataFrame:
    """Frames that lie wholly before a byte watermark."""
    return frames.where(F.col("frame_off") + F.col("frame_len") <= watermark)


def truncate(frames: DataFrame, offset: int) -> DataFrame:
    """Frames that remain when the log is cut at ``offset``; beyond the end is an error."""
    end = log_stats(frames).first()["pos"]
    if offset > end:
        raise ValueError(f"offset {offset} is beyond the end {end}")
    return visible(frames, offset)


def log_stats(frames: DataFrame) -> DataFrame:
    """Frames, bytes and greatest sequence number of a committed log."""
    pos = F.coalesce(F.sum("frame_len"), F.lit(0)).cast("long")
    return frames.agg(F.count("*").alias("n_frames"), pos.alias("pos"), F.max("max_seq").alias("last_seq"))


def read_at(content: Column, offset: int, length: int) -> Column:
    """Up to ``length`` bytes from ``offset``; fewer at the end, none beyond it."""
    return F.substring(content, offset + 1, length)


def visible_read_length(offset: Column, length: Column, watermark: int) -> Column:
    """Bytes that a fenced read at ``offset`` returns."""
    return F.greatest(F.lit(0), F.least(length, F.lit(watermark) - offset)).cast("long")


def generate(spark, n_txns: int, seed: int = 0, payload: bytes = b"A record like any other. ", schema_seq: int = 1) -> DataFrame:
    """Made records (seq, txn, schema_seq, payload): transactions of 2 to 20 records, numbered from 1 without gaps."""
    sizes = spark.range(n_txns).select(F.col("id").alias("txn"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(19)) + 2).alias("n"))
    begins = ordering.running_sum(sizes, "txn", "n", "before")
    return begins.select("txn", F.posexplode(F.array_repeat(F.lit(payload), F.col("n").cast("int"))).alias("at", "payload"), "before").select(
        (F.col("before") + F.col("at") + 1).cast("long").alias("seq"), "txn", F.lit(schema_seq).cast("long").alias("schema_seq"), "payload"
    )


def group_commit(records: DataFrame, cap: int = RECORD_MAX, log: str = "log", order: str = "seq", size: str = "rec_len") -> DataFrame:
    """Greedy packing of appends into frames, as a writer does whose queue is never empty.

    A frame starts with its header and takes appends while its size before taking is under
    ``cap``.  The sum restarts at points that depend on all rows before, so each log is one
    ordered stream, held in constant memory; logs run in parallel.  Adds ``frame_no`` (from 0 in
    each log), ``frame_len``-so-far as ``fill``.
    """
    dealt = records.repartition(F.col(log)).sortWithinPartitions(log, order)
    schema = StructType(dealt.schema.fields[:]).add("frame_no", "long").add("fill", "long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = pack  # no log yet
        frame = fill = 0
        for batch in batches:
            frames, fills = [], []
            for name, n in zip(batch.column(log).to_pylist(), batch.column(size).to_pylist(), strict=True):
                if name != current:
                    current, frame, fill = name, 0, FRAME_HEADER
                elif fill >= cap:
                    frame, fill = frame + 1, FRAME_HEADER
                fill += n or 0
                frames.append(frame)
                fills.append(fill)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(frames, pa.int64()), pa.array(fills, pa.int64())], names=[*batch.schema.names, "frame_no", "fill"])

    return dealt.mapInArrow(pack, schema)


def sealed(packed: DataFrame, log: str = "log", size: str = "rec_len") -> DataFrame:
    """The frames that ``group_commit`` made."""
    return packed.groupBy(log, "frame_no").agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("n_appends"), (F.sum(size) + FRAME_HEADER + FRAME_CHECKSUM).cast("long").alias("frame_len"))
