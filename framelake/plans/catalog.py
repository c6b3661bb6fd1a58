"""The registered log queries and their DuckDB counterparts.

Fixtures come from ``events``: ``seq`` is event_id + 1, seven events make a transaction, the
payload is ``props``.  Where a query needs a schema or a damaged log, its few rows are stated here.
Queries on log files write a log of their own into the cluster's shared folder and read it back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import codec
from framelake.functions.schema import DataType, Schema, SchemaError, encode_name, layout_table, width_expr
from framelake.operators import index, log
from framelake.operators.lineage import place
from framelake.sources import framelog
from framelake.streaming import ingest

SCHEMAS = (
    ("person", '{"name": {"first": "String 64", "last": "String? 64"}, "id": "Int"}'),
    ("reading", '{"sensor": "String 40", "at": "Int", "valid": "Bool", "celsius": "Float", "raw": "Blob 16"}'),
    ("order", '{"qty": "Int?", "paid": "Bool?", "note": "String? 30", "sku": "String 30"}'),
    ("levels", '{"a": {"z": "Int"}, "a-b": "Bool", "A": {"y": {"x": "Float?"}}}'),
)
DECLARATIONS = ("Int", "int", "INT?", "Int 64", "Int ?", "Int??", "?", "", "TimeStamp", "String", "String?", "String 0", "String -5", "String x", "String 5 6", "String? 50", "String 50?", "String +5", "String 4294967296", "Float", "Bool?", "Blob 12")
TREES = ('{"a": "Int"}', '["Int"]', '{"a": 7}', '{"a": {"b": null}}', '{"a": "Decimal"}', '{"a": {"b": "String"}}', '{"a": "Blob 0"}', '{"a": {"b": "Bool 1"}}', '{"%s": {"%s": "Int"}}' % ("a" * 32, "b" * 32), '{"a.b": "Int", "a": {"b": "Int"}}', '{"a": "Blob 4294967295", "b": "Int"}')
NAMES = ("", "id", "name.first", "größe", "x" * 64)
WATERMARK = 20_000
GROUP_CAP = 4096
DAMAGED_TXN = 700


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log's records."""
    e = _events(spark, sf_dir)
    return e.select((F.col("event_id") + 1).alias("seq"), F.expr("event_id div 7").alias("txn"), log.record_size(F.col("props")).alias("rec_len"), "event_type", F.expr("event_id % 3 + 1").alias("schema_seq"), "props")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.frame_layout(log.txn_summary(_records(spark, sf_dir)), "txn")


def schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for text in DECLARATIONS:
        try:
            t = DataType.parse(text)
            rows.append((text, t.name, t.size, t.nullable, t.width, None))
        except SchemaError as e:
            rows.append((text, None, None, None, None, type(e).__name__))
    return spark.createDataFrame(rows, "declaration string, type string, size bigint, nullable boolean, width bigint, error string")


def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole declarations, and why they cannot be used."""
    rows = []
    for i, text in enumerate(TREES):
        try:
            rows.append((i, len(Schema.from_json("t", text).fields), None))
        except SchemaError as e:
            rows.append((i, None, type(e).__name__))
    return spark.createDataFrame(rows, "tree int, n_fields int, error string")


def schema_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are stored."""
    return spark.createDataFrame([(n, encode_name(n).hex().upper()) for n in NAMES], "name string, stored string")


def _fields(spark: SparkSession) -> DataFrame:
    return layout_table(spark, [Schema.from_json(n, d) for n, d in SCHEMAS])


def schema_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark).select("schema", "ord", "name", "type", "nullable")


def schema_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths by the column rule, which must be the parser's."""
    return _fields(spark).withColumn("width", width_expr(F.col("type"), F.col("size"), F.col("nullable"))).select("schema", "name", "size", "width", "offset")


def record_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("seq", "rec_len")


def record_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which payloads would fit if each were repeated to about 4 MiB."""
    e = _events(spark, sf_dir)
    size = (codec.RECORD_HEADER + F.octet_length("props") * (F.lit(4194283) / 10 + F.col("event_id") % 3)).cast("long")
    return e.select((F.col("event_id") + 1).alias("seq"), size.alias("rec_len")).withColumn("fits", log.within_limit(F.col("rec_len")))


def record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded, a batch at a time."""
    source = _records(spark, sf_dir).select("seq", "schema_seq", F.col("props").cast("binary").alias("payload"))

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoded = codec.encode_column(b.column("seq"), b.column("schema_seq"), b.column("payload"))
            seq, schema_seq, payload = codec.decode_column(encoded)
            yield pa.RecordBatch.from_arrays([seq.cast(pa.int64()), schema_seq.cast(pa.int64()), payload.cast(pa.binary()).cast(pa.string()), pc.binary_length(encoded).cast(pa.int64())], names=["seq", "schema_seq", "payload", "rec_len"])

    return source.mapInArrow(there_and_back, "seq long, schema_seq long, payload string, rec_len long")


def record_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as it is stored."""
    source = _records(spark, sf_dir).select("seq", "schema_seq", F.col("props").cast("binary").alias("payload"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("seq"), codec.encode_column(b.column("seq"), b.column("schema_seq"), b.column("payload")).cast(pa.binary())], names=["seq", "stored"])

    return source.mapInArrow(encode, "seq long, stored binary").select("seq", F.hex("stored").alias("stored"))


def frame_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are frames and bytes that are none, and why."""
    good = codec.seal([codec.Record(1, 1, b"one"), codec.Record(2, 1, b"")])
    cases = {"whole": good, "with more behind": good + b"more", "empty body": codec.seal([]), "nothing": b"", "short": good[:23], "torn": good[:-1], "length under the least": (23).to_bytes(4, "little") + good[4:], "bit flipped": good[:30] + bytes([good[30] ^ 1]) + good[31:], "checksum flipped": good[:-1] + bytes([good[-1] ^ 1])}
    rows = []
    for name, data in cases.items():
        try:
            f = codec.Frame.decode(data)
            rows.append((name, "ok", f.length, sum(1 for _ in f.records())))
        except codec.CodecError as e:
            rows.append((name, type(e).__name__, None, None))
    return spark.createDataFrame(rows, "bytes string, state string, frame_len long, n_records long")


def txn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.txn_summary(_records(spark, sf_dir))


def txn_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.txn_columns(_records(spark, sf_dir)).select("seq", "txn", "txn_id", "txn_cnt")


def frame_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("txn", "frame_off", "frame_len", "min_seq", "max_seq")


def frame_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames sealed from whole transactions and decoded again, every tenth with one bit flipped."""
    txns = _records(spark, sf_dir).select("txn", "seq", "schema_seq", F.col("props").cast("binary").alias("payload"))
    dealt = txns.repartition("txn").sortWithinPartitions("txn", "seq")

    def check(table: pa.Table) -> pa.RecordBatch:
        txn, seq, schema_seq, payload = (table.column(c).combine_chunks() for c in ("txn", "seq", "schema_seq", "payload"))
        txn = txn.to_numpy(zero_copy_only=False)
        sealed = codec.seal_many(txn, seq, schema_seq, payload)
        txn = txn[np.flatnonzero(np.diff(txn, prepend=txn[0] - 1))]
        data, flipped = sealed.buf.copy(), txn % 10 == 9
        data[(sealed.starts + sealed.sizes // 2)[flipped]] ^= 1
        frames, _, _ = codec.frames_in(data)
        bad = np.zeros(len(frames), bool)
        bad[frames.damaged()] = True
        low, high = (pa.array(x.astype(np.int64), mask=bad) for x in (frames.least, frames.greatest))
        return pa.RecordBatch.from_arrays([pa.array(txn), pa.array(frames.sizes), pa.array(np.where(bad, "InvalidData", "ok")), low, high], names=["txn", "frame_len", "state", "min_seq", "max_seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the transaction that may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            numbers = table.column("txn").to_numpy()
            whole = int(np.searchsorted(numbers, numbers[-1])) if len(numbers) else 0
            if whole:
                yield check(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield check(rest)

    return dealt.mapInArrow(run, "txn long, frame_len long, state string, min_seq long, max_seq long")


def _write_log(spark: SparkSession, sf_dir: str) -> str:
    """The event log as files, a frame for each transaction."""
    path = place(spark, "log")
    r = _records(spark, sf_dir).select("seq", "schema_seq", F.col("props").cast("binary").alias("payload"), "txn")
    framelog.register(spark)
    r.repartitionByRange("txn").sortWithinPartitions("txn", "seq").write.format("framelog").option("by", "txn").mode("append").save(path)
    return path


def _numbers(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def log_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written and read back, as frames."""
    frames = spark.read.format("framelog").option("level", "frames").load(_write_log(spark, sf_dir))
    return _numbers(frames, "min_seq", "max_seq").select("frame_off", "frame_len", "min_seq", "max_seq", "n_records")


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written and read back, as records."""
    r = _numbers(spark.read.format("framelog").load(_write_log(spark, sf_dir)), "seq", "schema_seq")
    return r.select("seq", "schema_seq", F.col("payload").cast("string").alias("payload"), "frame_off")


def scan_damaged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of which one bit in the middle is flipped: the frames before."""
    path = _write_log(spark, sf_dir)
    hit = spark.read.format("framelog").option("level", "frames").load(path).where(F.col("min_seq") == 7 * DAMAGED_TXN + 1).select("frame_off").first()
    if hit:
        at = hit[0] + 30
        for f in framelog.log_files(path):
            if at < f.bytes:
                with open(f"{path}/{f.name}", "r+b") as file:
                    file.seek(at)
                    byte = file.read(1)[0]
                    file.seek(at)
                    file.write(bytes([byte ^ 1]))
                break
            at -= f.bytes
    return _numbers(framelog.read_valid(spark, path, "frames"), "min_seq", "max_seq").select("frame_off", "frame_len", "min_seq", "max_seq")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).withColumn("max_seq", F.when(F.col("txn") == DAMAGED_TXN, F.lit(5)).otherwise(F.col("max_seq")))


def scan_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.scan_valid_prefix(_damaged(spark, sf_dir), order="txn").select("txn", "frame_off", "frame_len", "max_seq")


def scan_valid_prefix_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the least numbers as key, the same damage goes unnoticed."""
    return log.scan_valid_prefix(_damaged(spark, sf_dir), "min_seq", order="txn").select("txn", "frame_off", "frame_len", "max_seq")


def scan_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = log.scan_valid_prefix(_damaged(spark, sf_dir), order="txn", diagnostics=True)
    return judged.groupBy("scanned", "stop_reason").agg(F.count("*").alias("n_frames"), F.min("txn").alias("first_txn"))


def visible_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.visible(_frames(spark, sf_dir), WATERMARK).select("txn", "frame_off", "frame_len")


def visible_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fenced reads of 1,000 bytes at the frames' starts return."""
    return _frames(spark, sf_dir).select("txn", log.visible_read_length(F.col("frame_off"), F.lit(1000), WATERMARK).alias("n_read"))


def truncate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log cut at a byte, in the middle of a frame, and read again."""
    path = _write_log(spark, sf_dir)
    framelog.truncate(path, WATERMARK)
    frames = spark.read.format("framelog").option("level", "frames").load(path)
    return log.log_stats(_numbers(frames, "max_seq"))


def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.log_stats(_frames(spark, sf_dir))


def read_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    data = F.col("props").cast("binary")
    return e.select("event_id", log.read_at(data, 3, 5).cast("string").alias("piece"), log.read_at(data, 1000, 5).cast("string").alias("beyond"))


def assign_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for all events in the order of event_id, going on after 1,000."""
    return log.assign_seq(_events(spark, sf_dir).select("event_id"), "event_id", 1000)


def append_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a log of half the events each, the second going on from the first, read back from its files."""
    e = _events(spark, sf_dir).select("event_id", F.col("props").cast("binary").alias("payload"))
    half = e.select(F.max("event_id")).first()[0] // 2
    path = place(spark, "log")
    _, last = ingest.append(e.where(F.col("event_id") <= half), path, "event_id")
    ingest.append(e.where(F.col("event_id") > half), path, "event_id")
    r = _numbers(spark.read.format("framelog").load(path), "seq")
    batch = F.when(F.col("seq") <= last, 1).otherwise(2).alias("batch")
    return r.groupBy(batch).agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.sum(log.record_size(F.col("payload"))).cast("long").alias("n_bytes"))


def group_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturated packing, one log per event type."""
    packed = log.group_commit(_records(spark, sf_dir).select(F.col("event_type").alias("log"), "seq", "rec_len"), GROUP_CAP)
    return log.sealed(packed)


def schema_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas written into a log as flagged records, and the records after them with the schemas they name."""
    path = place(spark, "log")
    first = spark.createDataFrame([(i, bytearray(index.schema_payload(n, d, i)), index.SCHEMA_FLAG) for i, (n, d) in enumerate(SCHEMAS[:2])], "event_id long, payload binary, schema_seq long")
    ingest.append(first, path, "event_id")
    ingest.append(_records(spark, sf_dir).select((F.col("seq") + 10).alias("event_id"), F.col("props").cast("binary").alias("payload"), "schema_seq"), path, "event_id")
    r = _numbers(spark.read.format("framelog").load(path), "seq", "schema_seq")
    return index.schema_resolve(index.data_in(r), index.schemas_in(r)).select("seq", "schema_seq", "schema", "version")


def index_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_bucket(_records(spark, sf_dir), F.col("event_type"), "event_type")


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By an index that is saved and read back."""
    path = place(spark, "index")
    index.save_index(_records(spark, sf_dir), F.col("event_type"), path)
    return index.search_saved(spark, path, "purchase")


def seq_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a map of numbers that is saved and read back: of the log, only the frames that have them."""
    path, saved = _write_log(spark, sf_dir), place(spark, "map")
    index.seq_map(spark.read.format("framelog").load(path)).write.parquet(saved)
    found = _numbers(index.fetch(spark, path, spark.read.parquet(saved), [1, 500, 10_000, 10_001]), "seq")
    return found.select("seq", F.expr("(seq - 1) div 7").alias("txn"), F.col("payload").cast("string").alias("props"))


def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a table with a primary key: every user's last event."""
    e = _events(spark, sf_dir).select((F.col("event_id") + 1).alias("seq"), "user_id", "event_type")
    return index.latest_per_key(e, "user_id")


def made_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made records, as many transactions as there are: what the generator promises of them."""
    made = log.generate(spark, 1000)
    sizes = made.groupBy("txn").agg(F.count("*").alias("n"), (F.max("seq") - F.min("seq") + 1).alias("width"))
    whole = made.agg(F.count("*").alias("n_records"), F.countDistinct("seq").alias("n_numbers"), F.max("seq").alias("last"))
    return sizes.agg(F.count("*").alias("n_txns"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum((F.col("n") != F.col("width")).cast("int")).cast("long").alias("n_gaps")).crossJoin(
        whole.select((F.col("n_records") == F.col("n_numbers")).alias("numbers_differ"), (F.col("n_records") == F.col("last")).alias("no_number_left_out"))
    )  # fmt: skip  both are one row


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sealed logs that overlap, the later one with a column more."""
    r = _records(spark, sf_dir)
    n = 600
    return index.compact([r.where(F.col("seq") <= n).select("seq", "rec_len"), r.where(F.col("seq") > n // 2).select("seq", "rec_len", "event_type")]).select("seq", "rec_len", "event_type")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        schema_types, schema_errors, schema_names, record_bytes, frame_errors, schema_flatten, schema_layout, record_size, record_limit, record_roundtrip, txn_summary, txn_columns, frame_layout, frame_verify, scan_valid_prefix, scan_valid_prefix_min, scan_diagnostics,
        visible_read, visible_bytes, truncate_log, log_stats, read_at, assign_seq, append_commit, group_commit, schema_resolve, index_bucket, index_search, seq_lookup, compact,
        log_frames, log_records, scan_damaged_log, latest_per_user, made_log,
    )
    return {f.__name__: f for f in every}


_R = "r AS (SELECT event_id + 1 AS seq, event_id // 7 AS txn, 21 + octet_length(encode(props)) AS rec_len, event_type, event_id % 3 + 1 AS schema_seq, props FROM events)"
_T = f"{_R}, t AS (SELECT txn, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS n_records, (24 + sum(rec_len))::BIGINT AS frame_len FROM r GROUP BY txn)"
_FRAMES = f"{_T}, f AS (SELECT *, coalesce(sum(frame_len) OVER (ORDER BY txn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS frame_off FROM t)"
_DAMAGED = f"{_FRAMES}, d AS (SELECT txn, frame_off, frame_len, min_seq, CASE WHEN txn = {DAMAGED_TXN} THEN 5 ELSE max_seq END AS max_seq FROM f)"


def _prefix(key: str) -> str:
    return f"{_DAMAGED}, k AS (SELECT *, {key} > coalesce(lag({key}) OVER (ORDER BY txn), 0) AS ok FROM d), p AS (SELECT *, bool_and(ok) OVER (ORDER BY txn ROWS UNBOUNDED PRECEDING) AS scanned FROM k)"


def _values(rows: list[tuple], columns: str) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


# What the schemas and declarations above must give: stated here, not computed by the parser.
_LAYOUT = [
    ("person", 0, "id", "Int", 8, False), ("person", 1, "name.first", "String", 64, False), ("person", 2, "name.last", "String", 64, True),
    ("reading", 0, "at", "Int", 8, False), ("reading", 1, "celsius", "Float", 8, False), ("reading", 2, "raw", "Blob", 16, False), ("reading", 3, "sensor", "String", 40, False), ("reading", 4, "valid", "Bool", 1, False),
    ("order", 0, "note", "String", 30, True), ("order", 1, "paid", "Bool", 1, True), ("order", 2, "qty", "Int", 8, True), ("order", 3, "sku", "String", 30, False),
    ("levels", 0, "A.y.x", "Float", 8, True), ("levels", 1, "a.z", "Int", 8, False), ("levels", 2, "a-b", "Bool", 1, False),
]
_PARSED = [
    ("Int", "Int", 8, False, 8, None), ("int", "Int", 8, False, 8, None), ("INT?", "Int", 8, True, 9, None), ("Int 64", None, None, None, None, "UnexpectedSize"), ("Int ?", None, None, None, None, "UnexpectedSize"),
    ("Int??", None, None, None, None, "UnknownType"), ("?", None, None, None, None, "UnknownType"), ("", None, None, None, None, "UnknownType"), ("TimeStamp", None, None, None, None, "UnknownType"),
    ("String", None, None, None, None, "MissingSize"), ("String?", None, None, None, None, "MissingSize"), ("String 0", None, None, None, None, "InvalidSize"), ("String -5", None, None, None, None, "InvalidSize"),
    ("String x", None, None, None, None, "InvalidSize"), ("String 5 6", None, None, None, None, "InvalidSize"), ("String? 50", "String", 50, True, 55, None), ("String 50?", None, None, None, None, "InvalidSize"),
    ("String +5", "String", 5, False, 10, None), ("String 4294967296", None, None, None, None, "InvalidSize"), ("Float", "Float", 8, False, 8, None), ("Bool?", "Bool", 1, True, 2, None), ("Blob 12", "Blob", 12, False, 17, None),
]
_TREES = [
    (0, 1, None), (1, None, "NotAnObject"), (2, None, "NotAnObject"), (3, None, "NotAnObject"), (4, None, "UnknownType"), (5, None, "MissingSize"), (6, None, "InvalidSize"), (7, None, "UnexpectedSize"),
    (8, None, "NameTooLong"), (9, None, "DuplicateName"), (10, None, "InvalidSize"),
]
_FRAME_STATES = [
    ("whole", "ok", 69, 2), ("with more behind", "ok", 69, 2), ("empty body", "ok", 24, 0), ("nothing", "UnexpectedEnd", None, None), ("short", "UnexpectedEnd", None, None), ("torn", "UnexpectedEnd", None, None),
    ("length under the least", "InvalidData", None, None), ("bit flipped", "InvalidData", None, None), ("checksum flipped", "InvalidData", None, None),
]


def _little(number: str, size: int) -> str:
    """A number's bytes as hexadecimal digits, the least first."""
    digits = f"lpad(to_hex({number}::BIGINT), {2 * size}, '0')"
    return "(" + " || ".join(f"substr({digits}, {2 * i - 1}, 2)" for i in range(size, 0, -1)) + ")"


_FIELDS = _values(_LAYOUT, "schema, ord, name, type, size, nullable")


def oracle_sql() -> dict[str, str]:
    width = "CASE WHEN type IN ('String', 'Blob') THEN 5 + size ELSE size + nullable::INT END"
    cap = GROUP_CAP
    return {
        "schema_types": f"SELECT declaration, type, size::BIGINT AS size, nullable::BOOLEAN AS nullable, width::BIGINT AS width, error FROM {_values(_PARSED, 'declaration, type, size, nullable, width, error')}",
        "schema_errors": f"SELECT tree::INT AS tree, n_fields::INT AS n_fields, error FROM {_values(_TREES, 'tree, n_fields, error')}",
        "schema_names": f"SELECT name, rpad(hex(encode(name)), 128, '0') AS stored FROM {_values([(n,) for n in NAMES], 'name')}",
        "record_bytes": f"WITH {_R} SELECT seq, {_little('rec_len', 4)} || '01' || {_little('seq', 8)} || {_little('schema_seq', 8)} || hex(encode(props)) AS stored FROM r",
        "frame_errors": f"SELECT bytes, state, frame_len::BIGINT AS frame_len, n_records::BIGINT AS n_records FROM {_values(_FRAME_STATES, 'bytes, state, frame_len, n_records')}",
        "schema_flatten": f"SELECT schema, ord, name, type, nullable FROM {_FIELDS}",
        "schema_layout": f"SELECT schema, name, size::BIGINT AS size, ({width})::BIGINT AS width, coalesce(sum({width}) OVER (PARTITION BY schema ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM {_FIELDS}",
        "record_size": f"WITH {_R} SELECT seq, rec_len FROM r",
        "record_limit": "SELECT event_id + 1 AS seq, trunc(21 + octet_length(encode(props)) * (4194283 / 10.0::DOUBLE + event_id % 3))::BIGINT AS rec_len, rec_len <= 4194304 AS fits FROM events",
        "record_roundtrip": f"WITH {_R} SELECT seq, schema_seq, props AS payload, rec_len FROM r",
        "txn_summary": f"WITH {_T} SELECT txn, min_seq, max_seq, n_records, frame_len FROM t",
        "txn_columns": f"WITH {_R} SELECT seq, txn, min(seq) OVER (PARTITION BY txn) AS txn_id, count(*) OVER (PARTITION BY txn) AS txn_cnt FROM r",
        "frame_layout": f"WITH {_FRAMES} SELECT txn, frame_off, frame_len, min_seq, max_seq FROM f",
        "frame_verify": f"WITH {_T} SELECT txn, frame_len, CASE WHEN txn % 10 = 9 THEN 'InvalidData' ELSE 'ok' END AS state, CASE WHEN txn % 10 <> 9 THEN min_seq END AS min_seq, CASE WHEN txn % 10 <> 9 THEN max_seq END AS max_seq FROM t",
        "scan_valid_prefix": f"WITH {_prefix('max_seq')} SELECT txn, frame_off, frame_len, max_seq FROM p WHERE scanned",
        "scan_valid_prefix_min": f"WITH {_prefix('min_seq')} SELECT txn, frame_off, frame_len, max_seq FROM p WHERE scanned",
        "scan_diagnostics": f"WITH {_prefix('max_seq')} SELECT scanned, CASE WHEN NOT ok THEN 'order' END AS stop_reason, count(*) AS n_frames, min(txn) AS first_txn FROM p GROUP BY ALL",
        "visible_read": f"WITH {_FRAMES} SELECT txn, frame_off, frame_len FROM f WHERE frame_off + frame_len <= {WATERMARK}",
        "visible_bytes": f"WITH {_FRAMES} SELECT txn, greatest(0, least(1000, {WATERMARK} - frame_off))::BIGINT AS n_read FROM f",
        "truncate_log": f"WITH {_FRAMES} SELECT count(*) AS n_frames, coalesce(sum(frame_len), 0)::BIGINT AS pos, max(max_seq) AS last_seq FROM f WHERE frame_off + frame_len <= {WATERMARK}",
        "log_stats": f"WITH {_T} SELECT count(*) AS n_frames, sum(frame_len)::BIGINT AS pos, max(max_seq) AS last_seq FROM t",
        "read_at": "SELECT event_id, substr(props, 4, 5) AS piece, substr(props, 1001, 5) AS beyond FROM events",
        "assign_seq": "SELECT event_id, 1000 + row_number() OVER (ORDER BY event_id) AS seq FROM events",
        "append_commit": "WITH m AS (SELECT max(event_id) // 2 AS half FROM events) SELECT CASE WHEN event_id <= half THEN 1 ELSE 2 END AS batch, min(event_id) + 1 AS min_seq, max(event_id) + 1 AS max_seq, sum(21 + octet_length(encode(props)))::BIGINT AS n_bytes FROM events, m GROUP BY 1",
        "group_commit": f"""WITH RECURSIVE {_R}, n AS (SELECT event_type AS log, seq, rec_len, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS i FROM r),
w AS (SELECT log, seq, rec_len, i, 0::BIGINT AS frame_no, 20 + rec_len AS fill FROM n WHERE i = 1
UNION ALL SELECT n.log, n.seq, n.rec_len, n.i, w.frame_no + CASE WHEN w.fill >= {cap} THEN 1 ELSE 0 END, CASE WHEN w.fill >= {cap} THEN 20 ELSE w.fill END + n.rec_len FROM w JOIN n ON n.log = w.log AND n.i = w.i + 1)
SELECT log, frame_no, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS n_appends, (sum(rec_len) + 24)::BIGINT AS frame_len FROM w GROUP BY 1, 2""",
        "schema_resolve": f"WITH {_R} SELECT seq + 2 AS seq, schema_seq, schema, version FROM r LEFT JOIN (VALUES (1, 'person', 0), (2, 'reading', 1)) s(schema_seq, schema, version) USING (schema_seq)",
        "index_bucket": f"WITH {_R} SELECT event_type, count(*) AS n_seq, min(seq) AS first_seq, max(seq) AS last_seq FROM r GROUP BY 1",
        "index_search": f"WITH {_R} SELECT seq FROM r WHERE event_type = 'purchase'",
        "seq_lookup": f"WITH {_R} SELECT seq, txn, props FROM r WHERE seq IN (1, 500, 10000, 10001)",
        "compact": f"WITH {_R} SELECT seq, rec_len, CASE WHEN seq > 300 THEN event_type END AS event_type FROM r",
        "log_frames": f"WITH {_FRAMES} SELECT frame_off, frame_len, min_seq, max_seq, n_records FROM f",
        "log_records": f"WITH {_FRAMES} SELECT seq, schema_seq, props AS payload, frame_off FROM r JOIN f USING (txn)",
        "scan_damaged_log": f"WITH {_FRAMES} SELECT frame_off, frame_len, min_seq, max_seq FROM f WHERE txn < {DAMAGED_TXN}",
        "latest_per_user": "SELECT max(event_id) + 1 AS seq, user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
        "made_log": "SELECT 1000::BIGINT AS n_txns, 2::BIGINT AS least, 20::BIGINT AS most, 0::BIGINT AS n_gaps, true AS numbers_differ, true AS no_number_left_out",
    }
