"""``framelog``: the private log format as a Spark data source, and a reader through Spark's own files.

    spark.dataSource.register(FrameLog)
    spark.read.format("framelog").load(dir)                        # records
    spark.read.format("framelog").option("level", "frames").load(dir)
    df.write.format("framelog").mode("append").save(dir)           # seq, schema_seq, payload
    spark.readStream.format("framelog").load(dir)

A log is a directory of ``*.flog`` files, one after another: first those that no writer of ours made, by
name, then those that manifests list.  ``frame_off`` counts bytes from the log's beginning.  A manifest
keeps of every file its length, its first and last keys and places every 16 MB at which frames begin, so
files are read in parts, and each part knows the key before it.

Reading stops silently at the first frame that is damaged or whose key does not increase; ``visible_to``
fences the log by bytes, ``scan_key`` chooses max_seq (default) or min_seq, ``diagnostics`` adds the
stopping frame as a row with its reason (frames only), ``push`` lets a range of seq skip files.  What the
manifests tell (files cut off, keys that fall from file to file) ends the log for all tasks; damage that
only reading shows ends the part it is found in.  ``read_valid`` finds the first damage of the whole log and
reads what lies before it.

Writing: each task stages its own file; the driver's commit publishes a manifest that names the batch's
files by linking it under the next number, which fails if another writer was there first.  So a batch is
visible whole or not at all, and files of failed or repeated tasks are never read.  Overwriting and
truncating publish a manifest that replaces all before it; files it no longer names go afterwards.
Durability is that of the job's commit (staged files and the manifest are synced); there is no sync per
record.  The directory must be one that all executors share.  ``read_log`` reads by Spark's ``binaryFile``
instead and so works on any store.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from framelake.functions.codec import RECORD_HEADER, Batch, InvalidData, frames_in, record_columns, seal_many

RECORDS = "file string, frame_no bigint, frame_off bigint, seq decimal(20,0), schema_seq decimal(20,0), payload binary"
FRAMES = "file string, frame_no bigint, frame_off bigint, frame_len bigint, min_seq decimal(20,0), max_seq decimal(20,0), crc bigint, n_records bigint, stop_reason string"
GROUP_BYTES = 4 * 1024 * 1024
MARK_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20
PIECE_ROWS = 1 << 16  # of a batch of records that Spark is given
FULL_EVERY = 64  # manifests, of which one names all files
U64 = pa.decimal128(20, 0)

_RECORDS = pa.schema([("file", pa.string()), ("frame_no", pa.int64()), ("frame_off", pa.int64()), ("seq", U64), ("schema_seq", U64), ("payload", pa.binary())])
_FRAMES = pa.schema([("file", pa.string()), ("frame_no", pa.int64()), ("frame_off", pa.int64()), ("frame_len", pa.int64()), ("min_seq", U64), ("max_seq", U64), ("crc", pa.int64()), ("n_records", pa.int64()), ("stop_reason", pa.string())])

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class File:
    """What a manifest keeps of a file.  Keys: (least, greatest number) of a frame."""

    name: str
    bytes: int
    frames: int = -1  # not known
    least: int = 0  # of all records
    greatest: int = 0
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    marks: list[list[int]] = field(default_factory=list)  # offset, number, and the key before, of some frames


def scan(read: Read, start: int = 0, end: int | None = None, last: int = 0, scan_key: str = "max_seq", fence: int | None = None, block: int = BLOCK_BYTES) -> Iterator[tuple[int, Batch | None, str | None]]:
    """(offset, frames, None) for runs of frames of the valid prefix, then perhaps (offset, None, reason).

    ``read(offset, n)`` gives up to n bytes.  ``end``: no frame begins there or later; ``fence``: none reaches beyond.
    """
    at, want = start, block
    while end is None or at < end:
        data = np.frombuffer(read(at, want if fence is None else max(0, min(want, fence - at))), np.uint8)
        batch, to, why = frames_in(data)
        if end is not None and len(batch):
            batch = batch.head(int(np.searchsorted(batch.starts + at, end)))
        if not len(batch) and why is None:
            if len(data) >= 4:
                need = int(np.frombuffer(data[:4].tobytes(), "<u4")[0])
                if fence is not None and at + need > fence:
                    return
                if len(data) == want and need > want:  # a frame over the block
                    want = need
                    continue
            if len(data) and (fence is None or at + len(data) < fence):
                yield at, None, f"UnexpectedEnd: {len(data)} bytes"
            return
        want = block
        keys = batch.greatest if scan_key == "max_seq" else batch.least
        before = np.concatenate((np.array([last], np.uint64), keys[:-1]))
        late, broken = np.flatnonzero(keys <= before)[:1], batch.damaged()[:1]
        good = min([len(batch), *late.tolist(), *broken.tolist()])
        if good:
            yield at, batch.head(good), None
            last = int(keys[good - 1])
        if good < len(batch):
            reason = "InvalidData: checksum" if len(broken) and broken[0] == good else f"order: {int(keys[good])} after {last}"
            yield at + int(batch.starts[good]), None, reason
            return
        if why:
            yield at + to, None, why
            return
        at += int(batch.starts[-1] + batch.sizes[-1])


def arrow(name: str, base: int, number: int, level: str, runs: Iterator[tuple[int, Batch | None, str | None]], diagnostics: bool = False, keep: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """What ``scan`` gives as rows; ``base``: where the file begins in the log, ``number``: of the first frame."""
    for at, batch, why in runs:
        if batch is None:
            if diagnostics and level == "frames":
                yield pa.RecordBatch.from_pylist([{"file": name, "frame_no": number, "frame_off": base + at, "stop_reason": why}], _FRAMES)
            return
        numbers, offsets = number + np.arange(len(batch)), base + at + batch.starts
        number += len(batch)
        if level == "frames":
            records = np.bincount(batch.records()[0], minlength=len(batch))
            columns = [pa.repeat(name, len(batch)), numbers, offsets, batch.sizes, pa.array(batch.least).cast(U64), pa.array(batch.greatest).cast(U64), batch.crc.astype(np.int64), records, pa.nulls(len(batch), pa.string())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_FRAMES)
            continue
        if keep:
            some = np.flatnonzero((batch.greatest >= keep[0]) & (batch.least <= keep[1]))
            batch, numbers, offsets = batch.pick(some), numbers[some], offsets[some]
        frame, seq, schema_seq, payload = record_columns(batch)
        for i, n in _pieces(payload):
            of = frame[i : i + n]
            out = pa.RecordBatch.from_arrays([pa.repeat(name, n), pa.array(numbers[of]), pa.array(offsets[of]), seq.slice(i, n).cast(U64), schema_seq.slice(i, n).cast(U64), _binary(payload, i, n)], schema=_RECORDS)
            if keep:
                values = seq.slice(i, n).to_numpy(zero_copy_only=False)
                out = out.filter(pa.array((values >= keep[0]) & (values <= keep[1])))
            if out.num_rows:
                yield out


def _pieces(payload: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of up to PIECE_ROWS values that together have up to a block's bytes, or one value: a
    frame may hold more records and bytes than one Arrow array can."""
    at, offs = 0, np.frombuffer(payload.buffers()[1], np.int64)
    while at < len(payload):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK_BYTES, "right")) - 1)
        n = min(to - at, PIECE_ROWS, len(payload) - at)
        yield at, n
        at += n


def _binary(payload: pa.Array, at: int, n: int) -> pa.Array:
    """``n`` values of a large binary array as a binary array, without copying them."""
    _, offs, data = payload.buffers()
    offs = np.frombuffer(offs, np.int64)[at : at + n + 1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offs - offs[0]).astype(np.int32).tobytes()), data.slice(offs[0], offs[-1] - offs[0])])


def opener(path: str, most: int | None = None) -> Read:
    """Positional reads of a file, of which bytes from ``most`` on do not count."""
    file = open(path, "rb")  # noqa: SIM115  closed with the task

    def read(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n if most is None else max(0, min(n, most - offset)))

    return read


def _numbers(path: str) -> list[int]:
    return sorted(int(m[1]) for m in (re.fullmatch(r"(\d{12})\.manifest", n) for n in os.listdir(path)) if m)


def manifest(path: str, number: int) -> dict:
    with open(os.path.join(path, f"{number:012d}.manifest")) as f:
        return json.load(f)


def latest(path: str) -> tuple[int, dict]:
    """Number and content of the last manifest (0 and empty for none): last_seq, streams."""
    numbers = _numbers(path) if os.path.isdir(path) else []
    return (numbers[-1], manifest(path, numbers[-1])) if numbers else (0, {})


def log_files(path: str) -> list[File]:
    """The log's files in order."""
    listed: list[File] = []
    replaced = False
    for number in reversed(_numbers(path)):
        m = manifest(path, number)
        listed = [File(**f) for f in m["files"]] + listed
        if m.get("replace"):
            replaced = True
            break
    names = {f.name for f in listed}
    plain = [] if replaced else sorted(n for n in os.listdir(path) if n.endswith(".flog") and not n.startswith("staged-") and n not in names)
    return [*(File(n, os.path.getsize(os.path.join(path, n))) for n in plain), *listed]


def committed(path: str) -> list[str]:
    return [os.path.join(path, f.name) for f in log_files(path)]


def publish(path: str, expected: int, content: dict) -> None:
    """Make ``content`` the manifest after number ``expected``; an error if that one is no longer the last."""
    number = expected + 1
    target = os.path.join(path, f"{number:012d}.manifest")
    staged = f"{target}.new-{uuid.uuid4().hex}"
    with open(staged, "w") as f:
        json.dump(content, f)
        f.flush()
        os.fsync(f.fileno())
    try:
        if _numbers(path)[-1:] not in ([], [expected]):
            raise FileExistsError(target)
        os.link(staged, target)
    except FileExistsError:
        raise RuntimeError(f"another writer has committed to {path}") from None
    finally:
        os.unlink(staged)
    sync_folder(path)


def vacuum(path: str) -> list[str]:
    """Remove what no reader can need any more: manifests before the last that replaces all, and files that none lists."""
    numbers, keep = _numbers(path), {f.name for f in log_files(path)}
    full = [n for n in numbers if manifest(path, n).get("replace")][-1:]
    if not full:
        return []
    gone = [f"{n:012d}.manifest" for n in numbers if n < full[0]] + [n for n in os.listdir(path) if n.endswith(".flog") and n not in keep]
    for n in gone:
        os.remove(os.path.join(path, n))
    return gone


def truncate(path: str, offset: int) -> None:
    """Cut a log at a byte: what lies beyond is not read any more.  Beyond the log's end is an error."""
    files, kept, at = log_files(path), [], 0
    end = sum(f.bytes for f in files)
    if not 0 <= offset <= end:
        raise ValueError(f"cannot cut at {offset}, the log has {end} bytes")
    for f in files:
        if at >= offset:
            break
        if at + f.bytes > offset:
            cut = offset - at
            f = replace(f, bytes=cut, frames=-1, marks=[m for m in f.marks if m[0] < cut], last=[], **_reach(os.path.join(path, f.name), cut))
        kept.append(f)
        at += f.bytes
    number, content = latest(path)
    content = content | {"files": [asdict(f) for f in kept], "replace": True, "last_seq": max([f.greatest for f in kept], default=0)}
    publish(path, number, content)
    vacuum(path)


def _reach(path: str, most: int) -> dict:
    """Least and greatest number in a file's first bytes."""
    batches = [b for _, b, _ in scan(opener(path, most)) if b is not None]
    return {"least": int(min((b.least.min() for b in batches), default=0)), "greatest": int(max((b.greatest.max() for b in batches), default=0))}


def last_seq(path: str) -> int:
    """The greatest number committed (0 for a new log): from the last manifest, and of files without any by reading."""
    if not os.path.isdir(path):
        return 0
    plain = [f for f in log_files(path) if f.frames < 0 and not f.greatest]
    return max([latest(path)[1].get("last_seq", 0), *(_reach(os.path.join(path, f.name), f.bytes)["greatest"] for f in plain)])


@dataclass
class Part(InputPartition):
    """Some frames of a file: those that begin in start..end."""

    path: str = ""
    name: str = ""
    base: int = 0  # of the file in the log
    bytes: int = 0
    start: int = 0
    end: int | None = None
    number: int = 0
    last: int = 0
    fence: int | None = None


def parts(path: str, files: list[File], options: dict, keep: tuple[int, int] | None = None, base: int = 0, last: int = 0) -> list[Part]:
    """The log, as far as files' lengths and manifests' keys tell that it is valid, in parts."""
    out, fence = [], options.get("visible_to")
    by = 1 if options.get("scan_key", "max_seq") == "max_seq" else 0
    for f in files:
        where = os.path.join(path, f.name)
        inside = int(fence) - base if fence else None
        if inside is not None and inside <= 0:
            break
        if f.first and f.first[by] <= last:
            # the log ends here; the first part says so
            out.append(Part(where, f.name, base, f.bytes, 0, 1, 0, last, inside))
            break
        begins = [[0, 0, last, last], *f.marks]
        for (start, number, *key), after in zip(begins, [*f.marks, None], strict=True):
            if not (keep and f.frames >= 0 and (f.greatest < keep[0] or f.least > keep[1])):
                out.append(Part(where, f.name, base, f.bytes, start, after[0] if after else None, number, key[by], inside))
        if os.path.getsize(where) < f.bytes:
            break  # its last part finds the torn frame
        base += f.bytes
        last = f.last[by] if f.last else 0
    return out


class Reader(DataSourceReader):
    keep: tuple[int, int] | None = None

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.options = path, options

    def partitions(self) -> list[Part]:
        if os.path.isdir(self.path):
            return parts(self.path, log_files(self.path), self.options, self.keep) or [Part()]
        folder, name = os.path.split(self.path)
        return parts(folder, [File(name, os.path.getsize(self.path))], self.options, self.keep) or [Part()]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from rows(partition, self.options, self.keep)


def rows(p: Part, options: dict, keep: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    if p.path:
        runs = scan(opener(p.path, p.bytes), p.start, p.end, p.last, options.get("scan_key", "max_seq"), p.fence)
        yield from arrow(p.name, p.base, p.number, options.get("level", "records"), runs, options.get("diagnostics", "false").lower() == "true", keep)


class PushingReader(Reader):
    """Skips files, frames and records outside a range of numbers.

    Used with option ``push`` only, as Spark refuses such readers unless
    spark.sql.python.filterPushdown.enabled is set.
    """

    def pushFilters(self, filters: list) -> Iterator:
        low, high = 0, (1 << 64) - 1
        for f in filters:
            if type(f) not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) or f.attribute != ("seq",) or self.options.get("level", "records") != "records" or int(f.value) != f.value:
                yield f
                continue
            value = int(f.value)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = max(low, value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = min(high, value - isinstance(f, LessThan))
        self.keep = (low, max(high, 0)) if low <= high and high >= 0 and low < 1 << 64 else (1, 0)


class Staged(WriterCommitMessage):
    def __init__(self, file: dict | None) -> None:
        self.file = file


def sync_folder(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


class Writer(DataSourceArrowWriter):
    """Groups a task's records into frames of up to ``group_bytes`` before the last is added.

    ``by``: a column instead; records side by side that are equal in it are one frame, a transaction.
    ``stream`` and ``batch``: the batch's number in a stream, kept by the manifest in the commit itself.
    """

    def __init__(self, path: str, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.batch = path, overwrite, uuid.uuid4().hex
        self.group, self.by = int(options.get("group_bytes", GROUP_BYTES)), options.get("by")
        self.stream = {options["stream"]: int(options["batch"])} if "stream" in options else {}
        if not os.path.isdir(os.path.dirname(os.path.abspath(path))):
            raise FileNotFoundError(f"no folder {os.path.dirname(os.path.abspath(path))}")
        os.makedirs(path, exist_ok=True)
        self.expected = latest(path)[0]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        out, name, rest = None, f"staged-{self.batch}-{uuid.uuid4().hex}.flog", None
        file, columns = File(name, 0), ["seq", "schema_seq", "payload", *([self.by] if self.by else [])]
        for batch in iterator:
            table = pa.Table.from_batches([batch.select(columns)])
            if any(table.column(c).null_count for c in range(3)):
                raise InvalidData("seq, schema_seq and payload must not be null")
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.nbytes >= BLOCK_BYTES:
                out = out or open(os.path.join(self.path, name), "wb")  # noqa: SIM115
                rest, file = self._seal(out, rest, file, False)
        if rest is not None and rest.num_rows:
            out = out or open(os.path.join(self.path, name), "wb")  # noqa: SIM115
            _, file = self._seal(out, rest, file, True)
        if out is None:
            return Staged(None)
        out.flush()
        os.fsync(out.fileno())
        out.close()
        return Staged(asdict(file))

    def _seal(self, out, table: pa.Table, file: File, final: bool) -> tuple[pa.Table, File]:
        """Write whole frames; the last one waits for more records unless ``final``."""
        table = table.combine_chunks()
        payload = table.column("payload").combine_chunks()
        size = pc.binary_length(payload).to_numpy(zero_copy_only=False).astype(np.int64) + RECORD_HEADER
        frame = _grouped(size, self.group)
        if self.by:
            codes = pc.dictionary_encode(table.column(self.by).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            frame = np.cumsum(np.concatenate(([0], codes[1:] != codes[:-1])))
        n = len(frame) if final else int(np.searchsorted(frame, frame[-1]))
        if not n:
            return table, file
        unsigned = lambda c: table.column(c).combine_chunks().cast(pa.uint64()).slice(0, n)
        b = seal_many(frame[:n], unsigned("seq"), unsigned("schema_seq"), payload.slice(0, n))
        out.write(b.buf)
        key = lambda i: [int(b.least[i]), int(b.greatest[i])]
        marks, since = list(file.marks), file.marks[-1][0] if file.marks else 0
        for i in np.flatnonzero(np.diff((file.bytes + b.starts - since) // MARK_BYTES, prepend=(file.bytes - since) // MARK_BYTES)).tolist():
            before = key(i - 1) if i else file.last
            if before:
                marks.append([file.bytes + int(b.starts[i]), file.frames + 1 + i if file.frames < 0 else file.frames + i, *before])
        known = file.frames >= 0
        least, greatest = int(b.least.min()), int(b.greatest.max())
        return table.slice(n), File(file.name, file.bytes + len(b.buf), max(file.frames, 0) + len(b), min(least, file.least) if known else least, max(greatest, file.greatest), file.first or key(0), key(-1), marks)

    def commit(self, messages: list) -> None:
        files = sorted((File(**m.file) for m in messages if m and m.file), key=lambda f: (f.least, f.name))
        _, before = latest(self.path)
        if not files and not self.overwrite and not self.stream:
            return
        content = {"last_seq": max([0 if self.overwrite else last_seq(self.path), *(f.greatest for f in files)]), "streams": before.get("streams", {}) | self.stream}
        full = self.overwrite or (self.expected + 1) % FULL_EVERY == 0
        if full and not self.overwrite:
            files = log_files(self.path) + files
        publish(self.path, self.expected, content | {"files": [asdict(f) for f in files], "replace": full})
        if self.overwrite:
            vacuum(self.path)

    def abort(self, messages: list) -> None:
        for n in os.listdir(self.path):
            if n.startswith(f"staged-{self.batch}"):
                os.remove(os.path.join(self.path, n))


def _grouped(size: np.ndarray, cap: int) -> np.ndarray:
    """Frame numbers of records in a row: a frame takes records while it is under ``cap`` before taking."""
    total, out, at, number = np.concatenate(([0], np.cumsum(size))), np.empty(len(size), np.int64), 0, 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] + cap - 20, "left")))
        out[at:to] = number
        at, number = min(to, len(size)), number + 1
    return out


class StreamReader(DataSourceStreamReader):
    """Offsets are the number of committed files, read by as many tasks as they have parts.  A log that is
    overwritten or cut meanwhile ends the stream with an error."""

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.options = path, options

    def initialOffset(self) -> dict:
        return {"files": 0, "bytes": 0}

    def latestOffset(self) -> dict:
        files = log_files(self.path) if os.path.isdir(self.path) else []
        return {"files": len(files), "bytes": sum(f.bytes for f in files)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        files = log_files(self.path)
        if sum(f.bytes for f in files[: end["files"]]) != end["bytes"]:
            raise RuntimeError(f"{self.path} is no longer the log that was read")
        by = 1 if self.options.get("scan_key", "max_seq") == "max_seq" else 0
        before = files[start["files"] - 1].last if start["files"] else []
        return parts(self.path, files[start["files"] : end["files"]], self.options, base=start["bytes"], last=before[by] if before else 0)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from rows(partition, self.options)


class FrameLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framelog"

    def schema(self) -> str:
        return FRAMES if self.options.get("level", "records") == "frames" else RECORDS

    def reader(self, schema) -> Reader:
        options = dict(self.options)
        kind = PushingReader if options.get("push", "false").lower() == "true" else Reader
        return kind(options["path"], options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], dict(self.options), overwrite)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"], dict(self.options))


def read_valid(spark: SparkSession, path: str, level: str = "records", **options: str) -> DataFrame:
    """The valid prefix of the whole log: one pass over the frames finds the first that ends it."""
    register(spark)
    load = lambda **more: spark.read.format("framelog").options(**options, **more).load(path)
    stop = load(level="frames", diagnostics="true").where("stop_reason is not null").agg(F.min("frame_off")).first()[0]
    if stop is None:
        return load(level=level)
    if stop == 0:
        return load(level=level).where("false")
    return load(level=level, **{"visible_to": str(min(stop, int(options.pop("visible_to", stop))))})


def read_log(spark: SparkSession, path: str, level: str = "records", **options: str) -> DataFrame:
    """The same rows from any store Spark reads.  Each file is held whole by its task, is a log of its own, and
    may have up to 2 GB, the limit of a value."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fence = options.get("visible_to")
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                runs = scan(lambda at, n, d=data: d[at : at + n], 0, None, 0, options.get("scan_key", "max_seq"), int(fence) if fence else None)
                yield from arrow(name, 0, 0, level, runs, options.get("diagnostics", "false").lower() == "true")

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(parse, FRAMES if level == "frames" else RECORDS)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameLog)
