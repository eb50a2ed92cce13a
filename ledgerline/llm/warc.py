"""WARC archives: writing with revisit records, and reading in parallel with boundary-chain verification.

An uncompressed archive has no index, and a payload may hold what looks like the start of a record. So tasks that read
a range of a file report, for each candidate record in it, where the chain of records that starts there leaves the
range. Pointer jumping from the start of each file then keeps the range entries that a chain of records really
reaches, in rounds that grow with the logarithm of a file's ranges, and only from those are records read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_batches, file_system, make_folder, materialize, write_file

#: Payloads of at least so many bytes may be revisits.
REVISIT = 1000
#: Bytes of a file that are looked through at once, and ranges that a task has, about.
RANGE, RANGES = 4 << 20, 8
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = REVISIT) -> DataFrame:
    """Adds refers_to: the id of the record that this one revisits, or null. A column of that name is replaced.

    Of equal payloads of at least `least` bytes the record with the largest id is the response. Payloads are compared
    by SHA-256 and length; only those and the ids are grouped. Null payloads count as empty. A null id is a response
    only where no record of its payload has an id; then, and where several records have the largest id, all of these
    are responses, as nothing names one of them. Other columns stay, whatever their names. An empty table gives no rows.
    """
    taken = {c.lower() for c in pages.columns}
    size, digest, winner = (next(n for i in range(len(taken) + 1) if (n := f"_{x}{i}") not in taken) for x in ("size", "digest", "winner"))
    keyed = pages.withColumn(size, F.octet_length(F.coalesce(payload_col, F.lit("")))).withColumn(digest, F.when(F.col(size) >= least, F.sha2(F.coalesce(payload_col, F.lit("")), 256)))
    winners = keyed.filter(F.col(digest).isNotNull()).groupBy(digest, size).agg(F.max(id_col).alias(winner), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = keyed.join(materialize(winners), [digest, size], "left")
    return joined.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col(winner)), F.col(winner))).drop(digest, size, winner)


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One record. A revisit has the HTTP header of the full response, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(planned: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> int:
    """Write one archive a partition and return the number of records. A task that runs again replaces its file.

    planned has what plan_records returns. Null payloads are empty, null or empty urls are left out, a null id names an
    empty page. Rows that repeat an id, or all of a row, are records of their own. A table without rows makes an empty
    folder.
    """
    rows = bound_batches(planned).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), "refers_to")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [0]

        def records():
            for batch in batches:
                for page, url, payload, refers in zip(*(batch[c] for c in ("id", "url", "payload", "refers_to")), strict=True):
                    count[0] += 1
                    yield record(page.as_py(), url.as_py(), (payload.as_py() or "").encode("utf-8", "replace"), refers.as_py())

        source = records()
        first = next(source, None)
        if first is not None:

            def parts():
                yield first
                yield from source

            write_file(f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc", parts())
        yield pa.record_batch({"n": pa.array([count[0]], pa.int64())})

    make_folder(planned.sparkSession, folder)
    return rows.mapInArrow(task, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class _Range:
    """Bytes of a file by offset, read in steps."""

    def __init__(self, path: str, start: int, size: int):
        files, name = file_system(path)
        self.file = files.open_input_file(name)
        self.length, self.start = self.file.size(), start
        self.held = self._read(start, size)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(size, self.length - at)))

    def bytes_at(self, at: int, size: int) -> bytes:
        if at >= self.start and at + size <= self.start + len(self.held):
            return self.held[at - self.start : at - self.start + size]
        return self._read(at, size)

    def header_at(self, at: int) -> tuple[bytes, int] | None:
        """The header of a record that starts here and the offset of its block; None if there is no header."""
        size = 4096
        while True:
            head = self.bytes_at(at, size) if at + size <= self.length else self.bytes_at(at, max(0, self.length - at))
            end = head.find(b"\r\n\r\n")
            if end >= 0:
                return head[:end], at + end + 4
            if at + size >= self.length:
                return None
            size *= 4


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _successor(data: _Range, at: int) -> int | None:
    """Where the record at this offset ends, if there is a whole record."""
    found = data.header_at(at)
    if not found or not MAGIC.match(found[0] + b"\r\n"):
        return None
    length = _fields(found[0]).get("content-length", "")
    end = found[1] + int(length) + 4 if length.isdecimal() else None
    return end if end is not None and end <= data.length and data.bytes_at(end - 4, 4) == b"\r\n\r\n" else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*(batch[c].to_pylist() for c in ("path", "start", "end")), strict=True):
            data = _Range(path, start, end - start + 16)
            after = {}
            for m in MAGIC.finditer(data.held):
                if start + m.start() < end and (to := _successor(data, start + m.start())) is not None:
                    after[start + m.start()] = to
            leaves = {}
            for at in sorted(after, reverse=True):
                leaves[at] = leaves.get(after[at], after[at])
            yield pa.record_batch({"path": pa.array([path] * len(leaves), pa.string()), "at": pa.array(list(leaves), pa.int64()), "leaves": pa.array(list(leaves.values()), pa.int64())})


def range_entries(ranges: DataFrame, tasks: int) -> DataFrame:
    """ranges: path, start, end, length. Returns path, at: the first true record of each range that has one."""
    found = materialize(ranges.repartition(tasks, "path", "start").mapInArrow(_candidates, "path string, at long, leaves long"))
    entered = found.select("path", F.col("leaves").alias("at")).distinct()
    jump = materialize(found.join(entered, ["path", "at"], "left_semi").union(found.filter("at = 0")).distinct())
    nodes = jump.select("path", "at")
    reached = materialize(nodes.filter("at = 0"))
    count = reached.count()
    while True:
        onward = reached.join(jump, ["path", "at"]).select("path", F.col("leaves").alias("at")).join(nodes, ["path", "at"], "left_semi")
        reached = materialize(reached.union(onward).distinct())
        if (now := reached.count()) == count:
            return reached
        count = now
        jump = materialize(jump.join(jump.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("beyond")), ["path", "leaves"]).select("path", "at", F.col("beyond").alias("leaves")))


def _parse(data: _Range, at: int) -> tuple[dict, bytes, int]:
    found = data.header_at(at)
    if not found or not MAGIC.match(found[0] + b"\r\n"):
        raise ValueError(f"no record at {at}")
    head, block = found
    fields = _fields(head)
    size = int(fields["content-length"])
    return fields, data.bytes_at(block, size), block + size + 4


def read_warc(spark: SparkSession, folder: str, step: int = RANGE, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in a folder.

    Columns: path, at (offset), record_type, record_id, uri, refers_to, payload_bytes (of the full response),
    payload_sha1 (lower-case hex; of the payload itself for responses, from the header for revisits), and payload
    unless it is left out. A record whose payload does not match its digest, or a file that does not end with a whole
    record, is an error; an empty file or folder has no records. Only file names and sizes are listed; contents are read in ranges by the tasks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder).select("path", "length")
    # So many tasks as the bytes ask for: ranges are a few bytes each, and would else be packed into few tasks.
    total = files.agg(F.sum(F.ceil(F.col("length") / step))).first()[0] or 0
    tasks = max(1, min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGES))))
    starts = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("start"))
    ranges = materialize(starts.withColumn("end", F.least("length", F.col("start") + step)))
    reached = range_entries(ranges, tasks)
    if not ranges.select("path").distinct().join(reached, "path", "left_anti").isEmpty():
        raise ValueError(f"a file in {folder} does not begin with a record")
    entries = reached.withColumn("start", F.col("at") - F.col("at") % step)
    work = ranges.join(entries, ["path", "start"]).select("path", "start", "end", "length", "at").repartition(tasks, "path", "start")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, end, length, at in zip(*(batch[c].to_pylist() for c in ("path", "end", "length", "at")), strict=True):
                data, rows = _Range(path, at, end - at + 65536), []
                while at < end:
                    fields, block, after = _parse(data, at)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != stated:
                        raise ValueError(f"the record at {at} in {path} does not match its digest")
                    size = len(payload) if fields["warc-type"] == "response" else int(_fields(http)["content-length"])
                    rows.append((path, at, fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, stated, payload if with_payload else None))
                    at = after
                    if len(rows) == 500:
                        yield _batch(rows, with_payload)
                        rows = []
                if after == length or _successor(data, after) is not None:
                    yield _batch(rows, with_payload)
                else:
                    raise ValueError(f"{path} has no record at {after}")

    return work.mapInArrow(task, "path string, at long, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_sha1 string" + ", payload binary" * with_payload)


_TYPES = [("path", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("payload", pa.binary())]


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = _TYPES if with_payload else _TYPES[:-1]
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])
