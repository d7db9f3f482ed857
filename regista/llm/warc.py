"""Web archives in ZIP packages: a writer of WARC records, and a reader that never extracts a package.

A package is a ZIP file of stored members: ``archive/data.warc.gz`` (WARC 1.1 records, each its own gzip member),
``indexes/index.cdxj`` (place and length of every record) and ``datapackage.json``. Each task writes packages of bounded size
as a stream; a table of the packages of the tasks that succeeded is what is read back, so files of lost or repeated attempts
are left aside.

The reader goes from ranges to ranges: the end of the file gives the central directory, by its ZIP64 record where the plain
one is full; the directory, read in pieces, gives the members (sizes and places beyond 32 bits from the ZIP64 extra field);
a member's local header gives where its bytes start; index lines give the records, which are dealt over all tasks and read
by range, neighbours at once. A package without an index has its WARC members walked record by record instead. Stored and
deflated indexes are read; WARC members must be stored, plain or gzip by record.

Records with equal payloads of ``SHARED`` bytes or more are written once: the smallest page_id (then url) is the response, the
others are revisits that name it, and their payload's length and digest come from the record they refer to.

Cases: a null html is an empty payload; null ids and urls are kept as nulls and come last (a url's line ends are written as %0D
and %0A, white space around it is not kept); rows that repeat an id, url and
html are one response and revisits of it; payloads of any length are written and read whole, one at a time; equal payloads
below ``SHARED`` bytes are all responses; an empty table gives no package and no row; other columns are not read. Packages
live in ``folder``, which driver and executors share, on any file system that Arrow opens by its address.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regista.llm.common import materialize, shared_dir

SHARED = 100
#: Bytes of a package after which a task begins another, of a read of neighbouring records, and of the index read by one row.
PACKAGE, READ, INDEX = 256 << 20, 4 << 20, 4 << 20
#: Bytes of records that one task reads.
TASK = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


# --- writing


def _record(row: dict) -> bytes:
    """One WARC record of a page."""
    html = (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + (b"" if row["refers"] else html)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if row['refers'] else 'response'}", f"WARC-Record-ID: <urn:uuid:{row['record']}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {row['url'].replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if row["url"] is not None else []
    lines += [f"WARC-Page-ID: {row['page_id']}"] if row["page_id"] is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{row['digest']}"]
    lines += [f"WARC-Refers-To: <urn:uuid:{row['refers']}>", f"WARC-Profile: {PROFILE}"] if row["refers"] else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """A package being written to a stream that cannot go back: sizes follow each member's bytes."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = opened(self.path)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self._open("archive/data.warc.gz")
        self.size, self.index = 0, io.BytesIO()

    def _open(self, name: str):
        return self.zip.open(zipfile.ZipInfo(name), "w", force_zip64=True)

    def add(self, row: dict) -> None:
        data = gzip.compress(_record(row), 6, mtime=0)
        self.member.write(data)
        said = {"url": row["url"], "digest": f"sha256:{row['digest']}", "filename": "data.warc.gz", "offset": str(self.size), "length": str(len(data))}
        self.index.write(f"{row['record']} {DATE[:4]} {json.dumps(said)}\n".encode())
        self.size += len(data)

    def close(self) -> None:
        self.member.close()
        for name, data in (("indexes/index.cdxj", self.index.getvalue()), ("datapackage.json", b'{"profile": "data-package", "wacz_version": "1.1.1"}')):
            with self._open(name) as member:
                member.write(data)
        self.zip.close()
        self.stream.close()


def shared_payloads(page: DataFrame, shared: int = SHARED) -> DataFrame:
    """Stored (head_digest, head_id, head_url, same) of the payloads that several pages hold: the page that keeps each, and how
    many rows repeat that page. Copies are merged where they lie before anything is sent."""
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.col("url").isNull().alias("u"), "url")
    rows = page.where(F.col("bytes") >= shared).groupBy("digest", "page_id", "url").count()
    heads = rows.groupBy("digest").agg(F.min(order).alias("head"), F.min_by("count", order).alias("same"), F.sum("count").alias("copies")).where("copies > 1")
    return materialize(heads.select(F.col("digest").alias("head_digest"), F.col("head.page_id").alias("head_id"), F.col("head.url").alias("head_url"), "same"), "heads")


def _named(digest: str, page_id: str, url: str) -> F.Column:
    """A UUID that follows from a record's payload, id and url."""
    text = F.md5(F.concat_ws("|", F.col(digest), F.coalesce(F.col(page_id).cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("u"), F.col(url)), F.lit("-"))))
    return F.concat_ws("-", *[F.substring(text, lo, n) for lo, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def write_packages(pages: DataFrame, folder: str | None = None, shared: int = SHARED, package: int = PACKAGE) -> DataFrame:
    """Write (page_id, url, html) rows to packages in ``folder``; a stored table of (path, records, bytes) is returned."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    html = F.coalesce("html", F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumns({"digest": F.sha2(html.cast("binary"), 256), "bytes": F.octet_length(html)})
    heads = shared_payloads(page, shared)
    known = page.join(heads.hint("merge"), (F.col("digest") == F.col("head_digest")) & (F.col("bytes") >= shared), "left")
    known = known.withColumn("is_head", F.col("head_digest").isNotNull() & F.col("page_id").eqNullSafe(F.col("head_id")) & F.col("url").eqNullSafe(F.col("head_url")))
    own, head = _named("digest", "page_id", "url"), _named("digest", "head_id", "head_url")
    rows = known.where("not (is_head and same > 1)").select("page_id", "url", "html", "digest", own.alias("record"), F.when(F.col("head_digest").isNotNull() & ~F.col("is_head"), head).alias("refers"))
    if not heads.where("same > 1").isEmpty():  # rows that repeat the response are merged and numbered, and the first stays it
        again = known.where("is_head and same > 1").groupBy("page_id", "url", "digest").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
        again = again.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
        rows = rows.unionByName(again.select("page_id", "url", "html", "digest", own.alias("record"), F.when(F.col("k") > 1, own).alias("refers")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for row in batch.slice(lo, 64).to_pylist():
                    now = now or _Package(folder)
                    # rows that repeat each other, and small equal ones, still are records of their own
                    row["record"] = row["record"] if not row["again"] else str(uuid.uuid5(uuid.UUID(row["record"]), f"{now.path}-{n}"))
                    now.add(row)
                    n += 1
                    if now.size >= package:
                        now.close()
                        yield _said(now, n)
                        now, n = None, 0
        if now:
            now.close()
            yield _said(now, n)

    def _said(done: _Package, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([done.path]), pa.array([n]), pa.array([done.size])], names=["path", "records", "bytes"])

    # only a response that others refer to needs a name that follows from its page
    rows = rows.withColumn("again", F.col("refers").isNotNull() | (F.octet_length(F.coalesce("html", F.lit(""))) < shared))
    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "packages")


# --- reading


class _Ranges:
    """A file read by ranges."""

    def __init__(self, path: str) -> None:
        system, where = opened(path)
        self.file = system.open_input_file(where)
        self.size = self.file.size()

    def __enter__(self) -> _Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, at: int, size: int) -> bytes:
        data = self.file.read_at(size, at)
        if len(data) < size:
            raise ValueError(f"{size} bytes asked for at {at}, {len(data)} found")
        return data


def directory(source: _Ranges) -> tuple[int, int, int]:
    """(place, size, entries) of the central directory, by the ZIP64 record where there is one."""
    tail = min(source.size, 22 + 65535 + 20)
    data, base = source.read(source.size - tail, tail), source.size - tail
    at = data.rfind(_END)
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):  # also in a comment
        at = data.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    entries, size, place = struct.unpack_from("<HII", data, at + 10)
    if at >= 20 and data[at - 20 : at - 16] == _LOCATOR64:
        where = struct.unpack_from("<Q", data, at - 12)[0]
        record = source.read(where, 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 record where its locator points")
        entries, size, place = struct.unpack_from("<QQQ", record, 32)
    elif place == 0xFFFFFFFF or size == 0xFFFFFFFF or entries == 0xFFFF:
        if base + at - size != place:
            raise ValueError("ZIP64 sizes without a ZIP64 record")
    return place, size, entries


def members(source: _Ranges) -> Iterator[dict]:
    """name, method, crc32, size, packed (size as it lies there) and header (place of the local header) of every member; the
    central directory is read in pieces."""
    place, left, entries = directory(source)
    held = b""
    for _ in range(entries):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            more = min(left, 1 << 20)
            if not more:
                raise ValueError("the central directory ends before its last entry")
            held, place, left = held + source.read(place, more), place + more, left - more
        if held[:4] != _ENTRY:
            raise ValueError("no entry of the central directory where one should be")
        flags, method, crc, packed, size = struct.unpack_from("<H", held, 8)[0], *struct.unpack_from("<H", held, 10), *struct.unpack_from("<III", held, 16)
        name_size, extra_size, comment_size = struct.unpack_from("<HHH", held, 28)
        header = struct.unpack_from("<I", held, 42)[0]
        name, extra = held[46 : 46 + name_size], held[46 + name_size : 46 + name_size + extra_size]
        while len(extra) >= 4:  # field 1 holds what is too long for 32 bits, in this order
            kind, n = struct.unpack_from("<HH", extra)
            field, extra = extra[4 : 4 + n], extra[4 + n :]
            if kind == 1:
                wide = [x[0] for x in struct.iter_unpack("<Q", field[: len(field) // 8 * 8])]
                size = wide.pop(0) if size == 0xFFFFFFFF else size
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
        held = held[46 + name_size + extra_size + comment_size :]
        yield {"name": name.decode("utf-8" if flags & 0x800 else "cp437"), "method": method, "crc32": crc, "size": size, "packed": packed, "header": header, "locked": bool(flags & 1)}


def first_byte(source: _Ranges, header: int) -> int:
    """Where a member's bytes start: after the local header, whose extra field has a length of its own."""
    data = source.read(header, 30)
    if data[:4] != _LOCAL:
        raise ValueError("no local header where the central directory points")
    return header + 30 + sum(struct.unpack_from("<HH", data, 26))


MEMBERS = "path string, name string, method int, crc32 long, size long, packed long, header long, start long"


def list_members(paths: DataFrame) -> DataFrame:
    """``MEMBERS`` of every package in ``paths`` (a column path): directories only, no member's content is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _Ranges(path) as source:
                    held = []
                    for m in members(source):
                        if not m.pop("locked"):
                            held.append({"path": path, **m, "start": first_byte(source, m["header"])})
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_pylist(held, _schema(MEMBERS))
                            held = []
                    yield pa.RecordBatch.from_pylist(held, _schema(MEMBERS))

    return paths.select("path").mapInArrow(run, MEMBERS)


def _schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])


PLACES = "path string, at long, length long, gz int"


def _lines(source: _Ranges, start: int, packed: int, method: int, lo: int, hi: int) -> Iterator[bytes]:
    """Lines of an index member that begin in [lo, hi) of its bytes; a deflated one is read from its start."""
    if method == 8:
        unpack, rest, at = zlib.decompressobj(-15), b"", 0
        while at < packed:
            n = min(READ, packed - at)
            *lines, rest = (rest + unpack.decompress(source.read(start + at, n))).split(b"\n")
            yield from lines
            at += n
        yield from (rest + unpack.flush()).split(b"\n")
        return
    at = lo
    if lo:  # the line under way belongs to the range before
        at -= 1
    rest, skip = b"", bool(lo)
    while at < packed:
        n = min(READ, packed - at)
        base, data = at - len(rest), rest + source.read(start + at, n)
        at += n
        pos = 0
        while (end := data.find(b"\n", pos)) >= 0:
            if not skip and base + pos >= hi:
                return
            if not skip:
                yield data[pos:end]
            skip, pos = False, end + 1
        rest = data[pos:]
        if base + pos >= hi and not skip:
            return
    if rest and not skip:
        yield rest


def locate_records(found: DataFrame) -> DataFrame:
    """``PLACES`` of the records of all packages by their indexes; of WARC members that no index of their package names, one
    row for the whole member (length as it lies there) whose records are walked. Long indexes are shared between tasks."""
    warc = found.where("method = 0 and (name like '%.warc' or name like '%.warc.gz')").select("path", F.element_at(F.split("name", "/"), -1).alias("file"), F.col("start").alias("data"), "packed", F.col("name").endswith(".gz").cast("int").alias("gz"))
    index = found.where("method in (0, 8) and (name like 'indexes/%.cdxj' or name like 'indexes/%.cdx')")
    index = index.withColumn("lo", F.explode(F.when(F.col("method") == 8, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("packed") - 1, F.lit(0)), F.lit(INDEX).cast("long")))))
    index = index.select("path", "start", "packed", "method", "lo", F.when(F.col("method") == 8, F.col("packed")).otherwise(F.col("lo") + INDEX).alias("hi")).repartition("path", "lo")
    fields = "path string, file string, at long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, packed, method, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                with _Ranges(path) as source:
                    held = []
                    for line in _lines(source, start, packed, method, lo, hi):
                        if b"{" not in line:
                            continue
                        said = json.loads(line[line.index(b"{") :])
                        held.append({"path": path, "file": said["filename"].rsplit("/", 1)[-1], "at": int(said["offset"]), "length": int(said["length"])})
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_pylist(held, _schema(fields))
                            held = []
                    yield pa.RecordBatch.from_pylist(held, _schema(fields))

    lines = index.mapInArrow(run, fields)
    # merged: both sides grow with the corpus, and what a task makes of its input cannot be known before
    named = lines.join(warc.hint("merge"), ["path", "file"]).select("path", (F.col("data") + F.col("at")).alias("at"), "length", "gz")
    walked = warc.join(index.select("path").distinct(), "path", "left_anti").select("path", F.col("data").alias("at"), F.col("packed").alias("length"), (F.col("gz") + 2).alias("gz"))
    return named.unionByName(walked)


RECORDS = "path string, at long, type string, record string, refers string, page_id long, url string, digest string, payload binary"


def parsed(record: bytes) -> dict:
    """Headers and payload of one WARC record."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where the index points")
    said = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
    block = block[: int(said["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in said.get("content-type", "") else block
    bare = lambda x: x[1:-1].removeprefix("urn:uuid:") if x else None
    page = said.get("warc-page-id")
    return {
        "type": said["warc-type"], "record": bare(said.get("warc-record-id")), "refers": bare(said.get("warc-refers-to")), "page_id": int(page) if page else None,
        "url": said.get("warc-target-uri"), "digest": said.get("warc-payload-digest"), "payload": payload,
    }


def _walked(source: _Ranges, at: int, length: int, gz: bool) -> Iterator[tuple[int, bytes]]:
    """(place, record) of the records of a member, one after the other."""
    end, place, data = at + length, at, b""  # data: read, but not yet used; place: what is read next
    while (base := place - len(data)) < end:
        if gz:
            unpack, record = zlib.decompressobj(31), []
            while not unpack.eof:
                if not data:
                    data = source.read(place, min(READ, end - place))
                    place += len(data)
                record.append(unpack.decompress(data))
                data = unpack.unused_data
            yield base, b"".join(record)
            continue
        while (head := data.find(b"\r\n\r\n")) < 0:
            data += (more := source.read(place, min(1 << 16, end - place)))
            place += len(more)
            if not more:
                raise ValueError("a WARC record without an end of its headers")
        said = {k.strip().lower(): v for k, v in (x.split(":", 1) for x in data[:head].decode().split("\r\n")[1:])}
        size = head + 4 + int(said["content-length"]) + 4
        if size > len(data):
            data += (more := source.read(place, size - len(data)))
            place += len(more)
        yield base, data[:size]
        data = data[size:]


def read_records(places: DataFrame) -> DataFrame:
    """``RECORDS`` at ``places``, read by range; records that lie side by side in one task are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, path_now, held, size = None, None, [], 0
        try:
            for path, spans in _spans(batches):
                if path != path_now:
                    if source:
                        source.file.close()
                    source, path_now = _Ranges(path), path
                if spans[0][2] > 1:
                    some = _walked(source, spans[0][0], spans[0][1], spans[0][2] == 3)
                else:
                    lo = spans[0][0]
                    data = source.read(lo, spans[-1][0] + spans[-1][1] - lo)
                    some = ((at, gzip.decompress(data[at - lo : at - lo + n]) if gz else data[at - lo : at - lo + n]) for at, n, gz in spans)
                for at, record in some:
                    held.append({"path": path, "at": at, **parsed(record)})
                    size += len(record)
                    if size > READ:
                        yield pa.RecordBatch.from_pylist(held, _schema(RECORDS))
                        held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, _schema(RECORDS))
        finally:
            if source:
                source.file.close()

    # ranges of the order (path, place): records stay neighbours, and one package is read by as many tasks as its bytes need
    tasks = (places.agg(F.sum("length")).first()[0] or 0) // TASK + 1
    return places.repartitionByRange(tasks, "path", "at").sortWithinPartitions("path", "at").mapInArrow(run, RECORDS)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Neighbouring places of one package, up to ``READ`` bytes; a longer record, or a member to walk, is alone."""
    now, held = None, []
    for batch in batches:
        for path, at, n, gz in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (path != now or gz > 1 or held[-1][2] > 1 or at != held[-1][0] + held[-1][1] or at + n - held[0][0] > READ):
                yield now, held
                held = []
            now = path
            held.append((at, n, gz))
    if held:
        yield now, held


def read_packages(paths: DataFrame) -> DataFrame:
    """``RECORDS`` of all packages in ``paths``."""
    return read_records(materialize(locate_records(materialize(list_members(paths), "members")), "places"))


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of each record; what a revisit leaves out comes
    from the response it refers to. The digest is that of the payload as read."""
    read = materialize(records.select("page_id", "url", "type", "record", "refers", F.octet_length("payload").cast("long").alias("bytes"), F.sha2(F.col("payload"), 256).alias("sha")), "records")
    referred = read.where("type = 'revisit'").select(F.col("refers").alias("record")).distinct()
    response = read.where("type = 'response'").join(referred, "record").select(F.col("record").alias("refers"), F.col("page_id").alias("to"), F.col("bytes").alias("n"), F.col("sha").alias("h"))
    known = read.where("type <> 'revisit'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "url")
    again = read.where("type = 'revisit'").join(response, "refers", "left")
    return known.unionByName(again.select("page_id", F.col("n").alias("payload_bytes"), F.col("h").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to").alias("refers_to"), "url"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to packages and read their records back."""
    return resolved(read_packages(write_packages(pages)))
