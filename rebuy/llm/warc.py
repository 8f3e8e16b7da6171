"""Sharded WARC archives: deterministic writer, manifest, and reader.

Records are range-sorted by (id, url, payload digest). The cut points are quantiles, weighted by
size, of a sample of keys drawn by a hash, so the ranges depend on the rows alone and not on how
Spark dealt them; each range is written by one task, which rolls to a new file once ``roll_bytes``
compressed bytes are reached. Headers, record ids and digests are derived from the row, every
record is a gzip member of its own without a time stamp: the same rows give the same files.

Of records with equal payloads of ``min_revisit`` bytes or more, the one with the largest (id, url)
is the response and all others are revisits of it. Equality is decided by SHA-256, the digest in
the header is SHA-1. Who revisits whom is settled on a table of keys; those decisions travel in
the sort just ahead of their rows, so payloads are shuffled once and never joined.

Commit: a task writes under names that no other attempt uses; only files that a finished task
reports get their final name, in a second job whose renaming may be repeated; last, Spark commits
the manifest. Readers open what the manifest lists, check sizes and digests, and fail on a
manifest that lacks rows, so a lost executor or driver leaves no half archive that reads as whole.

Files are written and read with ``pyarrow.fs``, in any store it knows (local or shared folders,
HDFS, S3, GCS). A task holds one Arrow batch of rows (``BATCH`` rows) and one record.

Defined cases: a null payload counts as empty and is always a response (if ``min_revisit`` is above
0). Null ids and urls have no header line and read back as null; null ids sort first, so a group
has a null ``refers_to`` only if all its ids are null. Of rows equal in id, url and payload, the
first is the record that the others revisit. Control characters and spaces of urls are
percent-encoded. An empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rebuy.llm.common import count_not_above, partitions_of
from rebuy.session import materialize

# A range holds a 200th of all bytes, but not fewer or more bytes than this.
LEAST_RANGE, MOST_RANGE = 4 << 20, 1 << 30
SAMPLE_PER_RANGE = 16
HEAVY_SHARE = 200  # a payload that more than a 200th of all rows share is looked up by broadcast (at most 200 of them)
ROW_BYTES = 600  # headers of a record, about
BATCH = 256
MANIFEST = "file string, staged string, range_id int, seq int, records long, revisits long, bytes long, crc32 long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _keys(df: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    payload = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    size = F.octet_length(payload).cast("long")
    return df.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.sha1(payload).alias("sha1"),
        size.alias("bytes"),
        F.when(size >= min_revisit, F.unhex(F.sha2(payload, 256))).alias("same"),
    )


def _ranges(keys: DataFrame, total: int, size: int) -> DataFrame:
    """One row with the ascending cut points between ranges."""
    width = min(max(size // 200, LEAST_RANGE), MOST_RANGE)
    wanted = max(1, -(-size // width))
    share = min(1.0, wanted * SAMPLE_PER_RANGE / max(total, 1))
    key = ["id", "url", "sha1"]
    drawn = keys.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = drawn.distinct().orderBy(*[F.col(c).asc_nulls_first() for c in key]).collect()
    weight = sum(r.bytes + ROW_BYTES for r in rows) / wanted
    cuts, filled = [], 0
    for before, row in zip(rows, rows[1:]):
        filled += before.bytes + ROW_BYTES
        if filled >= (len(cuts) + 1) * weight and len(cuts) < wanted - 1:
            cuts.append((row.id, row.url, row.sha1))
    id_type = keys.schema["id"].dataType.simpleString()
    return keys.sparkSession.createDataFrame([(cuts,)], f"cuts array<struct<id:{id_type},url:string,sha1:string>>")


def _revisits(keys: DataFrame, total: int) -> DataFrame:
    """Keys of records that revisit another one: id, url, sha1 and the record they refer to."""
    groups = keys.filter("same is not null").groupBy("same").agg(F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1"), "warc-groups")
    heavy = F.col("n") > total // HEAVY_SHARE
    few, rest = F.broadcast(groups.filter(heavy)), groups.filter(~heavy)
    member = keys.filter("same is not null")
    paired = member.join(few, "same").unionByName(member.join(few, "same", "left_anti").join(rest, "same"))
    return paired.filter(~(F.col("id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url")))).select(
        "id", "url", "sha1", "first"
    )


def _header(value: str) -> str:
    return quote(value, safe="".join(map(chr, range(33, 127))).replace("%", ""))


def _url(value: str) -> str:
    return "".join(quote(c) if ord(c) <= 32 or ord(c) == 127 else c for c in value)


def record_id(row_id: object, url: str | None, sha1: str, copy: int = 0) -> str:
    name = json.dumps([None if row_id is None else str(row_id), url, sha1, copy])
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name.encode()).digest()[:16], version=5)}>"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + hashlib.sha1(data).hexdigest()


class _Shards:
    """The files of one task: opened under a name of this attempt, rolled by compressed size."""

    def __init__(self, folder: str, roll_bytes: int, date: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.roll, self.date, self.attempt = roll_bytes, date, uuid.uuid4().hex
        self.out, self.done, self.range, self.seq = None, [], None, 0

    def put(self, range_id: int, member: bytes, revisit: bool) -> None:
        if range_id != self.range:
            self.close()
            self.range, self.seq = range_id, 0
        if self.out is None:
            self.name = f"{range_id:06d}-{self.seq:05d}.warc.gz"
            self.staged = f"{self.name}.{self.attempt}"
            self.out = self.store.open_output_stream(f"{self.folder}/{self.staged}", compression=None)
            self.size = self.crc = self.records = self.revisits = 0
            info = f"format: WARC File Format 1.1\r\nisPartOf: range {range_id}, file {self.seq}\r\n".encode()
            self._write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "")), ("WARC-Date", self.date),
                                 ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._write(member)
        self.records += 1
        self.revisits += revisit
        if self.size >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.crc = zlib.crc32(data, self.crc)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.staged, self.range, self.seq, self.records, self.revisits, self.size, self.crc))
            self.out, self.seq = None, self.seq + 1

    def finished(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.done), types)], names)
            self.done = []


def _writer(folder: str, roll_bytes: int, min_revisit: int, date: str, content_type: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, key, refers, copies = _Shards(folder, roll_bytes, date), None, None, 0
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            payloads = column["payload"].cast(pa.binary())
            small = zip(*(column[c].to_pylist() for c in ("range_id", "id", "url", "sha1", "decision", "first")))
            for place, (range_id, row_id, url, sha1, decision, first) in enumerate(small):
                if (row_id, url, sha1) != key:
                    key, refers, copies = (row_id, url, sha1), None, 0
                if decision:
                    refers = first
                    continue
                payload = payloads[place].as_py() or b""
                target = refers
                if target is None and copies and len(payload) >= min_revisit:
                    target = {"id": row_id, "url": url}
                http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                block = http if target else http + payload
                fields = [("WARC-Type", "revisit" if target else "response"), ("WARC-Record-ID", record_id(row_id, url, sha1, copies)), ("WARC-Date", date)]
                if url is not None:
                    fields.append(("WARC-Target-URI", _url(url)))
                if row_id is not None:
                    fields.append(("X-Source-Id", _header(str(row_id))))
                if target:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(target["id"], target["url"], sha1)), ("WARC-Refers-To-Date", date)]
                    if target["url"] is not None:
                        fields.append(("WARC-Refers-To-Target-URI", _url(target["url"])))
                    if target["id"] is not None:
                        fields.append(("X-Refers-To-Source-Id", _header(str(target["id"]))))
                fields += [("WARC-Payload-Digest", "sha1:" + sha1), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
                shards.put(range_id, _member(fields, block), bool(target))
                copies += 1
            yield from shards.finished()
        shards.close()
        yield from shards.finished()

    return write


def _publisher(folder: str, staging: str):
    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, final = fs.FileSystem.from_uri(folder)
        _, temporary = fs.FileSystem.from_uri(staging)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{temporary}/{row['staged']}", f"{final}/{row['file']}"
                found, there = store.get_file_info([source, target])
                if found.type == fs.FileType.File:
                    store.move(source, target)
                elif there.size != row["bytes"]:  # neither to be renamed nor renamed before by a lost attempt
                    raise FileNotFoundError(source)
            yield batch

    return publish


def write_archives(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit: int = 1000,
    roll_bytes: int = 64 << 20,
    date: str = "1970-01-01T00:00:00Z",
    content_type: str = "text/html; charset=utf-8",
) -> DataFrame:
    """Write one record per row below the new folder ``path``; returns the manifest."""
    spark = df.sparkSession
    keys = materialize(_keys(df, id_col, url_col, payload_col, min_revisit), "warc-keys")
    totals = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bytes") + ROW_BYTES), F.lit(0)).alias("size")).first()
    cuts = _ranges(keys.select("id", "url", "sha1", "bytes"), totals.n, totals.size)
    ranges = len(cuts.first().cuts) + 1
    rows = df.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload")
    ).withColumn("sha1", F.sha1(F.encode("payload", "UTF-8")))
    decisions = _revisits(keys, totals.n)
    first_type = decisions.schema["first"].dataType
    both = decisions.withColumn("decision", F.lit(True)).withColumn("payload", F.lit(None).cast("string")).unionByName(
        rows.withColumn("decision", F.lit(False)).withColumn("first", F.lit(None).cast(first_type))
    )
    place = count_not_above(F.col("cuts"), F.struct("id", "url", "sha1"), max(2, int(ranges**0.5)))
    placed = both.join(F.broadcast(cuts)).withColumn("range_id", place.cast("int")).drop("cuts")
    order = ["range_id", F.col("id").asc_nulls_first(), F.col("url").asc_nulls_first(), "sha1", F.col("decision").desc()]
    ordered = placed.repartitionById(ranges, F.col("range_id")).sortWithinPartitions(*order)
    store, folder = fs.FileSystem.from_uri(path)
    staging = f"{path}/staging-{uuid.uuid4().hex}"
    store.create_dir(fs.FileSystem.from_uri(staging)[1], recursive=True)
    store.create_dir(f"{folder}/data", recursive=True)
    ordered = ordered.select("range_id", "id", "url", "sha1", "decision", "first", "payload")
    staged = materialize(ordered.mapInArrow(_writer(staging, roll_bytes, min_revisit, date, content_type), MANIFEST), "warc-staged")
    files = staged.count()
    spread = staged.repartition(min(max(1, files), partitions_of(spark)), "file")
    final = spread.mapInArrow(_publisher(f"{path}/data", staging), MANIFEST).drop("staged").withColumn("files", F.lit(files).cast("long"))
    final.write.parquet(f"{path}/manifest")
    store.delete_dir(fs.FileSystem.from_uri(staging)[1])
    return spark.read.parquet(f"{path}/manifest")


def _records(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of every gzip member; one record is in memory at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = rest or stream.read(1 << 20)
            if not data:
                if parts:
                    raise ValueError("an archive ends inside a record")
                return
            parts.append(unpacker.decompress(data))
            rest = unpacker.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = body[: int(fields["Content-Length"])]
        if lines[0] != "WARC/1.1" or body[len(block) :] != b"\r\n\r\n":
            raise ValueError("not a whole WARC/1.1 record")
        yield fields, block


def _reader(folder: str, with_payload: bool):
    names = ["id", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(columns[: 7 + with_payload], names[: 7 + with_payload])

        for batch in batches:
            for file in batch.to_pylist():
                where = f"{root}/{file['file']}"
                if store.get_file_info(where).size != file["bytes"]:
                    raise ValueError(f"{where} has not the size that the manifest gives")
                rows, held, seen = [], 0, 0
                with store.open_input_stream(where, compression=None) as stream:
                    for fields, block in _records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = fields["WARC-Payload-Digest"], fields["WARC-Type"]
                        if _sha1(block) != fields["WARC-Block-Digest"] or (kind == "response" and _sha1(payload) != digest):
                            raise ValueError(f"{where}: {fields['WARC-Record-ID']} does not match its digest")
                        size = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length"))
                        row_id, refers = (None if (v := fields.get(name)) is None else unquote(v) for name in ("X-Source-Id", "X-Refers-To-Source-Id"))
                        rows.append((row_id, fields.get("WARC-Target-URI"), fields["WARC-Record-ID"], kind, size, digest.removeprefix("sha1:"), refers, payload))
                        seen += 1
                        held += len(payload) if with_payload else 0
                        if len(rows) >= BATCH or held >= 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                if seen != file["records"]:
                    raise ValueError(f"{where} has {seen} records, the manifest says {file['records']}")

    return read


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """One row per record: id, url, record_id, record_type, payload_bytes, payload_digest, refers_to, payload if asked for.

    A revisit has the size and digest of the payload it stands for and no payload of its own.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    listed = manifest.agg(F.count("*").alias("n"), F.max("files").alias("files")).first()
    if listed.n != (listed.files or 0):
        raise ValueError(f"the manifest of {path} lists {listed.n} of {listed.files} files")
    schema = "id string, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    files = manifest.select("file", "bytes", "records").repartition(min(max(1, listed.n), 4 * partitions_of(spark)), "file")
    found = files.mapInArrow(_reader(f"{path}/data", with_payload), schema + ", payload binary" * with_payload)
    return found.withColumns({"id": _typed("id", id_type), "refers_to": _typed("refers_to", id_type)})


def _typed(name: str, id_type: str) -> Column:
    return F.col(name).cast(id_type)
