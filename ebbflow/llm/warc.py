"""Deterministic sharded WARC writer, and a reader of what it wrote.

Records are dealt into shards by ranges of ``page_id`` that hold about equal bytes;
a shard's records are sorted and written in that order, one gzip member each, and a
file is closed once its compressed size reaches ``roll_bytes``.  All headers, record
ids and digests are derived from the record, so the same rows give the same files.
A task writes under temporary names of its own; only the attempt that Spark commits
has its names in the manifest, and a second job gives those files their final names.

Of records with equal payloads of at least ``min_bytes``, the one with the largest
``page_id`` is the response and the others revisit it.  Defined results: a null html
is an empty payload; a null url has no target header; control characters of a url are
percent-encoded; a null ``page_id`` counts as smaller than any other; of repeated rows
the first is the response, the others revisit; other columns are not read; an empty
table writes an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import blocks_for, table, whole_text
from ebbflow.session import checkpoint_dir

SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
#: Bins of equal width that the ids are first cut into.
BINS = 4096
#: Ranges for each shard's bytes: how finely shards can be cut.
RANGES_PER_SHARD = 16
RANGE_BITS = 40
READ_BYTES = 1 << 20
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "shard long, seq int, records long, bytes long, temporary string, path string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def header_safe(url: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Page-Id", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", header_safe(url)))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
            ("WARC-Refers-To-Page-Id", "" if refers_to is None else str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class ShardFiles:
    """The open file of the shard that a task is at."""

    def __init__(self, root: str, roll_bytes: int):
        self.files, self.base = fs.FileSystem.from_uri(root)
        self.files.create_dir(f"{self.base}/_temporary", recursive=True)
        self.files.create_dir(f"{self.base}/data", recursive=True)
        self.roll, self.out, self.done, self.shard = roll_bytes, None, [], None

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name = f"{self.base}/_temporary/{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records = self.files.open_output_stream(self.name), 0, 0
        self.out.write(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            final = f"{self.base}/data/{self.shard:08d}-{self.seq:06d}.warc.gz"
            self.done.append((self.shard, self.seq, self.records, self.size, self.name, final))
            self.out, self.seq = None, self.seq + 1


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, sha, keep (the response's id) and big (whether equal payloads are revisited), one row each."""
    keyed = pages.select("page_id", "sha", "range", F.octet_length("payload").alias("n"))
    keep = (
        keyed.where(F.col("n") >= min_bytes)
        .groupBy("sha")
        .agg(F.max("page_id").alias("keep"), F.lit(True).alias("big"))
    )
    return keyed.select("range", "page_id", "sha").distinct().join(keep, "sha", "left")


def shard_of_range(ranged: DataFrame, shard_bytes: int) -> DataFrame:
    """range -> shard: neighbouring ranges fill a shard, counted on from what the bins before theirs hold."""
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("size")).withColumn("bin", F.shiftright("range", RANGE_BITS))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS + 1 rows
    bins = sizes.groupBy("bin").agg(F.sum("size").alias("held"))
    bins = bins.select("bin", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bin").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(bins, "bin").select("range", F.expr(f"(offset + own) div {shard_bytes}").alias("shard"))


def part_of(value: Column, low: Column, high: Column, parts: Column) -> Column:
    """Which of so many equal parts of low to high (whole numbers of any size) the value lies in; never falls as it grows."""
    low = low.cast("double")
    share = (value.cast("double") - low) / (high.cast("double") - low + 1)
    return F.when(value.isNotNull(), F.least(F.floor(share * parts), parts - 1).cast("long"))


def with_range(pages: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Adds ``range``, which never falls with page_id, and gives the number of shards.

    The ids are cut into ``BINS`` bins of equal width, and a bin, between the least and largest id it holds, into as many
    ranges as its bytes ask for: ids far off the others do not widen the others' ranges.
    """
    size = F.octet_length(whole_text("html")) + 1
    low, high, total = pages.agg(F.min("page_id"), F.max("page_id"), F.sum(size)).first()
    n_shards = blocks_for(total or 0, shard_bytes)
    own = part_of(F.col("page_id"), F.lit(low or 0), F.lit(high or 0), F.lit(BINS))
    pages = pages.withColumn("_bin", F.coalesce(own, F.lit(-1).cast("long")))
    bins = pages.groupBy("_bin").agg(F.min("page_id").alias("_low"), F.max("page_id").alias("_high"), F.sum(size).alias("_size"))
    cuts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_size") * RANGES_PER_SHARD / shard_bytes))
    bins = bins.withColumn("_cuts", F.least(cuts, F.lit(1 << (RANGE_BITS - 1))))
    held = pages.join(F.broadcast(bins), "_bin")  # at most BINS + 1 rows
    part = F.coalesce(part_of(F.col("page_id"), F.col("_low"), F.col("_high"), F.col("_cuts")), F.lit(0).cast("long"))
    at = F.shiftleft(F.col("_bin"), RANGE_BITS) + part
    return held.select("page_id", "url", "html", at.alias("range")), n_shards


def write_warc(
    pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0
) -> str:
    """Writes page_id, url, html as archives below ``root``; returns the path of the manifest table."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    pages, n_shards = with_range(pages, shard_bytes)
    payload = F.encode(whole_text("html"), "UTF-8")
    rows = pages.select("range", "page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    told = roles(rows, min_bytes).withColumn("kind", F.lit(0))
    records = told.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    shards = shard_of_range(rows.select("range", (F.octet_length("payload") + 1).alias("size")), shard_bytes)
    ordered = (
        records.join(shards, "range")
        .repartition(n_shards, "shard")
        .sortWithinPartitions("shard", "page_id", "sha", "kind")
        .select("shard", "kind", "page_id", "sha", "url", "payload", "keep", "big")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ShardFiles(root, roll_bytes)
        role, written = (None, False), None
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                shard, kind, page_id, sha, url, payload, keep, big = (c[i].as_py() for c in columns)
                if not kind:
                    role, written = (keep, bool(big)), None
                    continue
                first = page_id == role[0] and written != (page_id, sha)
                written = (page_id, sha)
                files.add(shard, member(page_id, url, payload, role[0], role[1] and not first))
        files.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*files.done, strict=True), TYPES, strict=True)] if files.done else [pa.array([], t) for t in TYPES],
            [f.split()[0] for f in MANIFEST.split(", ")],
        )

    committed = f"{root}/_manifest_temporary"
    ordered.mapInArrow(run, MANIFEST).write.mode("error").parquet(committed)
    manifest = f"{root}/manifest"
    spark.read.parquet(committed).mapInArrow(lambda b: renamed(root, b), MANIFEST).write.mode("error").parquet(manifest)
    files, base = fs.FileSystem.from_uri(root)
    files.delete_dir(f"{base}/_temporary") if files.get_file_info(f"{base}/_temporary").type else None
    return manifest


TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def renamed(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives committed files their final names; a repeated attempt finds them in place."""
    files, _ = fs.FileSystem.from_uri(root)
    for batch in batches:
        for temporary, final in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if files.get_file_info(temporary).type == fs.FileType.File:
                files.move(temporary, final)
            elif files.get_file_info(final).type != fs.FileType.File:
                raise FileNotFoundError(f"neither {temporary} nor {final} exists")
        yield batch


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    unpacker, parts, data = zlib.decompressobj(31), [], stream.read(READ_BYTES)
    while data:
        parts.append(unpacker.decompress(data))
        data = b""
        if unpacker.eof:
            yield b"".join(parts)
            data, parts = unpacker.unused_data, []
            unpacker = zlib.decompressobj(31)
        data = data or stream.read(READ_BYTES)
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(record: bytes) -> tuple:
    """A record's fields, its digests checked against what it holds."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest != base32_sha1(payload)):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda k: int(v) if (v := fields.get(k)) else None
    return (
        number("WARC-Page-Id"),
        fields.get("WARC-Target-URI"),
        size,
        digest,
        kind,
        number("WARC-Refers-To-Page-Id"),
        payload if kind == "response" else None,
    )


def read_warc(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """Every record of the archives that the manifest names; a revisit has a null payload."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(root)
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            rows, held = [], 0
            with files.open_input_stream(path, compression=None) as stream:
                for record in members(stream):
                    rows.append(parse(record))
                    held += len(record)
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)

    paths = spark.read.parquet(manifest).select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, RECORD)


def scratch_root(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    root = scratch_root(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), root)
    return read_warc(spark, manifest, root).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
k AS (SELECT hex, max(page_id) AS keep FROM h GROUP BY hex)
SELECT page_id, payload_bytes,
       list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, (5 * g + 1)::INT, 5))::BIGINT >> s) & 31)::INT + 1, 1)
           FOR s IN [15, 10, 5, 0]] FOR g IN range(8)]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM h JOIN k USING (hex)
"""
