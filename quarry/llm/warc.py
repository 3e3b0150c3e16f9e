"""WARC archives of web pages: a deterministic sharded writer, and its reader.

Writing takes one narrow pass (keys, lengths and digests, to settle which of
several equal payloads is stored) and one wide shuffle (the range sort). Which
shard a page falls in depends on the keys alone, so the files come out the same
whatever the cluster, the number of tasks or the retries.

Each task writes the shards it holds one after another, record by record,
rolling to a new file once the compressed size is reached, under names that no
other attempt uses. The names come back as rows of a manifest; only those of
successful attempts are renamed to their final names, and the final manifest is
written after that. A reader goes by the manifest alone. The folder must be one that
pyarrow can open on all executors (a shared path, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import utf8, written
from quarry.session import scratch_path

# Parameters of the layout. A shard holds about SHARD_BYTES of payload; small
# inputs are dealt over LEAST_SHARDS all the same, so that many tasks write. The
# driver reads SAMPLED keys of 25 bytes for each shard (160 MB for 100 TB).
SHARD_BYTES, LEAST_SHARDS, SAMPLED = 256 << 20, 64, 16
ROLL_BYTES = 128 << 20
REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "temp string, name string, shard int, roll int, records long, bytes long, sha1 string"
_RECORDS = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def _store(path: str):
    """The file system of a shared folder and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _one_line(text: str | None) -> str:
    return quote(text or "", safe="".join(map(chr, range(0x21, 0x7F))).replace("%", ""))


def _headers(first: str, pairs) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in pairs), "", ""]).encode()


def _record_id(page, copy: str) -> str:
    return f"<urn:page:{page}:{copy}>"


def make_record(page, url, payload: bytes, digest: str, n_bytes: int, refers_to, copy: str) -> bytes:
    """One record, uncompressed. ``refers_to`` (a page id or None) makes it a
    revisit: the same response headers, but no payload."""
    url = _one_line(url)
    block = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", n_bytes)])
    revisit = refers_to is not None
    if not revisit:
        block += payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page, copy)),
              ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


class _Files:
    """The files of one task attempt; each finished one leaves a manifest row."""

    def __init__(self, folder: str, roll_bytes: int) -> None:
        self.fs, self.folder = _store(folder)
        self.roll_bytes, self.rows, self.out = roll_bytes, [], None
        context = TaskContext.get()
        self.attempt = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"

    def put(self, shard: int, record: bytes) -> None:
        if self.out and (self.shard != shard or self.size >= self.roll_bytes):
            roll = self.roll + 1 if self.shard == shard else 0
            self.close()
            self._open(shard, roll)
        elif not self.out:
            self._open(shard, 0)
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member with no name and no time in it
        data = packer.compress(record) + packer.flush()
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)
        self.records += 1

    def _open(self, shard: int, roll: int) -> None:
        self.shard, self.roll, self.size, self.records, self.hash = shard, roll, 0, 0, hashlib.sha1()
        self.temp = f"_temporary/{self.attempt}/{shard:06d}-{roll:04d}.warc.gz"
        path = f"{self.folder}/{self.temp}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(path, compression=None)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.rows.append((self.temp, f"pages-{self.shard:06d}-{self.roll:04d}.warc.gz", self.shard, self.roll,
                              self.records, self.size, self.hash.hexdigest()))
            self.out = None


def _manifest_batch(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = ["temp", "name", "shard", "roll", "records", "bytes", "sha1"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _decided(keys: DataFrame, least: int) -> DataFrame:
    """The rows to write as revisits: (page, url, digest, refers_to, copies to
    keep as responses). One row per (page, url, digest)."""
    one = keys.groupBy("page", "url", "digest", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    first = (one.where(F.col("n_bytes") >= least)
             .groupBy("digest", "n_bytes").agg(F.max(F.struct("page", "url")).alias("top"), F.sum("n").alias("copies"))
             .where("copies > 1 AND top.page IS NOT NULL").select(F.col("digest").alias("d"), F.col("n_bytes").alias("b"),
                                      F.col("top.page").alias("refers"), F.col("top.url").alias("u")))
    first = written(first, "warc-first")  # so that Spark can split a payload that very many pages have
    return (one.join(first, (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("b")))
            .select("page", "url", "digest", "refers",
                    (F.col("page").eqNullSafe(F.col("refers")) & (F.col("url").eqNullSafe(F.col("u")))).alias("holds")))


def _place(page: str, url: str, digest: str) -> Column:
    """17 bytes that sort as the page id does, null first, and then by a hash of
    the url and digest, so that the rows of one id can be cut too."""
    number = F.unhex(F.lpad(F.hex(F.coalesce(F.col(page), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0"))
    return F.concat(F.when(F.col(page).isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))), number,
                    F.unhex(F.lpad(F.hex(F.xxhash64(url, digest)), 16, "0")))


def _places(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "V17")


def _shard_of(keys: DataFrame, shards: int):
    """A function from a column of places to their shard numbers: cuts at equal
    shares of the payload bytes, read off a sample that a hash of the place picks
    (SAMPLED a shard), so that they follow from the data alone."""
    step = max(1, keys.count() // (SAMPLED * shards))
    sample = (keys.where(F.pmod(F.xxhash64("place"), F.lit(step)) == 0)
              .groupBy("place").agg(F.sum(F.col("n_bytes") + 512).alias("n")).orderBy("place").toArrow())
    run = np.cumsum(sample.column("n").to_numpy())
    at = np.searchsorted(run, run[-1] * (np.arange(1, shards) / shards)) if len(run) else np.zeros(0, np.int64)
    cuts = np.unique(_places(sample.column("place"))[at])

    def shard(place: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, _places(place), side="right").astype(np.int32))

    return F.arrow_udf(shard, "int")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write one record per row of ``pages`` into ``folder`` (a shared one) and
    return the manifest that was committed there.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads
    of ``revisit_from`` bytes or more, the one with the largest id is stored as
    a response (of several such rows: the greatest url; of repeated rows: one)
    and the rest as revisits. A null id is never referred to; where all of
    equal payloads have none, all are responses, as smaller payloads are. Records go by id, and those of one id by a
    hash of url and digest, then by these; null ids come first. The rows of an id
    or of none may lie in several shards, but repeated rows lie together. A very
    long payload is one record of one task. An empty table gives an empty
    manifest and no file.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        utf8(html_col).alias("html"))
    keyed = (rows.withColumn("digest", F.sha1("html")).withColumn("n_bytes", F.octet_length("html").cast("long"))
             .withColumn("place", _place("page", "url", "digest")))
    keys = written(keyed.drop("html"), "warc-keys")
    shards = keys.agg(F.sum("n_bytes")).first()[0] or 0
    shards = int(max(LEAST_SHARDS, -(-shards // shard_bytes)))
    shard = _shard_of(keys, shards)
    pages_in = keyed.withColumns({"tag": F.lit(1), "refers": F.lit(None).cast("long"), "holds": F.lit(None).cast("boolean")})
    decided = _decided(keys, revisit_from).withColumns({"tag": F.lit(0), "html": F.lit(None).cast("binary"),
                                                        "n_bytes": F.lit(0).cast("long"), "place": _place("page", "url", "digest")})
    parts = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, shards // 4))
    # a decision sorts just before the pages that it is about
    ordered = (pages_in.unionByName(decided).withColumn("shard", shard("place"))
               .repartitionByRange(parts, "shard").sortWithinPartitions("shard", "place", "url", "digest", "tag")
               .select("shard", F.substring("place", 10, 8).alias("tie"), "page", "url", "digest", "tag", "n_bytes", "refers", "holds", "html"))

    def run(batches):
        files, key, refers, holds, copy = _Files(folder, roll_bytes), None, None, False, 0
        for batch in batches:
            for shard, tie, page, url, digest, tag, n_bytes, to, stores, html in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (page, url, digest):
                    key, refers, holds, copy = (page, url, digest), None, False, 0
                if tag == 0:
                    refers, holds = to, stores
                    continue
                stored = refers is None or holds
                # the record that others refer to has the digest for a number
                number = digest if refers is not None and holds else f"{tie.hex()}-{(copy := copy + 1)}"
                files.put(shard, make_record("" if page is None else page, url, html, digest, n_bytes,
                                             None if stored else refers, number))
                holds = False
        files.close()
        if files.rows:
            yield _manifest_batch(files.rows)

    staged = written(ordered.mapInArrow(run, _MANIFEST), "warc-manifest")

    def commit(batches):
        store, base = _store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                final, temp = f"{base}/{r['name']}", f"{base}/{r['temp']}"
                # a second attempt finds the file moved already
                if store.get_file_info(temp).type != fs.FileType.NotFound:
                    store.move(temp, final)
                if store.get_file_info(final).size != r["bytes"]:
                    raise OSError(f"{final} is not as its manifest says: {store.get_file_info(final)}, {r}")
            yield batch

    committed = staged.repartition(parts, "name").mapInArrow(commit, _MANIFEST)
    committed.write.mode("overwrite").parquet(f"{folder}/_manifest")
    store, base = _store(folder)
    if store.get_file_info(f"{base}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{base}/_temporary")  # what lost attempts have left
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


class _Members:
    """Reads the gzip members of a file as a stream, in bounded memory."""

    def __init__(self, source) -> None:
        self.source, self.left, self.buffer, self.unpack = source, b"", bytearray(), None

    def _more(self) -> bool:
        data = self.left or self.source.read(1 << 20)
        if not data:
            return False
        self.unpack = self.unpack or zlib.decompressobj(31)
        self.buffer += self.unpack.decompress(data)
        self.left = self.unpack.unused_data
        if self.unpack.eof:
            self.unpack = None
        return True

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("a record is cut short")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[:at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record is cut short")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def headers(self) -> dict[str, str] | None:
        first = self.line()
        if first is None:
            return None
        out = {"": first.decode()}
        while line := self.line():
            k, _, v = line.decode().partition(": ")
            out[k] = v
        return out


def parse_records(source):
    """Records of one open archive: (page, url, n_bytes, digest, type, refers).
    Digests of blocks and stored payloads are worked out anew and compared."""
    stream = _Members(source)
    while (head := stream.headers()) is not None:
        block = stream.take(int(head["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")
        if f"sha1:{hashlib.sha1(block).hexdigest()}" != head["WARC-Block-Digest"]:
            raise ValueError(f"damaged block in {head['WARC-Record-ID']}")
        web, _, payload = block.partition(b"\r\n\r\n")
        n = int(next(x for x in web.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
        page, refers = (head.get(k, "<urn:page::0>").split(":")[2] for k in ("WARC-Record-ID", "WARC-Refers-To"))
        yield (int(page) if page else None, unquote(head["WARC-Target-URI"]), n, digest, head["WARC-Type"],
               int(refers) if refers else None)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives that the manifest in ``folder`` names: (page_id,
    url, payload_bytes, payload_digest, record_type, refers_to). Each archive is
    read as a stream by one task."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest").select("name")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches):
        store, base = _store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20) as source:
                    rows = []
                    for record in parse_records(source):
                        rows.append(record)
                        if len(rows) == 5000:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    return (manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")
            .mapInArrow(run, _RECORDS.format(id="long")))


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a fresh shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_warc(pages, folder, **options)
    return read_warc(spark, folder)
