"""Pages to WARC archives and back: a deterministic sharded writer and a streaming reader.

1. *Keys.* One pass gives (page_id, SHA-256, size) per page. The smallest page_id of each payload of at least ``least``
   bytes is its response (two minima per digest, added up before the shuffle), all others become revisits.
2. *Ranges.* A histogram of bytes over the ids, refined where a cell is too full, is merged into ranges of about ``goal``
   bytes each. It depends on the rows alone, not on samples, tasks or cores, so the same pages always give the same
   files. The rows of one id with more than that are dealt to several shards in turn.
3. *Writing.* One shuffle by shard; inside a shard pages are sorted by page_id. Revisit notes travel as rows of their own
   that sort before the pages they are for. The writer makes every header anew (record ids, digests of payload
   and block, lengths), compresses each record as a gzip member and begins a new file whenever the
   current one has reached ``roll`` compressed bytes.
4. *Commit.* Files are written below ``_temporary`` under the name of the task's attempt and moved into place when they are whole, so a
   repeated task replaces a file with an equal one. The manifest (path, records, sizes, SHA-256 of the file) is
   a Parquet table; a file ``MANIFEST``, made under another name and moved last, names it. Readers only see
   what it names.

The reader streams the members, checks every file, block and payload digest, and gives one row per record.

Null html counts as empty. A NULL page_id is written as a record without an id; it is never a response for others, and is
a revisit where its payload has a response. Rows with equal page_id and payload are all of the same type: responses when they have the
smallest id. A NULL or empty url becomes ``urn:page:<id>``; characters that a header cannot hold are percent-encoded. Extra
columns are ignored. An empty table gives a manifest without files and no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import only
from seriesloom.session import store, work_dir

LEAST = 100
ROLL = 256 << 20
# Bytes of a shard: about 4,096 shards, each between these bounds.
SHARDS, SMALLEST, LARGEST = 4096, 4 << 20, 1 << 30
OVERHEAD = 600
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID(int=0)
URL_SAFE = "!#$%&'()*+,-./:;<=>?@[]_~"

KEYS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
MANIFEST = ("path string, shard int, number int, records long, payload_bytes long, compressed_bytes long, sha256 string")


def keys(pages: DataFrame) -> DataFrame:
    """page_id, digest (hex), bytes, url of every page, stored once."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return store(pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"), F.col("url").cast("string").alias("url")), "page-keys")


def revisits(keyed: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, ref_id, ref_url of the pages that revisit another one, once per id and digest."""
    named = keyed.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    first = named.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"))
    unnamed = keyed.where((F.col("bytes") >= least) & F.col("page_id").isNull()).select("digest").distinct()
    first = first.join(unnamed.withColumn("unnamed", F.lit(True)), "digest", "left").where(
        (F.col("first.page_id") < F.col("last")) | F.col("unnamed"))
    first = first.select("digest", F.col("first.page_id").alias("ref_id"), F.col("first.url").alias("ref_url"))
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("ref_id"))
    return keyed.select("page_id", "digest").join(first, "digest").where(later).distinct()


class Ranges:
    """Ranges of ids: range r begins at starts[r] and has ``parts[r]`` shards from ``base[r]`` on; NULL ids follow."""

    def __init__(self, cells: list[tuple[int, int]], empty_bytes: int, goal: int):
        starts, parts, held = [], [], 0
        for start, size in sorted(cells):
            if not starts or held + size > goal:
                starts.append(start)
                parts.append(max(1, -(-size // goal)))
                held = 0
            held += size
        self.starts, self.parts = np.array(starts, np.int64), np.array(parts, np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.parts)]).astype(np.int64)
        self.unnamed = -(-empty_bytes // goal)
        self.count = int(self.base[-1]) + self.unnamed

    def span(self, ids: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First shard and number of shards of each id; where ``named`` is false, those of the NULL ids."""
        first = np.full(len(ids), self.base[-1], np.int32)
        parts = np.full(len(ids), max(1, self.unnamed), np.int32)
        at = np.searchsorted(self.starts, ids[named], "right") - 1
        first[named], parts[named] = self.base[at], self.parts[at]
        return first, parts


def ranges(keyed: DataFrame, goal: int | None = None) -> Ranges:
    """Ranges of about ``goal`` bytes from a histogram over the ids; at most some 16 cells per shard, or 65,536, reach the driver."""
    weight = F.col("bytes") + OVERHEAD
    low, high, named, unnamed = keyed.agg(
        F.min("page_id"), F.max("page_id"), F.sum(F.when(F.col("page_id").isNotNull(), weight)),
        F.sum(F.when(F.col("page_id").isNull(), weight))).first()
    total = (named or 0) + (unnamed or 0)
    goal = goal or min(max(total // SHARDS, SMALLEST), LARGEST)
    if named is None:
        return Ranges([], unnamed or 0, goal)
    shift = max(0, (high - low).bit_length() - (16 * (total // goal) + 1024).bit_length())
    rows = keyed.where("page_id is not null").select("page_id", weight.alias("weight"))
    cells: list[tuple[int, int]] = []
    while True:
        found = rows.groupBy(F.shiftright("page_id", shift).alias("cell")).agg(F.sum("weight").alias("weight")).collect()
        full = [r["cell"] for r in found if r["weight"] > goal and shift]
        cells += [(r["cell"] << shift, r["weight"]) for r in found if not (r["weight"] > goal and shift)]
        if not full:
            return Ranges(cells, unnamed or 0, goal)
        # At most total / goal cells are too full.
        listed = keyed.sparkSession.createDataFrame([(c,) for c in full], "cell long")
        rows = rows.join(F.broadcast(listed), F.shiftright("page_id", shift) == F.col("cell"), "left_semi")
        shift = max(0, shift - max(4, 16 - len(full).bit_length()))


def record_id(page_id: int | None, digest: str, url: str | None, repeat: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest} {url} {repeat}')}>"


def target_uri(page_id: int | None, url: str | None) -> str:
    return quote(url, safe=URL_SAFE, errors="surrogatepass") if url else f"urn:page:{page_id if page_id is not None else ''}"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own; the member holds no time, so equal records give equal bytes."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([
        packer.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()), packer.compress(block),
        packer.compress(b"\r\n\r\n"), packer.flush()])


def page_record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int, str | None] | None, repeat: str = "") -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    headers = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, digest, url, repeat)),
        ("WARC-Date", DATE), ("WARC-Target-URI", target_uri(page_id, url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers:
        headers += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], digest, refers[1])),
            ("WARC-Refers-To-Target-URI", target_uri(*refers)), ("WARC-Refers-To-Date", DATE),
            ("X-Refers-To-Page-ID", str(refers[0]))]
    return record(headers, block)


class ShardFiles:
    """The files of one shard: rolled by compressed size, moved into place when whole."""

    def __init__(self, filesystem, root: str, folder: str, shard: int, attempt: int, roll: int):
        self.filesystem, self.root, self.folder, self.shard, self.attempt, self.roll = filesystem, root, folder, shard, attempt, roll
        self.number, self.sink = 0, None

    def _open(self) -> None:
        self.name = f"pages-{self.shard:06d}-{self.number:04d}.warc.gz"
        self.unfinished = f"{self.root}/_temporary/{self.attempt}-{self.name}"
        self.sink, self.hash = self.filesystem.open_output_stream(self.unfinished, compression=None), hashlib.sha256()
        self.size = self.records = self.payload = 0
        info = f"software: seriesloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
        self._put(record([
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, "", self.name)), ("WARC-Date", DATE),
            ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def _put(self, member: bytes) -> None:
        self.sink.write(member)
        self.hash.update(member)
        self.size += len(member)

    def add(self, member: bytes, payload: int) -> tuple | None:
        if self.sink is None:
            self._open()
        self._put(member)
        self.records += 1
        self.payload += payload
        return self.close() if self.size >= self.roll else None

    def close(self) -> tuple | None:
        """Move the open file into place; its line of the manifest."""
        if self.sink is None:
            return None
        self.sink.close()
        self.sink = None
        self.filesystem.move(self.unfinished, f"{self.root}/{self.name}")
        self.number += 1
        return (f"{self.folder}/{self.name}", self.shard, self.number - 1, self.records, self.payload, self.size, self.hash.hexdigest())


def write_archives(pages: DataFrame, folder: str, goal: int | None = None, roll: int = ROLL, least: int = LEAST) -> DataFrame:
    """Write all pages below ``folder`` and commit; the manifest, one row per file."""
    spark = pages.sparkSession
    filesystem, root = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(f"{root}/_temporary", recursive=True)
    keyed = keys(pages)
    plan = ranges(keyed, goal)
    notes = store(revisits(keyed, least), "revisits")
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("first int, parts int")
    def span(ids: pd.Series, named: pd.Series) -> pd.DataFrame:
        first, parts = shared.value.span(ids.to_numpy(), named.to_numpy())
        return pd.DataFrame({"first": first, "parts": parts})

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("span", span(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNotNull()))

    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.lit(1).alias("kind"),
        F.col("url").cast("string").alias("url"), html.alias("html"), F.lit(None).cast("long").alias("ref_id"))
    thin = notes.select("page_id", "digest", F.lit(0).alias("kind"), F.col("ref_url").alias("url"),
                        F.lit(None).cast("binary").alias("html"), "ref_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        target, base = pafs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        files, note, last, repeat = None, None, None, 0
        lines: list[tuple | None] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "digest", "kind", "url", "html", "ref_id")]
            for shard, page_id, digest, kind, url, payload, ref_id in zip(*(c.to_pylist() for c in columns), strict=True):
                if not kind:
                    note = (page_id, digest, ref_id, url)
                    continue
                if files is None or files.shard != shard:
                    lines.append(files.close() if files else None)
                    files = ShardFiles(target, base, folder, shard, attempt, roll)
                repeat = repeat + 1 if last == (page_id, digest, url) else 0
                last = (page_id, digest, url)
                refers = note[2:] if note and note[:2] == (page_id, digest) else None
                lines.append(files.add(page_record(page_id, url, payload, refers, f"{shard}-{repeat}" if repeat else ""), len(payload)))
            done = [x for x in lines if x]
            lines = []
            if done:
                yield manifest_rows(done)
        if files and (line := files.close()):
            yield manifest_rows([line])

    # An id with more than a shard's bytes has several shards: its pages are dealt to them, its notes go to all.
    dealt = F.col("span.first") + F.pmod(F.monotonically_increasing_id(), F.col("span.parts")).cast("int")
    noted = F.explode(F.sequence(F.col("span.first"), F.col("span.first") + F.col("span.parts") - 1))
    rows = placed(full).withColumn("shard", dealt).drop("span").unionByName(
        placed(thin).withColumn("shard", noted).drop("span")).repartition(max(1, plan.count), "shard").sortWithinPartitions(
        "shard", "page_id", "digest", "kind", "url")
    path = f"{folder}/_manifest-{uuid.uuid4().hex}"
    rows.mapInArrow(write, MANIFEST).write.parquet(path)
    commit(filesystem, root, path)
    return manifest(spark, folder)


def manifest_rows(lines: list[tuple]) -> pa.RecordBatch:
    path, shard, number, records, payload, size, sha256 = zip(*lines, strict=True)
    return pa.RecordBatch.from_pydict({
        "path": list(path), "shard": pa.array(shard, pa.int32()), "number": pa.array(number, pa.int32()),
        "records": pa.array(records, pa.int64()), "payload_bytes": pa.array(payload, pa.int64()),
        "compressed_bytes": pa.array(size, pa.int64()), "sha256": list(sha256)})


def commit(filesystem, root: str, path: str) -> None:
    """Name the manifest in one step, then drop what lost attempts left."""
    unfinished = f"{root}/_temporary/MANIFEST-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(unfinished) as out:
        out.write(json.dumps({"manifest": path}).encode())
    filesystem.move(unfinished, f"{root}/MANIFEST")
    filesystem.delete_dir_contents(f"{root}/_temporary", missing_dir_ok=True)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files below ``folder``; fails where nothing was committed."""
    filesystem, root = pafs.FileSystem.from_uri(folder)
    with filesystem.open_input_stream(f"{root}/MANIFEST") as source:
        named = json.loads(source.read())
    return spark.read.schema(MANIFEST).parquet(named["manifest"])


def members(source, seen) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked one by one; ``seen`` is given every compressed byte."""
    held = b""
    while True:
        if not held:
            held = source.read(1 << 16)
            if not held:
                return
            seen(held)
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not held:
                held = source.read(1 << 16)
                if not held:
                    raise ValueError("the last record is cut")
                seen(held)
            parts.append(unpacker.decompress(held))
            held = unpacker.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block must have the stated length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    told = headers.get("WARC-Block-Digest")
    if told and told != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
    return headers, block


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Per record of the manifest's files: page_id, payload_bytes, payload_digest, record_type, refers_to.

    With ``payloads`` also url and html (NULL for revisits).
    """

    def flush(rows):
        page, size, digest, kind, refers, uri, html = zip(*rows, strict=True)
        columns = [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()),
                   pa.array(kind, pa.string()), pa.array(refers, pa.int64())]
        if payloads:
            columns += [pa.array(uri, pa.string()), pa.array(html, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def read(batches):
        for batch in batches:
            for path, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, name = pafs.FileSystem.from_uri(path)
                whole, rows, held = hashlib.sha256(), [], 0
                with filesystem.open_input_stream(name, compression=None) as source:
                    for raw in members(source, whole.update):
                        headers, block = parse(raw)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                        page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), size, digest, kind, refers and int(refers),
                                     headers["WARC-Target-URI"], payload if kind == "response" else None))
                        held += len(payload) if payloads else 100
                        if held > 1 << 22:
                            yield flush(rows)
                            rows, held = [], 0
                if whole.hexdigest() != told:
                    raise ValueError(f"{path} differs from the manifest")
                if rows:
                    yield flush(rows)

    schema = KEYS + (", url string, html binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return files.select("path", "sha256").repartition(max(1, files.count())).mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to archives in a new shared folder and read them back."""
    folder = work_dir(spark, "warc")
    return read_archives(write_archives(pages, folder if ":/" in folder else f"file://{folder}"))
