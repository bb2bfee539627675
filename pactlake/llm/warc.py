"""Web archives: WARC records with a two-level capture index.

Each task writes one archive of gzip members, one a record, to the shared folder. The index has a
line per capture, sorted by reversed-host URL key and page id: range partitions (shards) hold
compressed blocks of BLOCK_LINES lines, and a sparse directory of the blocks' first keys at the
shard's end. A look-up finds the shard by the shards' first keys, reads the directory, searches it by
bisection, reads one block, and then reads the record's bytes alone.

A task that is run again writes another file; only files that the rows of the tasks that counted
name are ever read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, shared_dir, small_batches, table, text_of

BLOCK_LINES = 500
#: Captures of an index shard, which one task writes and one task reads back; at most MAX_SHARDS shards.
SHARD_LINES, MAX_SHARDS = 4_000, 20_000
OPEN_FILES = 64
HOT_DIGESTS = 1000
DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The host's labels reversed, then path and query: `com,example,www)/a?b`. Blanks and control
    characters are escaped; a null URL has the key `-`; what can't be split counts as a path."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        parts, host, port = None, "", None
    if parts is None:
        key = ")" + url
    else:
        where = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
        key = f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    return "".join([c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in key])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join([f"{k}: {v}\r\n" for k, v in headers])
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    return int(x) if (x := record_id[len("<urn:x-page:") : -1]) else None


def page_record(page_id: int | None, url: str | None, payload: bytes, response: int | None, revisit: bool) -> bytes:
    """A response record with the payload, or a revisit record with the HTTP head alone, which still
    has the payload's length."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join([c if c > " " else f"%{ord(c):02X}" for c in url or ""])
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _id(response))]
    return _record(headers, head if revisit else head + payload)


def parse_record(raw: bytes) -> dict:
    """headers (lower-case names), http (likewise) and payload of a record of page_record()."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def _open(folder: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", dedup_from: int = 0) -> DataFrame:
    """Writes a record per row of pages under `folder`; returns the captures: key, page_id, file,
    start, length.

    Of rows with equal payloads of `dedup_from` bytes or more, those with the largest page_id are
    responses and the others revisit it. A null html is the empty payload; a null page_id is never
    the largest, and rows without any id are responses; repeated rows give repeated records. Payloads are
    bytes as they are; in a URL what isn't UTF-8 counts as U+FFFD. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # payloads of one row are their own responses; of the others there are digests alone to join
    again = rows.where(F.octet_length("payload") >= dedup_from).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    again = materialize(again.where(F.col("n") > 1))
    total = again.agg(F.sum("n")).first()[0] or 0
    # digests of over a share of 1 / HOT_DIGESTS of these rows, so HOT_DIGESTS at most, are broadcast, and
    # their rows are dealt by page and not by digest
    hot = again.where(F.col("n") > total / HOT_DIGESTS).select(F.col("digest").alias("of"), F.col("response").alias("hot"))
    dealt = rows.join(F.broadcast(hot), F.col("digest") == F.col("of"), "left")
    dealt = dealt.withColumn("digest", F.when(F.col("of").isNull(), F.col("digest")).otherwise(F.concat_ws(":", "page_id", F.xxhash64("url"))))
    joined = dealt.join(again.select("digest", "response"), "digest", "left")
    joined = joined.select("page_id", "url", "payload", F.coalesce("hot", "response").alias("response"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        store, path = _open(folder)
        name = f"archive-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            at = out.write(gzip.compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), 4, mtime=0))
            for whole in itertools.chain([first], batches):
                for part in range(0, whole.num_rows, 256):
                    made = []
                    for p, u, body, r in zip(*_columns(whole.slice(part, 256)), strict=True):
                        raw = gzip.compress(page_record(p, u, body, r, r is not None and p != r), 4, mtime=0)
                        out.write(raw)
                        made.append((url_key(u), p, name, at, len(raw)))
                        at += len(raw)
                    if made:
                        yield _batch(made, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], ["key", "page_id", "file", "start", "length"])

    return materialize(joined.mapInArrow(write, "key string, page_id long, file string, start long, length long"))


def _columns(batch: pa.RecordBatch) -> list[list]:
    """Columns as lists; texts by text_of(), but null stays null."""
    texts = lambda c: [None if x is None else text_of(x) for x in as_bytes(c)]
    return [texts(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns]


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _order(key: str, page_id: int | None) -> tuple[bytes, int]:
    """As Spark sorts: keys by their bytes, a null id first."""
    return key.encode(), -(1 << 63) - 1 if page_id is None else page_id


def write_index(captures: DataFrame, folder: str) -> list[tuple[tuple[bytes, int], str]]:
    """Writes the capture index under `folder`; returns (first key, file) of each shard in order,
    MAX_SHARDS at most."""
    number = min(MAX_SHARDS, captures.count() // SHARD_LINES + 1)
    dealt = captures.repartitionByRange(number, "key", "page_id", "file", "start").sortWithinPartitions("key", "page_id", "file", "start")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []
        directory: list[tuple] = []
        name, store, out, at, head = f"index-{uuid.uuid4().hex}", None, None, 0, None

        def flush():
            nonlocal at
            raw = zlib.compress("".join([json.dumps(x, ensure_ascii=False) + "\n" for x in lines]).encode(), 6)
            directory.append((lines[0][0], lines[0][1], at, len(raw)))
            at += out.write(raw)
            lines.clear()

        for batch in batches:
            if batch.num_rows and out is None:
                store, path = _open(folder)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                head = head or row
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        raw = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(raw + struct.pack("<Q", len(raw)))
        out.close()
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield _batch([(*head[:2], name, *head[2:4])], kinds, ["key", "page_id", "file", "first_file", "first_start"])

    shards = materialize(dealt.mapInArrow(write, "key string, page_id long, file string, first_file string, first_start long"))
    # of shards that start with one key, that which goes on to others is last
    found = sorted((_order(r["key"], r["page_id"]), r["first_file"], r["first_start"], r["file"]) for r in shards.toLocalIterator())
    return [(f[0], f[3]) for f in found]


class Shard:
    """Reader of one index shard: the directory at its end, then blocks by range reads."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        (n,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        self.blocks = [(_order(k, p), a, b) for k, p, a, b in json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))]
        self.starts = [b[0] for b in self.blocks]
        self.held: tuple[int, list] = (-1, [])

    def block(self, k: int) -> list:
        if self.held[0] != k:
            _, at, n = self.blocks[k]
            rows = [json.loads(x) for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n") if x]
            self.held = (k, [(_order(r[0], r[1]), *r[1:]) for r in rows])
        return self.held[1]

    def find(self, key: tuple[bytes, int]) -> Iterator[tuple]:
        """Captures (page_id, file, start, length) of the key, which may run over several blocks."""
        k = max(0, bisect.bisect_left(self.starts, key) - 1)
        while k < len(self.blocks) and self.starts[k] <= key:
            rows = self.block(k)
            at = bisect.bisect_left(rows, key, key=lambda r: r[0])
            while at < len(rows) and rows[at][0] == key:
                yield rows[at][1:]
                at += 1
            k += 1


class Archives:
    """Records by range reads; a bounded number of files stays open."""

    def __init__(self, store, path: str):
        self.store, self.path, self.open = store, path, OrderedDict()

    def read(self, file: str, start: int, length: int) -> dict:
        if file not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)[1].close()
            self.open[file] = self.store.open_input_file(f"{self.path}/{file}")
        self.open.move_to_end(file)
        return parse_record(gzip.decompress(self.open[file].read_at(length, start)))


def read_back(pages: DataFrame, shards: list[tuple[tuple[bytes, int], str]], folder: str, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Looks every row of pages up in the index and reads its record: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Equal rows are looked up once and give each of their records."""
    small_batches(pages.sparkSession)
    firsts = [s[0] for s in shards]
    wanted = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url")).distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for p, u in zip(*_columns(batch), strict=True):
                key = url_key(u)
                at = _order(key, p)
                # every shard that may hold it: captures of one key and page may run over several
                for to in range(max(0, bisect.bisect_left(firsts, at) - 1), max(1, bisect.bisect_right(firsts, at))):
                    made.append((to, key, p))
            if made:
                yield _batch(made, [pa.int32(), pa.string(), pa.int64()], ["shard", "key", "page_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        archives, number, shard, last = Archives(store, path), -1, None, None
        for batch in batches:
            made = []
            for to, key, p in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if to != number:
                    number, shard, last = to, Shard(store, f"{path}/{shards[to][1]}"), None
                at = _order(key, p)
                if at == last:
                    continue
                last = at
                for _, file, start, length in shard.find(at):
                    got = archives.read(file, start, length)
                    headers, body = got["headers"], got["payload"]
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response":
                        if base32_sha1(body) != digest:
                            raise ValueError(f"damaged record in {file} at {start}")
                        made.append((_page(headers["warc-record-id"]), len(body), digest, "response", None))
                    else:
                        made.append((_page(headers["warc-record-id"]), int(got["http"]["content-length"]), digest, "revisit", _page(headers["warc-refers-to"])))
            if made:
                yield _batch(made, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    routed = wanted.mapInArrow(route, "shard int, key string, page_id long").repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "key", "page_id")
    return routed.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(shards: list[tuple[tuple[bytes, int], str]], folder: str, url: str | None, page_id: int | None) -> list[dict]:
    """Records of one capture, without Spark: shard, directory, block and record by range reads."""
    if not shards:
        return []
    store, path = _open(folder)
    key = _order(url_key(url), page_id)
    archives, out = Archives(store, path), []
    k = max(0, bisect.bisect_left([s[0] for s in shards], key) - 1)
    while k < len(shards) and shards[k][0] <= key:
        out += [archives.read(*x[1:]) for x in Shard(store, f"{path}/{shards[k][1]}").find(key)]
        k += 1
    return out


def archive(pages: DataFrame, **columns) -> tuple[str, list]:
    """Writes archives and index of pages to a new folder of the shared one; returns folder and shards."""
    folder = f"{shared_dir(pages.sparkSession)}/archive-{uuid.uuid4().hex}"
    store, path = _open(folder)
    store.create_dir(path)
    return folder, write_index(write_archives(pages, folder, **columns), folder)


def op6_warc_archive(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder, shards = archive(pages)
    return read_back(pages, shards, folder)
