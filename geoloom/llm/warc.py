"""WARC archives and a capture index merged from sorted runs.

*Writing.* Records are built as text in the JVM (one expression per record) and
written by Spark's text writer, whose line separator is the blank lines that end
a record; so archives land through whatever file system the shared folder
has. Equal payloads of ``MIN_REVISIT`` bytes or more are stored once: the
capture with the smallest id is the response, the others are revisits that
refer to it. Only digests and ids are grouped, with a partial aggregate
first, so a payload of a third of all pages is no hot key.

*Reading.* An archive is one row of the binary source and is parsed as a stream
of records (``RECORDS_PER_FILE`` of them at most; a compressed archive must stay
below the 2 GB that Spark allows one row); payloads are digested again.

*Index.* Each archive gives one run, sorted by URL key, timestamp and id. The
key space is cut into ranges by a sample of the keys (a hot URL is cut by
timestamp and id). Every run is cut at the bounds into sorted blocks, each range
receives its blocks as they are, and a loser tree merges them. Ranges in order are
the global order.

Archives are compressed as whole files; offsets in the index are those of the
uncompressed archive.

Defined cases: null html is an empty payload; a null url has no target line
and an empty URL key; a null id has no id line, is last among equal payloads,
and gets the epoch as its date; rows that repeat the smallest id are all
responses; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import parse_qsl, quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.scratch import Scratch

MIN_REVISIT = 100
RECORDS_PER_FILE = 1024
#: Captures that one range of the merge holds, about.
RANGE_ROWS = 1 << 16
#: Captures whose keys place the bounds: for each range, and in all.
SAMPLED_PER_RANGE, MOST_SAMPLED = 40, 1_000_000
EPOCH = 1_704_067_200
END = "\r\n\r\n"


def _line(name: str, value):
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame) -> DataFrame:
    """One column ``value``: the WARC record of each page, without the blank lines that end it.

    A capture's date is ``EPOCH`` plus its id in seconds, as pages carry none.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha2("html", 256))
    groups = p.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "first_id")
    p = p.join(groups, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    safe_url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    uuid = lambda x: F.concat(F.lit("<urn:geoloom:page:"), x, F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", F.coalesce(uuid(F.col("page_id")), F.lit("<urn:geoloom:page:none>"))),
        _line("WARC-Date", F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")), _line("WARC-Target-URI", safe_url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), _line("WARC-Payload-Length", F.col("n").cast("string")),
        _line("WARC-Refers-To", F.when(revisit, uuid(F.col("first_id")))), _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
    )
    return p.select(F.concat(head, body).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    records(pages).write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and sorted query, lower-cased: captures of one page share it."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return url.lower()
    query = "&".join("=".join(x) for x in sorted(parse_qsl(parts.query, keep_blank_values=True)))
    path = quote(unquote(parts.path), safe="/:@!$&'()*+,;=~-._").rstrip("/").lower() or "/"
    return f"{','.join(reversed(host.split('.')))}{port}){path}{'?' + query.lower() if query else ''}"


class _Stream:
    """Uncompressed bytes of an archive, read forward in bounded pieces."""

    def __init__(self, raw: memoryview, step: int = 1 << 18):
        self.raw, self.step, self.at = raw, step, 0
        self.inflate = zlib.decompressobj(31)
        self.buffer, self.done = bytearray(), 0

    def _more(self) -> bool:
        if self.inflate.eof:
            rest = self.inflate.unused_data
            if not rest and self.at >= len(self.raw):
                return False
            self.inflate = zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(rest)
            return True
        if self.at >= len(self.raw):
            return False
        self.buffer += self.inflate.decompress(self.raw[self.at : self.at + self.step])
        self.at += self.step
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.done += len(out)
        return out


def parse(raw: memoryview) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of every record of a compressed archive."""
    stream = _Stream(raw)
    while True:
        offset = stream.done
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ": " in line)
        block = stream.take(int(fields["Content-Length"]))
        yield offset, stream.done - offset, fields, block.partition(b"\r\n\r\n")[2]
        stream.take(len(END))


_CAPTURE = "run string, url_key string, ts string, page_id long, url string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _CAPTURE.split(", ")])


def _page(urn: str | None) -> int | None:
    tail = (urn or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def _order(row: tuple) -> tuple:
    return row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[5]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run per archive."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            run, rows = path.as_py().rpartition("/")[2], []
            for offset, length, f, payload in parse(memoryview(content.as_buffer())):
                digest, size = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["WARC-Payload-Length"])
                intact = True
                if f["WARC-Type"] == "response":
                    intact = (size, digest) == (len(payload), hashlib.sha256(payload).hexdigest())
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                url = f.get("WARC-Target-URI")
                ts = f["WARC-Date"].translate(str.maketrans("", "", "-:TZ"))
                rows.append((run, url_key(url), ts, _page(f["WARC-Record-ID"]), url, offset, length, f["WARC-Type"], size, digest, _page(f.get("WARC-Refers-To")), intact))
            rows.sort(key=_order)
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 4096], strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``; those of an archive (``run``) are in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_read, _CAPTURE)


class LoserTree:
    """Merges k sorted sequences; each step replays one path of losers, log2(k) comparisons."""

    def __init__(self, sequences: list[Iterator[tuple]]):
        self.sources = sequences
        self.k = len(sequences)
        self.heads: list[tuple | None] = [next(s, None) for s in sequences]
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether the head of a goes first; exhausted sequences are last, ties by sequence."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.sources[winner], None)
            self._replay(winner)


_BLOCK = "range int, block binary"


def _cut(bounds):
    """Cuts sorted stretches of captures at the bounds: one row per range and stretch, the captures as one Arrow block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bounds.value
        for batch in batches:
            keys = list(map(_order, zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
            numbers, blocks = [], []
            for a, z in zip(starts, starts[1:], strict=False):
                at = a
                while at < z:
                    k = bisect_right(edges, keys[at])
                    stop = bisect_left(keys, edges[k], at, z) if k < len(edges) else z
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, _SCHEMA) as out:
                        out.write_batch(batch.slice(at, stop - at).cast(_SCHEMA) if batch.schema != _SCHEMA else batch.slice(at, stop - at))
                    numbers.append(k)
                    blocks.append(sink.getvalue().to_pybytes())
                    at = stop
            if numbers:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], ["range", "block"])

    return run


def _merged(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks as one sorted sequence."""
    tables = [pa.ipc.open_stream(b).read_all() for b in blocks]
    whole = pa.concat_tables(tables)
    keys = list(map(_order, zip(*(whole.column(c).to_pylist() for c in _NAMES), strict=True)))
    stops = list(accumulate(t.num_rows for t in tables))
    sequences = [iter([(keys[i], i) for i in range(z - t.num_rows, z)]) for t, z in zip(tables, stops, strict=True)]
    order = pa.array([i for _, i in LoserTree(sequences)], pa.int64())
    yield from whole.take(order).combine_chunks().to_batches(max_chunksize=8192)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one range after another, each range merged by itself."""
    held, at = [], None
    for batch in batches:
        for number, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and number != at:
                yield from _merged(held)
                held = []
            at = number
            held.append(block.as_py())
    if held:
        yield from _merged(held)


def range_bounds(runs: DataFrame, captures: int, ranges: int) -> list[tuple]:
    """Keys that cut the captures into about equal ranges, from at most about MOST_SAMPLED of them."""
    share = min(1.0, min(SAMPLED_PER_RANGE * ranges, MOST_SAMPLED) / max(captures, 1))
    picked = runs.filter(F.pmod(F.xxhash64("run", "offset"), F.lit(1 << 30)) < int(share * (1 << 30))).select(*_NAMES[:4], *[F.lit(None).cast("string").alias("url")], "offset").toArrow()
    keys = sorted(map(_order, zip(*(c.to_pylist() for c in picked.columns), strict=True)))
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def merged_index(runs: DataFrame, captures: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in the order of URL key, timestamp and id: partition after partition, row after row."""
    ranges = max(1, -(-captures // range_rows), min(captures, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = runs.sparkSession.sparkContext.broadcast(range_bounds(runs, captures, ranges))  # MOST_SAMPLED keys at most
    blocks = runs.select(*_NAMES).mapInArrow(_cut(bounds), _BLOCK)
    # Only the handles of blocks are put in order here; the captures in them stay as the runs have them.
    return blocks.repartitionByRange(ranges, "range").sortWithinPartitions("range").mapInArrow(_merge, _CAPTURE)


def capture_index(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes the archives of ``pages`` below the scratch folder, reads them back and merges their index."""
    path = scratch.path("archives")
    write_archives(pages, path)
    runs = scratch.keep(read_runs(pages.sparkSession, path), "runs")
    return merged_index(runs, runs.count())
