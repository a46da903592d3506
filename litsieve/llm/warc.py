"""WARC archives of pages, and their index by external merge of sorted capture runs.

Archives are written by Spark's text writer (a record's bytes, then CR LF CR LF), read back whole file by
whole file, and parsed by Content-Length. The captures of an archive form a run, sorted by URL key and
timestamp where it was read. The index merge cuts each run at common key boundaries, moves the slices, and
a loser tree merges the k sorted slices of each key range, so that ranges follow one another in global order.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import columns, cut_lineage, salted_left_join, shuffle_width
from litsieve.session import ensure_checkpoint_dir

LEAST_REVISIT = 100        # payloads of fewer bytes are always written out
ARCHIVE_RECORDS = 2_000
SAMPLE_PER_RANGE = 40      # keys that the driver sees for each range of the index
EPOCH = 1_577_836_800
KEY = ("url_key", "timestamp", "page_id")
CAPTURE = ("url_key string, timestamp string, page_id long, url string, record_type string, payload_bytes long, "
           "payload_digest string, refers_to long, archive string, offset long, length long")


def _fields() -> list[str]:
    return [c.split()[0] for c in CAPTURE.split(", ")]


def captures(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> with payload, digest, record type and the page a revisit refers to.

    Of equal payloads of LEAST_REVISIT bytes or more, rows with the smallest page_id are responses and the
    others revisit it; a null html is an empty payload; a row without page_id never revisits nor is referred to.
    """
    rows = columns(pages, page_id="long", url="string", html="string").withColumn("payload", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    groups = (rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest")
              .agg(F.min("page_id").alias("_first"), F.count("page_id").alias("_n")).where("_n > 1").drop("_n"))
    rows = salted_left_join(rows.drop("html"), groups, "payload_digest", F.col("page_id"))
    revisit = F.coalesce(F.col("page_id") > F.col("_first"), F.lit(False))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                       F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.when(revisit, F.col("_first")).alias("refers_to"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record(rows: DataFrame) -> DataFrame:
    """One WARC/1.1 record a capture, as text; a revisit holds the HTTP head alone."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(315_360_000))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("refers_to"))),
                                 F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"))
    length = F.octet_length("_http") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return rows.withColumn("_http", http).select(
        F.concat(head, F.lit("Content-Length: "), length.cast("string"), F.lit("\r\n\r\n"), "_http", body).alias("value"))


def write_archives(pages: DataFrame, folder: str, records: int = ARCHIVE_RECORDS) -> None:
    """Gzipped WARC files of at most ``records`` records under ``folder``, on any file system Spark can write."""
    (record(captures(pages)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records).text(folder))


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path: com,example)/path?query; scheme, fragment, www. and ports do not count."""
    rest = (url or "").split("#", 1)[0].strip()
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        path = f"?{query}"
    host = host.rpartition("@")[2].partition(":")[0].lower().removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))})/{path.rstrip('/') if slash else path}"


class _Inflated(io.RawIOBase):
    """Reads gzip members one after another from bytes, a bounded piece at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.z = data, 0, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        while not self.left:
            if self.z.eof:
                if self.at >= len(self.data):
                    return 0
                self.z = zlib.decompressobj(31)
            piece = self.z.unconsumed_tail
            if not piece:
                piece, self.at = self.data[self.at:self.at + (1 << 20)], self.at + (1 << 20)
            if not piece:
                return 0
            self.left = self.z.decompress(piece, 1 << 22)
            if self.z.eof and self.z.unused_data:
                self.at -= len(self.z.unused_data)
        n = min(len(to), len(self.left))
        to[:n], self.left = self.left[:n], self.left[n:]
        return n


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record; offsets count uncompressed bytes."""
    stream, at = io.BufferedReader(_Inflated(data) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 20), 0
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        size, head = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError(f"record at byte {at} is cut off")
        end = stream.read(4)
        size += len(line) + n
        yield head, block, at, size
        at += size + len(end)


def _capture(head: dict[str, str], block: bytes, archive: str, offset: int, length: int) -> tuple:
    page = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, url = head["warc-type"], head.get("warc-target-uri")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if kind == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = head["warc-payload-digest"].partition(":")[2]
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if head["warc-payload-digest"] != f"sha256:{digest}":
            raise ValueError(f"{archive}, byte {offset}: payload does not match its digest")
    stamp = "".join(c for c in head["warc-date"] if c.isdigit())
    return (url_key(url), stamp, page(head["warc-record-id"]), url, kind, size, digest, page(head.get("warc-refers-to")), archive, offset, length)


def _order(row: tuple) -> tuple:
    """URL key, timestamp, page (none first); then the place, so that the order is total."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _table(rows: list[tuple], extra: dict | None = None) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*((n, kinds[k]) for n, k in (c.split() for c in CAPTURE.split(", "))))
    cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)]
    more = extra or {}
    return pa.RecordBatch.from_arrays(cols + list(more.values()), names=[*names, *more])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives below ``folder``, those of each archive together as one sorted run."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                archive = path.as_py().rpartition("/")[2]
                run = [_capture(h, b, archive, at, n) for h, b, at, n in records(content.as_buffer().to_pybytes())]
                run.sort(key=_order)
                for k in range(0, len(run), 10_000):
                    yield _table(run[k:k + 10_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(parse, CAPTURE)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so each next row costs one path of log2 k matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.keys = [h and _order(h) for h in self.heads]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, build=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and x <= y

    def _play(self, winner: int, build: bool = False) -> None:
        node = (winner + self.k) >> 1
        while node:
            other = self.losers[node]
            if other < 0 and build:
                self.losers[node] = winner
                return
            if not self._beats(winner, other):
                self.losers[node], winner = winner, other
            node >>= 1
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.heads[best := self.losers[0]]) is not None:
            yield row
            self.heads[best] = head = next(self.runs[best], None)
            self.keys[best] = head and _order(head)
            self._play(best)


def merge_index(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Sorted runs (see read_archives) -> all captures with position, their place in the global order.

    Range boundaries come from a bounded sample of keys; equal URLs are told apart by time and page, so one
    URL may span ranges. A range's task holds its slices only: about 1/ranges of the index.
    """
    runs = cut_lineage(runs)  # keeps each run in its partition, in order
    ranges = ranges or shuffle_width(runs)
    n = runs.count()
    share = min(1.0, SAMPLE_PER_RANGE * ranges / max(n, 1))
    seen = runs.select(*KEY).sample(False, share, seed=11).collect()
    sample = sorted((r[0], r[1], r[2] is not None, r[2] or 0) for r in seen)
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            yield _table(rows, {"range": pa.array([bisect_right(bounds, _order(r)[:4]) for r in rows], pa.int32()),
                                "place": pa.array(range(len(rows)), pa.int64())})

    def merge(table: pa.Table) -> pa.Table:
        # slices arrive in any order; each is put back in run order by its own places, never by key
        table = table.sort_by([("archive", "ascending"), ("slice", "ascending"), ("place", "ascending")])
        names = _fields()
        archive, part = table["archive"].to_pylist(), table["slice"].to_pylist()
        rows = list(zip(*(table[c].to_pylist() for c in names)))
        cuts = [i for i in range(len(rows)) if not i or archive[i] != archive[i - 1] or part[i] != part[i - 1]] + [len(rows)]
        merged = list(LoserTree([iter(rows[a:b]) for a, b in zip(cuts, cuts[1:])]))
        out = _table(merged, {"range": table["range"].combine_chunks(), "position": pa.array(range(len(merged)), pa.int64())})
        return pa.Table.from_batches([out])

    cut = runs.mapInArrow(slices, f"{CAPTURE}, range int, place long").withColumn(
        "slice", F.monotonically_increasing_id() - F.col("place"))  # one value a batch of a run
    merged = cut.groupBy("range").applyInArrow(merge, f"{CAPTURE}, range int, position long")
    before = cut.groupBy("range").count().collect()   # one row a range
    starts, total = {}, 0
    for r in sorted(before, key=lambda r: r["range"]):
        starts[r["range"]], total = total, total + r["count"]
    if not starts:
        return merged.drop("range")
    lookup = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])
    return merged.withColumn("position", F.col("position") + lookup[F.col("range").cast("long")]).drop("range")


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def archive_and_index(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages' archives, reads them back and merges the index: one row per input row.

    With ``folder`` the archives stay there; without, they lie in the session's shared folder and are removed
    once the captures are checkpointed. Repeated rows are captured each (of the smallest id: all as responses);
    url may be null; ties in the order go by page_id, archive and offset; an empty table gives no rows.
    """
    spark = pages.sparkSession
    to = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, to)
    runs = cut_lineage(read_archives(spark, to))
    if folder is None:
        remove(spark, to)
    return merge_index(runs)
