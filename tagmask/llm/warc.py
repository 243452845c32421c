"""WARC archives of page captures, with revisit records and a globally ordered capture index.

Tasks write archives (one gzip member per record) and, for each, a run file of index entries sorted by URL key and time. The
runs are merged externally: ranges of (key, time, place) are cut from the runs' own keys, and in each range a loser tree
merges the run files, of which it holds one block each. Reading back goes over the archive files themselves.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.llm.common import attach, new_path, read, written
from tagmask.llm.vector_text import light

#: Bytes of payload, and records, after which a task begins a new archive.
ARCHIVE_BYTES, ARCHIVE_ENTRIES = 32_000_000, 100_000
#: Entries of a block of a run file, keys that a run gives to the sample, run files that one loser tree merges, entries that
#: one merging task should get about, and ranges at most (their keys go to every task; beyond, ranges get longer).
RUN_BLOCK, SAMPLED, FAN_IN, MERGED_TOGETHER, MOST_RANGES = 256, 50, 512, 50_000, 10_000
#: Capture times: the tables have none, so a page's id counts seconds from here.
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: host labels reversed, then path and query (com,example)/path?query."""
    match = re.match(r"(?s)[^:/?#]*://([^/?#]*)([^#]*)", url or "")
    if not match:
        return (url or "").lower()
    host = re.sub(r":\d*$", "", match[1].rpartition("@")[2].lower())
    return ",".join(reversed(host.split("."))) + ")" + (match[2] or "/").lower()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captured(page_id: int | None) -> datetime.datetime:
    return EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**9)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "") -> bytes:
    """One record as a gzip member: a response, or a revisit where `refers_to` is given. `place` (archive and offset) makes
    the record's id its own where pages repeat."""
    date = lambda page: captured(page).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    named = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{place}')}>", "WARC-Date": date(page_id), "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""), "WARC-Payload-Digest": "sha1:" + payload_digest(payload), "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload))}
    if refers_to is not None:
        named |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Date": date(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    named |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record of an archive, checked for whole lengths."""
    offset = 0
    while offset < len(data):
        member, parts, end = zlib.decompressobj(31), [], offset
        while not member.eof and end < len(data):
            parts.append(member.decompress(data[end : end + 65536]))
            end = min(len(data), end + 65536)
        raw, size = b"".join(parts), end - offset - len(member.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        length = int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
            raise ValueError("not a whole record")
        yield offset, headers, rest[:length]
        offset += size


class LoserTree:
    """Merges sorted runs, of which only the heads are held: each inner node holds the loser of its match, the winner is on top."""

    def __init__(self, runs: Iterable[Iterable], key: Callable):
        self.runs, self.key = [iter(run) for run in runs], key
        self.size = max(1, len(self.runs))
        self.values: list = [None] * self.size
        #: What is compared: whether the run is used up, its head's key, its number (ties go to the earlier run).
        self.heads: list[tuple] = [(1, None, i) for i in range(self.size)]
        for run in range(len(self.runs)):
            self._advance(run)
        self.losers = [-1] * self.size
        self.winner = self._built(1) if self.size > 1 else 0

    def _advance(self, run: int) -> None:
        for value in self.runs[run]:
            self.values[run], self.heads[run] = value, (0, self.key(value), run)
            return
        self.values[run], self.heads[run] = None, (1, None, run)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x[0] < y[0] if x[0] or y[0] else x[1:] < y[1:]

    def _built(self, node: int) -> int:
        """The winner under a node; the loser stays there. Leaves follow the inner nodes."""
        if node >= self.size:
            return node - self.size
        a, b = self._built(2 * node), self._built(2 * node + 1)
        if self._less(b, a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while not self.heads[self.winner][0]:
            run = self.winner
            yield self.values[run]
            self._advance(run)
            node = (run + self.size) // 2
            while node > 0:
                if self._less(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


#: An index entry; `archive` and `offset` say where its record lies.
ENTRY = pa.schema([("url_key", pa.string()), ("time", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())])


def write_run(store: fs.FileSystem, name: str, entries: Iterable[tuple]) -> int:
    """Write sorted entries as a run file of blocks, in the order given; how many there were. Only a block is held."""
    count, options = 0, pa.ipc.IpcWriteOptions(compression="zstd")
    with store.open_output_stream(name, compression=None) as out, pa.ipc.new_file(out, ENTRY, options=options) as file:
        entries = iter(entries)
        while block := list(islice(entries, RUN_BLOCK)):
            file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), ENTRY, strict=True)], schema=ENTRY))
            count += len(block)
    return count


def read_run(store: fs.FileSystem, name: str, low: tuple = (), high: tuple | None = None) -> Iterator[tuple]:
    """The entries of a run file from key `low` to before `high`, block by block; the first block is found by halving."""
    with store.open_input_file(name) as opened:
        file = pa.ipc.open_file(opened)
        rows = lambda i: list(zip(*(c.to_pylist() for c in file.get_batch(i).columns), strict=True))
        first, last = 0, file.num_record_batches
        while last - first > 1:  # the first block that may hold `low`
            middle = (first + last) // 2
            head = tuple(c[0].as_py() for c in file.get_batch(middle).columns[:4])
            first, last = (middle, last) if head <= low else (first, middle)
        for i in range(first, file.num_record_batches):
            for row in rows(i):
                if high is not None and row[:4] >= high:
                    return
                if row[:4] >= low:
                    yield row


def first_captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of pages whose payload an earlier id has; payloads under `least_bytes` have none."""
    narrow = written(pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")), "warc-digests")
    usable = narrow.filter((F.col("n") >= least_bytes) & F.col("page_id").isNotNull())
    firsts = usable.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).filter("c > 1").drop("c")
    found = attach(narrow.select("page_id", "sha"), written(firsts, "warc-firsts"), ["sha"], "page_id")
    return written(found.filter("page_id > refers_to").distinct(), "warc-revisits")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) as archives, each with a sorted run of index entries; the (written) list of both: archive,
    run, entries and a sample of the run's keys.

    A task that is run again writes files under new names; only files that the list names count.
    """
    small = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    joined = attach(small, first_captures(pages, least_bytes), ["page_id", "sha"], "page_id").drop("sha")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        new = lambda: f"{folder}/capture-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        name, buffer, entries, held = new(), io.BytesIO(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal name, buffer, entries, held
            with store.open_output_stream(f"{name}.warc.gz", compression=None) as out:
                out.write(buffer.getvalue())
            entries.sort(key=lambda e: e[:4])
            write_run(store, f"{name}.run", entries)
            keys = [dict(zip(ENTRY.names[:4], e[:4], strict=True)) for e in entries[:: max(1, len(entries) // SAMPLED)]]
            row = pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "run": [f"{name}.run"], "entries": [len(entries)], "keys": pa.array([keys], pa.list_(pa.struct(list(ENTRY)[:4])))})
            name, buffer, entries, held = new(), io.BytesIO(), [], 0
            return row

        for batch in light(batches, "html"):
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode()
                entries.append((url_key(url), captured(page_id).strftime("%Y%m%d%H%M%S"), f"{name}.warc.gz", buffer.tell(), page_id, "response" if refers_to is None else "revisit"))
                buffer.write(record(page_id, url, payload, refers_to, f"{name}:{buffer.tell()}"))
                held += len(payload)
                if held >= ARCHIVE_BYTES or len(entries) >= ARCHIVE_ENTRIES:
                    yield flush()
        if entries:
            yield flush()

    return written(joined.mapInArrow(write, f"archive string, run string, entries long, keys array<struct<{KEY}>>"), "warc-runs")


KEY = "url_key: string, time: string, archive: string, offset: long"


def cut_keys(runs: DataFrame, entries: int) -> list[tuple]:
    """Keys that cut the runs into ranges of about `entries` entries, at most MOST_RANGES: merging holds blocks, so longer
    ranges only take longer. They are keys of the runs, with time and place, so that one hot URL is cut too."""
    total = runs.agg(F.sum("entries")).first()[0] or 0
    parts = max(1, min(MOST_RANGES, -(-total // entries)))
    keys = runs.select(F.explode("keys").alias("k")).select("k.*")
    share = min(1.0, parts * 20 / max(1, keys.count()))
    some = keys.filter(F.pmod(F.xxhash64("archive", "offset"), F.lit(1_000_000)) < share * 1_000_000).collect()
    ordered = sorted(tuple(r) for r in some)
    return sorted({ordered[i * len(ordered) // parts] for i in range(1, parts)}) if ordered else []


def merge_runs(runs: DataFrame, path: str, entries: int = MERGED_TOGETHER) -> DataFrame:
    """All entries in global order of (url_key, time, archive, offset), numbered from 0 as `capture_order`.

    Pass by pass, tasks merge up to FAN_IN run files through a loser tree into one, of each of which they hold one block. Where
    there are more runs than that, the first pass merges whole ones, since every range opens every run that is left; the
    next cuts ranges of keys. The last pass merges what is left of a range and numbers it after the ranges before.
    """
    cuts = cut_keys(runs, entries)

    def merged(store, files: list[str], part: int, cut: bool) -> LoserTree:
        low, high = (cuts[part - 1] if part and cut else ()), (cuts[part] if part < len(cuts) and cut else None)
        return LoserTree([read_run(store, file, low, high) for file in files], lambda e: e[:4])

    def one_pass(cut: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, folder = fs.FileSystem.from_uri(path)
            for batch in batches:
                for part, files in zip(batch.column("part").to_pylist(), batch.column("files").to_pylist(), strict=True):
                    name = f"{folder}/merged-{part:06d}-{uuid.uuid4().hex}.run"
                    n = write_run(store, name, merged(store, files, part, cut))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], ["part", "run", "entries"])

        return merge

    def dealt(pieces: DataFrame) -> DataFrame:
        """Files of a range in groups of about FAN_IN, by hash."""
        sizes = pieces.groupBy("part").agg(F.ceil(F.count("*") / FAN_IN).alias("groups"))
        grouped = pieces.join(sizes, "part").groupBy("part", F.pmod(F.xxhash64("run"), F.col("groups")).alias("g"))
        return spread(grouped.agg(F.array_sort(F.collect_list("run")).alias("files")).select("part", "files"))

    def spread(units: DataFrame) -> DataFrame:
        units = written(units, "warc-units")
        return units.repartition(max(1, min(20_000, units.count())))

    kinds, left, count = "part int, run string, entries long", runs.select(F.lit(0).alias("part"), "run"), runs.count()
    if cuts and count > FAN_IN:
        left = written(dealt(left).mapInArrow(one_pass(False), kinds), "warc-whole").select("part", "run")
        count = left.count()
    groups = F.lit(max(1, -(-count // FAN_IN)))
    first = left.groupBy(F.pmod(F.xxhash64("run"), groups).alias("g")).agg(F.array_sort(F.collect_list("run")).alias("files"))
    first = first.select(F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("part"), "files")
    pieces = written(spread(first).mapInArrow(one_pass(True), kinds), "warc-merged")
    while pieces.groupBy("part").count().filter(F.col("count") > FAN_IN).limit(1).count():
        pieces = written(dealt(pieces).mapInArrow(one_pass(False), kinds), "warc-merged")
    # At most MOST_RANGES numbers.
    sizes = dict(pieces.groupBy("part").agg(F.sum("entries")).collect())
    starts = [0, *accumulate(sizes.get(part, 0) for part in range(len(cuts)))]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for part, files in zip(batch.column("part").to_pylist(), batch.column("files").to_pylist(), strict=True):
                order, entries = starts[part], iter(merged(store, files, part, False))
                while block := list(islice(entries, RUN_BLOCK)):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), ENTRY, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(range(order, order + len(block)), pa.int64())], [*ENTRY.names, "capture_order"])
                    order += len(block)

    last = spread(pieces.groupBy("part").agg(F.array_sort(F.collect_list("run")).alias("files")))
    return last.mapInArrow(number, "url_key string, time string, archive string, offset long, page_id long, record_type string, capture_order long")


def read_archives(runs: DataFrame, path: str) -> DataFrame:
    """Every record of the listed archive files: archive, offset, page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digests of responses are computed from the payload read, and must equal the header's."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(name, compression=None) as file:
                    data = file.read()
                rows = []
                for offset, headers, block in records(data):
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["X-Payload-Length"])
                    if headers["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if payload_digest(payload) != digest or len(payload) != size:
                            raise ValueError("a payload does not have its digest")
                    ids = [int(headers[k]) if headers.get(k) else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                    rows.append((name, offset, ids[0], size, digest, headers["WARC-Type"], ids[1]))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    tasks = max(1, min(20_000, runs.count()))
    return runs.select("archive").repartition(tasks).mapInArrow(scan, "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) written and read back, one row per row, with its place in the global capture history.

    Of equal payloads of at least `least_bytes`, the smallest page_id is the response and larger ids revisit it; rows that
    repeat that id are responses too, as are rows without an id. Null HTML is an empty payload, a null URL an empty key.
    """
    runs = write_archives(pages, path, least_bytes)
    history = written(merge_runs(runs, path).select("archive", "offset", "url_key", "capture_order"), "warc-history")
    # Both sides grow with the pages: a merge join, whatever the optimiser makes of their compressed sizes.
    return read_archives(runs, path).join(history.hint("merge"), ["archive", "offset"]).drop("archive", "offset")


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, through archives and the merged index."""
    rows = archive(read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_order")
