"""WARC archives with an external index merge.

Writing tasks append gzip members to archives in the shared folder and spill their index entries as locally sorted
runs. Passes of bounded fan-in merge groups of runs into longer ones until no key has more than FAN_IN of them; ranges of the
key (URL key, timestamp, record) are then merged independently: each range opens just the run blocks that reach into it.
Every merge is a loser tree over streams, so a task holds one block of each of its runs, and the ranges in their order
are the globally ordered capture histories.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..scratch import Workspace
from .skew import hot_keys, split_join

ARCHIVE_BYTES = 256 << 20
RUN_ENTRIES = 50_000
BLOCK_ENTRIES = 1024
RANGE_ENTRIES = 200_000
#: Block keys looked at to place borders; only the balance of the ranges depends on it. There are fewer ranges than keys, so beyond some
#: 4e9 entries ranges grow, which makes tasks longer, not larger.
BORDER_SAMPLE = 20_000
#: Runs that a merge opens (twice as many where pieces of runs meet), entries that a task of a merge pass has on average.
FAN_IN = 64
PASS_ENTRIES = 1 << 21
OUT_ENTRIES = 4096
DATE = "2024-01-01T00:00:00Z"

ENTRY = pa.schema([("urlkey", pa.string()), ("ts", pa.string()), ("record", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("digest", pa.string())])
_KEY = pa.list_(pa.string())
BLOCK = pa.schema([("run", pa.string()), ("block", pa.int32()), ("entries", pa.int32()), ("first_key", _KEY), ("last_key", _KEY)])
PLACED = pa.schema([("history_range", pa.int32()), ("history_seq", pa.int64()), *ENTRY])
READ_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("urlkey", pa.string()), ("history_range", pa.int32()), ("history_seq", pa.int64())])
HISTORY = "history_range int, history_seq long, urlkey string, ts string, record string, page_id long, file string, offset long, length long, record_type string, digest string"
BLOCKS = "run string, block int, entries int, first_key array<string>, last_key array<string>"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: `com,example,www)/a?b`. No scheme, user, default port or fragment."""
    rest = (url or "").strip().partition("#")[0]
    scheme, mark, tail = rest.partition("://")
    rest, scheme = (tail, scheme.lower()) if mark else (rest, "")
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    host, _, port = host.partition(":")
    if port and {"http": "80", "https": "443"}.get(scheme) != port:
        port = f":{port}"
    else:
        port = ""
    host = host.removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}{port}){path if path.startswith('/') else '/' + path}"


def record_bytes(kind: str, record: str, url: str, date: str, payload: bytes, digest: str, refers: str | None, page_id: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, whose Content-Length is the full payload's, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record}>", f"WARC-Date: {date}"]
    if clean := "".join(c for c in url if c not in "\r\n"):
        head.append(f"WARC-Target-URI: {clean}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers is not None:
        head += [f"X-Refers-To-Page-Id: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one uncompressed record."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so a next item costs one path of log2(k) matches."""

    def __init__(self, runs: list[Iterator[dict]], key: Callable[[dict], tuple]):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._pull(i)
        self.lost = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _pull(self, i: int) -> None:
        self.head[i] = next(self.runs[i], None)
        self.keys[i] = None if self.head[i] is None else self.key(self.head[i])

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        at, winner = (i + self.k) // 2, i
        while at > 0:
            if self.lost[at] < 0:  # still being built: wait for the other side
                self.lost[at] = winner
                return
            if self._before(self.lost[at], winner):
                self.lost[at], winner = winner, self.lost[at]
            at //= 2
        self.lost[0] = winner

    def __iter__(self) -> Iterator[dict]:
        while self.k and self.head[top := self.lost[0]] is not None:
            yield self.head[top]
            self._pull(top)
            self._play(top)


def _key(e: dict) -> tuple[str, str, str]:
    return e["urlkey"], e["ts"], e["record"]


def _store_run(store, base: str, entries: Iterator[dict], block_entries: int) -> pa.RecordBatch:
    """Writes ordered entries as a run and returns its blocks."""
    path, made = f"{base}/run-{uuid.uuid4().hex}.arrow", []
    with store.open_output_stream(path) as sink, pa.ipc.new_file(sink, ENTRY) as w:
        while b := list(islice(entries, block_entries)):
            w.write_batch(pa.RecordBatch.from_pylist(b, ENTRY))
            made.append({"run": path, "block": len(made), "entries": len(b), "first_key": list(_key(b[0])), "last_key": list(_key(b[-1]))})
    return pa.RecordBatch.from_pylist(made, BLOCK)


def _write(root: str, block_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        store.create_dir(base, recursive=True)
        out, name, at, entries = None, None, 0, []

        def spill() -> pa.RecordBatch:
            entries.sort(key=_key)
            made = _store_run(store, base, iter(entries), block_entries)
            entries.clear()
            return made

        for batch in batches:
            for r in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, at = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload, url = (r["payload"] or "").encode(), r["url"] or ""
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                kind = "response" if r["refers_to"] is None else "revisit"
                # the same row gets the same record id in every attempt
                record = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['page_id']} {r['date']} {url} {digest}"))
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(record_bytes(kind, record, url, r["date"], payload, digest, r["refers_to"], r["page_id"])) + z.flush()
                out.write(data)
                entries.append({"urlkey": url_key(url), "ts": r["date"], "record": record, "page_id": r["page_id"], "file": name, "offset": at, "length": len(data), "record_type": kind, "digest": digest})
                at += len(data)
                if len(entries) >= RUN_ENTRIES:
                    yield spill()
        if out:
            out.close()
        if entries:
            yield spill()

    return run


def _deal(borders: list[tuple]):
    """Each run block goes to every range that it reaches into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("first_key", "last_key"))
            hits = [(i, r) for i, (a, b) in enumerate(zip(first, last)) for r in range(bisect.bisect_right(borders, tuple(a)), bisect.bisect_right(borders, tuple(b)) + 1)]
            took = batch.take(pa.array([i for i, _ in hits], pa.int64()))
            yield pa.record_batch([took.column(took.schema.get_field_index("lane")), pa.array([r for _, r in hits], pa.int32()), took.column(0), took.column(1)], ["lane", "part", "run", "block"])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict[str, list[int]]]]:
    """(lane, part, blocks by run) of each stretch of rows with one lane and part."""
    now, held = None, {}
    for batch in batches:
        for lane, part, path, block in zip(*(c.to_pylist() for c in batch.columns)):
            if (lane, part) != now:
                if held:
                    yield *now, held
                now, held = (lane, part), {}
            held.setdefault(path, []).append(block)
    if held:
        yield *now, held


def _merged(store, by_run: dict[str, list[int]], borders: list[tuple], part: int) -> Iterator[dict]:
    """Entries of one range of some runs, in order; each run is read block by block."""
    low, high = (borders[part - 1] if part else None), (borders[part] if part < len(borders) else None)

    def read(path: str, which: list[int]) -> Iterator[dict]:
        with store.open_input_file(path) as f:
            reader = pa.ipc.open_file(f)
            for b in sorted(which):
                for e in reader.get_batch(b).to_pylist():
                    if (low is None or _key(e) >= low) and (high is None or _key(e) < high):
                        yield e

    return iter(LoserTree([read(p, b) for p, b in sorted(by_run.items())], _key))


def _pass(root: str, borders: list[tuple], block_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        for lane, part, by_run in _cells(batches):
            made = _store_run(store, base, _merged(store, by_run, borders, part), block_entries)
            yield made.append_column("lane", pa.array([lane] * made.num_rows, pa.int64()))

    return run


def _merge(root: str, borders: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(root)
        for _, part, by_run in _cells(batches):
            entries, seq = _merged(store, by_run, borders, part), 0
            while some := list(islice(entries, OUT_ENTRIES)):
                yield pa.RecordBatch.from_pylist([e | {"history_range": part, "history_seq": seq + i} for i, e in enumerate(some)], PLACED)
                seq += len(some)

    return run


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        name, f = None, None
        for batch in batches:
            rows = []
            for e in batch.to_pylist():
                if e["file"] != name:
                    if f:
                        f.close()
                    name = e["file"]
                    f = store.open_input_file(f"{base}/{name}")
                f.seek(e["offset"])
                warc, http, payload = parse_record(zlib.decompress(f.read(e["length"]), 31))
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                if warc["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{name} at {e['offset']}: payload and digest differ")
                page, refers = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
                rows.append({
                    "page_id": None if page is None else int(page), "payload_bytes": int(http["content-length"]), "payload_digest": digest,
                    "record_type": warc["warc-type"], "refers_to": None if refers is None else int(refers), "urlkey": e["urlkey"],
                    "history_range": e["history_range"], "history_seq": e["history_seq"],
                })
            yield pa.RecordBatch.from_pylist(rows, READ_BACK)
        if f:
            f.close()

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, history_range int, history_seq long"


def write_archives(pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, least_bytes: int = 0, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Writes a record per row under ``root`` (a folder that all executors share) and returns its run blocks.

    Null payloads and URLs are empty. Of rows with equal payloads of at least least_bytes bytes those with the largest
    id are responses, the others revisit it; rows without an id are responses. An attempt that is run again writes
    files of other names, and only those of the attempt that counted are in the table returned.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    date = F.coalesce(F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(DATE)) if date_col else F.lit(DATE)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), date.alias("date"), F.sha1(payload).alias("sha"))
    same = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    same = Workspace(pages.sparkSession, "payloads").table(same, "same")
    # a payload that many pages hold is dealt to many tasks
    tagged = split_join(rows, same.select("sha", "keep"), "sha", hot_keys(same, "sha"), ["page_id", "url"], "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("keep"), F.col("keep"))).drop("keep")
    return tagged.mapInArrow(_write(root, block_entries), BLOCKS)


def _borders(blocks: DataFrame, wanted: int) -> list[tuple]:
    """At most wanted - 1 keys that part the entries about evenly."""
    if wanted < 2:
        return []
    keys = sorted(tuple(r[0]) for r in blocks.select("first_key").orderBy(F.xxhash64("run", "block")).limit(BORDER_SAMPLE).collect())
    return sorted({keys[len(keys) * i // wanted] for i in range(1, wanted)}) if keys else []


def _dealt(blocks: DataFrame, borders: list[tuple]) -> DataFrame:
    """(lane, part, run, block), the rows of a lane and part beside each other in one task."""
    dealt = blocks.select("run", "block", "first_key", "last_key", "lane").mapInArrow(_deal(borders), "lane long, part int, run string, block int")
    return dealt.repartition("lane", "part").sortWithinPartitions("lane", "part", "run", "block")


def merge_index(blocks: DataFrame, root: str, range_entries: int = RANGE_ENTRIES, fan_in: int = FAN_IN, pass_entries: int = PASS_ENTRIES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Globally ordered capture histories: by (history_range, history_seq) in order of URL key, timestamp and record.

    A lane is a set of runs of which a key has one at most. While there are more than fan_in lanes, a pass merges each fan_in of them
    into one, cut into pieces of about pass_entries entries, one task a piece. So no task opens more than about fan_in runs,
    and an entry is written once more for each power of fan_in in the number of runs.
    """
    work = Workspace(blocks.sparkSession, "lanes")
    entries, runs = blocks.agg(F.sum("entries"), F.countDistinct("run")).first()
    numbered = blocks.select("run").distinct().withColumn("lane", F.row_number().over(Window.orderBy("run")).cast("long") - 1)  # a row a run
    blocks = blocks.join(numbered, "run").select("run", "block", "entries", "first_key", "last_key", "lane")
    lanes, step = runs, 0
    while lanes > fan_in:
        lanes, step = -(-lanes // fan_in), step + 1
        borders = _borders(blocks, -(-entries // (lanes * pass_entries)))
        next_lane = blocks.withColumn("lane", F.floor(F.col("lane") / fan_in).cast("long"))
        blocks = work.table(_dealt(next_lane, borders).mapInArrow(_pass(root, borders, block_entries), BLOCKS + ", lane long"), f"pass-{step}")
    borders = _borders(blocks, -(-(entries or 0) // range_entries))
    return _dealt(blocks.withColumn("lane", F.lit(0).cast("long")), borders).mapInArrow(_merge(root, borders), HISTORY)


def read_archives(history: DataFrame, root: str) -> DataFrame:
    """The records behind index entries, one row each; digests of responses are computed again and must agree."""
    files = history.repartition("file").sortWithinPartitions("file", "offset")
    return files.mapInArrow(_read(root), READ)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    root = f"{work.path}/archives"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    blocks = work.table(write_archives(pages, root), "blocks")
    history = work.table(merge_index(blocks, root), "history")
    return read_archives(history, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
k as (select h, max(page_id) keep, count(*) n from p group by h)
select page_id, strlen(h)::bigint payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(h), (5 * (i // 4) + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::bigint, 1)), '') payload_digest,
  case when page_id < keep then 'revisit' else 'response' end record_type,
  case when page_id < keep then keep end refers_to
from p join k using (h)
"""
