"""WARC archives: a writer with revisit records and a splittable reader.

Writing: one gzip member a record, one file a task, renamed when whole. Payloads of at least
`least` bytes that are equal (SHA-1 and length) become one response, that of the largest id,
and revisit records that name it. Digests are compared without payloads; a row's payload is
shuffled once, to the join that tells it whether it is a revisit.

Reading: files are cut into byte ranges. A task looks for gzip's magic bytes in its range,
takes a place as a member only if it inflates to a WARC version line and a header block,
and owns the records that start inside its range; a record's end may be beyond it. A
candidate inside another member's compressed bytes fails that test, and one that is inside
a record already read is never looked at. Records without a digest get it from the payload.

Defined cases: null html is an empty payload; ids must not be null to be named by revisits
(rows with a null id are responses); repeated ids with equal payloads: the row itself is
the response, as it holds the largest id; payloads of any length are written and inflated in
chunks of a bounded read window; an empty table gives files without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, new_folder, open_folder, table

RANGE = 8 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
LEAST = 1000
SALTS = 16  # parts into which the rows of one payload are split in the join
MOST_TASKS = 50_000  # that read ranges; a task may have several
_CHUNK = 1 << 16


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member. A revisit has no payload; its length is in an own header field."""
    sha = hashlib.sha1(payload).digest()
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20]", "", url or ""),
        "WARC-Payload-Digest: sha1:" + base64.b32encode(sha).decode(),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    body = payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def responses(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html and refers_to (null: a response). Only digests are grouped and joined."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", "html", F.sha1(html).alias("__sha"), F.length(html).alias("__n"))
    named = own.where((F.col("__n") >= least) & F.col("page_id").isNotNull())
    # a hot payload's rows: the aggregation's partial step takes them together, and the join spreads them by salt
    first = named.groupBy(F.col("__sha").alias("__s"), F.col("__n").alias("__l")).agg(F.max("page_id").alias("__first"), F.count("*").alias("__c")).where("__c > 1").drop("__c")
    first = first.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = (
        named.select(F.col("page_id").alias("__id"), "__sha", "__n", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("__t"))
        .join(first, (F.col("__sha") == F.col("__s")) & (F.col("__n") == F.col("__l")) & (F.col("__t") == F.col("__salt")))
        .where(F.col("__id") < F.col("__first")).select("__id", "__sha", "__first").distinct()
    )
    revisits = revisits.withColumnRenamed("__sha", "__s")
    joined = own.join(revisits, (F.col("page_id") == F.col("__id")) & (F.col("__sha") == F.col("__s")), "left")
    return joined.select("page_id", "url", "html", F.col("__first").alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = LEAST) -> list:
    """Write the archives; rows (name, size), one a task."""
    fields = [(f.name, f.dataType.simpleString()) for f in pages.schema.fields if f.name == "page_id"]
    if not fields:
        raise ValueError("pages need a page_id")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = open_folder(folder)
        name, size = f"part-{context.partitionId():06d}.warc.gz", 0
        trial = f"{path}/_{name}.{context.attemptNumber()}"
        with system.open_output_stream(trial, compression=None) as stream:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    data = record(page_id, url, (html or "").encode(), refers_to)
                    stream.write(data)
                    size += len(data)
        system.move(trial, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name], "size": [size]})

    return sorted(responses(pages, least).mapInArrow(lean(run), "name string, size long").collect())


def _inflate(stream, at: int, size: int, first: bytes):
    """(inflated member, its end) for a member at `at`, or None if it isn't a whole record."""
    unpacker, out, data, place = zlib.decompressobj(31), [], first, at
    try:
        head = unpacker.decompress(data, 1 << 12)
        while True:
            # `first` may end inside the member's header: what there is of the version line is judged
            if head[: len(VERSION)] != VERSION[: len(head)]:
                return None
            if len(head) >= len(VERSION):
                break
            if unpacker.eof:
                return None
            rest = unpacker.unconsumed_tail
            if not rest:
                place += len(data)
                stream.seek(place)
                data = rest = stream.read(_CHUNK)
                if not rest:
                    return None
            head += unpacker.decompress(rest, 1 << 12)
        out.append(head)
        while not unpacker.eof:
            rest = unpacker.unconsumed_tail
            if not rest:
                place += len(data)
                stream.seek(place)
                data = rest = stream.read(_CHUNK)
                if not rest:
                    return None
            out.append(unpacker.decompress(rest))
    except zlib.error:
        return None
    return b"".join(out), place + len(data) - len(unpacker.unused_data)


def parse(member: bytes) -> tuple[dict, bytes] | None:
    """(header fields in lower case, payload), or None if the lengths don't agree."""
    head, found, body = member.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        fields[key.strip().lower().decode()] = value.strip().decode()
    n = fields.get("content-length", "")
    if not n.isdigit() or len(body) < int(n):
        return None
    return fields, body[: int(n)]


def scan_range(stream, size: int, start: int, end: int):
    """Yield (offset, fields, payload) of the records that start in [start, end)."""
    at, window, base = start, b"", start
    while at < end:
        if at < base or at + len(MAGIC) > base + len(window):
            stream.seek(at)
            base, window = at, stream.read(_CHUNK * 16)
            if not window:
                return
        k = window.find(MAGIC, at - base)
        if k < 0:
            at = base + max(1, len(window) - len(MAGIC) + 1)
            if base + len(window) >= size:
                return
            continue
        at = base + k
        if at >= end:
            return
        got = _inflate(stream, at, size, window[k : k + _CHUNK])
        record_ = parse(got[0]) if got else None
        if record_ is None:
            at += 1
            continue
        yield at, record_[0], record_[1]
        at = got[1]


def read(spark: SparkSession, folder: str, files: list, span: int = RANGE) -> DataFrame:
    """page_id, payload_bytes, payload_digest (bare lower-case hex), record_type and refers_to of every record."""
    rows = [(r["name"], r["size"]) for r in files if r["size"]]
    n = sum(-(-size // span) for _, size in rows)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(span).cast("long")))
    ranges = spark.createDataFrame(rows, "name string, size long").select("name", "size", starts.alias("start"))
    ranges = ranges.select("name", "size", "start", F.least("size", F.col("start") + span).alias("stop")).repartition(min(max(1, n), MOST_TASKS))

    def number(value: str | None):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(found[1]) if found else None

    def run(batches):
        system, path = open_folder(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name, size, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                out = []
                with system.open_input_file(f"{path}/{name}") as stream:
                    for _, fields, payload in scan_range(stream, size, start, stop):
                        kind = fields["warc-type"]
                        if kind == "revisit":
                            digest, n = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(), int(fields["x-payload-length"])
                        else:
                            digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                        out.append((number(fields["warc-record-id"]), n, digest, kind, number(fields.get("warc-refers-to"))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return ranges.mapInArrow(lean(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    return read(spark, folder, write(table(spark, sf_dir, "pages"), folder))


ORACLE = f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) d, strlen(coalesce(html, '')) n from pages),
g as (select d, n, max(page_id) first from p where n >= {LEAST} group by d, n)
select page_id, p.n::bigint payload_bytes, p.d payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end record_type,
  case when first <> page_id then first end::bigint refers_to
from p left join g on p.d = g.d and p.n = g.n
"""
