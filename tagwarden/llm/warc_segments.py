"""WARC archives with segmented records: writing, and reading back by segment reassembly.

Writing: a page is a ``response`` record whose block is an HTTP message in chunked framing;
of pages with equal payloads the one with the smallest id is the response and the others are
``revisit`` records that refer to it. A block of over ``SEGMENT_BYTES`` is cut: the first
segment keeps the record's id (WARC-Segment-Number 1), the others are ``continuation`` records that
name it as their origin, and the last one has the total length. Every record is a gzip member of its own, so one can be read at
its offset alone; the files are written by Spark's own writer, each with a bounded number of records. (A record of under 16 MB ends
its member with a zero byte, which the writer puts there as its line end.)

Reading: files are inflated and parsed by Content-Length as a stream, so beside a file's bytes one record is in memory; continuation records are grouped by origin id,
ordered by segment number, their total length verified; the chunked framing is decoded and the
payload's digest verified. A record that lacks a segment or fails a check comes back with an ``error``, and so does
what cannot be read at all: a cut or damaged gzip member (what it held up to there is read), a record cut short, a
number in a head that is none. Zero bytes after a member are padding.

Nulls and odd inputs: a null html is an empty payload, and empty payloads are equal like others; a
null url is left out of the record; a row that repeats page_id and html gets a record of its own (a
revisit of the first), and where rows repeat as a whole they are counted and written from their counts, in runs dealt to all tasks; a null page_id is read back as null; of ties for the first the row with the smallest url is the
response; very long payloads are segmented whole; an empty table gives archives without records and no rows; only the
three named columns are read, so none can clash.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagwarden.llm.common import new_folder, table

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 16 << 10, 4 << 10, 2_000
RUN = 1_000  # copies of one row that a task writes at a time
DATE = "2024-01-01T00:00:00Z"  # fixed, so that a task that runs again writes the same bytes
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing (extensions and trailers allowed); raises ValueError when it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            if body.find(b"\r\n", at) < 0:
                raise ValueError("last chunk is not closed")
            return b"".join(out)
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at:at + size])
        at += size + 2


def member(record: bytes) -> bytes:
    """A record and the empty lines after it as a gzip member, without its last byte, which is zero."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = c.compress(record + b"\r\n\r\n") + c.flush()
    if data[-1]:
        raise ValueError("a record of 16 MB or more; take smaller segments")
    return data[:-1]


def _record(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records(page_id, url: str | None, payload: bytes, ordinal: int, first_id, first_ordinal: int | None,
            segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page. ``first_ordinal`` None: a response, else a revisit of that record."""
    sha = digest(payload)
    name = lambda i, k: f"<urn:page:{'null' if i is None else i}:{sha}:{k}>"
    own = name(page_id, ordinal)
    uri = None if url is None else "".join(c if 33 <= ord(c) <= 126 else "%" + "%".join(
        f"{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
    head = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": uri,
            "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http;msgtype=response"}
    if first_ordinal is not None:
        return [_record(head | {"WARC-Type": "revisit", "WARC-Refers-To": name(first_id, first_ordinal),
                                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"},
                        HTTP)]
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        return [_record(head, block)]
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    out = [_record(head | {"WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        out.append(_record({"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}:{k}>", "WARC-Date": DATE,
                            "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k,
                            "WARC-Segment-Total-Length": len(block) if k == len(parts) else None}, part))
    return out


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES) -> None:
    """Writes ``pages (page_id, url, html)`` as WARC files under ``folder``.

    Equal payloads are found on (digest, id) rows, pre-aggregated, so a payload that a third of
    all pages share moves as one row a task; the pages themselves are shuffled once, by id. Rows that repeat id, url and html
    are folded into one with their count before that.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # a key without nulls: the join and the window below then share one shuffle of the pages
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    p = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"), key.alias("key"))
    keys = p.select("page_id", "sha").groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    keys = keys.where("n > 1").select("sha", "first_id")
    # only pages whose payload repeats need to know the first of them
    firsts = p.select("key", "sha").distinct().join(keys, "sha").select("key", "sha", "first_id", F.lit(True).alias("more"))
    first_id = [F.col("first_id"), F.col("more").isNotNull().alias("repeats")]
    if p.groupBy("key", "sha").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = p.join(firsts, ["key", "sha"], "left").select("page_id", "url", "payload", *first_id, F.lit(1).cast("long").alias("ordinal"))
    else:  # rows of one id and payload are numbered by url: those of one url at once, by their count
        d = p.groupBy("page_id", "key", "sha", "url").agg(F.min("payload").alias("payload"), F.count("*").alias("n"))
        same = W.partitionBy("key", "sha").orderBy("url")
        d = d.join(firsts, ["key", "sha"], "left").select("page_id", "url", "payload", *first_id, "n", (F.sum("n").over(same) - F.col("n")).alias("before"))
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("run")
        d = d.select("*", runs).repartition(n, F.xxhash64("page_id", "url", "run"))
        copies = F.sequence(F.col("run"), F.least("n", F.col("run") + RUN) - 1)
        rows = d.select("page_id", "url", "payload", "first_id", "repeats", "before", F.explode(copies).alias("copy")) \
            .select("page_id", "url", "payload", "first_id", "repeats", (F.col("before") + F.col("copy") + 1).alias("ordinal"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                first = not r["repeats"] or (r["page_id"] == r["first_id"] and r["ordinal"] == 1)
                out += map(member, records(r["page_id"], r["url"], r["payload"], r["ordinal"], r["first_id"],
                                           None if first else 1, segment))
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\u0000").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


_PARSED = ("type string, id string, uri string, digest string, refers string, origin string, number int, total long, "
           "block binary, error string")


def _number(text: str | None) -> int | None:
    """A decimal number of a head; ValueError for anything else."""
    if text is None:
        return None
    if not (text.isascii() and text.isdigit() and len(text) < 19):
        raise ValueError(f"malformed number {text[:40]!r}")
    return int(text)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one uncompressed archive."""
    return parse_stream(iter([data]))


def parse_stream(chunks: Iterator[bytes]) -> Iterator[dict]:
    """The records of an archive that comes in chunks; ``error`` tells what is wrong with one. Only what is not yet parsed
    is held. After a record whose length cannot be read, the next line that begins a record is looked for."""
    held = bytearray()

    def more() -> bool:
        chunk = next(chunks, None)
        if chunk is None:
            return False
        held.extend(chunk)
        return True

    def find(what: bytes, at: int = 0) -> int:
        while (found := held.find(what, at)) < 0:
            at = max(at, len(held) - len(what) + 1)
            if not more():
                return -1
        return found

    while True:
        while (at := held.find(b"WARC/")) < 0:  # stray bytes between records
            del held[:max(0, len(held) - 4)]
            if not more():
                return
        del held[:at]
        end = find(b"\r\n\r\n")
        if end < 0:
            yield {"block": b"", "digest": "", "error": "record head cut short"}
            return
        head = {}
        for line in bytes(held[:end]).split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        get = head.get
        size = number = total = error = None
        try:
            size = _number(get(b"content-length", "0"))
            number, total = _number(get(b"warc-segment-number")), _number(get(b"warc-segment-total-length"))
            number = None if number is None else min(number, 2 ** 31 - 1)
        except ValueError as e:
            error = str(e)
        block = b""
        if size is None:
            after = find(b"\r\n\r\nWARC/", end)
        else:
            after = end + 4 + size
            while len(held) < after and more():
                pass
            block = bytes(held[end + 4:after])
            if len(block) < size:
                error = error or "record cut short"
        yield {"type": get(b"warc-type"), "id": get(b"warc-record-id"), "uri": get(b"warc-target-uri"),
               "digest": (get(b"warc-payload-digest") or "").removeprefix("sha1:"), "refers": get(b"warc-refers-to"),
               "origin": get(b"warc-segment-origin-id") or (get(b"warc-record-id") if number else None),
               "number": number, "total": total, "block": block, "error": error}
        if after < 0:
            return
        del held[:after]


def read_archives(spark, folder: str) -> DataFrame:
    """``(type, id, uri, digest, refers, payload, error)``: every record of the archives, reassembled.

    Whole records stay where they were read; only segments are shuffled, by their origin id. One
    record's segments meet in one row, as the record itself does.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    schema = pa.schema([("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("digest", pa.string()),
                        ("refers", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()),
                        ("block", pa.binary()), ("error", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column("content"):
                broken: list[str] = []
                held, size = [], 0
                # the stream ends before ``broken`` is asked for
                for r in itertools.chain(parse_stream(inflated(c.as_py(), broken)), (
                        {"block": b"", "digest": "", "error": e} for e in broken)):
                    held.append(r)
                    size += len(r["block"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    every = files.mapInArrow(split, _PARSED)
    tail = F.struct("number", "block", "total", "type", "uri", "digest", "refers", "error")
    segment = F.col("origin").isNotNull() & F.col("error").isNull()  # a bad segment comes back by itself, its record as lacking it
    seg = (every.where(segment).groupBy(F.col("origin").alias("id"))
           .agg(F.sort_array(F.collect_list(tail)).alias("parts")))
    one = every.where(~segment).select("id", F.array(tail).alias("parts"))
    return one.unionByName(seg).mapInArrow(_reassemble, "type string, id string, uri string, digest string, "
                                           "refers string, payload binary, error string")


def inflated(raw: bytes, broken: list[str]) -> Iterator[bytes]:
    """What the members of a gzip file hold, in steps; other files as they are. What is wrong with the last member
    read goes to ``broken``, after all that stands before the damage."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view, at = memoryview(raw), 0
    while True:
        while at < len(raw) and raw[at] == 0:  # padding
            at += 1
        if at >= len(raw):
            return
        d = zlib.decompressobj(31)
        try:
            while not d.eof and at < len(raw):
                step = view[at:at + (1 << 16)]
                part = d.decompress(step, 4 << 20)
                yield part
                while not d.eof and d.unconsumed_tail:  # a member may inflate to very much
                    yield d.decompress(d.unconsumed_tail, 4 << 20)
                at += len(step) - len(d.unused_data)
        except zlib.error as e:
            broken.append(f"gzip member damaged: {e}")
            return
        if not d.eof:
            broken.append("gzip member cut short")
            return


def reassembled(parts: list[dict]) -> tuple[bytes, str | None]:
    """``(payload, error)`` of one record from its ordered segments."""
    if parts[0].get("error"):
        return b"", parts[0]["error"]
    numbers = [p["number"] for p in parts]
    block = b"".join(p["block"] for p in parts)
    if numbers != [None]:
        if numbers != list(range(1, len(parts) + 1)):
            return b"", "segment missing or repeated"
        if parts[-1]["total"] is None:
            return b"", "last segment missing"
        if parts[-1]["total"] != len(block):
            return b"", "total length differs"
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return b"", "no HTTP head"
    if parts[0]["type"] != "response":
        return b"", None
    try:
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return b"", str(e)
    if parts[0]["digest"] and digest(payload) != parts[0]["digest"]:
        return payload, "digest differs"
    return payload, None


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = b.column("id").to_pylist(), []
        for id_, parts in zip(ids, b.column("parts")):
            parts = parts.as_py()
            payload, error = reassembled(parts)
            first = parts[0]
            rows.append({"type": first["type"], "id": id_, "uri": first["uri"], "digest": first["digest"],
                         "refers": first["refers"], "payload": payload, "error": error})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("digest", pa.string()),
            ("refers", pa.string()), ("payload", pa.binary()), ("error", pa.string())]))


def op7_warc_segments(spark, sf_dir: str) -> DataFrame:
    """Contract columns of every page, from the records that were read back."""
    folder = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    page = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    found = read_archives(spark, folder).select(
        page("id").alias("page_id"), "type", "id", "refers", F.octet_length("payload").cast("long").alias("n"),
        "digest", "error")
    found = found.checkpoint()  # ids, sizes and digests only
    bad = found.where(F.col("error").isNotNull()).limit(3).collect()
    if bad:
        raise ValueError(f"archive records failed: {bad}")
    response = found.where("type = 'response'").select("page_id", "n", "digest", F.lit("response").alias("record_type"),
                                                       F.lit(None).cast("long").alias("refers_to"))
    full = found.where("type = 'response'").select(F.col("id").alias("refers"), F.col("n").alias("full"),
                                                   F.col("digest").alias("full_digest"))
    revisit = found.where("type = 'revisit'").select("page_id", "refers").join(full, "refers", "left").select(
        "page_id", F.col("full").alias("n"), F.col("full_digest").alias("digest"), F.lit("revisit").alias("record_type"),
        page("refers").alias("refers_to"))
    return response.unionByName(revisit).select("page_id", F.col("n").alias("payload_bytes"),
                                                F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def oracle() -> str:
    """The query in SQL, base32 from the hex digits of the digest."""
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((h{g} >> {35 - 5 * i}) & 31 AS INTEGER), 1)"
                         for g in range(4) for i in range(8))
    parts = ", ".join(f"CAST('0x' || substr(hex, {10 * g + 1}, 10) AS BIGINT) AS h{g}" for g in range(4))
    return f"""
SELECT page_id, payload_bytes, {digits} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT *, {parts} FROM (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages))"""
