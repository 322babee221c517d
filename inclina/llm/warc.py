"""WARC archives: written with Spark's text writer, read back by boundary chains.

:func:`write_archives` puts one record per page into uncompressed WARC 1.1 files, all with built-in functions. Of
records with equal payloads the one with the largest page_id is the response; the others are revisits
that hold no payload and refer to it.

:func:`read_archives` reads archives in the byte ranges that Spark deals out. The version line ``WARC/1.1`` also
occurs inside payloads, so a match is only a *candidate*. Each task walks its range once and emits, per candidate, its
offset and that of its successor by the record's own lengths, shortened to the first one outside the range.
Pointer jumping from the start of every file (each round doubles the steps that a pointer spans) keeps the range entries that are
reachable; a second pass walks every range from its entry on and cuts the records out. What lies between two records of the chain
is payload, whatever it looks like. A record that goes on in later ranges is put together from its pieces.

Only offsets are shuffled, a few per range; payloads stay where Spark reads them, but for records that cross a range at
a false match. No file is read whole by a task, and nothing but counts reaches the driver.

Defined results: null html is an empty payload. Rows without a page_id are records whose id cannot be named; they come before
all ids when the response is chosen. Of repeated rows (same page_id, same payload) one is the response and the others revisit it. An empty
table writes no record and reads back as no row. A record that is cut off, or that is not followed by a record or the end of its
file, ends its file's chain: it and what follows it are left out, and :func:`chain_ends` tells where. Field values that hold
the version line's text are escaped when written. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inclina.llm.store import scratch, stored
from inclina.operators.joins import attach_checked, left_join_ns
from inclina.operators.ordering import prefix_sums

MAGIC = "WARC/1.1\r\n"
_LINE = "\r\n"
_GAP = "\r\n\r\n"
RECORD = "file string, at long, type string, headers map<string,string>, block binary"
#: Ranges (four longs each) that may be broadcast.
RANGES = 1_000_000
#: Bytes of record blocks in a batch.
BATCH = 8 << 20
_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of binary ``data`` in base 32: every 5 hexadecimal digits are 4 of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX, _BASE32)


def _payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, same): payloads with equal ``same`` (length and two hashes) are equal."""
    html, url = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary"), F.coalesce(pages["url"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("url"), html.alias("payload"))
    same = F.struct(F.length("payload").alias("n"), F.col("digest"), F.xxhash64("payload").alias("x"))
    return rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("same", same)


def page_records(pages: DataFrame) -> DataFrame:
    """The records to write: page_id, url, payload, digest, revisit, and ``first_id``, the page_id of the response that a revisit refers to.

    Only ids and hashes are grouped. Rows that share the largest id of their payload (repeated rows) are the one case in
    which a payload travels: they are counted per url, and the smallest url's first row is the response."""
    rows = _payloads(pages)
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id")  # the largest id, nulls below all
    ids = rows.groupBy("same", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy("same").agg(F.sum("n").alias("n"), F.max(F.struct(order.alias("id"), "n")).alias("top")).where("n > 1")
    firsts = stored(groups.select("same", F.lit(True).alias("shared"), F.col("top.id.page_id").alias("first_id"), F.col("top.n").alias("tied")), "responses")
    joined = attach_checked(rows, firsts, ["same"])
    is_first = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    tied = F.coalesce(is_first & (F.col("tied") > 1), F.lit(False))
    out = ["page_id", "url", "payload", "digest", "revisit", "first_id"]
    records = joined.where(~tied).withColumn("revisit", ~is_first).select(*out)
    if not firsts.where("tied > 1").limit(1).count():
        return records
    per_url = joined.where(tied).groupBy("same", "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"))
    least = per_url.groupBy("same").agg(F.min("url").alias("least"))
    repeated = left_join_ns(per_url, least, ["same"]).withColumns({"digest": F.col("same.digest"), "first_id": F.col("page_id")})
    response = repeated.where("url = least").withColumn("revisit", F.lit(False))
    rest = F.col("n") - F.when(F.col("url") == F.col("least"), 1).otherwise(0)
    revisits = repeated.withColumn("rest", rest).where("rest > 0").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rest")))).withColumn("revisit", F.lit(True))
    return records.unionByName(response.select(*out)).unionByName(revisits.select(*out))


def _record_id(page_id: Column, last: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), last, F.lit(">"))


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """One WARC record per row of ``pages`` (page_id, url, html) into files of ``folder``, one per partition. A response's id ends
    in its digest, a revisit's in a random part."""
    revisit, digest = F.col("revisit"), F.col("digest")
    # white space, control characters and the version line cannot stand in a field
    uri = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), "WARC/", "WARC%2F")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length("payload").cast("string"), F.lit(_GAP)
    ).cast("binary")
    block = F.concat(http, F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")))
    fields = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.when(revisit, F.uuid()).otherwise(digest))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id"), digest))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.length("block").cast("string")),
    ]
    head = F.concat(F.lit(MAGIC), F.concat_ws(_LINE, *fields), F.lit(_GAP)).cast("binary")
    # the writer ends every value with one more line end
    value = F.concat(head, F.col("block"), F.lit(_LINE).cast("binary")).cast("string")
    page_records(pages).withColumn("block", block).select(value.alias("value")).write.option("lineSep", _LINE).text(folder)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What lies before, between and after the version lines of every file: the range it starts in and its bytes.

    Rows of one range are in the order of the file, in one partition."""
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("body"))


def _length(head: bytes) -> int | None:
    """The Content-Length of a record's fields."""
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, range, at, out): per candidate its offset in the range and the first offset outside that its chain leads to (null: it
    breaks off inside); one row without ``at`` tells the range's length."""
    own: tuple | None = None
    at: list[int] = []
    to: list[int] = []
    size = 0

    def handed() -> pa.RecordBatch:
        out: list[int | None] = [None] * len(at)
        for i in range(len(at) - 1, -1, -1):
            if to[i] >= size:
                out[i] = to[i]
            elif (j := bisect.bisect_left(at, to[i])) < len(at) and at[j] == to[i]:
                out[i] = out[j]
        n = len(at) + 1
        columns = [pa.array([own[0]] * n), pa.array([own[1]] * n, pa.int64()), pa.array([None, *at], pa.int64()), pa.array([size, *out], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "range", "at", "out"])

    for batch in batches:
        for file, start, n, head in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != own:
                if own:
                    yield handed()
                own, at, to, size, first = (file, start), [], [], 0, start == 0
            if first:  # nothing precedes the first version line of a good file
                size, first = n, False
                continue
            length = _length(head) if head is not None else None
            at.append(size)
            to.append(-1 if length is None else size + len(MAGIC) + len(head) + len(_GAP) + length + len(_GAP))
            size += len(MAGIC) + n
    if own:
        yield handed()


def _walk(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(file, range, base, size) of every range and (file, at) of its reachable offsets outside ranges' insides."""
    pieces = _pieces(spark, folder)
    head = F.when(F.instr("body", _GAP) > 0, F.substring_index("body", _GAP, 1))
    narrow = pieces.select("file", "range", F.octet_length("body").cast("long").alias("n"), head.cast("binary").alias("head"))
    found = stored(narrow.mapInArrow(_candidates, "file string, range long, at long, out long"), "warc-candidates")
    lengths = found.where("at IS NULL").select("file", "range", F.col("out").alias("size"))
    ranges = stored(prefix_sums(lengths, ["file"], ["range"], {"size": F.col("size")}).select("file", "range", F.col("size_before").alias("base"), "size"), "warc-ranges")
    placed = attach_checked(found.where("at IS NOT NULL AND out IS NOT NULL"), ranges.drop("size"), ["file", "range"], RANGES)
    steps = placed.select("file", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("out")).alias("out"))
    starts = ranges.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    # Pointers matter only where some range's chain can arrive; nearly all candidates of a range share one way out.
    arrivals = stored(steps.select("file", F.col("out").alias("at")).distinct().unionByName(starts).distinct(), "warc-arrivals")
    jumps = stored(steps.join(arrivals, ["file", "at"]), "warc-jumps")
    reached = stored(starts, "warc-reached")
    known = reached.count()
    while True:
        forward = reached.join(jumps, ["file", "at"]).select("file", F.col("out").alias("at"))
        reached = stored(reached.unionByName(forward).distinct(), "warc-reached")
        if (now := reached.count()) == known:
            return ranges, reached
        known = now
        ahead = jumps.select("file", F.col("at").alias("out"), F.col("out").alias("far"))
        jumps = stored(jumps.join(ahead, ["file", "out"]).select("file", "at", F.col("far").alias("out")), "warc-jumps")


def chain_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: its ``bytes``, where its chain ends (``reached``, at a range's granularity if it breaks), and ``whole``."""
    ranges, reached = _walk(spark, folder)
    ends = reached.groupBy("file").agg(F.max("at").alias("reached"))
    sizes = ranges.groupBy("file").agg(F.sum("size").alias("bytes"))
    return sizes.join(ends, "file").withColumn("whole", F.col("bytes") == F.col("reached"))


def _fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.split(b"\r\n"):
        name, mark, value = line.partition(b":")
        if mark:
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return fields


def _open(raw: bytes) -> tuple[str, list[tuple[str, str]], bytes] | None:
    """Type, fields and block of a whole record without its version line; None where it is not one."""
    at = raw.find(_GAP.encode())
    length = _length(raw[:at]) if at >= 0 else None
    if length is None or at + len(_GAP) + length + len(_GAP) != len(raw) or not raw.endswith(_GAP.encode()):
        return None
    fields = _fields(raw[:at])
    return fields.get("warc-type", ""), list(fields.items()), raw[at + len(_GAP) : at + len(_GAP) + length]


_CUT = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("to", pa.int64()), ("type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("piece", pa.binary()),
])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the chain that end in their range, and pieces (``to``: the record's end) of those that do not."""
    magic, gap, rows, held = MAGIC.encode(), _GAP.encode(), [], 0
    own: tuple | None = None
    pos = start = to = 0  # offsets in the file: of the next piece; of the open record and its end
    due: int | None = None  # where the chain's next record starts
    parts: list[bytes] = []  # the open record

    def piece(at: int, end: int, raw: bytes) -> dict:
        return {"file": own[0], "at": at, "to": end, "type": None, "headers": None, "block": None, "piece": raw}

    for batch in batches:
        for file, place, body, base, entry in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, place) != own:
                if parts:
                    rows.append(piece(start, to, b"".join(parts)))
                own, pos, due, parts = (file, place), base, entry, []
                if place == 0:  # what precedes the first version line
                    pos += len(body)
                    continue
            raw = magic + body
            if parts:
                parts.append(raw)
            elif pos == due:
                at = body.find(gap)
                length = _length(body[:at]) if at >= 0 else None
                start, to, parts = pos, -1 if length is None else pos + len(magic) + at + len(gap) + length + len(gap), [raw]
            elif due is not None and pos < due:  # of a record that an earlier range began
                rows.append(piece(pos, due, raw))
            pos += len(raw)
            held += len(raw)
            if parts and pos >= to:  # past its end: no record follows it
                record = _open(b"".join(parts)[len(magic) :]) if pos == to else None
                if record:
                    rows.append({"file": file, "at": start, "to": to, "type": record[0], "headers": record[1], "block": record[2], "piece": None})
                due, parts = to if record else None, []
            if held > BATCH:
                yield pa.RecordBatch.from_pylist(rows, _CUT)
                rows, held = [], 0
    if parts:
        rows.append(piece(start, to, b"".join(parts)))
    yield pa.RecordBatch.from_pylist(rows, _CUT)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from their pieces, in order; pieces that do not make up one are left out."""
    schema = pa.schema([_CUT.field(n) for n in ("file", "at", "type", "headers", "block")])
    for batch in batches:
        rows = []
        for file, to, pieces in zip(*(c.to_pylist() for c in batch.columns)):
            pieces = sorted((p["at"], p["piece"]) for p in pieces)
            raw = b"".join(p for _, p in pieces)
            if raw.startswith(MAGIC.encode()) and pieces[0][0] + len(raw) == to and (record := _open(raw[len(MAGIC) :])):
                rows.append({"file": file, "at": pieces[0][0], "type": record[0], "headers": record[1], "block": record[2]})
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the WARC files in ``folder``: file, at (offset), type, headers (lower-case names), block (bytes)."""
    ranges, reached = _walk(spark, folder)
    # Where each range's own chain begins: the first reachable offset at or after its base.
    marks = ranges.select("file", "range", F.col("base").alias("at"), F.lit(1).alias("kind")).unionByName(
        reached.select("file", F.lit(None).cast("long").alias("range"), "at", F.lit(0).alias("kind"))
    )
    after = Window.partitionBy("file").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.min(F.when(F.col("kind") == 0, F.col("at"))).over(after)
    entries = stored(marks.withColumn("entry", entry).where("kind = 1").select("file", "range", F.col("at").alias("base"), "entry"), "warc-entries")
    few = entries.limit(RANGES + 1).count() <= RANGES

    def cut(own: DataFrame) -> DataFrame:
        if few:
            placed = _pieces(spark, folder).join(F.broadcast(own), ["file", "range"])
        else:  # too many ranges to broadcast: pieces move, in order
            numbered = _pieces(spark, folder).withColumn("turn", F.monotonically_increasing_id())
            placed = numbered.join(own, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "turn")
        narrow = placed.select("file", "range", F.col("body").cast("binary").alias("body"), "base", "entry")
        return narrow.mapInArrow(_cut, "file string, at long, to long, type string, headers map<string,string>, block binary, piece binary")

    records = cut(entries).where("piece IS NULL").select("file", "at", "type", "headers", "block")
    # A record crosses into a range whose chain begins after its start; only files with such ranges are read for pieces.
    crossed = entries.where("entry > base").select("file").distinct()
    if not crossed.limit(1).count():
        return records
    pieces = cut(entries.join(crossed, "file", "left_semi")).where("piece IS NOT NULL")
    crossing = pieces.groupBy("file", "to").agg(F.collect_list(F.struct("at", "piece")).alias("pieces"))
    return records.unionByName(crossing.mapInArrow(_whole, RECORD))


def page_table(records: DataFrame) -> DataFrame:
    """Per record of :func:`write_archives`: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload."""
    def page_of(field: str) -> Column:
        return F.regexp_extract(F.col("headers")[field], "^<urn:page:(-?[0-9]+):", 1).try_cast("long")

    http = F.substring_index(F.col("block").cast("string"), _GAP, 1)
    payload = F.substr(F.col("block"), F.octet_length(http) + len(_GAP) + 1)
    revisit = F.col("type") == "revisit"
    return records.select(
        page_of("warc-record-id").alias("page_id"),
        F.when(revisit, F.regexp_extract(http, r"(?i)\r\nContent-Length: *([0-9]+)", 1).cast("long")).otherwise(F.length(payload).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1)).otherwise(base32_sha1(payload)).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, page_of("warc-refers-to")).alias("refers_to"), F.when(~revisit, payload).alias("payload"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return page_table(read_archives(pages.sparkSession, folder))
