"""WARC archives: written, read back, and rewritten with revisit records.

Archives are gzip-compressed files of one WARC/1.1 record after another,
written by Spark's own text sink (any file system, one attempt per file is
committed): a record's headers, an empty line, its block, an empty line. A
`response` block is an HTTP header and the payload, a `revisit` block the HTTP
header alone (profile identical-payload-digest). A compressed file is one
task, read as a stream of pieces that start at the version line; a piece is
complete when its block is as long as `Content-Length` says, so a payload may
hold version lines itself. What a task holds is one record.

Revisit resolution reads the headers of the archives (payloads stay where
they are), shuffles them by payload digest, keeps one response per digest, and
joins the others to it; revisit records that are already there count with the
digest they name. Then the archives are written anew, each record with fresh
headers, and payloads that became revisits are gone. `restored` turns it
around: every revisit gets the payload facts of the response that it refers to.

Of equal payloads of at least `min_bytes` the record with the largest key is
the response (null keys are least; among equal keys the largest record id);
smaller payloads are all responses. Defined cases: a null payload is empty; a
null URL has no target header; control characters and spaces of a URL are
percent-encoded; repeated rows are records of their own; an empty table gives
empty archives; other columns never matter. A revisit whose response isn't in
the archives keeps what its own headers say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.common import pick
from trialgrid.session import scratch_path, written

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: The profile of a revisit by payload digest, and the date a record gets if it has none.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
MIN_BYTES = 1000
#: A hot digest's records meet its response in so many tasks.
SALTS = 8
#: The extension header that carries the key of the source row.
KEY_HEADER = "X-Record-Key"

COLUMNS = ("record_id string, record_type string, key bigint, uri string, date string, payload_digest string, "
           "payload_bytes bigint, refers_to string, refers_to_key bigint, payload binary")
SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("key", pa.int64()), ("uri", pa.string()),
                    ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("refers_to", pa.string()), ("refers_to_key", pa.int64()), ("payload", pa.binary())])


def responses(rows: DataFrame, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
              date: str = NO_DATE) -> DataFrame:
    """A response record per row, with a random record id: write it before it is read twice."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    return pick(rows, key=key_col, uri=uri_col, payload=payload_col).select(
        F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"), F.lit("response").alias("record_type"),
        F.col("key").cast("bigint").alias("key"), F.col("uri").cast("string").alias("uri"), F.lit(date).alias("date"),
        F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("bigint").alias("refers_to_key"),
        payload.alias("payload"))


def _header(name: str, value: Column) -> Column:
    """`name: value` and a line end; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _safe_uri(uri: Column) -> Column:
    safe = uri
    for code in [*range(0x21), 0x7F]:
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(uri.rlike(r"[\x00-\x20\x7F]"), safe).otherwise(uri)


def write_archives(records: DataFrame, path: str) -> str:
    """The records as gzip-compressed archives under `path`, a file per partition."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.decode(F.col("payload"), "UTF-8")))
    lines = F.concat(
        F.lit(VERSION + CRLF), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Date", F.col("date")), _header("WARC-Target-URI", _safe_uri(F.col("uri"))), _header(KEY_HEADER, F.col("key")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", F.col("refers_to")),
                                 _header("X-Refers-To-Key", F.col("refers_to_key")))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        _header("Content-Length", F.octet_length(F.col("block"))), F.lit(CRLF), F.col("block"))
    (records.withColumn("block", block).select(lines.alias("value"))
     .write.mode("errorifexists").option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path))
    return path


class BadArchive(ValueError):
    """A record that doesn't end where its headers say, or a payload that isn't what its digest says."""


def record_length(raw: bytes) -> int:
    """Length of the record that `raw` starts with (version line taken off), from its headers to the empty line after its block."""
    head, found, _ = raw.partition(b"\r\n\r\n")
    said = [line for line in head.split(b"\r\n") if line.startswith(b"Content-Length: ")]
    if not found or not said:
        raise BadArchive("a record without a length")
    return len(head) + 4 + int(said[0][16:]) + 4


def parse_record(raw: bytes) -> dict:
    """The fields of one whole record, version line taken off."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF))
    length = int(fields["Content-Length"])
    if block[length:] != b"\r\n\r\n":
        raise BadArchive(f"record {fields.get('WARC-Record-ID')} doesn't end after {length} bytes")
    http, _, payload = block[:length].partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        said = [line.split(b": ", 1)[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")]
        size = int(said[0]) if said else None
    else:
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise BadArchive(f"record {fields.get('WARC-Record-ID')} has another payload than its digest says")
    key, refers_to_key = fields.get(KEY_HEADER), fields.get("X-Refers-To-Key")
    return {"record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "key": None if key is None else int(key),
            "uri": fields.get("WARC-Target-URI"), "date": fields["WARC-Date"], "payload_digest": digest, "payload_bytes": size,
            "refers_to": fields.get("WARC-Refers-To"), "refers_to_key": None if refers_to_key is None else int(refers_to_key),
            "payload": None if revisit else payload}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under `path`, each payload checked against
    its digest; without `payloads` they are read and checked but not passed on."""
    mark = f"{VERSION}{CRLF}".encode()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_pieces, missing, file, out, held = [], 0, None, [], 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=SCHEMA)

        for batch in batches:
            for piece, source in zip(batch.column(0), batch.column(1), strict=True):
                piece, source = piece.as_py(), source.as_py()
                if source != file:
                    if open_pieces:
                        raise BadArchive(f"{file} ends inside a record")
                    file = source
                    if piece:
                        raise BadArchive(f"{file} doesn't start with a record")
                    continue  # what stands before the first version line: nothing
                missing = missing - len(mark) - len(piece) if open_pieces else record_length(piece) - len(piece)
                open_pieces.append(piece)
                if missing > 0:
                    continue  # the payload itself holds a version line
                record = parse_record(mark.join(open_pieces))
                open_pieces = []
                held += record["payload_bytes"] or 0
                out.append(record if payloads else {**record, "payload": None})
                if len(out) >= 1000 or held >= 1 << 24:
                    yield table()
                    out, held = [], 0
        if open_pieces:
            raise BadArchive(f"{file} ends inside a record")
        if out:
            yield table()

    pieces = (spark.read.option("lineSep", VERSION + CRLF).text(path)
              .select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file")))
    return pieces.mapInArrow(parse, COLUMNS)


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(record_id, refers_to, refers_to_key) of every record whose payload another record's response stands for.

    Headers are grouped by digest with a partial aggregate in every task.
    Records then meet their response under a salted digest."""
    named = headers.where(F.col("payload_bytes") >= min_bytes).select("record_id", "record_type", "key", "payload_digest")
    first = F.max(F.when(F.col("record_type") == "response", F.struct("key", "record_id")))
    kept = (named.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
            .where((F.col("n") > 1) & F.col("first").isNotNull())
            .select("payload_digest", F.col("first.record_id").alias("refers_to"), F.col("first.key").alias("refers_to_key"),
                    F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = named.select("record_id", "payload_digest", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return (salted.join(kept, ["payload_digest", "salt"]).where(F.col("record_id") != F.col("refers_to"))
            .select("record_id", "refers_to", "refers_to_key"))


def resolve_revisits(spark: SparkSession, path: str, out_path: str, min_bytes: int = MIN_BYTES) -> str:
    """The archives under `path` written anew under `out_path`, with one
    response per payload and revisits of it. A record's payload is read with
    the decision on it joined by record id."""
    headers = written(read_archives(spark, path, payloads=False).drop("payload"), "warc-headers", "zstd")
    # written, so that its size is known: a small table of decisions needs no shuffle of the payloads
    decided = written(revisits(headers, min_bytes).select(
        "record_id", F.col("refers_to").alias("to"), F.col("refers_to_key").alias("to_key")), "warc-decided", "zstd")
    records = read_archives(spark, path).join(decided, "record_id", "left")
    again = F.col("to").isNotNull()
    fresh = records.select(
        "record_id", F.when(again, F.lit("revisit")).otherwise(F.col("record_type")).alias("record_type"), "key", "uri", "date",
        "payload_digest", "payload_bytes", F.coalesce("to", "refers_to").alias("refers_to"),
        F.when(again, F.col("to_key")).otherwise(F.col("refers_to_key")).alias("refers_to_key"),
        F.when(~again, F.col("payload")).alias("payload"))
    return write_archives(fresh, out_path)


def restored(headers: DataFrame) -> DataFrame:
    """Records without their payloads; a revisit's digest, length and key come
    from the response that it refers to. `headers` is read several times: give
    a written table."""
    wanted = headers.where("record_type = 'revisit' and refers_to is not null").select("refers_to").distinct()
    target = headers.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("key").alias("_key"), F.col("payload_digest").alias("_digest"),
        F.col("payload_bytes").alias("_bytes"))
    spread = (target.join(wanted, "refers_to")
              .select(F.col("refers_to").alias("_to"), "_key", "_digest", "_bytes",
                      F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")))
    # a record that refers to nothing is dealt by its own id, not with all the others of its kind
    rows = headers.withColumn("_to", F.coalesce("refers_to", F.concat(F.lit("-"), F.col("record_id"))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["_to", "_salt"], "left").select(
        "record_id", "record_type", "key", "uri", "date", F.coalesce("_digest", "payload_digest").alias("payload_digest"),
        F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), "refers_to",
        F.coalesce("_key", "refers_to_key").alias("refers_to_key"))


def archived(rows: DataFrame, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
             min_bytes: int = MIN_BYTES) -> DataFrame:
    """Every row as a record of archives with revisits resolved, read back from them and restored."""
    spark = rows.sparkSession
    raw = write_archives(responses(rows, key_col, uri_col, payload_col), scratch_path(spark, "warc-raw"))
    out = resolve_revisits(spark, raw, scratch_path(spark, "warc"), min_bytes)
    return restored(written(read_archives(spark, out, payloads=False).drop("payload"), "warc-read", "zstd"))
