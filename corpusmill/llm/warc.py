"""Content-addressed WARC archive.

Payload bytes lie once each in a table of payloads under their SHA-256; a second table holds
every record's exact header, that is all of the record before its payload. A join of both gives the
original records back; each payload is verified against its digests as it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Workspace, hot_keys, salted_join, settings, shared_folder

_CRLF = "\r\n"
_HTTP = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}{_CRLF}"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digits: Column) -> Column:
    """Upper-case base32 without padding of a hexadecimal string of a multiple of 5 digits (SHA-1: 40)."""
    groups = [F.lpad(F.conv(F.substring(digits, 5 * g + 1, 5), 16, 32), 4, "0") for g in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, row: Column) -> Column:
    """A record's name, from its page and the number of its row, so that repeated rows have names of their own."""
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(" "), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


@dataclass(frozen=True)
class Archive:
    folder: str

    def payloads(self, spark: SparkSession) -> DataFrame:
        """payload_key (SHA-256), payload."""
        return spark.read.schema("payload_key binary, payload binary").parquet(f"{self.folder}/payloads")

    def headers(self, spark: SparkSession) -> DataFrame:
        """page_id, header, payload_key; payload_follows: whether the payload is part of the record."""
        return spark.read.schema("page_id long, header string, payload_key binary, payload_follows boolean").parquet(f"{self.folder}/headers")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> Archive:
    """Writes one record for each row of pages (page_id, url, html) below ``folder``.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of ``least_bytes`` or more, those with the
    least page_id are responses and the rest revisits of it; shorter payloads are all responses. A null page_id
    is least only if there is no other; a null url is an empty target. Repeated rows give repeated records, an
    empty table an empty archive; other columns are left out.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "facts")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_key", F.unhex(F.sha2("payload", 256)))
    light = rows.select("page_id", "url", "payload_key", F.octet_length("payload").cast("bigint").alias("n"), base32_of_hex(F.sha1("payload")).alias("digest"))
    facts = work.keep("facts", light.withColumn("row", F.monotonically_increasing_id()))  # written, so that rows keep their numbers
    # one light row a payload: an aggregate that starts before the shuffle, so equal payloads don't meet in one task
    first = work.keep("first", facts.groupBy("payload_key").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("lead"), F.count("*").alias("rows")).select("payload_key", F.col("lead.page_id").alias("first_id"), F.col("lead.row").alias("first_row"), "rows"))
    facts = salted_join(facts, first.drop("rows"), "payload_key", hot_keys(first, "payload_key", "rows"), by="row")
    again = (F.col("n") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(_CRLF))

    clean_url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    common = F.concat(line("WARC-Record-ID", record_id(F.col("page_id"), F.col("row"))), line("WARC-Date", date), line("WARC-Target-URI", clean_url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("Content-Type", "application/http; msgtype=response"))
    response = F.concat(F.lit(f"WARC/1.1{_CRLF}WARC-Type: response{_CRLF}"), common, line("Content-Length", (F.col("n") + len(_HTTP)).cast("string")))
    revisit = F.concat(F.lit(f"WARC/1.1{_CRLF}WARC-Type: revisit{_CRLF}"), common, line("WARC-Profile", _PROFILE), line("WARC-Refers-To", record_id(F.col("first_id"), F.col("first_row"))), line("X-Refers-To-Page", F.col("first_id").cast("string")), line("Content-Length", str(len(_HTTP))))
    header = F.concat(F.when(again, revisit).otherwise(response), F.lit(_CRLF + _HTTP))
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        facts.select("page_id", header.alias("header"), "payload_key", (~again).alias("payload_follows")).write.parquet(f"{folder}/headers")
        nobody = F.lit(-(1 << 63))  # stands for a null page_id, so that keys are plain columns
        kept = rows.select("payload_key", F.coalesce("page_id", nobody).alias("id"), "payload").join(first.select("payload_key", F.coalesce("first_id", nobody).alias("id")), ["payload_key", "id"])
        # repeated rows of the least page_id leave one payload; they lie together after the join, so payloads move once
        kept.dropDuplicates(["payload_key", "id"]).select("payload_key", "payload").write.parquet(f"{folder}/payloads")
    work.drop("facts", "first")
    return Archive(folder)


def field(header: Column, name: str) -> Column:
    """A header field's value, null where it is missing."""
    found = F.regexp_extract(header, f"(?:^|\\n){name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def records(archive: Archive, spark: SparkSession) -> DataFrame:
    """page_id and record: each original record's exact bytes.

    Only records with a payload of their own are joined with it; records of one payload, many only below ``least_bytes``, are dealt out.
    """
    headers = archive.headers(spark)
    end = F.lit(b"\r\n\r\n")
    whole = headers.where("payload_follows").select("page_id", "header", "payload_key")
    work = Workspace(spark, "records")
    shared = work.keep("shared", whole.groupBy("payload_key").agg(F.count("*").alias("rows")).where("rows > 1"))
    hot = hot_keys(shared, "payload_key", "rows")
    whole = salted_join(whole, archive.payloads(spark), "payload_key", hot, by="page_id", how="left")
    body = F.when(F.unhex(F.sha2("payload", 256)) == F.col("payload_key"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload is missing or doesn't match its digest")).cast("binary"))
    rest = headers.where("NOT payload_follows").select("page_id", F.concat(F.encode("header", "UTF-8"), end).alias("record"))
    return whole.select("page_id", F.concat(F.encode("header", "UTF-8"), body, end).alias("record")).union(rest)


def parsed(records: DataFrame) -> DataFrame:
    """page_id, record_id, record_type, refers_to, refers_to_id, stated_digest, payload_bytes, payload_digest of records (page_id, record).

    Bytes and digest are worked out from the record's own block, null for revisits, which have none. A block whose length isn't the stated
    Content-Length, or whose digest isn't the stated one, stops the query.
    """
    latin = F.decode("record", "ISO-8859-1")
    r = records.select("page_id", "record", F.instr(latin, "\r\n\r\n").alias("a"))
    r = r.select("page_id", F.decode(F.expr("substring(record, 1, a - 1)"), "UTF-8").alias("head"), F.expr("substring(record, a + 4, octet_length(record) - a - 7)").alias("block"))
    r = r.withColumn("b", F.instr(F.decode("block", "ISO-8859-1"), "\r\n\r\n")).withColumn("payload", F.expr("substring(block, b + 4, octet_length(block) - b - 3)"))
    kind, stated = field(F.col("head"), "WARC-Type"), F.substring_index(field(F.col("head"), "WARC-Payload-Digest"), ":", -1)
    r = r.select("page_id", field(F.col("head"), "WARC-Record-ID").alias("record_id"), kind.alias("record_type"), field(F.col("head"), "X-Refers-To-Page").cast("bigint").alias("refers_to"), field(F.col("head"), "WARC-Refers-To").alias("refers_to_id"), stated.alias("stated_digest"),
        field(F.col("head"), "Content-Length").cast("bigint").alias("stated_length"), F.octet_length("block").cast("bigint").alias("length"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("digest"))
    own = F.col("record_type") == "response"
    sound = (F.col("stated_length") == F.col("length")) & F.when(own, F.col("digest") == F.col("stated_digest")).otherwise(F.col("payload_bytes") == 0)
    digest = F.when(sound, F.when(own, F.col("digest"))).otherwise(F.raise_error(F.lit("a record's length or payload doesn't match its header")).cast("string"))
    return r.select("page_id", "record_id", "record_type", "refers_to", "refers_to_id", "stated_digest", F.when(own, F.col("payload_bytes")).alias("payload_bytes"), digest.alias("payload_digest"))


def contents(archive: Archive, spark: SparkSession) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the reconstructed records say.

    Every record is rebuilt, parsed and hashed again; a revisit has the bytes and digest of the response that it names. A missing response, a payload that
    doesn't match its key and a record that doesn't match its header stop the query.
    """
    work = Workspace(spark, "contents")
    read = work.keep("read", parsed(records(archive, spark)))
    responses = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = read.where("record_type <> 'response'").select("page_id", "record_type", "refers_to", F.col("refers_to_id").alias("record_id"), "stated_digest")
    named = work.keep("named", revisits.groupBy("record_id").agg(F.count("*").alias("rows")))
    found = salted_join(revisits, read.where("record_type = 'response'").select("record_id", "payload_bytes", "payload_digest"), "record_id", hot_keys(named, "record_id", "rows"), by="page_id", how="left")
    digest = F.when(F.col("payload_digest") == F.col("stated_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit's response is missing or doesn't match its digest")).cast("string"))
    return responses.union(found.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to"))
