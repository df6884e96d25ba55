"""WARC archives: written from a table of pages, and read back by boundary-chain verification.

Writing: the archive of a partition is a text file of records whose separator is a record's
trailer (CRLF CRLF), written by Spark's committed writer, so any file system will do and a lost task
is simply run again. Of large equal payloads one record has the payload, the others revisit it.

Reading (versions 1.0 and 1.1): the files are cut at every place where a trailer and the begin of
a version line meet, by whichever tasks own those bytes. Each piece is a candidate: its offset is
the sum of the pieces before it (sums by file part first, then inside the part), and its header
says where its successor must begin. Candidates whose successor is the next candidate form runs; pointer
jumping over the ends of runs, from the start of the file, finds the runs that the chain enters and
where. Everything else is magic inside a payload: it is rejected, and goes back into the payload of the
record that spans it. Only numbers are dealt out; the bytes of a record that is one piece are
made use of where they were read, and only records of several pieces gather theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, no_null

CRLF = "\r\n"
MAGIC = "WARC/1."  #: of either version; what follows in a version line has MINOR characters
MINOR = len("1" + CRLF)
TRAILER = CRLF * 2
DATE = "2024-01-01T00:00:00Z"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
#: Payloads of at least so many bytes are stored once.
DEDUP_BYTES = 1000
#: Pieces of records with magic inside that are broadcast (under 100 bytes each); more are joined by sorting.
FEW_PARTS = 200_000


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = DEDUP_BYTES) -> DataFrame:
    """pages with payload_digest (SHA-1 in hex), record_type and refers_to.

    Of the pages with equal payloads of `least` bytes or more, that with the largest id is the
    response. Repeated rows of that id are responses too; a null id loses to any other and
    is a response if there is no other. A null payload is empty. Columns of these names are
    replaced, all others are kept; names beginning with _lw_ are taken. The join is a sorted one at
    every size, so that a payload that many pages share can be split.
    """
    pages = pages.withColumn("payload_digest", F.sha1(no_null(html_col).cast("binary")))
    large = F.octet_length(no_null(html_col)) >= least
    shared = pages.where(large).groupBy("payload_digest").agg(F.count("*").alias("_lw_n"), F.max(id_col).alias("_lw_first")).where("_lw_n > 1")
    shared = shared.select(F.col("payload_digest").alias("_lw_digest"), "_lw_first").hint("merge")
    pages = pages.join(shared, large & (pages.payload_digest == shared["_lw_digest"]), "left").drop("_lw_digest")
    again = F.col("_lw_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_lw_first"))
    return pages.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_lw_first"))}).drop("_lw_first")


def _line(name: str, value: Column) -> Column:
    """A header line, left out where its value is null; line ends and control bytes in values become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x1f\x7f]", " "), F.lit(CRLF)), F.lit(""))


def urn(id_col: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.col(id_col).cast("string"), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", minor: int = 1) -> DataFrame:
    """One string column, record: a WARC record (1.0 or 1.1 by `minor`) for each row of with_revisits(), without its trailer."""
    body = F.when(F.col("record_type") == "response", F.concat(F.lit(HTTP), no_null(html_col))).otherwise(F.lit(""))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit(f"{MAGIC}{minor}{CRLF}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", urn(id_col)), _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.col(url_col)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), _line("WARC-Refers-To", urn("refers_to")),
        F.when(revisit, f"WARC-Profile: http://netpreserve.org/warc/1.{minor}/revisit/identical-payload-digest{CRLF}").otherwise(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", F.octet_length(body).cast("string")), F.lit(CRLF),
    )
    return pages.select(F.concat(head, body).alias("record"))


def write(recs: DataFrame, path: str, codec: str = "gzip") -> None:
    """An archive for each partition, as a committed job. codec none leaves files that many tasks can read at once."""
    recs.write.option("lineSep", TRAILER).option("compression", codec).text(path)


def _pieces(spark, path: str) -> DataFrame:
    """(file, block, row, value): the archives cut where a trailer and a version line meet."""
    raw = spark.read.option("lineSep", TRAILER + MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _parsed(body: Column) -> tuple[Column, Column, Column]:
    """Header, content (binary, to the end) and stated length of a record's bytes after MAGIC; null where there is no header."""
    upto = F.substring_index(body, TRAILER, 1)
    there = (F.octet_length(upto) < F.octet_length(body)) & (body.startswith("1" + CRLF) | body.startswith("0" + CRLF))
    head = F.when(there, F.substring(upto, F.lit(MINOR + 1), F.octet_length(upto)))
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r?$", 1)
    return head, F.when(there, F.substring(body.cast("binary"), F.octet_length(upto) + len(TRAILER) + 1, F.octet_length(body))), F.nullif(length, F.lit("")).cast("long")


def _magic(value: Column) -> Column:
    """Whether a piece begins with MAGIC: a file's first one does if a record begins there (no separator has taken it), any other that does begins none."""
    return value.startswith(MAGIC)


def _body(value: Column) -> Column:
    return F.when(_magic(value), F.substring(value, F.lit(len(MAGIC) + 1), F.octet_length(value))).otherwise(value)


def candidates(pieces: DataFrame) -> DataFrame:
    """(file, block, row, pos, first, at, next, end, length): _pieces(), without their bytes.

    at: the offset of the piece's version line (in the file's uncompressed bytes), end: that of what
    follows the piece. next: where the record that begins there would be followed by another, null
    if its header is none. pos: the piece's place in its file. Headers are read before pieces are
    dealt out, so that only numbers are.
    """
    head, _, length = _parsed(_body(F.col("value")))
    whole = F.octet_length(head) + len(MAGIC) + MINOR + 2 * len(TRAILER) + length
    raw = pieces.select("file", "block", "row", (F.octet_length("value").cast("long") + len(TRAILER + MAGIC)).alias("_size"), _magic(F.col("value")).alias("_magic"), length.alias("_length"), whole.alias("_whole"))
    by_block = raw.groupBy("file", "block").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # file parts
    by_block = by_block.select("file", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_bytes", "_rows")))
    inside = Window.partitionBy("file", "block").orderBy("row")
    p = raw.withColumns({"_to": F.sum("_size").over(inside), "_i": F.row_number().over(inside)}).join(by_block, ["file", "block"])
    p = p.withColumn("end", F.col("_bytes") + F.col("_to") - len(TRAILER + MAGIC))
    p = p.withColumn("first", F.col("_bytes") + F.col("_to") == F.col("_size")).withColumn("pos", F.col("_rows") + F.col("_i") - 1)
    p = p.withColumn("at", F.when(F.col("first"), 0).otherwise(F.col("_bytes") + F.col("_to") - F.col("_size") - len(MAGIC)).cast("long"))
    own = F.col("first") == F.col("_magic")
    return p.select("file", "block", "row", "pos", "first", "at", F.when(own, F.col("at") + F.col("_whole")).alias("next"), "end", F.when(own, F.col("_length")).alias("length"))


def reachable(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, at) of the candidates (file, pos, at, next) on the chain from each file's start."""
    place = Window.partitionBy("file").orderBy("pos")  # numbers only; a file is an archive of bounded size
    c = found.select("file", "pos", "at", "next")
    c = c.withColumns({"_tied": F.coalesce(F.lag("next").over(place) == F.col("at"), F.lit(False))})
    c = scratch.save(c.withColumn("run", F.sum(F.when(F.col("_tied"), 0).otherwise(1)).over(place)), "runs")
    ends = c.groupBy("file", "run").agg(F.max(F.struct("pos", "next")).alias("e")).select("file", "run", F.col("e.next").alias("exit"))
    jump = ends.join(c.select("file", F.col("at").alias("exit"), F.col("run").alias("to")), ["file", "exit"])  # ends that land on a candidate
    jump = scratch.save(jump.select("file", "run", "exit", "to"), "jumps")
    seen = scratch.save(c.where("at = 0").select("file", "run", F.col("at").alias("entry")), "entered")
    links = jump
    while True:  # each turn doubles the length of jumps: after k turns all within 2**k runs are seen
        more = seen.join(links, ["file", "run"]).select("file", F.col("to").alias("run"), F.col("exit").alias("entry")).join(seen.select("file", "run"), ["file", "run"], "left_anti")
        more = scratch.save(more.distinct(), "more")
        if more.isEmpty():
            break
        seen = scratch.save(seen.union(more), "entered")
        two = links.join(links.select("file", F.col("run").alias("to"), F.col("exit").alias("exit2"), F.col("to").alias("to2")), ["file", "to"])
        links = scratch.save(two.select("file", "run", F.col("exit2").alias("exit"), F.col("to2").alias("to")), "jumps")
        if links.isEmpty():
            break
    return c.join(seen, ["file", "run"]).where("at >= entry").select("file", "pos", "at", "next")


def whole_records(head: Column, content: Column, length: Column) -> dict[str, Column]:
    """What read() gives of a record by default."""
    return {"head": head, "content": F.substring(content, F.lit(1), length.cast("int")), "complete": F.octet_length(content) >= length}


def read(spark, path: str, fields: Callable[[Column, Column, Column], dict[str, Column]] = whole_records, strict: bool = False) -> DataFrame:
    """(file, at, head, content, complete) for every record of the archives in path.

    fields: other columns, made of a record's head, the bytes from its content on (which may go
    past it) and its stated length; they are worked out where the bytes are read, before
    anything is dealt out. Only records on the chain count; whatever follows a broken header is
    not reached, and is an error if `strict`. complete is false for a record whose bytes end early. No
    files, or empty ones, give no records.
    """
    scratch = Scratch(spark, "warc")
    pieces = scratch.save(_pieces(spark, path), "pieces")  # once: rows of another scan may be numbered otherwise
    numbers = scratch.save(candidates(pieces), "candidates")
    chain = reachable(numbers, scratch).where("next is not null").select("file", "pos")
    if strict:
        ends = numbers.groupBy("file").agg(F.max("end").alias("end"))
        reached = numbers.join(chain, ["file", "pos"], "left_semi").groupBy("file").agg(F.max("next").alias("next"))
        lost = ends.join(reached, "file", "left").where("end > 0 and coalesce(next, 0) < end").first()
        if lost is not None:
            raise ValueError(f"{lost['end'] - (lost['next'] or 0)} bytes after the last record of {lost['file']}")
    owner = F.last(F.when(F.col("_chained"), F.col("pos")), True).over(Window.partitionBy("file").orderBy("pos"))
    owned = numbers.join(chain.withColumn("_chained", F.lit(True)), ["file", "pos"], "left").withColumn("_chained", F.coalesce("_chained", F.lit(False))).withColumn("owner", owner)
    owned = scratch.save(owned.where("owner is not null").select("file", "block", "row", "pos", "at", "first", "length", "owner", F.count("*").over(Window.partitionBy("file", "owner")).alias("_n")), "owned")
    scratch.keep(pieces, owned)

    key = ["file", "block", "row"]
    made = lambda body, length: [c.alias(n) for n, c in fields(*_parsed(body)[:2], length).items()]
    body = _body(F.col("value"))
    one = pieces.select(*key, *made(body, _parsed(body)[2])).join(owned.where("_n = 1").select(*key, "at"), key).drop("block", "row")
    cut = owned.where("_n > 1")
    parts = cut.count()
    if not parts:
        return one.select("file", "at", *(c for c in one.columns if c not in ("file", "at")))
    p = pieces.join(F.broadcast(cut) if parts <= FEW_PARTS else cut.hint("merge"), key)  # of records with magic inside
    p = p.withColumn("_body", F.when(F.col("first"), body).otherwise(F.col("value"))).drop("value")
    many = p.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "length", "_body"))).alias("a"))  # one record's bytes
    many = many.select("file", F.col("a")[0]["at"].alias("at"), F.col("a")[0]["length"].alias("length"), F.array_join(F.transform("a", lambda x: x["_body"]), TRAILER + MAGIC).alias("_body"))
    many = many.select("file", "at", *made(F.col("_body"), F.col("length")))
    return many.unionByName(one)


def payload(head: Column, content: Column, length: Column) -> dict[str, Column]:
    """Of a record, for read(): page_id, record_type, refers_to, and the bytes and the digest of the payload read (of its own; a revisit has none)."""
    named = lambda name: F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    number = lambda name: F.nullif(F.regexp_extract(named(name), r"<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("long")
    at = F.octet_length(F.substring_index(content.cast("string"), TRAILER, 1)) + len(TRAILER)
    body = F.substring(content, at + 1, length.cast("int") - at)
    body = F.when((named("WARC-Type") == "response") & (at <= length), body).otherwise(F.lit("").cast("binary"))
    return {"page_id": number("WARC-Record-ID"), "record_type": named("WARC-Type"), "refers_to": number("WARC-Refers-To"), "payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(body)}


def resolved(recs: DataFrame) -> DataFrame:
    """Records of payload(), revisits with the bytes and the digest of what they refer to (null if that isn't there)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = recs.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to")
    whole = recs.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(F.min(F.struct("payload_bytes", "payload_digest")).alias("of")).where("refers_to is not null")
    found = again.join(whole.hint("merge"), "refers_to", "left").select("page_id", "of.payload_bytes", "of.payload_digest", "record_type", "refers_to")
    return recs.where("record_type <> 'revisit'").select(*names).union(found)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    scratch = Scratch(spark, "archives")
    path = scratch.path("warc")
    write(records(with_revisits(pages)), path)
    recs = scratch.save(read(spark, path, payload, strict=True), "read")
    written, found = pages.count(), recs.count()
    if found != written:
        raise RuntimeError(f"{found} records read of {written} written")
    return resolved(recs)


OP5_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as payload_bytes, sha1(body) as payload_digest from p),
w as (select payload_digest, max(page_id) as first from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes::bigint as payload_bytes, d.payload_digest,
    case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
    case when first is not null and page_id is distinct from first then first end as refers_to
from d left join w on d.payload_digest = w.payload_digest and d.payload_bytes >= 1000"""
