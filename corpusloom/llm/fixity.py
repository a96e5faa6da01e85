"""Merkle fixity audit of WARC replicas.

Records stand at ordered offsets of files. A leaf is the digest of a record's bytes; a node holds the digest of the digests
and lengths of up to 16 nodes below it, and the range of offsets that they span, up to one root for the whole collection.
Two replicas, each with offsets of its own, exchange roots; where they differ, the digests of the nodes below are compared,
and only branches that differ are descended, so a few corrupt records among many cost a few joins of a few rows. Places in a
tree follow from record ids, and digests hold lengths, not offsets, so a record that is shorter or missing in one replica
moves what follows but doesn't make it differ.

The audit is DataFrame operations; records' bytes are hashed where they are read, and only digests and offsets move.
`read_warcs` reads files of records, plain or with gzip members, a file in one task.

Defined cases: null urls and bodies are empty; records without an id are dealt to files of their own (below 0) by their
digests; records with the same id are one leaf, whose digest is that of theirs in order, with how often each is there; an
empty collection has no root and no difference; a record that one replica lacks is reported with a null digest for it; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, table

FANOUT = 16
#: Ids in a file: those that agree but for their last 8 bits.
FILE_IDS = 256


#: The date of records that have none of their own.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A WARC 1.1 resource record; header lines end with CR LF, two of those end the record."""
    body = F.coalesce(body, F.lit(""))
    head = ["WARC/1.1", "WARC-Type: resource"]
    lines = [*map(F.lit, head), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))]
    lines += [F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))), F.lit("Content-Type: text/html")]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def plain_records(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of the records of a file; for gzip members, offset and length are the member's in the file. What
    isn't a record, or is cut off, is one to the file's end."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            try:
                text = d.decompress(raw[at:])
                end = len(raw) - len(d.unused_data)
            except zlib.error:
                text, end = raw[at:], len(raw)
            yield at, end - at, text
        else:
            head = raw.find(b"\r\n\r\n", at)
            size = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", raw[at : head + 2]) if head >= 0 else None
            end = head + 8 + int(size[1]) if size and raw[at : at + 5] == b"WARC/" else len(raw)
            end = min(end, len(raw))
            yield at, end - at, raw[at:end]
        at = end


READ = "name string, start long, size long, kind string, record_id string, date string, uri string, payload binary, digest string"


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """READ: the records of all files under a path. digest: of a record's bytes, without compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                for start, size, text in plain_records(raw.as_py()):
                    head, _, rest = text.partition(b"\r\n\r\n")
                    say = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
                    row = [name, start, size, say.get("warc-type"), say.get("warc-record-id"), say.get("warc-date"), say.get("warc-target-uri"), rest.removesuffix(b"\r\n\r\n"), hashlib.sha256(text).hexdigest()]
                    yield pa.RecordBatch.from_pylist([dict(zip(_READ, row))], schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(run, READ)


_READ = [x.split()[0] for x in READ.split(", ")]
_SCHEMA = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (x.split() for x in READ.split(", "))])


def _number() -> Column:
    return F.when(F.col("record_id").isNotNull(), F.xxhash64("record_id").bitwiseAND(0x7FFFFFFFFFFFFFFF))


def by_record_id(records: DataFrame) -> DataFrame:
    """Records as `leaves` takes them, of `read_warcs`: numbered by a hash of their ids."""
    return records.select(_number().alias("page_id"), "size", "digest")


def leaves(records: DataFrame) -> DataFrame:
    """(file, idx, page_id, start, size, digest) of a replica's (page_id, size, digest): a leaf an id, in files of FILE_IDS ids."""
    h = F.xxhash64("digest")
    file = F.when(F.col("page_id").isNull(), -1 - F.pmod(h, F.lit(1 << 16))).otherwise(F.shiftright("page_id", 8))
    idx = F.when(F.col("page_id").isNull(), F.pmod(F.shiftright(h, 16), F.lit(FILE_IDS))).otherwise(F.pmod(F.col("page_id"), F.lit(FILE_IDS)))
    rows = records.select("page_id", "size", "digest").groupBy("page_id", "size", "digest").agg(F.count("*").alias("n"))  # copies are merged where they are read
    rows = rows.select(file.cast("long").alias("file"), idx.cast("long").alias("idx"), "page_id", "size", "digest", "n")
    held = F.array_sort(F.collect_list(F.struct("digest", "n")))
    rows = rows.groupBy("file", "idx").agg(F.max("page_id").alias("page_id"), F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"), held.alias("held"))
    digest = F.when(F.col("n") == 1, F.col("held")[0]["digest"]).otherwise(F.sha2(F.concat_ws(",", F.transform("held", lambda x: F.concat_ws(":", x["digest"], x["n"]))), 256))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("idx")) - F.col("size")
    return rows.select("file", "idx", "page_id", before.alias("start"), "size", digest.alias("digest"))


def _parent(kind: str) -> tuple[Column, Column]:
    """File and idx of the node above: among a file's nodes, among files (4 bits of their numbers, or more), or the root."""
    zero = F.lit(0).cast("long")
    if kind == "file":
        return F.col("file"), F.shiftright("idx", 4)
    return (F.shiftright("file", int(kind.split()[1])), zero) if kind.startswith("files") else (zero, zero)


def tree(bottom: DataFrame) -> list[tuple[str, DataFrame]]:
    """Levels (file, idx, start, end, digest) from the leaves to the root, each with how its nodes stand above the last
    level's. Nodes of a file come first, then nodes over files.

    A level has a sixteenth of the rows of the one below, and each of its rows is made of 16 at most.
    """
    level = stored(bottom.select("file", "idx", "start", (F.col("start") + F.col("size")).alias("end"), "digest"), "merkle")
    levels = [("leaf", level)]
    while True:
        n_files, n_idx, n = level.agg(F.max("file") - F.min("file"), F.max("idx"), F.count("*")).first()
        if n == 0 or levels[-1][0] == "root":
            return levels
        bits = 4
        while n_files and n_files >> bits > n:  # numbers far apart: steps that join no nodes are left out
            bits += 4
        kind = "file" if n_idx else f"files {bits}" if n_files >= FANOUT else "root"
        file, idx = _parent(kind)
        below = F.array_sort(F.collect_list(F.struct("file", "idx", (F.col("end") - F.col("start")).alias("size"), "digest")))
        ranges = F.transform(below, lambda x: F.concat_ws(":", x["file"], x["idx"], x["size"], x["digest"]))
        spans = (F.min("start"), F.max("end")) if kind == "file" else (F.lit(0).cast("long"), F.sum(F.col("end") - F.col("start")))  # of a file, else of all its bytes
        level = level.groupBy(file.alias("up_file"), idx.alias("up_idx")).agg(spans[0].alias("start"), spans[1].alias("end"), F.sha2(F.concat_ws(",", ranges), 256).alias("digest"))
        level = stored(level.withColumnsRenamed({"up_file": "file", "up_idx": "idx"}), "merkle")
        levels.append((kind, level))


def audit(first: list[tuple[str, DataFrame]], second: list[tuple[str, DataFrame]]) -> DataFrame:
    """The leaves (file, idx) that differ, with both digests (null where a replica lacks the record) and the first replica's range."""
    compare = lambda a, b: a.alias("a").join(b.alias("b"), ["file", "idx"], "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select("file", "idx", F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.col("a.digest").alias("digest"), F.col("b.digest").alias("other_digest"))
    if [kind for kind, _ in first] != [kind for kind, _ in second]:  # trees of unlike height share no inner node
        return compare(first[0][1], second[0][1])
    differ = compare(first[-1][1], second[-1][1])
    for k in range(len(first) - 2, -1, -1):
        file, idx = _parent(first[k + 1][0])
        open_ = differ.select(F.col("file").alias("pf"), F.col("idx").alias("pi"))
        below = lambda level: level.withColumns({"pf": file, "pi": idx}).join(open_, ["pf", "pi"], "left_semi").drop("pf", "pi")  # noqa: B023, E731
        differ = compare(below(first[k][1]), below(second[k][1]))
    return differ


def audit_files(spark: SparkSession, first: str, second: str) -> DataFrame:
    """`audit` of two folders of WARC files, with the record ids of what differs."""
    both = [stored(read_warcs(spark, path).drop("payload"), "warc_records") for path in (first, second)]
    found = [stored(leaves(by_record_id(r)), "leaves") for r in both]
    names = both[0].unionByName(both[1]).select("record_id", _number().alias("page_id")).where("record_id is not null").distinct()
    differ = audit(*(tree(x) for x in found))
    ids = found[0].select("file", "idx", "page_id").union(found[1].select("file", "idx", "page_id")).distinct()
    return differ.join(ids, ["file", "idx"]).join(names, "page_id", "left").select("record_id", "digest", "other_digest")


def op5_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the WARC records of `pages` against a replica, with offsets of its own, whose records of ids divisible by 97 have
    a corrupt byte, and those with remainder 1 lack their bodies' last character; one row for each record found corrupt."""
    pages = table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 97
    body = F.coalesce(F.col("html"), F.lit(""))
    broken = F.when(kind == 0, F.concat(F.lit("#"), F.substring(body, 2, 2147483647))).when(kind == 1, F.left(body, F.greatest(F.lit(0), F.char_length(body) - 1))).otherwise(body)
    held, found = record(F.col("page_id"), F.col("url"), body), record(F.col("page_id"), F.col("url"), broken)
    hashed = lambda r, a: [F.octet_length(r).cast("long").alias(f"size{a}"), F.sha2(r, 256).alias(f"digest{a}")]
    both = stored(pages.select("page_id", *hashed(held, 1), *hashed(found, 2)), "records")  # pages are read once for both
    mine, theirs = (stored(leaves(both.select("page_id", F.col(f"size{k}").alias("size"), F.col(f"digest{k}").alias("digest"))), "leaves") for k in (1, 2))
    return audit(tree(mine), tree(theirs)).join(mine.select("file", "idx", "page_id"), ["file", "idx"]).select("page_id", "file", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"), "digest", "other_digest")


def _record_sql(body: str) -> str:
    crlf = "chr(13) || chr(10)"
    head = f"'WARC/1.1' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || {crlf} || 'WARC-Date: {DATE}' || {crlf}"
    return f"{head} || 'WARC-Target-URI: ' || coalesce(url, '') || {crlf} || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || CAST(strlen({body}) AS VARCHAR) || {crlf} || {crlf} || {body} || {crlf} || {crlf}"


OP5_SQL = f"""
WITH bodies AS (
  SELECT page_id, url, coalesce(html, '') AS body,
         CASE page_id % 97 WHEN 0 THEN '#' || substr(coalesce(html, ''), 2) WHEN 1 THEN left(coalesce(html, ''), greatest(0, length(coalesce(html, '')) - 1)) ELSE coalesce(html, '') END AS broken
  FROM pages
), hashed AS (
  SELECT page_id, CAST(floor(page_id / {FILE_IDS}.0) AS BIGINT) AS file, CAST(strlen({_record_sql('body')}) AS BIGINT) AS length, sha256({_record_sql('body')}) AS digest, sha256({_record_sql('broken')}) AS other_digest
  FROM bodies
)
SELECT page_id, file, "offset", length, digest, other_digest
FROM (SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset" FROM hashed)
WHERE digest <> other_digest
"""
