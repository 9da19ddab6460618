"""WARC archives of pages, and their fixity audit by Merkle trees.

`write_archive` lays pages down as WARC/1.1 files (gzip), one record after another; `read_archive` parses them back, a row
for each record with its place. A file is a segment. `tree` hashes each record together with its offset range into a leaf,
and ordered runs of `FANOUT` nodes, with the range they span, into the nodes above, up to a root for each segment. `audit`
compares the roots of two replicas and descends only below nodes that differ, down to the records.

Scale: files hold a bounded number of records, and of bytes: pages above 32 kB lie in files of their own with fewer records (a single page
may be larger than FILE_BYTES), so trees have a fixed number of levels and a file fits a task; hashing the levels and the descent are
grouped and joined by (segment, node), of bounded size each whatever the pages' keys. A replica's content isn't shuffled;
hashes are.

Defined cases: null page_id, url or html are kept as nulls; line breaks in a url are percent-encoded in its header and decoded on reading;
repeated rows are records of their own; a damaged header makes one leaf up to the next record that begins in good order (or the
file's end), an unreadable file is one leaf of its stored bytes; a segment that a replica lacks differs as a whole;
empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FANOUT = 16
VERSION = "WARC/1.1"
#: Records of a file; FANOUT ** LEVELS is no less.
FILE_RECORDS = 2048
LEVELS = 3
#: Bytes of pages in a file, and the sizes of page up to which files have FILE_RECORDS records, and a sixteenth of it.
FILE_BYTES = 64 << 20
SIZES = (FILE_BYTES // FILE_RECORDS, 16 * FILE_BYTES // FILE_RECORDS)
_START = re.compile(rb"(?<=\r\n\r\n)WARC/1\.1\r\n")
_HEADER = re.compile(rb"WARC/1\.1\r\n((?:[^\r\n:]+: [^\r\n]*\r\n)+)\r\n")


def record(page_id: Column, url: Column, html: Column, date: Column) -> Column:
    """A WARC record's text, without the two line breaks that end it."""
    crlf = F.lit("\r\n")
    clean = F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.coalesce(html, F.lit(""))
    digest = F.md5(F.concat_ws("\x00", page_id.cast("string"), clean, F.sha2(body.cast("binary"), 256)))
    name = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, crlf), F.lit(""))
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: resource\r\n"),
        field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), name, F.lit(">"))),
        F.lit("WARC-Date: "), date, crlf,
        field("WARC-Target-URI", clean),
        field("X-Page-Id", page_id.cast("string")),
        F.when(html.isNull(), F.lit("X-Null-Block: true\r\n")).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256))),
        F.lit("Content-Length: "), F.octet_length(body.cast("binary")).cast("string"), crlf, crlf, body,
    )


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_records: int = FILE_RECORDS, damaged: Column | None = None) -> None:
    """Files of WARC records under a path of any store that Spark writes. damaged: records whose date gets another last digit, as if
    a bit of the stored file had turned; for trying an audit."""
    if file_records > FANOUT**LEVELS:
        raise ValueError("more records in a file than leaves in a tree")
    html = F.col("html").cast("string")
    said = F.lit(date) if damaged is None else F.when(damaged, F.lit(date[:-2] + ("0" if date[-2] != "0" else "1") + date[-1])).otherwise(F.lit(date))
    size = F.coalesce(F.octet_length(html), F.lit(0))
    rows = pages.select(record(F.col("page_id").cast("long"), F.col("url").cast("string"), html, said).alias("value"), size.alias("size"))
    write = lambda df, n, to: df.select("value").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", n).text(to)
    largest = pages.agg(F.max(size)).first()[0] or 0
    write(rows.where(F.col("size") <= SIZES[0]) if largest > SIZES[0] else rows, file_records, path)
    if largest > SIZES[0]:
        write(rows.where(f"size > {SIZES[0]} and size <= {SIZES[1]}"), max(1, file_records // 16), f"{path}/large")
    if largest > SIZES[1]:
        write(rows.where(f"size > {SIZES[1]}"), max(1, min(file_records // 16, FILE_BYTES // largest)), f"{path}/huge")


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """Start, end, header fields (None: damaged) and block of each record."""
    at = 0
    while at < len(raw):
        head = _HEADER.match(raw, at)
        fields = dict(x.split(": ", 1) for x in head[1].decode("utf-8", "replace").splitlines() if ": " in x) if head else {}
        size = fields.get("Content-Length", "")
        end = head.end() + int(size) + 4 if head and size.isdigit() else -1
        if 0 <= end <= len(raw) and raw[end - 4 : end] == b"\r\n\r\n":
            yield at, end, fields, raw[head.end() : end - 4]
        else:
            following = _START.search(raw, at + 1)
            end = following.start() if following else len(raw)
            yield at, end, None, raw[at:end]
        at = end


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: segment, number, start, end, sha256 of its bytes, sound, page_id, url, html, n_bytes and block_sha256 of
    its block. Offsets are those of the uncompressed file."""
    common.ship(spark)
    common.small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    segment = F.regexp_replace(F.regexp_extract("path", r"((?:/large/|/huge/)?[^/]+)$", 1), r"-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    schema = pa.schema(
        [("segment", pa.string()), ("number", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("sha256", pa.string()), ("sound", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("n_bytes", pa.int64()), ("block_sha256", pa.string())]
    )
    decode = lambda s: s.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = parse(gzip.decompress(stored))
                except (OSError, EOFError, zlib.error):
                    found = iter([(0, len(stored), None, stored)])
                out: list[tuple] = []
                for number, (start, end, fields, block) in enumerate(found):
                    whole = hashlib.sha256(_framed(fields, block)).hexdigest()
                    own = hashlib.sha256(block).hexdigest()
                    sound = fields is not None and fields.get("WARC-Block-Digest") == f"sha256:{own}"
                    f = fields or {}
                    page, url = f.get("X-Page-Id", ""), f.get("WARC-Target-URI")
                    html = None if fields is None or "X-Null-Block" in f else block.decode("utf-8", "replace")
                    out.append((name, number, start, end, whole, sound, _long(page), None if url is None else decode(url), html, len(block), own))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), schema)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), schema)], schema=schema)

    return files.select(segment.alias("segment"), "content").mapInArrow(rows, "segment string, number long, start long, `end` long, sha256 string, sound boolean, page_id long, url string, html string, n_bytes long, block_sha256 string")


def _long(said: str) -> int | None:
    """A whole number that fits 64 bits, else null."""
    return int(said) if re.fullmatch(r"-?[0-9]{1,19}", said) and -(1 << 63) <= int(said) < 1 << 63 else None


def _framed(fields: dict[str, str] | None, block: bytes) -> bytes:
    """What a record's digest covers: its header fields and its block."""
    if fields is None:
        return b"\x00" + block
    return b"\x01" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode("utf-8", "replace") + b"\r\n" + block


def tree(records: DataFrame) -> DataFrame:
    """Nodes of every segment's tree: level (0: leaves), segment, node, hash, start, end."""
    leaf = F.sha2(F.concat_ws("|", F.lit("leaf"), "sha256", "start", "end").cast("binary"), 256)
    level = records.select(F.lit(0).alias("level"), "segment", F.col("number").alias("node"), leaf.alias("hash"), "start", "end")
    out = level
    for height in range(1, LEVELS + 1):
        child = F.struct("node", "hash", "start", "end")
        level = level.groupBy("segment", F.floor(F.col("node") / FANOUT).cast("long").alias("parent")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        said = F.concat_ws("|", F.lit("node"), F.transform("children", lambda c: F.concat_ws(",", c["hash"], c["start"], c["end"])))
        level = level.select(
            F.lit(height).alias("level"), "segment", F.col("parent").alias("node"), F.sha2(said.cast("binary"), 256).alias("hash"),
            F.array_min(F.transform("children", lambda c: c["start"])).alias("start"), F.array_max(F.transform("children", lambda c: c["end"])).alias("end"),
        )
        out = out.unionByName(level)
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that differ between two trees, from the roots down; below equal nodes nothing is compared. level, segment, node,
    start_a, end_a, start_b, end_b (null: that replica lacks it). Rows of level 0 are the damaged records."""
    differing, out = None, None
    for height in range(LEVELS, -1, -1):
        sides = []
        for t, mark in ((a, "a"), (b, "b")):
            side = t.where(F.col("level") == height)
            if differing is not None:
                above = differing.select("segment", F.col("node").alias("parent"))
                side = side.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).join(above, ["segment", "parent"], "left_semi")
            sides.append(side.select("segment", "node", *(F.col(c).alias(f"{c}_{mark}") for c in ("hash", "start", "end"))))
        differing = sides[0].join(sides[1], ["segment", "node"], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        differing = differing.select(F.lit(height).alias("level"), "segment", "node", "start_a", "end_a", "start_b", "end_b")
        out = differing if out is None else out.unionByName(differing)
    return out


def audited(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each record of either replica (rows of read_archive) with its place, whether it's sound and the same in both, and the
    segment's root. Place, hash and root are those of a; of a record that only b holds, those of b."""
    trees = [common.written(tree(r)) for r in (a, b)]
    damaged = common.written(audit(*trees).where("level = 0").select("segment", F.col("node").alias("number"), F.lit(False).alias("equal"), "start_a"))
    only_b = damaged.where("start_a is null").select("segment", "number", "equal")
    roots = [t.where(F.col("level") == LEVELS).select("segment", F.col("hash").alias("root")) for t in trees]
    one = a.join(damaged.drop("start_a"), ["segment", "number"], "left").join(roots[0], "segment")
    two = b.join(only_b, ["segment", "number"]).join(roots[1], "segment")
    out = lambda d: d.select("page_id", "segment", "number", "start", "end", "sha256", "n_bytes", "block_sha256", (F.col("sound") & F.coalesce("equal", F.lit(True))).alias("intact"), "root")
    return out(one).unionByName(out(two))


def op8_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """Two replicas of all pages are written, in the second of which the records of every 97th page_id are damaged, read back and audited:
    each record's page, the size and digest of its block, and whether the audit finds it intact."""
    pages = common.table(spark, sf_dir, "pages")
    place = f"{common.shared_folder(spark)}/gleanery-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    common.sweep_at_exit(spark)
    records = []
    for replica, damaged in (("a", None), ("b", F.coalesce(F.col("page_id").cast("long") % 97 == 0, F.lit(False)))):
        write_archive(pages, f"{place}/{replica}", damaged=damaged)
        records.append(common.written(read_archive(spark, f"{place}/{replica}").drop("url", "html")))
    return audited(*records).select("page_id", "n_bytes", "block_sha256", "intact")
