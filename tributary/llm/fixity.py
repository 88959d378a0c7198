"""WARC fixity: Merkle trees over records in archive order, compared between replicas.

A manifest has a row a record: archive, position (its byte offset), length, digest (SHA-256 of the record's bytes as they are
stored) and whether it could be read. Trees are built bottom up: leaf nodes are ranges of 64 KB of offsets, whose digest is
the SHA-256 of their records in the order of offsets; each further node is a range of 16 nodes, up to a root an archive and
one root over all archives. The audit compares roots, then descends level by level into children of
mismatching nodes only, and last compares the records of mismatching leaf ranges.

Equal records of one offset are counted before anything is shuffled, and unlike records that claim one offset (which only a
bad manifest has) are combined by adding their hashes, so no number of them is one task's load. A range holds at most 65,536
offsets.

Reading: a file's records follow each other by their stated lengths. Bytes that can't be read as a record (a bad first line
or length, a bad gzip member, an end before the record's) are a row of their own, marked unsound, up to where the next
record begins; so nothing of a file is left out, and what is behind the damage keeps its offset. A file is read
by one task, whole.

Defined results: a null position counts as -1 and a null archive as the empty string. Repeated rows count by number: a record
present twice in one replica and once in the other is reported. An empty replica has no root and all
records of the other are missing from it. An empty file has no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import discard, hot_map, salted_join, settle, shared_dir, shuffles_freed, small_batches

FAN_BITS, LEAF_BITS = 4, 16
#: Bytes of an archive, about: the record that goes beyond is its last.
ARCHIVE_BYTES = 16 << 20
#: Archives are written in so many passes over the records: beside what is written lies only a pass's share of texts, shuffled.
PASSES = 4
#: What ends a record.
END = "\r\n\r\n"


def record_text(url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record, with the headers that its fixity covers, but for END."""
    payload = F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END), payload
    )


def write_archives(records: DataFrame, size: int = ARCHIVE_BYTES) -> str:
    """Write records (one text column, without END) as WARC files of about `size` bytes; returns the folder, with one file in archive=<name>.

    An archive holds a range of digests, in their order; there are as many as the sum of all lengths asks for. Copies of a record
    that make up more than an archive by themselves are dealt over further ones, <name>-<part>. Texts are shuffled once, a share of them
    in each of PASSES.
    """
    text, end = records.columns[0], len(END)
    digest = F.sha2(F.col("r").cast("binary"), 256)
    rows = records.select(F.col(text).alias("r")).withColumn("digest", digest).withColumn("len", (F.octet_length("r") + end).cast("long"))
    runs = settle(rows.groupBy(F.unhex("digest").alias("d")).agg(F.sum("len").alias("bytes")).filter(F.col("bytes") > size).withColumn("digest", F.lower(F.hex("d"))), "copies")
    total = int(rows.agg(F.sum("len")).first()[0] or 0)
    bits = next(b for b in range(21) if size << b >= total or b == 20)
    bucket = F.shiftright(F.conv(F.substring("digest", 1, 5), 16, 10).cast("int"), 20 - bits)
    name = F.lpad(bucket.cast("string"), 7, "0")
    hot = hot_map(runs, "digest")
    if hot is not None:
        parts = runs.select("digest", F.ceil(F.col("bytes") / size).alias("parts"))
        rows = salted_join(rows.withColumn("_row", F.monotonically_increasing_id()), parts, "digest", hot, "_row", "left")
        part = F.pmod(F.xxhash64("_row"), F.col("parts")) + 1
        name = F.when(F.col("parts").isNull(), name).otherwise(F.concat(name, F.lit("-"), part.cast("string")))
    spark = records.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/warc-{uuid.uuid4().hex}"
    passes = min(PASSES, 1 << bits)
    for k in range(passes):  # by the range of digests, so all copies of a record are in one pass, however they are dealt
        own = rows.filter(bucket % passes == k).select(name.alias("archive"), "r")
        dealt = own.repartition("archive").sortWithinPartitions("archive", F.sha2(F.col("r").cast("binary"), 256))
        with shuffles_freed(spark):
            dealt.write.mode("append").partitionBy("archive").option("lineSep", END).text(path)
    discard(runs)
    return path


def manifest(records: DataFrame, archive: Column, position: Column, record: Column) -> DataFrame:
    """(archive, position, length, digest, sound, copies): each record hashed once, equal rows counted."""
    rows = records.select(archive.alias("archive"), position.alias("position"), record.alias("_r"))
    return counted(rows.select("archive", "position", F.length("_r").cast("long").alias("length"), F.sha2("_r", 256).alias("digest"), F.lit(True).alias("sound")))


def counted(rows: DataFrame) -> DataFrame:
    """A manifest of rows (archive, position, length, digest, sound)."""
    keys = [F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"), F.coalesce(F.col("position").cast("long"), F.lit(-1)).alias("position")]
    return rows.select(*keys, "length", "digest", "sound").groupBy("archive", "position", "length", "digest", "sound").agg(F.count("*").alias("copies"))


def leaves(records: DataFrame) -> DataFrame:
    """Level 1: (archive, node, digest, n), the digest over a range's records in the order of their offsets."""
    mark = F.sha2(F.concat_ws("|", "position", "length", "digest", F.col("sound").cast("string"), "copies"), 256)
    lanes = [F.conv(F.substring(mark, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    at = records.groupBy("archive", F.shiftright("position", LEAF_BITS).alias("node"), "position").agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(lanes)], F.sum("copies").alias("n"))
    own = F.concat_ws("|", "position", *[(F.col(f"s{i}") % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("string") for i in range(4)], F.col("n").cast("string"))
    ranges = at.select("archive", "node", "position", "n", own.alias("own")).groupBy("archive", "node").agg(F.array_sort(F.collect_list(F.struct("position", "own"))).alias("_c"), F.sum("n").alias("n"))
    return ranges.select("archive", "node", F.sha2(F.array_join(F.transform("_c", lambda x: x["own"]), ",").cast("binary"), 256).alias("digest"), "n")


def parents(nodes: DataFrame) -> DataFrame:
    """The level above; a node has 16 children at most."""
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    joined = F.array_join(F.transform("_c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"])), ",")
    up = nodes.groupBy("archive", F.shiftright("node", FAN_BITS).alias("_up")).agg(children.alias("_c"), F.sum("n").alias("n"))
    return up.select("archive", F.col("_up").alias("node"), F.sha2(joined, 256).alias("digest"), "n")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from leaves to archive roots (nodes 0 and, for negative positions, -1), each a small table."""
    most = records.agg(F.max(F.when(F.col("position") >= 0, F.col("position")).otherwise(-F.col("position")))).first()[0] or 0
    levels = [settle(leaves(records), "merkle")]
    for _ in range(max(0, -(-(int(most).bit_length() - LEAF_BITS) // FAN_BITS))):
        levels.append(settle(parents(levels[-1]), "merkle"))
    return levels


def root(levels: list[DataFrame]) -> DataFrame:
    """(root, n): one row over all archives, whose digests are added in lanes; none for an empty table."""
    mark = F.sha2(F.concat_ws("|", "archive", F.col("node").cast("string"), "digest"), 256)
    lanes = [F.sum(F.conv(F.substring(mark, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    return levels[-1].agg(*lanes, F.sum("n").alias("n")).filter("n IS NOT NULL").select(F.sha2(F.concat_ws("|", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("root"), "n")


def differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """(archive, node) of nodes that are not alike in both."""
    a, b = one.select("archive", "node", F.col("digest").alias("da")), two.select("archive", "node", F.col("digest").alias("db"))
    return a.join(b, ["archive", "node"], "full").filter(~F.col("da").eqNullSafe(F.col("db"))).select("archive", "node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Rows (archive, position, status, length, digest, copies, replica_length, replica_digest, replica_copies) of records that differ.

    copies: how many records of each side the other lacks there, of which length and digest are of the one with the least digest.
    status: changed (both have a record there, another one), damaged (the replica's bytes there are no record), missing or
    extra in the replica, or conflict where several records claim a position. primary and replica are manifests.
    """
    a, b = (m if hasattr(m, "_settled") else settle(m, "manifest") for m in (primary, replica))
    one, two = tree(a), tree(b)
    while len(one) < len(two):
        one.append(settle(parents(one[-1]), "merkle"))
    while len(two) < len(one):
        two.append(settle(parents(two[-1]), "merkle"))
    found = [x.first() for x in (root(one), root(two))]
    if found[0] == found[1]:
        suspects = one[0].select("archive", "node").limit(0)
    else:
        suspects = differing(one[-1], two[-1])
        for x, y in zip(one[-2::-1], two[-2::-1]):
            at = settle(suspects.toDF("archive", "_up"), "mismatch")
            below = lambda level: level.withColumn("_up", F.shiftright("node", FAN_BITS)).join(at, ["archive", "_up"], "left_semi").drop("_up")  # noqa: B023, E731
            suspects = differing(below(x), below(y))
    at = settle(suspects.toDF("archive", "_leaf"), "mismatch")
    within = lambda rows: rows.withColumn("_leaf", F.shiftright("position", LEAF_BITS)).join(at, ["archive", "_leaf"], "left_semi").drop("_leaf")
    both = within(a).withColumn("own", F.lit(1)).unionByName(within(b).withColumn("own", F.lit(-1)))
    odd = both.groupBy("archive", "position", "length", "digest", "sound").agg(F.sum(F.col("copies") * F.col("own")).alias("over")).filter("over != 0")
    ours, theirs = F.col("over") > 0, F.col("over") < 0
    # One row a place; where several records claim it, their number tells, and none is gathered.
    per = odd.groupBy("archive", "position").agg(
        F.sum(F.when(ours, F.col("over"))).alias("na"), F.sum(F.when(theirs, -F.col("over"))).alias("nb"),
        F.min(F.when(ours, F.struct("digest", "length"))).alias("x"), F.min(F.when(theirs, F.struct("digest", "length", "sound"))).alias("y"),
    )
    many = (F.coalesce("na", F.lit(0)) > 1) | (F.coalesce("nb", F.lit(0)) > 1)
    status = F.when(many, "conflict").when(F.col("nb").isNull(), "missing").when(~F.col("y.sound"), "damaged").when(F.col("na").isNull(), "extra").otherwise("changed")
    return per.select("archive", "position", status.alias("status"), F.col("x.length").alias("length"), F.col("x.digest").alias("digest"), F.coalesce("na", F.lit(0)).alias("copies"), F.col("y.length").alias("replica_length"), F.col("y.digest").alias("replica_digest"), F.coalesce("nb", F.lit(0)).alias("replica_copies"))


def inflated(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """A gzip member's content and its size in the file; None if it is bad or cut off. most: only so many bytes of content, size 0."""
    inflater, parts, to = zlib.decompressobj(wbits=31), [], at
    try:
        if most:
            return inflater.decompress(data[at : at + 4096], most), 0
        while not inflater.eof and to < len(data):
            parts.append(inflater.decompress(data[to : to + 65536]))
            to += 65536
    except zlib.error:
        return None
    return (b"".join(parts), min(to, len(data)) - at - len(inflater.unused_data)) if inflater.eof else None


def next_record(data: bytes, at: int) -> int:
    """The first place after `at` where a record seems to begin, or the end."""
    plain = data.find(END.encode() + b"WARC/", at)
    plain = plain + len(END) if plain >= 0 else len(data)
    member = data.find(b"\x1f\x8b\x08", at + 1, plain)
    while member >= 0:
        got = inflated(data, member, 64)
        if got and got[0].startswith(b"WARC/"):
            return member
        member = data.find(b"\x1f\x8b\x08", member + 1, plain)
    return plain


def parse_record(data: bytes, at: int) -> tuple[int, str, str, bytes] | None:
    """(length in the file, type, target, payload) of the record that begins here, or None if there is none that is whole."""
    member = None
    if data[at : at + 2] == b"\x1f\x8b":
        if (member := inflated(data, at)) is None:
            return None
        record, begin = member[0], 0
    else:
        record, begin = data, at
    if record[begin : begin + 5] != b"WARC/":
        return None
    close = record.find(END.encode(), begin)
    if close < 0:
        return None
    fields = dict(x.split(b":", 1) for x in record[begin:close].split(b"\r\n")[1:] if b":" in x)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    n = fields.get(b"content-length", b"")
    if not n.isdigit() or len(n) > 18:
        return None
    body = close + len(END)
    if record[body + int(n) : body + int(n) + len(END)] != END.encode():
        return None
    text = lambda k: fields.get(k, b"").decode("utf-8", "replace")
    return member[1] if member else body + int(n) + len(END) - at, text(b"warc-type"), text(b"warc-target-uri"), record[body : body + int(n)]


def parse_warc(data: bytes) -> list[tuple[int, int, str, str, bytes, bool]]:
    """(offset, length, type, target, payload, sound) of all parts of a WARC file, plain or of gzip members.

    For gzip files offset and length are of the member, as archives index them. Bytes that are no record have sound false, an
    empty payload, and go up to the next record or the end of the file.
    """
    out, at = [], 0
    while at < len(data):
        found = parse_record(data, at)
        if found:
            out.append((at, *found, True))
            at += found[0]
        else:
            to = next_record(data, at)
            out.append((at, to - at, "", "", b"", False))
            at = to
    return out


WARC = "archive string, offset long, length long, type string, target string, payload binary, sound boolean, digest string"


def read_warc(spark: SparkSession, path: str, payloads: bool = True, change: Callable[[str, bytes], bytes] | None = None) -> DataFrame:
    """(archive, offset, length, type, target, payload, sound, digest) of all parts of the WARC files of a folder and those below it.

    archive: the path, or after a folder archive=<name> that name. digest: SHA-256 of the part's bytes in the file. payloads:
    false leaves them null. change: what has happened to a file's bytes (to try out an audit).
    """
    small_batches(spark, 16)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.coalesce(F.nullif(F.regexp_extract("path", "/archive=([^/]+)/", 1), F.lit("")), F.col("path"))
    files = files.select(named.alias("archive"), "content").filter("length(content) > 0")

    def run(it):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.string()]
        names = ["archive", "offset", "length", "type", "target", "payload", "sound", "digest"]
        for batch in it:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data = change(name, data) if change else data
                rows = parse_warc(data)
                for at in range(0, len(rows), 1000):
                    part = [(name, o, n, kind, target, payload if payloads else None, sound, hashlib.sha256(data[o : o + n]).hexdigest()) for o, n, kind, target, payload, sound in rows[at : at + 1000]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate(kinds)], names=names)

    return files.mapInArrow(run, WARC)


def fixity_manifest(files: DataFrame) -> DataFrame:
    """The manifest of what read_warc() gives."""
    return counted(files.select("archive", F.col("offset").alias("position"), "length", "digest", "sound"))


def write_warc(records: list[tuple[str, bytes]], compress: bool = True) -> bytes:
    """A WARC file of (target, payload) resource records, each its own gzip member."""
    out = io.BytesIO()
    for target, payload in records:
        record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (target.encode(), len(payload), payload)
        out.write(gzip.compress(record, mtime=0) if compress else record)
    return out.getvalue()
