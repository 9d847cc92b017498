"""WARC records and a Merkle fixity audit of their replicas.

Pages become WARC/1.1 response records, laid out in archives of bounded
size. A replica of an archive is a set of stored records with their offsets.
The audit hashes every record together with its place (offset and length)
into a leaf, hashes ranges of FANOUT leaves, in order of offset, into nodes,
and so on up to one root for each archive; it then compares the roots of two
replicas and descends only into ranges whose hashes differ, level by level,
until it has the differing records. Of archives with equal roots nothing but the
root is compared.

A level's hash is SHA-256 over the children's hashes in order, so a node is
the same for every replica that holds the same bytes at the same places.
Nodes are numbered by position in the layout, not by what was found, so a
lost or damaged record spoils only the nodes above it.

``write_archives`` and ``read_archives`` store records as tables of binary
records with their offsets, by archive; ``archive_bytes`` gives the file.

Defined cases: a null html is an empty payload, a null url an empty target;
equal pages are records of their own; repeated ids are ordered by url and
html; a null id comes first; pages of any size are one record; an empty table
gives an empty result; other columns are ignored. A record that one replica
lacks is reported as missing there, one that only the replica has as extra.
Records of any size are hashed where they are read and aren't shuffled by
the audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.llm.common import Scratch

#: Records to an archive, and hashes to a node.
ARCHIVE_RECORDS, FANOUT = 1024, 8
#: Levels from the leaves to the root: FANOUT ** LEVELS >= ARCHIVE_RECORDS.
LEVELS = 4
DATE = "2024-01-01T00:00:00Z"
#: One in about so many records of the damaged replica that the query audits has a byte changed.
DAMAGE_ONE_IN = 97


def response_record(url: Column, body: Column) -> Column:
    """The bytes of a WARC/1.1 response record; its id is made from what it holds."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    payload = F.concat(F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "utf-8"), body)
    digest = F.sha2(F.concat(F.encode(url, "utf-8"), F.lit(b"\n"), body), 256)
    uuid = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), payload, F.lit(b"\r\n\r\n"))


def described(pages: DataFrame) -> DataFrame:
    """(page_id, url, length, record_sha256, record) of every page."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), response_record(F.col("url"), body).alias("record"))
    return rows.select("page_id", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("record_sha256"), "record")


def laid_out(rows: DataFrame, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Records (page_id, url, length, record_sha256, ...) with their archive, position and offset.

    Records go to archives by a hash, about archive_records to each, so that
    no global order is needed, and lie there by page id. Whatever columns the
    rows have go through the one shuffle that brings an archive together, so
    callers that don't need the bytes leave them out.
    """
    n = -(-rows.count() // archive_records) or 1
    rows = rows.withColumn("archive", F.pmod(F.xxhash64("page_id", "url", "record_sha256"), F.lit(n)))
    order = [F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "record_sha256"]
    own = Window.partitionBy("archive").orderBy(*order)
    before = F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("position", F.row_number().over(own) - 1).withColumn("offset", F.coalesce(before, F.lit(0)))


def records(pages: DataFrame, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """(archive, position, offset, length, page_id, url, record): the pages as records laid out in archives, to be stored."""
    return laid_out(described(pages), archive_records).select("archive", "position", "offset", "length", "page_id", "url", "record")


def write_archives(placed: DataFrame, path: str) -> None:
    """Store the records of ``records`` under a path of any file system that Spark writes to."""
    placed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def archive_bytes(placed: DataFrame, archive: int) -> bytes:
    """One archive as a file: its records, joined in order of offset. An archive is of bounded size."""
    rows = placed.filter(F.col("archive") == archive).orderBy("offset").select("record").collect()
    return b"".join(bytes(r["record"]) for r in rows)


def leaves(placed: DataFrame) -> DataFrame:
    """(archive, position, offset, length, record_sha256, hash): a leaf for each record, bound to its place.

    Records are hashed unless ``placed`` has their ``record_sha256``.
    """
    digest = F.col("record_sha256") if "record_sha256" in placed.columns else F.sha2("record", 256)
    own = placed.select("archive", "position", "offset", "length", digest.alias("record_sha256"))
    bound = F.concat_ws(":", F.lit("leaf"), "offset", "length", "record_sha256")
    return own.withColumn("hash", F.sha2(F.encode(bound, "utf-8"), 256))


def tree(leaf: DataFrame, scratch: Scratch, name: str, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """(archive, node, hash) of each level, from the leaves (level 0) to the roots; a written table for each.

    A node covers ``fanout`` positions of the level below, in order; its hash
    names the children that it has.
    """
    below = leaf.select("archive", F.col("position").cast("long").alias("node"), "hash")
    out = [below]
    for level in range(1, levels + 1):
        child = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most ``fanout`` of them
        above = below.groupBy("archive", F.floor(F.col("node") / fanout).alias("parent")).agg(child.alias("children"))
        named = F.transform("children", lambda c: F.concat_ws("=", c["node"], c["hash"]))
        above = above.select("archive", F.col("parent").alias("node"), F.sha2(F.encode(F.concat_ws(",", named), "utf-8"), 256).alias("hash"))
        below = scratch.keep(above, f"{name}-level{level}")
        out.append(below)
    return out


def roots(top: DataFrame) -> DataFrame:
    """(archive, root) from the top level; archives of more than fanout ** levels records have several top nodes, hashed together."""
    rows = top.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("top"))
    return rows.select("archive", F.sha2(F.encode(F.concat_ws(",", F.transform("top", lambda c: c["hash"])), "utf-8"), 256).alias("root"))


def mismatches(one: list[DataFrame], two: list[DataFrame], scratch: Scratch, fanout: int = FANOUT) -> DataFrame:
    """(archive, position) of the records that differ, found from the roots down.

    ``one`` and ``two`` are the levels of two replicas' trees. Each step looks
    only at the children of the nodes that differed one level above, and is
    written before the next; the descent ends where nothing differs.
    """
    found: DataFrame | None = None
    for level in range(len(one) - 1, -1, -1):
        a, b = (x[level].select("archive", "node", F.col("hash").alias(c)) for x, c in ((one, "a"), (two, "b")))
        if found is not None:
            within = found.select("archive", F.col("node").alias("parent"))
            parent = F.floor(F.col("node") / fanout)
            a, b = (x.withColumn("parent", parent).join(within, ["archive", "parent"], "left_semi").drop("parent") for x in (a, b))
        differing = a.join(b, ["archive", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node")
        found = scratch.keep(differing, f"differing{level}")
        if found.isEmpty():
            break
    return found.select("archive", F.col("node").alias("position"))


def audit(replica_one: DataFrame, replica_two: DataFrame, scratch: Scratch, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row for each record of the first replica and each extra one of the second, with the archive's roots and its state.

    state: ``intact``; ``altered`` (other bytes at the same place); ``missing`` (not in
    the second); ``extra`` (only in the second). Leaves of the second replica
    are only looked at where the descent ends.
    """
    leaf, levels_of = [], []
    for name, placed in (("one", replica_one), ("two", replica_two)):
        own = scratch.keep(leaves(placed), f"leaves-{name}")
        levels_of.append(tree(own, scratch, name, fanout, levels))
        leaf.append(own.drop("hash"))
    both = roots(levels_of[0][-1]).withColumnRenamed("root", "root_one").join(roots(levels_of[1][-1]).withColumnRenamed("root", "root_two"), "archive", "full")
    both = scratch.keep(both, "roots")
    bad = mismatches(*levels_of, scratch, fanout)
    place = ["archive", "position"]
    two = leaf[1].join(bad, place, "left_semi").select(*place, *(F.col(c).alias(f"{c}_two") for c in ("offset", "length", "record_sha256")))
    one = leaf[0].join(bad, place, "left_semi").select(*place, F.lit(True).alias("in_one"))
    two = scratch.keep(bad.join(two, place, "left").join(one, place, "left"), "found")
    known = leaf[0].join(two.filter("in_one").drop("in_one").withColumn("differs", F.lit(True)), place, "left")
    state = F.when(F.col("differs").isNull(), "intact").when(F.col("record_sha256_two").isNull(), "missing").otherwise("altered")
    theirs = F.when(F.col("differs"), F.col("record_sha256_two")).otherwise(F.col("record_sha256"))
    rows = known.select(*place, F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), "record_sha256", theirs.alias("replica_sha256"), state.alias("state"))
    extra = two.filter("in_one IS NULL").select(
        *place, F.col("offset_two").alias("record_offset"), F.col("length_two").alias("record_length"), F.lit(None).cast("string").alias("record_sha256"),
        F.col("record_sha256_two").alias("replica_sha256"), F.lit("extra").alias("state"),
    )
    return rows.unionByName(extra).join(both, "archive", "left").select(
        *place, "record_offset", "record_length", "record_sha256", "replica_sha256", F.col("root_one").alias("root"), F.col("root_two").alias("replica_root"), "state"
    )


def damaged(placed: DataFrame, one_in: int = DAMAGE_ONE_IN, column: str = "record") -> DataFrame:
    """A replica with the last payload byte before the closing line breaks changed, in records chosen by their content."""
    chosen = F.pmod(F.crc32(column), F.lit(one_in)) == 0
    bytes_kept = F.expr(f"substring({column}, 1, CAST(length - 5 AS INT))")
    return placed.withColumn(column, F.when(chosen, F.concat(bytes_kept, F.lit(b"\x00\r\n\r\n"))).otherwise(F.col(column)))


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages: their records as laid out in archives, against a replica with some bytes changed.

    Each replica's records are hashed where they are read; only places and
    hashes are shuffled.
    """
    scratch = Scratch(spark, "warc")
    rows = described(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    own = damaged(rows.withColumn("replica", F.col("record")), column="replica").withColumn("replica_sha256", F.sha2("replica", 256))
    placed = scratch.keep(laid_out(own.drop("record", "replica")), "archives")
    replica = placed.drop("record_sha256").withColumnRenamed("replica_sha256", "record_sha256")
    found = audit(placed, replica, scratch)
    return found.join(placed.select("archive", "position", "page_id", "url"), ["archive", "position"]).select(
        "page_id", "url", "archive", "position", "record_offset", "record_length", "record_sha256", "replica_sha256", "root", "replica_root", "state"
    )
