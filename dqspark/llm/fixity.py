"""Merkle fixity audit of web archives.

The records of an archive lie at ordered offset ranges. A node covers fan_out ranges in a row and hashes their bounds
and digests in order, up to one root. Two replicas are compared from their roots down, and only under nodes that
differ, until the ranges of the records that differ are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The lines of a record, of which the blank one ends the head.
_HEAD = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: %s\r\nWARC-Record-ID: <urn:page:%s>\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A web page as bytes of an archive record. Nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.format_string(_HEAD, F.coalesce(url, F.lit("")), F.coalesce(page_id.cast("string"), F.lit("")), F.octet_length(body))
    return F.encode(F.concat(head, body, F.lit("\r\n\r\n")), "utf-8")


def archive_records(pages: DataFrame, per_archive: int = 256, held: Column | None = None) -> DataFrame:
    """One row per distinct record: archive, ordinal, offset, length, page_id, digest, copies, held_digest.

    An archive holds the pages of per_archive ids, ordered by page_id and digest, one after the other. Equal rows are
    one record with a count of copies; versions of a page are records of their own. Rows without a page_id are spread
    over archives below zero by their digest. held is what a replica holds at the record's place, as an expression on
    page_id and record; held_digest is its digest, or null where it holds nothing.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record.alias("record"))
    rows = rows.select(
        "page_id",
        F.sha2("record", 256).alias("digest"),
        F.octet_length("record").cast("long").alias("length"),
        F.sha2(F.col("record") if held is None else held, 256).alias("held_digest"),
    )
    known = F.floor(F.col("page_id") / per_archive)
    rows = rows.withColumn("archive", F.coalesce(known, -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).cast("long"))
    one = rows.groupBy("archive", "page_id", "digest").agg(F.count("*").alias("copies"), F.max("length").alias("length"), F.max("held_digest").alias("held_digest"))
    in_order = Window.partitionBy("archive").orderBy("page_id", "digest")
    before = F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    ordinal = (F.row_number().over(in_order) - 1).cast("long")
    return one.select("archive", ordinal.alias("ordinal"), before.alias("offset"), "length", "page_id", "digest", "copies", "held_digest")


def leaves(records: DataFrame) -> DataFrame:
    """The lowest nodes: (archive, level 0, node = ordinal, first, stop, hash)."""
    stop = F.col("offset") + F.col("length")
    text = F.concat_ws(":", "offset", stop, "digest")
    return records.select("archive", F.lit(0).alias("level"), F.col("ordinal").alias("node"), F.col("offset").alias("first"), stop.alias("stop"), F.sha2(text, 256).alias("hash"))


def _above(nodes: DataFrame, fan_out: int) -> DataFrame:
    """The next level up. A node has at most fan_out parts, whatever the archive's size."""
    parts = F.array_sort(F.collect_list(F.struct("node", "hash")))
    grouped = nodes.groupBy("archive", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / fan_out).cast("long").alias("node"))
    joined = F.concat_ws(",", F.transform(parts, lambda x: F.concat_ws("=", x["node"], x["hash"])))
    return grouped.agg(F.min("first").alias("first"), F.max("stop").alias("stop"), F.sha2(joined, 256).alias("hash"))


def tree(records: DataFrame, fan_out: int = 16) -> list[DataFrame]:
    """The levels from the leaves up to the roots. An empty table gives leaves only."""
    levels = [leaves(records)]
    height = records.agg(F.max("ordinal")).first()[0]
    width = 1 if height is None else height + 1
    while width > 1:
        levels.append(_above(levels[-1], fan_out))
        width = -(-width // fan_out)
    return levels


def differing_leaves(ours: list[DataFrame], theirs: list[DataFrame], fan_out: int = 16) -> DataFrame:
    """(archive, node, status) of the leaves that differ: changed, missing or extra in theirs. Trees of equal height."""
    keys = ["archive", "node"]
    wanted = None
    for level, (a, b) in reversed(list(enumerate(zip(ours, theirs, strict=True)))):
        a, b = a.select(*keys, F.col("hash").alias("ours")), b.select(*keys, F.col("hash").alias("theirs"))
        if wanted is not None:
            above = ["archive", F.floor(F.col("node") / fan_out).cast("long").alias("above")]
            a = a.select(*keys, "ours", above[1]).join(wanted, ["archive", "above"], "left_semi").drop("above")
            b = b.select(*keys, "theirs", above[1]).join(wanted, ["archive", "above"], "left_semi").drop("above")
        found = a.join(b, keys, "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs")))
        wanted = found.select("archive", F.col("node").alias("above"))
        if level == 0:
            status = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("changed")
            return found.select(*keys, status.alias("status"))
    raise ValueError("a tree has at least its leaves")


def audit(manifest: DataFrame, replica: DataFrame, fan_out: int = 16) -> DataFrame:
    """The records whose digest in a replica is not that of the manifest.

    manifest has the columns of archive_records; replica has archive, ordinal, offset, length and digest of what was
    read at the manifest's places. Result: archive, ordinal, offset, length, page_id, status. Equal replicas and empty
    tables give no rows.
    """
    ours, theirs = tree(manifest, fan_out), tree(replica, fan_out)
    height = max(len(ours), len(theirs))
    for levels in (ours, theirs):
        while len(levels) < height:
            levels.append(_above(levels[-1], fan_out))
    found = differing_leaves(ours, theirs, fan_out).withColumnRenamed("node", "ordinal")
    places = ["archive", "ordinal"]
    of = manifest.select(*places, "offset", "length", "page_id")
    beyond = replica.select(*places, F.col("offset").alias("other_offset"), F.col("length").alias("other_length"))
    found = found.join(of, places, "left").join(beyond, places, "left")
    return found.select(
        *places,
        F.coalesce("offset", "other_offset").alias("offset"),
        F.coalesce("length", "other_length").alias("length"),
        "page_id",
        "status",
    )
