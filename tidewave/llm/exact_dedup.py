"""Exact duplicates by an extendible-hash index on shared files. DataFrame functions only.

The key of a text is the XXH64 of its normal form. The directory of the index starts with one bucket and doubles as
long as a bucket holds more keys than it should; its entries are prefixes of the key, so a bucket is a range of keys.
Rows are summed to one entry for each key and digest, and dealt by looking their key up in the directory: each bucket
goes to one owner task, which writes its entries in the order of their keys, those of one key as a chain. A key with
one row is unique. The texts of all others are read again and compared byte by byte along their chain: the least and
the greatest text of an entry must be the same, which Spark works out on the map side first, so that a group of copies,
however large, sends two texts for each task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, looked_up, lower_ascii, numbered, scratch, stored, without

#: Keys that a bucket holds before it splits; with very many keys it holds more, so that the directory has at most 2 ** MOST_DEPTH entries.
BUCKET_KEYS, MOST_DEPTH = 50_000, 12

#: Keys with several rows are broadcast up to this number (8 bytes each, 8 MB); beyond it the join shuffles both sides.
BROADCAST_KEYS = 1_000_000


def split_directory(cells: dict[int, int], bucket_keys: int, max_depth: int) -> tuple[int, list[int]]:
    """The directory's depth and the bucket of each of its entries, from the number of keys for each prefix of ``max_depth`` bits.

    An overfull bucket splits in two by its next bit; the directory doubles when that bucket was as deep as the directory.
    """
    load = lambda prefix, depth: sum(n for cell, n in cells.items() if cell >> (max_depth - depth) == prefix)
    depth, leaves, todo = 0, [], [(0, 0, sum(cells.values()))]
    while todo:
        prefix, local, keys = todo.pop()
        if keys <= bucket_keys or local == max_depth:
            leaves.append((prefix, local))
            continue
        depth = max(depth, local + 1)
        left = load(2 * prefix, local + 1)
        todo += [(2 * prefix + 1, local + 1, keys - left), (2 * prefix, local + 1, left)]
    entries = [0] * (1 << depth)
    for bucket, (prefix, local) in enumerate(leaves):  # in the order of their keys
        first = prefix << (depth - local)
        entries[first : first + (1 << (depth - local))] = [bucket] * (1 << (depth - local))
    return depth, entries


def prefix_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def exact_duplicates(docs: DataFrame, key_bits: int = 64, bucket_keys: int = BUCKET_KEYS, max_depth: int = MOST_DEPTH) -> DataFrame:
    """One row for each row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after A-Z became a-z; a null text is an empty one, and empty texts equal each other.
    Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any other, and of rows that
    also share the doc_id the one with the largest row number stays. An empty table gives no rows. Other columns are
    ignored. ``key_bits`` below 64 makes keys collide, for tests. ``row`` is that of one scan, written with the digests.
    """
    return index_duplicates(documents(docs), key_bits, bucket_keys, max_depth)


def index_duplicates(texts: DataFrame, key_bits: int = 64, bucket_keys: int = BUCKET_KEYS, max_depth: int = MOST_DEPTH) -> DataFrame:
    """``exact_duplicates`` of rows (row, doc_id, text)."""
    mask = (1 << key_bits) - 1 if key_bits < 64 else -1
    normal = texts.withColumn("text", lower_ascii(F.col("text")))
    keyed = normal.withColumn("key", F.shiftleft(F.xxhash64("text").bitwiseAND(F.lit(mask)), 64 - key_bits)).withColumn("sha", F.sha2("text", 256))
    rows = stored(keyed.select("row", "doc_id", "key", "sha"))

    cells = {r["cell"]: r["keys"] for r in rows.groupBy(prefix_of(F.col("key"), max_depth).alias("cell")).agg(F.approx_count_distinct("key").alias("keys")).collect()}
    most = max(bucket_keys, math.ceil(2 * sum(cells.values()) / (1 << max_depth)))
    depth, directory = split_directory(cells, most, max_depth)
    bucket = F.element_at(F.lit(directory), (prefix_of(F.col("key"), depth) + 1).cast("int"))
    entries = rows.groupBy(bucket.alias("bucket"), "key", "sha").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("keeper"))
    index = stored(entries.repartition(max(directory) + 1, "bucket").sortWithinPartitions("bucket", "key", "sha"))  # by owner

    chains = index.where("n > 1")
    suspects = stored(index.groupBy("bucket", "key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    if suspects.count() <= BROADCAST_KEYS:
        suspects = F.broadcast(suspects)
    compared = keyed.select("key", "text").join(suspects, "key", "left_semi").groupBy("key", F.sha2("text", 256).alias("sha")).agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    if not compared.where("least <> greatest").isEmpty():  # the bytes decide
        raise ValueError("two different texts share a key and a SHA-256")
    found = looked_up(rows, stored(chains.drop("bucket")), ["key", "sha"], "n", "left")
    entry = F.col("keeper").isNotNull()
    return found.select(
        "row",
        "doc_id",
        F.when(entry, F.col("keeper.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(entry, F.col("keeper.row") == F.col("row")).otherwise(F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all its columns, without the rows that ``exact_duplicates`` drops."""
    rows = numbered(docs)
    with scratch(docs.sparkSession) as kept:
        dropped = kept(index_duplicates(rows.select("row", "doc_id", "text")).where("not kept").select("row"))
    return without(rows, dropped)
