"""Merkle manifest of a dataset, with proofs, by nested intervals.

Leaves are ranked within their source. A node is labelled with the interval of leaf ranks that it covers; at level L
intervals have a length of fan ** L, so lo / fan ** L is its bucket. Nothing else is needed to relate nodes: an
ancestor's interval contains a node's, which is one join for each level on tree and bucket, and a node's siblings are
what its parent's interval holds besides its own, those that end before it begins to the left, the others to the right.

Levels are built upward, each from the one below, and paths are attached downward, from the root to the nodes right
above the leaves. A parent meets at most ``fan`` nodes, so no join has a hot key, however large a source is, and each
level is a sixteenth of the one below. The subroots are the leaves of one more tree. Digests are lowercase hex SHA-256;
a node's is over its children's hex digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lower_ascii, scratch, sent_if_small, stored

FAN = 16

#: A document is tampered with, for the test of its proof, where the CRC-32 of its id is divisible by this.
TAMPERED = 5

#: Siblings on the way to a root.
PATH = "array<struct<left:string,right:string>>"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """``-`` if null, else the number of bytes, ``:`` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def joined(children: Column) -> Column:
    """The digests of ``children``, one after the other."""
    return F.concat_ws("", F.transform(children, lambda c: c["digest"]))


def leaves_of(docs: DataFrame) -> DataFrame:
    """tree, doc_id, row, digest and altered, the digest of the text as it is tampered with.

    ``tree`` orders sources: empty for null, else ``=`` and the source.
    """
    columns = {c: F.col(f"`{c}`") for c in FIELDS}
    altered = columns | {"text": lower_ascii(columns["text"].cast("string"))}
    hit = F.crc32(columns["doc_id"].cast("string")) % TAMPERED == 0
    own = docs.select(
        F.coalesce(F.concat(F.lit("="), columns["source"].cast("string")), F.lit("")).alias("tree"),
        columns["doc_id"].cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        digest(*map(field, columns.values())).alias("digest"),
        F.when(hit, digest(*map(field, altered.values()))).alias("altered"),
    )
    return own.withColumn("altered", F.coalesce("altered", "digest"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, the place within their ``tree`` by ``order``, and ``n``, the tree's number of rows.

    Rows are dealt into ranges of (tree, order) and numbered where they are. A tree's part in a range begins at its
    first number there, and so many of its rows lie in the ranges before. No task holds a whole tree.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    parts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("tree")  # a row for each range: bounded by the number of tasks
    before = F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    parts = stored(parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n")))
    return dealt.join(sent_if_small(parts), ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def parents(nodes: DataFrame, length: int, fan: int) -> DataFrame:
    """The nodes above ``nodes`` (tree, n, lo, hi, digest, and ``held``, whatever else they carry): tree, n, bucket, lo, hi, digest, children.

    ``length`` is that of the parents' intervals. A tree of one leaf keeps it as its root.
    """
    child = F.struct("lo", "hi", "digest", *[c for c in ("held",) if c in nodes.columns])
    families = nodes.groupBy("tree", "n", F.expr(f"lo div {length}").alias("bucket")).agg(F.array_sort(F.collect_list(child)).alias("children"))  # at most `fan`
    own = F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(digest(joined(F.col("children"))))
    return families.select("tree", "n", "bucket", (F.col("bucket") * length).alias("lo"), F.least((F.col("bucket") + 1) * length, F.col("n")).alias("hi"), own.alias("digest"), "children")


def grown(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """The stored levels of all trees, from the one above ``leaves`` (tree, n, rank, digest, held) to that of the highest root."""
    base = leaves.select("tree", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *[c for c in ("held",) if c in leaves.columns])
    levels = [stored(parents(base, fan, fan))]
    most = levels[0].agg(F.max("n").alias("n")).first()["n"] or 0
    while fan ** len(levels) < most:
        below = levels[-1].where(F.col("n") > fan ** len(levels)).select("tree", "n", "lo", "hi", "digest")  # trees that have no root yet
        levels.append(stored(parents(below, fan ** (len(levels) + 1), fan)))
    return levels


def is_root() -> Column:
    return (F.col("lo") == 0) & (F.col("hi") == F.col("n"))


def siblings(children: Column, lo: Column, hi: Column) -> Column:
    """The digests to the left and to the right of [lo, hi): the parent's interval without the node's own."""
    return F.struct(joined(F.filter(children, lambda c: c["hi"] <= lo)).alias("left"), joined(F.filter(children, lambda c: c["lo"] >= hi)).alias("right"))


def with_paths(levels: list[DataFrame], roots: DataFrame, fan: int) -> DataFrame:
    """The lowest level with ``path``, the siblings of a node and of all its ancestors, lowest first.

    ``roots`` has tree, the path above a tree's root, and what else its nodes are to carry.
    """
    carried = [c for c in roots.columns if c not in ("tree", "path")]
    above = None
    for height in range(len(levels), 0, -1):
        nodes = levels[height - 1]
        found = nodes.where(is_root()).join(roots, "tree")
        if above is not None:
            family = above.select("tree", F.col("bucket").alias("over"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("children").alias("family"), F.col("path").alias("rest"), *carried)
            inner = nodes.where(~is_root()).withColumn("over", F.expr(f"lo div {fan ** (height + 1)}")).join(family, ["tree", "over"]).where("from <= lo and hi <= to")
            inner = inner.withColumn("path", F.concat(F.array(siblings(F.col("family"), F.col("lo"), F.col("hi"))), F.col("rest")))
            found = found.unionByName(inner.select(*found.columns))
        above = found if height == 1 else stored(found)
    return above


def of_children(families: DataFrame) -> DataFrame:
    """Each child of ``families`` (with paths) as ``child``, with its own ``path``: a tree's only leaf has no siblings below the root."""
    each = families.withColumn("child", F.explode("children"))
    own = F.array(siblings(F.col("children"), F.col("child")["lo"], F.col("child")["hi"]))
    return each.withColumn("path", F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(own, F.col("path")))).drop("children")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path give."""
    return F.aggregate(path, start, lambda own, at: F.sha2(F.concat(at["left"], own, at["right"]), 256))


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of ``docs``.

    proof_sha256 is over the digests of all siblings on the way to the root, level by level, left to right. folded_root
    comes from the siblings and the leaf, that of the tampered text where the document is tampered with; verified says
    whether it is the root. Null fields count as ``-``, and so does a null doc_id, which is never tampered with. Leaves
    of one source ascend by doc_id (null first), those of one doc_id by digest. Rows that repeat are leaves each. A
    source of one document has its leaf as subroot, a dataset of one source its subroot as root. An empty table gives
    no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as kept:
        leaves = ranked(leaves_of(docs), ["doc_id", "digest", "row"])
        levels = grown(leaves.withColumn("held", F.struct("doc_id", "altered")), fan)
        subroots = reduce(DataFrame.unionByName, [level.where(is_root()).select("tree", "digest") for level in levels])
        tops = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
        top_levels = grown(tops.withColumn("held", F.struct("source")), fan)
        root = top_levels[-1].where(is_root()).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
        top = of_children(with_paths(top_levels, root, fan))
        roots = stored(top.select(F.col("child.held.source").alias("tree"), "path", F.col("child.digest").alias("subroot"), "root"))
        each = of_children(with_paths(levels, roots, fan))
        proof = F.sha2(F.concat_ws("", F.transform("path", lambda at: F.concat(at["left"], at["right"]))), 256)
        out = each.select(F.col("child.held.doc_id").alias("doc_id"), F.col("child.digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.col("child.held.altered"), F.col("path")).alias("folded_root"))
        return kept(out.withColumn("verified", F.col("folded_root") == F.col("root")))
