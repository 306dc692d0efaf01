"""Merkle manifests against trees that are built node by node."""

import hashlib
import zlib

from tidewave.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, tree string, digest int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, lower=False):
    values = [None if v is None else str(v) for v in doc[:5]]
    if lower and values[4] is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[4])
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes, fan):
    """The root of ``nodes``, and for each of them the (left, right) siblings on its way."""
    at, paths, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // fan * fan : k // fan * fan + fan]
            paths[i].append((run[: k % fan], run[k % fan + 1 :]))
        level = [h(*level[k : k + fan]) for k in range(0, len(level), fan)]
        at = [k // fan for k in at]
    return level[0], paths


def plain(docs, fan):
    trees = {}
    for doc in docs:
        trees.setdefault(doc[1], []).append(doc)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in sources:
        own = sorted(trees[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d)))
        built[s] = (own, *climb([leaf_of(d) for d in own], fan))
    root, tops = climb([built[s][1] for s in sources], fan)
    out = []
    for s, top in zip(sources, tops, strict=True):
        own, subroot, paths = built[s]
        for doc, path in zip(own, paths, strict=True):
            hit = doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 5 == 0
            fold = leaf_of(doc, lower=hit)
            for left, right in path + top:
                fold = h(*left, fold, *right)
            proof = h(*(x for left, right in path + top for x in left + right))
            out.append((doc[0], leaf_of(doc), subroot, root, proof, fold, fold == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def made(sizes):
    docs, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            docs.append((i * 7 % 1009, source, None if i % 4 == 0 else "en", None if i % 5 == 0 else i, None if i % 6 == 0 else f"Text {'É' * (i % 3)} of {i}", "x", "y", i))
            i += 1
    return docs


def test_trees_of_many_sizes(spark):
    long = (5_000, "hot", "en", 1, "A Long Text " * 60_000, None, None, None)
    docs = [*made({"hot": 300, None: 17, "": 1, "a": 16, "B": 15, "é": 2, "=": 33, "z1": 4}), long, long, (None, "hot", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    for fan in (16, 3, 2):
        assert rows_of(manifest.manifest(spark.createDataFrame(docs, SCHEMA).repartition(5), fan)) == plain(docs, fan)


def test_many_sources_few_documents_none(spark):
    docs = made({f"s{i}": 1 + i % 2 for i in range(40)})
    assert rows_of(manifest.manifest(spark.createDataFrame(docs, SCHEMA))) == plain(docs, 16)
    alone = made({"only": 1})
    found = manifest.manifest(spark.createDataFrame(alone, SCHEMA)).collect()
    assert rows_of(manifest.manifest(spark.createDataFrame(alone, SCHEMA))) == plain(alone, 16)
    assert found[0]["leaf"] == found[0]["subroot"] == found[0]["root"] and found[0]["proof_sha256"] == h("")
    assert rows_of(manifest.manifest(spark.createDataFrame(made({"only": 18}), SCHEMA))) == plain(made({"only": 18}), 16)
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5_000).selectExpr("IF(id % 3 = 0, 'hot', concat('t', id % 50)) AS tree", "id * 37 % 5003 AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = manifest.ranked(rows.repartition(9), ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    trees = {}
    for r in sorted(found, key=lambda r: (r["tree"], r["v"])):
        own = trees.setdefault(r["tree"], [])
        assert r["rank"] == len(own)
        own.append(r["n"])
    assert sum(map(len, trees.values())) == 5_000 and all(set(ns) == {len(ns)} for ns in trees.values())
