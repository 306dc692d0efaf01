"""How the candidate pairs of the near-duplicate stage grow, and that none is lost."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidewave.llm import simhash
from tidewave.llm.shared import stored


def template(n, seed=8):
    """Texts that share 255 of 300 words, in one run or dealt over the text: pairs of a similarity of 0.74 or less."""
    rng = np.random.default_rng(seed)
    common, rows = [f"c{x}" for x in range(255)], []
    for i in range(n):
        own = [f"o{i}x{x}" for x in rng.integers(0, 100_000, 45)]
        rows.append((i, " ".join(common + own)))
    return rows


def met(spark, rows):
    """How many pairs of rows meet under a shingle, before any bound on pairs is looked at, and how many are left."""
    texts = stored(spark.createDataFrame(rows, "row long, text string"))
    known = stored(simhash.first_shingles(texts, 5, 0.8, simhash.shingle_frequencies(texts, 5)))
    shared = stored(simhash.sharing(known))
    none = spark.createDataFrame([], "row long, root long")
    mixed = shared.withColumn("of", F.lit(1_000))
    smaller, larger = (x.groupBy("s", "cell").count() for x in simhash.opposed(mixed, 0.8))
    pairs = smaller.join(larger.withColumnRenamed("count", "others"), ["s", "cell"]).agg(F.coalesce(F.sum(F.col("count") * F.col("others")), F.lit(0)).alias("n")).first()["n"]
    return pairs, simhash.sharing_pairs(shared, known.select("row", "sketch"), none, 0.8).count()


def test_pairs_of_one_template_grow_with_the_rows(spark):
    for n in (250, 500, 1000):
        pairs, left = met(spark, template(n))
        assert pairs <= 4 * n and left == 0, (n, pairs, left)


def test_similar_texts_of_many_sizes_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows, common = [], [f"c{x}" for x in range(400)]
    for i in range(260):
        size = int(rng.integers(1, 90))
        start = int(rng.integers(0, 40))
        words = common[start : start + size] + [f"o{x}" for x in rng.integers(0, 12, int(rng.integers(0, 9)))]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, t) for i, t in template(40)] + [(2000 + i, t + f" end{i}") for i, t in template(40)[:7]]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if len(w) > 5 else {tuple(w)} for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    for long in (64, 0):  # with 0 all shingles are split by sizes
        monkeypatch.setattr(simhash.opposed, "__defaults__", (long,))
        monkeypatch.setattr(simhash.sharing_pairs, "__defaults__", (long,))
        kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert kept == {i for i in sets if root(i) == i} and 60 < len(kept) < 300


def test_pairs_near_the_bound_equal_all_pairs(spark, monkeypatch):
    """Cut, extended and mixed copies of similarities around 0.8, with passages that many share, in any order of shingles: no pair is lost."""
    rng = np.random.default_rng(17)
    passages = [[f"p{k}x{i}" for i in range(30)] for k in range(4)]
    texts = []
    for i in range(150):
        base = [f"b{i}w{x}" for x in range(int(rng.integers(40, 110)))]
        if rng.random() < 0.6:
            at = int(rng.integers(0, len(base)))
            base[at:at] = passages[int(rng.integers(0, 4))]
        texts.append(base)
        for _ in range(2):
            own, n = list(base), len(base)
            kind = rng.integers(0, 3)
            if kind == 0:
                own = own[int(rng.integers(0, n // 4)) :]
            elif kind == 1:
                own = own + [f"e{rng.integers(0, 9)}" for _ in range(int(rng.integers(0, n // 3)))]
            else:
                at = int(rng.integers(0, n - 8))
                own[at : at + int(rng.integers(1, 8))] = passages[int(rng.integers(0, 4))][: int(rng.integers(1, 12))]
            texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    expected = {(a, b) for a, b in combinations(range(len(sets)), 2) if (both := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - both)}
    assert len(expected) > 100
    df = stored(spark.createDataFrame(rows, "row long, text string"))
    none = spark.createDataFrame([], "row long, root long")
    for frequencies in (None, simhash.shingle_frequencies(df, 5), np.random.default_rng(3).integers(0, 9, simhash.FREQUENCY_CELLS).astype(np.uint8)):
        known = stored(simhash.first_shingles(df, 5, 0.8, frequencies))
        shared = stored(simhash.sharing(known))
        for long in (64, 0):
            found = simhash.sharing_pairs(shared, known.select("row", "sketch"), none, 0.8, long)
            assert expected <= {(r["a"], r["b"]) for r in found.collect()}


def test_few_cells_lose_no_repeat(spark, monkeypatch):
    texts = stored(spark.createDataFrame([(i, t) for i, t in template(30)] + [(100 + i, t + " x") for i, t in template(30)], "row long, text string"))
    known = stored(simhash.first_shingles(texts, 5, 0.8, None))
    expected = {r["s"] for r in known.select(F.explode("first").alias("s")).groupBy("s").count().where("count > 1").collect()}
    for cells in (1 << 26, 1 << 10):
        monkeypatch.setattr(simhash, "REPEAT_CELLS", cells)
        lists = simhash.repeated(known).collect()
        assert expected <= {r["s"] for r in lists}
        firsts = {r["row"]: r["first"] for r in known.collect()}
        assert all(firsts[r["row"]][r["at"]] == r["s"] for r in lists)


def test_frequencies_count_texts(spark):
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "a b c d e a b c d e"), (4, None)], "row long, text string").fillna("")
    found = simhash.shingle_frequencies(texts, 5)
    common = simhash.shingle_hashes(b"a b c d e", 5)
    assert found[simhash.cells_of(common)].tolist() == [2] and found.max() == 2  # three texts: two bits
    assert simhash.shingle_frequencies(texts.limit(0).repartition(2), 5) is None or not simhash.shingle_frequencies(texts.limit(0), 5).any()


def test_parts_of_the_repeats_lose_and_repeat_none(spark, monkeypatch):
    texts = stored(spark.createDataFrame([(i, t) for i, t in template(30)] + [(100 + i, t + " x") for i, t in template(30)], "row long, text string"))
    known = stored(simhash.first_shingles(texts, 5, 0.8, None))
    found = {}
    for cells, parts in ((1 << 14, 1), (1 << 14, 8), (1 << 28, 1)):
        monkeypatch.setattr(simhash, "REPEAT_CELLS", cells)
        monkeypatch.setattr(simhash, "REPEAT_PARTS", parts)
        rows = [tuple(r) for r in simhash.repeated(known).collect()]
        assert len(rows) == len(set(rows))
        found[cells, parts] = set(rows)
    assert found[1 << 28, 1] <= found[1 << 14, 8] <= found[1 << 14, 1]


def test_two_texts_alone_are_a_pair_at_once(spark):
    """Pairs of copies that nothing else resembles need no row of a shingle moved again, and what they share counts for pairs met elsewhere."""
    texts = stored(spark.createDataFrame([(i, t + f" end{i}") for k in (0, 100) for i, t in ((k + i, t) for i, t in template(20))], "row long, text string"))
    known = stored(simhash.first_shingles(texts, 5, 0.8, simhash.shingle_frequencies(texts, 5)))
    lists, several = simhash.repeats(known)
    pairs = {(r["a"], r["b"]) for r in simhash.two_alone(several, 0.8).collect()}
    assert pairs == {(i, 100 + i) for i in range(20)}
    alone = {r["s"] for r in several.where("of = 2").collect()}
    assert alone and not alone & {r["s"] for r in simhash.shared_by(2, lists, several).collect()}


def test_words_packed_for_verification_have_the_same_shingles():
    for text in ("", "  \t ", "A b c\x0bD  e f G", "é" * 50 + " x y z " * 400):
        words = simhash.unpacked_words(simhash.packed_words(text.encode()))
        assert simhash.shingle_hashes(words, 5).tolist() == simhash.shingle_hashes(text.encode(), 5).tolist()
