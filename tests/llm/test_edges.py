"""Very long texts, very many terms, and columns whose names the operators use themselves."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tidewave.llm import line_dedup, quality, sentence_pieces, simhash, topk_search, whitening

OWN_NAMES = ["row", "fp", "n", "doc", "u", "v", "root", "key", "ids", "n_ids", "decoded_same", "text_sha256", "tree", "digest", "held", "s", "x", "at", "first", "sketch", "place"]


def with_own_names(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in OWN_NAMES})


def test_clashing_columns(spark):
    rows = [(i, f"text number {i % 3} of some words that are the same in all of them") for i in range(9)] + [(9, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clash = with_own_names(plain)
    path = public_tokenizers.path("piece_bpe_32k.model")
    for apply in (lambda d: simhash.near_duplicates(d, 3).drop("row"), lambda d: sentence_pieces.encode_documents(d, path, with_ids=False).drop("row")):
        assert sorted(map(tuple, apply(clash).collect())) == sorted(map(tuple, apply(plain).collect()))
    kept = simhash.drop_similar(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in simhash.drop_similar(plain).collect())
    vectors = spark.createDataFrame([(i, [float(i % 4), float(i)]) for i in range(8)], "vec_id long, embedding array<double>")
    assert whitening.whiten(with_own_names(vectors)).count() == 16 and topk_search.search(with_own_names(vectors)).count() == 7


def test_very_long_texts(spark):
    line, shared = "x" * 3_000_000, "a line that six texts have, of more than forty characters"
    docs = spark.createDataFrame([(i, f"{line}{i}\n{shared}\n" * (1 + i % 2)) for i in range(6)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in line_dedup.drop_repeated_lines(docs).collect()}
    for i in range(6):
        text = f"{line}{i}\n" * (1 + i % 2)
        own = f"{line}{i}\n{shared}\n" * (1 + i % 2) if i == 5 else text
        assert found[i] == (3 + 2 * (i % 2), 0 if i == 5 else 1 + i % 2, hashlib.sha256(own.encode()).hexdigest()), i
    words = "the cat sat on a mat and then it ran off to see what was in the house".split()
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(60)] + [(100, " ".join(rng.choice(words, 600_000)), "en"), (101, "#$%&*!QXZ" * 300_000, "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.drop_low_quality(spark.createDataFrame(texts, "doc_id long, text string, lang string"), labels).collect()}
    assert 100 in kept and 101 not in kept


def test_very_many_terms_and_no_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 20_000))
    df = spark.createDataFrame([(i * 50, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(1024 * x).astype(np.int64)
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in topk_search.search(df).collect()}
    assert found == {(q * 50, v * 50): int(whole[q] @ whole[v]) for q in (0, 2, 4) for v in range(6) if v != q}
    assert topk_search.search(df.where("vec_id < 0")).count() == 0


def test_all_trusted_documents_teach_and_none_is_judged_by_its_own_model(spark):
    import numpy as np

    from tidewave.llm import quality

    rng = np.random.default_rng(8)
    words = ["alpha", "beta", "gamma", "delta", "other", "words"]
    rows = [(i, " ".join(rng.choice(words, 30)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["perplexity"] for r in quality.classify(docs, labels).collect()}
    half = {r[0]: r[1] for r in spark.sql("SELECT id, pmod(xxhash64(id), 2) FROM range(30)").collect()}
    for model, of in ((range(30), range(30, 40)), ([i for i in half if half[i]], [i for i in half if not half[i]])):
        plain = quality.train(docs.where(docs.doc_id.isin(list(model))))
        for i in of:
            assert abs(np.log(found[i]) + plain[quality.grams(rows[i][1], quality.ORDER)].mean(dtype=float)) < 1e-6
