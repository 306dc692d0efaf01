"""Each stage of the pipeline, over all that the one before kept, against a plain version."""

from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from test_llm import WORDS, plain_kneser_ney, plain_pseudonyms

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(30):
        rows.append((i, " ".join(rng.choice(WORDS, 70)) + f"\nmail me@x{i}.org on 2020-02-{i % 28 + 1:02d}", "en" if i % 3 else "fr"))
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en") for i in range(6)]  # copies
    for i in range(6, 12):
        words = rows[i][1].split(" ")
        words[5] = "elsewhere"
        rows.append((200 + i, " ".join(words), "en"))  # near copies
    rows += [(300 + i, "".join(rng.choice(list("#$%&*!QXZ 0123"), 300)), "en") for i in range(4)]  # junk
    rows += [(400, None, None), (401, "", "en"), (None, "no id", "en")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, "web", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(20)] + [(300, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {r["doc_id"] for r in spark.createDataFrame([(i,) for i, *_ in labels], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) % 2 as at").where("at = 0 and doc_id < 20").collect()}


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_stages(spark, tables):
    path, fitted = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    want = rows_of(docs)

    kept = stages["quality"](spark, docs, path)
    assert kept.columns == docs.columns
    perplexity = plain_kneser_ney([r[1] for r in want if r[0] in fitted], 4)
    unseen = {lang: sorted(perplexity(r[1]) for r in want if r[0] is not None and r[0] < 20 and r[0] not in fitted and lang in (None, r[2])) for lang in ("en", "fr", None)}
    bound = {lang: 1.1 * own[int(np.ceil(0.995 * len(own))) - 1] for lang, own in unseen.items()}
    want = [r for r in want if perplexity(r[1] or "") <= bound[r[2]] * (1 + 1e-5)]
    assert rows_of(kept) == want and not any((r[0] or 0) // 100 == 3 for r in want) and len(want) > 35
    kept.write.parquet(f"{path}/1")

    kept = stages["exact_dedup"](spark, spark.read.parquet(f"{path}/1"), path)
    groups = {}
    for r in want:
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in r[1] or ""), []).append(r)
    want = sorted((max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in groups.values()), key=str)
    assert rows_of(kept) == want
    kept.write.parquet(f"{path}/2")

    kept = stages["near_dedup"](spark, spark.read.parquet(f"{path}/2"), path)
    split = [(r[1] or "").lower().split() for r in want]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in split]
    roots = list(range(len(want)))
    for a, b in combinations(range(len(want)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = roots[a], roots[b]
            roots = [new if x == old else x for x in roots]
    firsts = {}
    for root, r in zip(roots, want, strict=True):
        firsts[root] = min(firsts.get(root, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(firsts.values(), key=str)
    assert rows_of(kept) == want
    kept.write.parquet(f"{path}/3")

    kept = stages["pii"](spark, spark.read.parquet(f"{path}/3"), path)
    assert kept.columns == docs.columns
    hidden = [(r[0], None if r[1] is None else plain_pseudonyms(r[1], corpus_pipeline.PII_KEY)) for r in want]
    want = [(i, t, r[2], r[3], None if t is None else len(t)) for (i, t), r in zip(hidden, want, strict=True)]
    found = [r if r[1] is not None else (*r[:4], None) for r in rows_of(kept)]
    assert sorted(found, key=str) == sorted(want, key=str) and not any("@x" in (r[1] or "") for r in want)
    kept.write.parquet(f"{path}/4")

    pieces = stages["packing"](spark, spark.read.parquet(f"{path}/4"), path).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in want if r[0] is not None}
    own = pieces.dropna(subset=["doc_id"]).sort_values("piece").groupby("doc_id")["ids"].apply(lambda x: [int(i) for part in x for i in part])
    assert {int(k): v for k, v in own.items()} == ids
    assert pieces.sequence_id.nunique() == -(-int(pieces.length.sum()) // 4096)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 4096


def test_run_is_its_stages(spark, tables):
    path, _ = tables
    out = corpus_pipeline.run(spark, path)
    # junk, copies and near copies are gone; nothing else is
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} >= {*range(6, 30)}
    assert not {r["doc_id"] for r in out.select("doc_id").distinct().collect()} & {*range(206, 212), *range(300, 304)}


def test_stages_run_without_a_write_between(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    written = docs
    for name, each in corpus_pipeline.STAGES[:3]:
        docs = each(spark, docs, path)
    for i, (_, each) in enumerate(corpus_pipeline.STAGES[:3]):
        each(spark, written, path).write.mode("overwrite").parquet(f"{path}/w{i}")
        written = spark.read.parquet(f"{path}/w{i}")
    assert rows_of(docs) == rows_of(written) and docs.count() > 20


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
