import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewave.llm import exact_dedup, line_dedup, lm_scoring, packing, pii, quality, sentence_pieces, simhash, topk_search, url_filter

DOCS = "doc_id long, text string, lang string, key string, row string"
WORDS = "the cat sat on a mat and then it ran off to see what was in the red house by the sea".split()
LONG = " ".join(WORDS[i % 20] + str(i % 7) for i in range(9000))
ROWS = [
    (1, "Hello World", "en", "x", "y"), (2, "hello world", "en", None, None), (2, "hello world", "en", None, None), (3, None, None, None, None),
    (4, "", "fr", None, None), (None, "null id text", "en", None, None), (5, LONG, "en", None, None), (6, LONG + " end", "en", None, None),
    (7, "Ça va\nmail me@site.org 4539 1488 0343 6467 or 10.1.2.3 on 2020-02-29\n", "fr", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_duplicates(docs, none):
    for bits, keys in ((64, 50_000), (3, 1)):  # with 3 bits of key, different texts collide and buckets split
        found = exact_dedup.exact_duplicates(docs, key_bits=bits, bucket_keys=keys).collect()
        groups = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found}
        assert groups[1] == (2, 3) and groups[3] == (4, 2) and groups[5] == (5, 1) and groups[None] == (None, 1)
        assert len(found) == len(ROWS) and sum(r["kept"] for r in found) == 6
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == 6


def test_directory_doubles():
    depth, entries = exact_dedup.split_directory({0: 5, 1: 5, 8: 1}, 5, 4)
    assert depth == 4 and len(entries) == 16 and entries[0] != entries[1] and entries[8] == entries[15]


def test_simhash_against_all_pairs(spark, docs, none):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40)
    fps = {int(x) for x in base}
    for x in base[:20]:
        for _ in range(5):
            fps.add(int(x) ^ sum(1 << int(b) for b in rng.permutation(63)[: rng.integers(1, 4)]))
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(fps, 2):
        if bin(a ^ b).count("1") <= 3:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    from tidewave.llm.components import roots

    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    for most in (1 << 16, 2):  # a small bound deals buckets anew
        found = {r["u"]: r["v"] for r in roots(simhash.near_links(table, 3, most)).collect()}
        assert {x: found.get(x, x) for x in fps} == {x: root(x) for x in fps}
    ids = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 3).collect()}
    assert ids[2] == 1 and ids[4] == 3
    assert simhash.near_duplicates(none, 3).count() == 0 and simhash.drop_similar(none).count() == 0


def test_similar_texts_leave_one(spark):
    rng = np.random.default_rng(2)
    rows, doc_id = [], 0
    for _ in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for copy in range(4):
            own = list(words)
            if copy:
                own[int(rng.integers(0, 300))] = "changed"
            rows.append((doc_id, " ".join(own)))
            doc_id += 1
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 80, 4))


def test_similar_texts_equal_all_pairs_in_long_buckets(spark):
    # one template: 400 texts share half of their words, pairs of them nearly all; the first resembles none of the others
    rng = np.random.default_rng(5)
    common, rows = [f"c{x}" for x in range(150)], []
    for i in range(200):
        own = [f"o{i}x{x}" for x in rng.integers(0, 5000, 55 if i else 150)]
        near = list(own)
        near[3] = "changed"
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common[i % 90 :] + near))]
    rows += [(1000 + i, " ".join(common[:140] + [f"e{i}x{x}" for x in range(12)])) for i in range(100)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i in sets if root(i) == i} and 200 < len(kept) < 400


def test_packing(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(docs, path, capacity=512).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for doc_id, text, *_ in ROWS:
        if doc_id in (2, None):
            continue
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = found[found.doc_id == doc_id].sort_values("piece")
        assert own.length.tolist() == [min(512, len(ids) - i) for i in range(0, len(ids), 512)]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[i : i + 512], "<u4").tobytes()) for i in range(0, len(ids), 512)]
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 512
    assert packing.pack(none, path).count() == 0


def test_minimum_bin_slack_fills_bins():
    slots, bins = packing.pack_histogram({7: 3, 3: 3, 5: 2}, 10)
    assert bins == 4 and sum(x[0] == 5 for x in slots) >= 1


def test_pii(spark, docs, none):
    found = {r["doc_id"]: r for r in pii.private_documents(docs, "key").collect()}
    row = found[7]
    assert row["private_kinds"] == ["email", "card", "ip", "date"] and "me@site.org" not in row["text"] and "4539" not in row["text"]
    assert found[5]["text"] == LONG and found[3]["text"] == ""
    assert pii.private_documents(none, "key").count() == 0
    cards = spark.range(500).select(F.format_string("%05d", "id").alias("d"))
    assert cards.select(pii.permute_digits(F.col("d"), "k", "x").alias("p")).distinct().count() == 500


def plain_pseudonyms(text, key):
    """The same by Python's own means."""
    import datetime
    import hashlib
    import re

    sha = lambda *parts: hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()

    def feistel(a, ma, b, mb, tweak):
        for r in range(10):
            a, ma, b, mb = b, mb, (a + int(sha(key, tweak, r, b)[:15], 16) % ma) % ma, ma
        return a, b

    def digits_of(d, kind):
        left = len(d) // 2
        a, b = feistel(int(d[:left]), 10**left, int(d[left:]), 10 ** (len(d) - left), f"{kind}{len(d)}")
        return f"{a:0{left}d}{b:0{len(d) - left}d}"

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))

    def refill(m, digits):
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in m)

    def swap(found):
        m = found.group(0)
        d = re.sub(r"\D", "", m)
        if "@" in m:
            return f"user.{sha(key, 'email', m.lower())[:32]}@mail.invalid"
        if re.fullmatch(r"\d+(\.\d+){3}", m):
            o = [int(x) for x in m.split(".")]
            if max(o) > 255:
                return m
            a, b = feistel(o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536, "ip")
            return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", m):
            try:
                day = datetime.date.fromisoformat(m)
            except ValueError:
                return m
            nth = (day - datetime.date(1800, 1, 1)).days
            if not 1800 <= day.year <= 2199:
                return m
            a, b = feistel(nth // 773, 189, nth % 773, 773, "date")
            return (datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)).isoformat()
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
            area, group, serial = map(int, m.split("-"))
            if not 1 <= area <= 899 or area == 666 or not group or not serial:
                return m
            a, b = feistel(area - 1 - (area > 666), 898, (group - 1) * 9999 + serial - 1, 99 * 9999, "ssn")
            return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
        if "=" in m or ":" in m:
            token = re.search(r"[\w/+.-]{16,}", m).group(0)
            return m.replace(token, (sha(key, "secret", token) * (len(token) // 64 + 1))[: len(token)])
        if re.search(r"[ .)-]\d{3}[ .-]\d{4}$", m) and 10 <= len(d) <= 13:
            return refill(m, d[:-10] + digits_of(d[-10:], "phone"))
        if luhn(d) % 10 == 0:
            body = digits_of(d[:-1], "card")
            return refill(m, body + str((10 - luhn(body + "0") % 10) % 10))
        return m

    return re.sub(pii.CANDIDATE.replace(r"\p{L}\p{N}", r"\w"), swap, text, flags=re.ASCII)


def test_pii_equals_the_plain_form(spark):
    rng = np.random.default_rng(16)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        body = number(15)
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    makers = [
        lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"+1 {number(3)}.{number(3)}.{number(4)}", card, lambda: number(16),
        lambda: f"{rng.integers(0, 300)}.{rng.integers(0, 256)}.1.2", lambda: f"{rng.integers(1700, 2300)}-{rng.integers(0, 14):02d}-{rng.integers(0, 33):02d}", lambda: f"who.{number(2)}@site{number(1)}.org",
        lambda: f"token = {'aB3' * int(rng.integers(4, 30))}", lambda: "plain words", lambda: "000-12-3456", lambda: "665-01-0001", lambda: "667-99-9999",
    ]
    rows = [(i, " ".join(makers[int(j)]() + "," for j in rng.integers(0, len(makers), 6))) for i in range(150)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (501, None), (502, "")]
    found = pii.private_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)), "a key").collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted((i, plain_pseudonyms(t or "", "a key")) for i, t in rows)
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"), F.col("id").alias("doc_id"))
    assert pii.private_documents(days, "k").select("text").distinct().where("text rlike '^(18|19|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}$'").count() == 3000


def test_the_posterior_is_that_of_a_beta(spark):
    rng = np.random.default_rng(17)
    cases = [(0.3, 2.0, 0.5), (5.0, 3.0, 0.5), (40.0, 20.0, 0.6), (3000.0, 2900.0, 0.5), (0.05, 0.05, 0.5), (1.0, 1.0, 0.2)]
    for a, b, share in cases:
        got = spark.range(1).select(url_filter.above(F.lit(a), F.lit(b), share)).first()[0]
        assert abs(got - (rng.beta(a, b, 400_000) > share).mean()) < 0.006


def test_url_rules_and_reputation(spark):
    urls = [(1, "http://A.com/x"), (2, "https://b.net/fr/1?q"), (3, None), (4, "nothing"), (5, "http://www.example.com/en/1"), (6, "http://bad.org/1")]
    pages = spark.createDataFrame([*urls, urls[5], (None, "http://bad.org/" + "long/" * 50_000)], "page_id long, url string").withColumns({"host": F.lit("x"), "rule": F.lit(1), "n_pages": F.lit(2)})
    outcomes = spark.createDataFrame([(6, 1)] * 60 + [(1, 0)] * 60 + [(None, 1), (1, None)], "page_id long, bad int")
    rules = [("allow", "com", "/"), ("block", "net", "/fr/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]
    found = {r["page_id"]: r for r in url_filter.judge(pages, outcomes, rules).collect()}
    assert found[1]["rule"] == "com/" and found[2]["verdict"] == "block" and found[5]["rule"] == "www.example.com/en/"
    assert found[3]["host"] == "" and found[4]["path"] == "" and found[6]["verdict"] == "block"
    assert url_filter.judge(pages, outcomes, rules).where("host = 'bad.org' and verdict = 'block'").count() == 3
    assert url_filter.judge(pages.limit(0), outcomes.limit(0), rules).count() == 0


def test_ppm_probabilities_sum_to_one():
    data = np.frombuffer(b"\n\n\n\n\nthe theater of the threads\n\n\n\n\nand then they\n", np.uint8)
    g, n = np.unique(lm_scoring.grams(data, 5), return_counts=True)
    levels = lm_scoring.levels_of(g, n.astype(np.int64), range(6), [])
    for context in (b"e the", b"uvxyz", b"  qhe", b"\n\n\n\n\n"):
        g = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], np.uint64)
        assert abs((10 ** lm_scoring.log10_of(levels, g)).sum() - 1) < 1e-9


def plain_ppm(train, texts, order):
    """log10 scores by PPM with method C and exclusion, symbol by symbol."""
    counts = {}
    for t in train:
        padded = b"\n" * order + t + b"\n"
        for i in range(order, len(padded)):
            for k in range(order + 1):
                own = counts.setdefault(padded[i - k : i], {})
                own[padded[i]] = own.get(padded[i], 0) + 1
    out = []
    for t in texts:
        padded, total = b"\n" * order + t + b"\n", 0.0
        for i in range(order, len(padded)):
            p, excluded = 1.0, set()
            for k in range(order, -1, -1):
                own = {s: n for s, n in counts.get(padded[i - k : i], {}).items() if s not in excluded}
                if not own:
                    continue
                size = sum(own.values()) + len(own)
                if padded[i] in own:
                    p *= own[padded[i]] / size
                    break
                p *= len(own) / size
                excluded |= own.keys()
            else:
                p /= 256 - len(excluded)
            total += np.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("order", [3, 5])
def test_ppm_equals_the_plain_form(spark, monkeypatch, order):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice([*WORDS, "Größe", "naïve", f"x{i}"], int(rng.integers(0, 40)))) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm_scoring, "FLUSH", 5)
    found = {r["doc_id"]: r for r in lm_scoring.score(docs, lm_scoring.fold(), order, frequent_words=4).collect()}
    normal = [t.encode().lower() for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(80)]
    want = plain_ppm([t for t, h in zip(normal, held, strict=True) if not h], normal, order)
    assert all(abs(found[i]["score"] - w) < 1e-3 and found[i]["held_out"] == held[i] for i, w in enumerate(want))
    from collections import Counter

    c = Counter(w for t, h in zip(normal, held, strict=True) if not h for w in [*t.split(), "end"])
    size = sum(c.values()) + len(c) + 1
    for i, t in enumerate(normal):
        words = [*t.split(), "end"]
        assert abs(found[i]["base_score"] - sum(np.log10((c[w] + 1) / size) for w in words)) < 1e-9
        assert (found[i]["n_tokens"], found[i]["n_known"], found[i]["train_tokens"]) == (len(words), sum(w in c for w in words), sum(c.values()))


def test_ppm_grams_survive_their_packing():
    rng = np.random.default_rng(12)
    for order in (3, 5, 6):
        g = rng.integers(0, 1 << 8 * (order + 1), 1000, np.uint64, endpoint=False)
        assert (lm_scoring.by_place(lm_scoring.by_context(g, order), order) == g).all()
        r, starts = np.sort(g), np.array([0, 10, 11, 500])
        rows = lm_scoring.packed(r, starts, order + 1)
        back, lengths = lm_scoring.unpacked([rows[i:j].tobytes() for i, j in zip(starts, [10, 11, 500, 1000], strict=True)], order + 1)
        assert (back == r).all() and lengths.tolist() == [10, 1, 489, 500]


def test_ppm_scores(docs, none):
    found = lm_scoring.score(docs, lm_scoring.fold()).collect()
    assert len(found) == len(ROWS) and all(r["score"] < 0 for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (3, 4)} == {1}
    assert lm_scoring.score(none, lm_scoring.fold()).count() == 0


def test_sentence_pieces_equal_the_reference_library(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = sentence_pieces.encode_documents(docs, path).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert all(r["ids"] == model.encode(texts[r["doc_id"]]) and r["decoded_same"] for r in found)
    assert sentence_pieces.encode_documents(none, path).count() == 0
    assert {r["doc_id"]: r["text"] for r in sentence_pieces.decode_documents(sentence_pieces.encode_documents(docs, path), path).collect()} == texts


def test_quality_rejects_what_trusted_text_is_not(spark, none):
    rng = np.random.default_rng(3)
    good = [(i, " ".join(rng.choice(WORDS, 80)), "en") for i in range(60)]
    bad = [(100 + i, "".join(rng.choice(list("#$%&*!QXZ 0123"), 400)), "en") for i in range(10)]
    docs = spark.createDataFrame([*good, *bad, (200, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (41, None, None)], "doc_id long, quality int, toxic int")
    keep = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    assert not any(keep[i] for i in range(100, 110)) and sum(keep[i] for i in range(60)) >= 57
    model = np.exp(quality.train(docs.where("doc_id < 60")).astype(float)).reshape(-1, quality.CLASSES)
    assert np.allclose(model.sum(axis=1), 1, atol=1e-4)
    assert quality.classify(none, labels).count() == 0 and quality.classify(docs, labels.limit(0)).where("keep").count() == 71


def plain_kneser_ney(texts, order):
    """log probability of a class after others by interpolated modified Kneser-Ney, and the classes of a text."""
    from collections import Counter, defaultdict

    classes = lambda t: (0,) * (order - 1) + tuple(quality.class_of(c) for c in t + "\n")
    counts = {order: Counter(c[i : i + order] for c in map(classes, texts) for i in range(len(c) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    levels = {}
    for k, own in counts.items():
        n1, n2, n3, n4 = (sum(n == i for n in own.values()) for i in (1, 2, 3, 4))
        d = [0.5, 0.75, 0.9]
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            d = [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        total, saved = defaultdict(int), defaultdict(float)
        for g, n in own.items():
            total[g[:-1]] += n
            saved[g[:-1]] += d[min(n, 3) - 1]
        levels[k] = own, d, total, saved

    def p(g):
        if not g:
            return 1 / quality.CLASSES
        own, d, total, saved = levels[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        n = own.get(g, 0)
        return (n - d[min(n, 3) - 1] if n else 0) / total[g[:-1]] + saved[g[:-1]] / total[g[:-1]] * p(g[1:])

    return lambda t: np.exp(-np.mean([np.log(p(classes(t)[i : i + order])) for i in range(len(t) + 1)]))


def test_perplexities_equal_the_plain_form(spark):
    rng = np.random.default_rng(18)
    texts = [" ".join(rng.choice([*WORDS, "Größe,", "(x)", "12.5%"], int(rng.integers(0, 30)))) for _ in range(40)] + ["", "\t?", "漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    plain = plain_kneser_ney(texts[:25], 4)
    rows = docs.withColumn("row", F.col("doc_id"))
    found = quality.perplexities(rows, quality.train(docs.where("doc_id < 25"))).collect()
    assert all(abs(r["perplexity"] / plain(texts[r["doc_id"]]) - 1) < 1e-4 for r in found)


def test_quality_thresholds_are_of_all_trusted_documents(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(WORDS, 80)), "en" if i < 40 else "fr") for i in range(60)] + [(60, "#$%", "en"), (61, "#$%", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(61)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.classify(docs, labels, quantile=0.9, max_trusted=1).collect()}
    for lang, of in (("en", [*range(40), 60]), ("fr", range(40, 60))):
        own = sorted(found[i]["perplexity"] for i in of)
        whole = quality.SLACK * own[int(np.ceil(0.9 * len(own))) - 1]
        # only texts of 256 characters or more have enough trusted ones of their length
        assert all(abs(r["threshold"] - whole) < 1e-6 or r["n_chars"] > 200 and r["threshold"] > whole for r in found.values() if r["lang"] == lang)
    assert not found[61]["keep"] and sum(found[i]["keep"] for i in range(60)) >= 50


def best_by_all_pairs(rows, every, k):
    v = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in x]) for i, x in rows]
    want = []
    for n, (i, q) in enumerate(v):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j) for m, (j, x) in enumerate(v) if m != n)[:k]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(want)


def found_by(spark, rows, k=10):
    found = topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("own")), k=k).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)


def test_search_against_all(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i % 290, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    odd = [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (None, [0.0] * 8)]
    assert found_by(spark, rows + odd) == best_by_all_pairs(rows, 100, 10)
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 16)
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 64)  # several blocks of queries
    assert found_by(spark, rows) == best_by_all_pairs(rows, 100, 10)
    ties = [(i, [1.0, 2.0]) for i in range(130)] + [(200, [0.0]), (300, [])]
    assert found_by(spark, ties, 3) == best_by_all_pairs(ties, 100, 3)
    assert found_by(spark, [(5, [1.0])]) == []


def test_search_skips_and_stays_exact():
    rng = np.random.default_rng(14)
    vectors = np.floor(rng.normal(size=(3000, 16)) * 2.0 ** -np.arange(16) * 1024)  # few terms matter
    queries, best, skipped = vectors[:20], topk_search.Best(20, 10), 0
    for at in range(0, 3000, 500):
        skipped += topk_search.traverse(queries, np.arange(20), vectors[at : at + 500], np.arange(at, at + 500), np.arange(at, at + 500), best)
    assert skipped > 100_000
    for q in range(20):
        want = sorted((-int(queries[q] @ vectors[i]), i) for i in range(3000) if i != q)[:10]
        assert list(zip(*best.found[q][:2], strict=True)) == [(-s, i) for s, i in want]


def test_search_of_large_weights_is_exact_or_fails(spark):
    rows = [(0, [2e6, 1e6]), (1, [2e6, 1.0]), (2, [-2e6, 1e6]), (3, [1e5, 3.0])]
    assert found_by(spark, rows) == best_by_all_pairs(rows, 100, 10)
    with pytest.raises(Exception, match="64 bits"):
        found_by(spark, [(0, [1e30]), (1, [1e30])])


def test_line_dedup(spark, none):
    shared = "  This line is shared by many documents, WHATEVER they say  "
    rows = [(i, f"own line {i}\n{shared if i % 2 else shared.upper()}\n", "x", 1) for i in range(8)] + [(20, None, None, 2), (None, shared, None, 3), (21, shared[:30], None, None), (3, f"{shared}\nagain", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, row long")
    for sent_keys in (1_000_000, 0):  # by a broadcast, and by a join
        found = line_dedup.drop_repeated_lines(docs, sent_keys=sent_keys).collect()
        assert len(found) == len(rows)
        own = {(r["doc_id"], r["text"].split("\n")[0]): r for r in found}
        assert own[7, "own line 7"]["n_dropped"] == 0 and all(own[i, f"own line {i}"]["n_dropped"] == 1 and own[i, f"own line {i}"]["text"] == f"own line {i}\n" for i in range(7))
        assert own[None, ""]["n_dropped"] == 1 and own[20, ""]["n_lines"] == 1 and own[21, shared[:30]]["n_dropped"] == 0 and own[3, "again"]["n_dropped"] == 1
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_no_repeated_line_is_lost_in_small_or_full_filters(spark, monkeypatch):
    rng = np.random.default_rng(15)
    lines = [f"{i} " + "x" * 50 for i in range(300)]
    rows = [(i, "\n".join(rng.choice(lines, 8))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    holders = {x: {i for i, t in rows if x in t.split("\n")} for x in lines}
    want = {i: "\n".join(x for x in t.split("\n") if len(holders[x]) < 5 or max(holders[x]) == i) for i, t in rows}
    monkeypatch.setattr(line_dedup, "CHUNK_BITS", 1 << 12)
    monkeypatch.setattr(line_dedup, "FLUSH", 50)
    for bits in (1 << 8, 1 << 16):
        assert {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs, bits=bits).collect()} == want
    two = line_dedup.seen_twice(docs.where("doc_id < 100").union(docs.where("doc_id >= 100")), 40, 1 << 16)
    assert 0 < np.unpackbits(two).mean() < 0.02


def test_words_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    cache, whole = packing.word_cache(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(7)
    assert np.frombuffer(cache.encode("Əli"), "<u4").tolist() == whole.encode("Əli", add_special_tokens=False).ids
    for top in (0x80, 0x180, 0x250, 0x600, 0x10000):
        for _ in range(1500):
            text = "".join(chr(c) for c in rng.integers(9, top, 12) if not 0xD800 <= c < 0xE000)
            text = text.replace(text[3:4], " ").replace(text[5:6], "'s ")
            assert np.frombuffer(cache.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("capacity", [64, 512])
def test_packing_is_near_its_lower_bound(capacity):
    rng = np.random.default_rng(8)
    for lengths in (rng.integers(1, capacity + 1, 3000), rng.geometric(8 / capacity, 3000).clip(1, capacity), np.full(100, capacity // 3 + 1)):
        histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        bins = packing.pack_histogram(histogram, capacity)[1]
        # pieces of more than half a bin need one each
        least = max(-(-int(lengths.sum()) // capacity), int((lengths > capacity // 2).sum()), 50 if len(lengths) == 100 else 0)
        assert least <= bins <= 1.02 * least + 1


def planted_near_copies():
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((2 * i, " ".join(words)))
        for _ in range(3):
            words[int(rng.integers(0, 200))] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    return rows + [(200 + i, f"copied text number {i % 10}") for i in range(40)]


def test_rows_are_told_apart_whatever_the_split_plan(spark, tmp_path):
    rows = planted_near_copies()
    plain = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(6)
    plain.write.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    steps = {
        "exact": exact_dedup.drop_exact_duplicates, "similar": simhash.drop_similar, "quality": lambda d: quality.drop_low_quality(d, labels),
        "groups": lambda d: exact_dedup.exact_duplicates(d).select("doc_id", "keep_id", "kept"), "fingerprints": lambda d: simhash.near_duplicates(d, 3).drop("row"),
    }
    read = lambda: spark.read.parquet(str(tmp_path / "docs"))
    want = {k: sorted(f(read()).drop("text").collect()) for k, f in steps.items()}
    assert len(want["exact"]) == 130 and len(want["similar"]) == 70
    other = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}  # all files in one split
    assert sorted(steps["similar"](read().repartition(4)).drop("text").collect()) == want["similar"]
    for name, f in steps.items():
        planned = f(read())  # the split plan changes between planning and the action
        try:
            for k, v in other.items():
                spark.conf.set(k, v)
            assert sorted(planned.drop("text").collect()) == want[name], name
        finally:
            for k in other:
                spark.conf.unset(k)


def test_fingerprints_equal_plain_ones(spark):
    rows = [*planted_near_copies()[:40], (900, "One two"), (901, ""), (902, None), (903, "A b\tC\x0bd e A b\tC")]
    import xxhash

    def plain(text):
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\x0b", " ").split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"

    found = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert found == {i: plain(t) for i, t in rows}


def test_hot_keys_and_own_columns(spark):
    from tidewave.llm import shared

    rows = spark.range(1000).select((F.col("id") % 5 * (F.col("id") > 600).cast("int")).alias("k"), "id")
    entries = shared.stored(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    for how in ("inner", "left"):
        a = sorted(shared.looked_up(rows, entries.where("k < 4"), ["k"], "n", how, hot=100).select("k", "id", "n", "top").collect(), key=str)
        assert a == sorted(rows.join(entries.where("k < 4"), "k", how).select("k", "id", "n", "top").collect(), key=str)
    docs = spark.createDataFrame([(1, "a b c", 5, 6, 7), (2, "a b c", 5, None, 7)], "doc_id long, text string, row int, doc int, `the.key` int")
    assert exact_dedup.drop_exact_duplicates(docs).collect() == docs.where("doc_id = 2").collect()
    assert simhash.drop_similar(docs).collect() == docs.where("doc_id = 1").collect()


def test_no_shared_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    from tidewave.llm import shared

    class Without:
        sparkContext = spark.sparkContext
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    assert "tidewave-" in shared.shared_folder(Without)
    monkeypatch.setattr(shared, "is_local", lambda s: False)
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(Without)


@pytest.mark.parametrize(("fallback", "spaces"), [(True, False), (True, True), (False, False)])
def test_unigram_models_equal_the_reference_library(tmp_path, fallback, spaces):
    """The model is written by hand: pieces and scores, nothing is trained."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = sentence_pieces.UNIGRAM, fallback
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = True, spaces, True
    specials = [("<unk>", sentence_pieces.UNKNOWN), ("<s>", sentence_pieces.CONTROL), ("</s>", sentence_pieces.CONTROL)]
    specials += [(f"<0x{i:02X}>", sentence_pieces.BYTE) for i in range(256)] if fallback else []
    for piece, kind in specials:
        model.pieces.add(piece=piece, score=0.0, type=kind)
    rng = np.random.default_rng(19)
    pieces = {"▁", *"abcdefgh", *("▁" + c for c in "abcd")} | {"".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 5)))) for _ in range(60)}
    for piece in sorted(pieces):
        model.pieces.add(piece=piece, score=-float(rng.uniform(2, 9)), type=sentence_pieces.NORMAL)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    plain = sentencepiece.SentencePieceProcessor(model_file=str(path))
    encoder = sentence_pieces.Encoder(str(path), 1)
    texts = ["".join(rng.choice(list("abcdefgh  zé"), int(rng.integers(0, 25)))) for _ in range(400)] + ["", " ", "  a  b ", "zzz", "éa"]
    found = [np.frombuffer(ids, "<u4").tolist() for ids, _ in encoder.both(texts)]
    different = [(t, f, plain.encode(t)) for t, f in zip(texts, found, strict=True) if f != plain.encode(t)]
    assert not different, different[:3]


def test_the_most_frequent_are_found_however_many_are_common(spark, monkeypatch):
    from tidewave.llm import shared

    monkeypatch.setattr(shared, "FINE_CELLS", 4)
    rng = np.random.default_rng(6)
    ns = [9, 9, 5, 5, 5, 1, 200_000, 300_000, *(int(x) for x in rng.integers(100_000, 1 << 40, 60)), *[7] * 40]
    counted = spark.createDataFrame(list(enumerate(ns)), "id int, n long")
    for most in (1, 2, 3, 30, 62, 64, 70, 85, 104, 107, 108, 1000):
        found = sorted((r["n"] for r in shared.most_frequent(counted, "n", most).collect()), reverse=True)
        assert found == sorted(ns, reverse=True)[:most], most


def test_keys_reach_the_driver_as_digests(spark, monkeypatch):
    long = "a line that repeats " * 2_000
    docs = spark.createDataFrame([(i, f"own {i}\n{long}") for i in range(6)], "doc_id long, text string")
    sizes = []
    whole = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: (sizes.append((t := whole(self)).nbytes), t)[1])
    kept = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert kept == dict.fromkeys(range(5), 1) | {5: 0} and sizes and max(sizes) < 1_000


def test_queries_in_blocks_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = sorted(map(tuple, topk_search.search(df).collect()))
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 64)
    assert sorted(map(tuple, topk_search.search(df).collect())) == one and len(one) == 90
    assert topk_search.search(df.limit(0)).count() == 0


def test_quality_hears_letters_of_other_scripts(spark):
    rng = np.random.default_rng(23)
    scripts = {"el": "το παιδί έτρεξε στον κήπο και είδε ένα μεγάλο σπίτι κοντά στη θάλασσα", "ru": "мальчик бежал по саду и увидел большой дом у самого моря под горой", "zh": "孩子们在花园里跑步看见一座大房子靠近海边山下有河"}
    for lang, line in scripts.items():
        words = line.split()
        clean = [" ".join(rng.permutation(words)) if len(words) > 1 else line[int(k) :] + line[: int(k)] for k in rng.integers(0, len(line), 40)]
        mixed = ["".join(rng.permutation(list(t.replace(" ", "")))) for t in clean[:10]]
        mixed = ["".join(c + " " * (i % 6 == 5) for i, c in enumerate(t)) if " " in line else t for t in mixed]
        model = quality.train(spark.createDataFrame([(t,) for t in clean[10:]], "text string"))
        docs = spark.createDataFrame([(i, i, lang, t) for i, t in enumerate(clean[:10] + mixed)], "row long, doc_id long, lang string, text string")
        p = {r["row"]: r["perplexity"] for r in quality.perplexities(docs, model).collect()}
        assert max(p[i] for i in range(10)) < 0.6 * min(p[i] for i in range(10, 20)), lang
    assert quality.class_of("é") == quality.class_of("ß") and quality.class_of("Ж") == quality.class_of("Q") and quality.class_of("ж") != quality.class_of("з")
    points = "жЖé中a\U00020000"
    assert quality.grams(points, 1).tolist()[:5] == [quality.class_of(c) for c in points[:3]] + [quality.SINGLE.index("a") + ord("中") % 26, quality.class_of("a")]
