"""Forced-boundary BPE against the tokenizers library."""

import hashlib
import os
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewave.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [
    "a", "q", "z", "j", "x", "'", "'s", "'re", "'ll", "'ve", "'d", "r", "e", "l", "v", " ", "  ", "\n", "\n\n", "\t", "\r\n", "!", "?", ".", "-", "<|endoftext|>", "<|", "1", "23",
    "é", "ß", "\xa0", " ", "　", "\x85", "᠎", "中", "文", "Ж", "я", "😀", "́", "\x00", "\x1c", "ﬁ", "٣", "the", " The", "—", "’s",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(encoder, text):
    parts = list(encoder.parts(text))
    return array("I", b"".join(ids for ids, _ in parts)).tolist(), b"".join(t for _, t in parts).decode()


def test_texts_of_awkward_bits_and_of_any_characters(library, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(byte_pairs, "AT_ONCE", 5)  # texts are put together from parts
    monkeypatch.setattr(byte_pairs, "CACHE_FRAGMENTS", 300)  # and the cache starts anew
    encoder = byte_pairs.Encoder(byte_pairs.codec_at(PATH))
    for i in range(12_000):
        if i % 3:
            text = "".join(rng.choices(BITS, k=rng.randint(0, 14)))
        else:
            text = "".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(32, 126), rng.randint(0x2000, 0x206F)])) for _ in range(rng.randint(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert whole(encoder, text) == (ids, library.decode(ids, skip_special_tokens=False)), repr(text)


def test_cuts_are_inside_no_token():
    codec = byte_pairs.codec_at(PATH)
    for token in codec.bytes_of[:-1]:  # the last is the mark of a special token
        assert not any(codec.cut[256 * x + y] for x, y in zip(token, token[1:], strict=False))
    data = "The cat's tail, 42 of 7: naïve".encode()
    borders = codec.borders(data.decode(), data).tolist()
    fragments = [data[i:j] for i, j in zip(borders, borders[1:], strict=False)]
    assert b"".join(fragments) == data and b" tail" in fragments and len(fragments) > 6


def test_any_ids_decode_as_the_library_does(library):
    rng, codec = random.Random(5), byte_pairs.codec_at(PATH)
    for _ in range(5_000):  # the first 256 are single bytes, mostly no UTF-8
        ids = [rng.randint(0, 50_256) if rng.random() < 0.5 else rng.randint(0, 255) for _ in range(rng.randint(0, 8))]
        assert codec.decoded(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, library):
    long = "It's a very long text, isn't it? " * 9_000 + "x" * 20_000
    rows = [(1, "Hello world", "a"), (2, None, "b"), (3, "", None), (None, "no id", None), (4, long, "c"), (4, long, "c"), (5, "end<|endoftext|>  of\n\ntext", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("ids", docs_ids()).withColumn("n_tokens", docs_ids())
    found = byte_pairs.encode_documents(docs, PATH)
    assert found.columns == ["row", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    out = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in found.collect())
    expected = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert decoded == (text or "")
        expected.append((str(doc), len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids))
    assert out == sorted(expected)
    texts = byte_pairs.decode_documents(found, PATH).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in texts) == sorted((str(d), t or "") for d, t, _ in rows)
    assert byte_pairs.encode_documents(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 15496, 99_999_999, -1])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in byte_pairs.decode_documents(odd, PATH).collect()} == {1: None, 2: "", 3: "Hello"}


def docs_ids():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_other_models_are_an_error():
    with pytest.raises(ValueError, match="isn't plain byte-level BPE"):
        byte_pairs.plain_model(public_tokenizers.path("word_bpe_49k.json"))


def test_fragments_start_no_threads_and_those_that_decode_to_others_are_told(library, monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    codec = byte_pairs.Codec(PATH)
    encoder = byte_pairs.Encoder(codec)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    assert whole(encoder, "plain words, plain") == (library.encode("plain words, plain").ids, "plain words, plain") and not encoder.changed
    words = library.token_to_id("\u0120words")
    monkeypatch.setattr(codec, "bytes_of", [*codec.bytes_of[:words], b" other", *codec.bytes_of[words + 1 :]])
    encoder = byte_pairs.Encoder(codec)
    for _ in range(2):  # from the cache, too
        assert whole(encoder, "plain words, plain")[1] == "plain other, plain"
