"""SentencePiece models by the tokenizers library.

The model's protobuf gives pieces, scores, kinds and the normaliser. They are rebuilt as a tokenizer: the normaliser
with the space marker, unigram scores or the merges that the scores of a BPE model imply, and byte fallback. No piece
of the usual models spans two words, so tasks encode the different words of a batch, in batches with several threads,
and decode them again; texts are their words' ids. Models with pieces across words encode whole texts.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import documents, map_batches

SPACE = "▁"

#: Kinds of pieces and models, fixed values of the SentencePiece format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2

#: Words that a task remembers; once a batch has gone beyond it, it starts anew. Texts or words that the library is given at once.
CACHE_WORDS = 300_000
TEXTS_AT_ONCE, WORDS_AT_ONCE = 64, 8_192

#: A word: its leading spaces and what follows up to the next.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def read_model(data: bytes):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(data)
    return model


def implied_merges(pieces: dict[str, int], scores: dict[str, float]) -> list[tuple[str, str]]:
    """The pairs that make each piece, better scores first; of one piece's pairs those of lower ids first."""
    found = []
    for piece, score in scores.items():
        for i in range(1, len(piece)):
            left, right = piece[:i], piece[i:]
            if left in pieces and right in pieces:
                found.append((-score, pieces[left], pieces[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(data: bytes):
    """A tokenizers.Tokenizer that encodes as the SentencePiece model does, without control symbols; the text before its marker; and, unless pieces span words, a tokenizer for single words.

    A text of which nothing is left before its marker has no ids.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = read_model(data)
    spec, trainer = model.normalizer_spec, model.trainer_spec
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
    if trainer.model_type == UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in model.pieces], unk_id=unknown, byte_fallback=trainer.byte_fallback)
    elif trainer.model_type == BPE:
        ids = {p.piece: i for i, p in enumerate(model.pieces)}
        scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER_DEFINED)}
        core = models.BPE(ids, implied_merges({k: ids[k] for k in scores}, scores), unk_token=model.pieces[unknown].piece, fuse_unk=True, byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)

    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    marker = [normalizers.Prepend(SPACE)] if spec.add_dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, *marker, normalizers.Replace(" ", SPACE)])
    plain = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*plain, *([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else [])])
    first = normalizers.Sequence(steps).normalize_str if steps else str
    if any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces):
        return tokenizer, first, None
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD.pattern), "isolated")
    words = Tokenizer(core)  # for what is normal and split already
    words.decoder = decoders.Sequence(plain)
    return tokenizer, first, (words, SPACE * spec.add_dummy_prefix)


_built: dict = {}


class Encoder:
    """Encodes and decodes texts with a model; remembers words as long as it lives."""

    def __init__(self, path: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        if path not in _built:
            with open(path, "rb") as f:
                _built[path] = build(f.read())
        self.tokenizer, self.first, self.single = _built[path]
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}

    def both(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids, as little-endian 32-bit numbers, and the text decoded from them."""
        return self._by_word(texts) if self.single else self._whole(texts)

    def _whole(self, texts: list[str]) -> list[tuple[bytes, str]]:
        out = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[at : at + TEXTS_AT_ONCE]
            filled = [bool(self.first(t)) for t in part]
            encoded = iter(self.tokenizer.encode_batch_fast([t for t, own in zip(part, filled, strict=True) if own], add_special_tokens=False))
            ids = [next(encoded).ids if own else [] for own in filled]  # the library would give an empty text its prefix
            out += [(array("I", i).tobytes(), d) for i, d in zip(ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False), strict=True)]
        return out

    def _by_word(self, texts: list[str]) -> list[tuple[bytes, str]]:
        words, marker = self.single
        split = [WORD.findall(marker + own.replace(" ", SPACE)) if own else [] for own in map(self.first, texts)]
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.text = {}, {}
        new = list(set(chain.from_iterable(split)) - self.ids.keys())
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            ids = [e.ids for e in words.encode_batch_fast(part, add_special_tokens=False)]
            self.ids.update(zip(part, [array("I", i).tobytes() for i in ids], strict=True))
            self.text.update(zip(part, words.decode_batch(ids, skip_special_tokens=False), strict=True))
        # decoding drops the marker before the text
        return [(b"".join(map(self.ids.__getitem__, found)), "".join(map(self.text.__getitem__, found))[len(marker) :]) for found in split]


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2, with_ids: bool = True) -> DataFrame:
    """row, doc_id, n_ids, ids_crc32, decoded_same (and ids): one row for each row of ``docs``.

    ids_crc32 is over the ids as little-endian 32-bit numbers; decoded_same says whether decoding gives the text back.
    A null text is an empty one and has no ids. Whole texts are encoded. Rows that repeat are encoded each; an empty
    table gives no rows. Other columns are ignored. Executors read the model at ``model_path``.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path, threads)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = encoder.both(texts)
            columns = {
                "row": b.column("row"),
                "doc_id": b.column("doc_id"),
                "n_ids": pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(i) for i, _ in found], pa.int64()),
                "decoded_same": pa.array([d == t for (_, d), t in zip(found, texts, strict=True)], pa.bool_()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(i, "<i4") for i, _ in found], pa.list_(pa.int32()))
            yield pa.record_batch(list(columns.values()), list(columns))

    return map_batches(documents(docs), each, "row long, doc_id long, n_ids long, ids_crc32 long, decoded_same boolean" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give a null text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Encoder(model_path, 1).tokenizer
        for b in batches:
            ids = b.column("ids").to_pylist()
            texts = iter(tokenizer.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
            yield pa.record_batch([b.column("doc_id"), pa.array([None if x is None else next(texts) for x in ids], pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), each, "doc_id long, text string")
