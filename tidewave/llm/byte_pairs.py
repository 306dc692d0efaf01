"""Byte-level BPE by forced boundaries.

Merges only ever make tokens of the vocabulary, so no merge crosses a pair of neighbouring bytes that occurs inside no
token: such a pair is a certain cut. A table of all 65,536 pairs, made once from the vocabulary, finds the cuts of a
text in one look-up for each byte. The fragments between cuts, mostly words with the space before them, are encoded
independently by the tokenizers library and put together again; tasks remember the ids of short fragments.

The library also splits texts by a pattern before it merges. A cut never changes that split: cuts lie between whole
characters, never after white space (what follows decides how a run of it is split) and never beside an apostrophe or
inside a contraction. Everywhere else a cut is a border of the pattern itself, or lies inside a run of one class of
characters, whose two parts the pattern takes as they are.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import byte_letters
from .shared import documents, map_batches

#: Fragments that a task remembers, of at most so many bytes; once a text has gone beyond it, it starts anew. Fragments that are put together at once.
CACHE_FRAGMENTS, SHORT, AT_ONCE = 200_000, 64, 100_000

#: White space beyond ASCII, a fixed value of Unicode (with U+180E, which was such in older versions).
WIDE_SPACE = "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Pairs of letters inside the contractions of the pattern, a fixed value of the format.
IN_CONTRACTIONS = ("re", "ve", "ll")


def certain_cuts(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whether to cut between bytes x and y, at 256 * x + y: for texts without white space beyond ASCII, and for those with it."""
    cut = np.ones((256, 256), bool)
    for token in tokens:
        own = np.frombuffer(token, np.uint8)
        cut[own[:-1], own[1:]] = False
    cut[:, 0x80:0xC0] = False  # inside a character
    cut[:0x21] = False  # white space and controls
    cut[ord("'")] = cut[:, ord("'")] = False
    for pair in IN_CONTRACTIONS:
        cut[ord(pair[0]), ord(pair[1])] = False
    wide = cut.copy()
    wide[sorted({c.encode()[-1] for c in WIDE_SPACE})] = False
    return cut.ravel(), wide.ravel()


def plain_model(path: str):
    """The tokenizer at ``path`` without truncation and padding, and its definition; an error unless it is byte-level BPE whose fragments can't depend on each other."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and (spec["decoder"] or {}).get("type") == "ByteLevel"
    own_symbols = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    whole_marks = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    if model["type"] != "BPE" or spec["normalizer"] or not (byte_level and own_symbols and whole_marks):
        raise ValueError(f"{path} isn't plain byte-level BPE")
    tokenizer = Tokenizer.from_str(json.dumps(spec))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, spec


class Codec:
    """Encodes and decodes with the tokenizer at a path: what doesn't change, which a worker keeps."""

    def __init__(self, path: str):
        self.tokenizer, spec = plain_model(path)
        byte_of = {c: b for b, c in byte_letters().items()}
        # a token with a letter that stands for no byte is its own text
        as_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.bytes_of = [as_bytes.get(i, b"") for i in range(max(as_bytes) + 1)]
        self.cut, self.cut_wide = certain_cuts([as_bytes[i] for i in spec["model"]["vocab"].values()])
        self.wide_space = re.compile(f"[{WIDE_SPACE}]").search
        self.marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.marks, key=len, reverse=True)
        self.at_marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.marks else lambda text: [text]

    def borders(self, text: str, data: bytes) -> np.ndarray:
        """Where the fragments of ``data``, which is ``text`` in UTF-8, begin, and its end."""
        own = np.frombuffer(data, np.uint8)
        table = self.cut if len(data) == len(text) or not self.wide_space(text) else self.cut_wide
        pairs = own[:-1].astype(np.uint16) << 8 | own[1:]
        return np.concatenate([[0], np.flatnonzero(table[pairs]) + 1, [len(data)]])

    def decoded(self, ids: list[int]) -> str:
        """The text of ``ids``; numbers that are no id are left out, bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of[i] for i in ids if 0 <= i < len(self.bytes_of)).decode("utf-8", "replace")


class Encoder:
    """A codec with the fragments of one task: their ids, as little-endian 32-bit numbers, and, where these stand for other bytes than the fragment's, those."""

    def __init__(self, codec: Codec):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads for a few fragments cost more than they save
        self.codec, self.known, self.changed = codec, {}, {}

    def _encoded(self, fragments: set[bytes]) -> dict[bytes, bytes]:
        """Ids of fragments, each of which is decoded, too."""
        new, of = list(fragments), self.codec.bytes_of
        out = {}
        for f, e in zip(new, self.codec.tokenizer.encode_batch_fast([f.decode() for f in new], add_special_tokens=False), strict=True):
            ids = e.ids
            out[f] = array("I", ids).tobytes()
            if (decoded := of[ids[0]] if len(ids) == 1 else b"".join([of[x] for x in ids])) != f:
                self.changed[f] = decoded
        return out

    def parts(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """Ids and what they decode to, part for part of ``text``, so that a very long text isn't held as fragments at once."""
        for nth, segment in enumerate(self.codec.at_marks(text)):
            if nth % 2:
                mark = self.codec.marks[segment]
                yield array("I", [mark]).tobytes(), self.codec.bytes_of[mark]
            elif segment:
                yield from self._segment(segment)

    def _segment(self, segment: str) -> Iterator[tuple[bytes, bytes]]:
        data = segment.encode()
        borders = self.codec.borders(segment, data)
        for at in range(0, len(borders) - 1, AT_ONCE):
            own = borders[at : at + AT_ONCE + 1].tolist()
            fragments = list(map(data.__getitem__, map(slice, own, own[1:])))
            if len(self.known) > CACHE_FRAGMENTS:
                self.known, self.changed = {}, {}
            ids = list(map(self.known.get, fragments))
            if None in ids:
                found = self._encoded({f for f, i in zip(fragments, ids, strict=True) if i is None})
                self.known.update((f, i) for f, i in found.items() if len(f) <= SHORT)
                ids = [found[f] if i is None else i for f, i in zip(fragments, ids, strict=True)]
            changed = self.changed
            yield b"".join(ids), b"".join([changed.get(f, f) for f in fragments]) if changed else data[own[0] : own[-1]]
            if changed:
                self.changed = {f: x for f, x in changed.items() if len(f) <= SHORT}


_codecs: dict[str, Codec] = {}


def codec_at(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = True) -> DataFrame:
    """row, doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): one row for each row of ``docs``.

    ids_sha256 is over the ids as little-endian unsigned 32-bit numbers, decoded_sha256 over the text, in UTF-8, that
    decoding the ids gives. A null text is an empty one and has no ids. Whole texts are encoded, the marks of special
    tokens in them as those tokens. Rows that repeat are encoded each, a null doc_id stays null, an empty table gives
    no rows. Other columns, whatever their names, are ignored. Executors read the tokenizer at ``tokenizer_path``.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(codec_at(tokenizer_path))
        for b in batches:
            found, all_ids = [], []
            for text in b.column("text").to_pylist():
                ids_hash, text_hash, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for ids, decoded in encoder.parts(text):
                    ids_hash.update(ids)
                    text_hash.update(decoded if not encoder.changed else decoded.decode("utf-8", "replace").encode())  # parts end with whole characters
                    n += len(ids) // 4
                    if with_ids:
                        kept.append(ids)
                found.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
                all_ids.append(np.frombuffer(b"".join(kept), "<i4"))
            n, ids_hex, text_hex = zip(*found, strict=True) if found else ((), (), ())
            columns = {"row": b.column("row"), "doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(text_hex, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.record_batch(list(columns.values()), list(columns))

    return map_batches(documents(docs), each, "row long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give a null text, no ids an empty one; ids that the tokenizer doesn't have, or that are null, are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_at(tokenizer_path)
        for b in batches:
            texts = [None if ids is None else codec.decoded([i for i in ids if i is not None]) for ids in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), each, "doc_id long, text string")
