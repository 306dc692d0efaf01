"""Packing of token sequences by minimum bin slack.

Tokenising tasks cut each document into pieces and number the pieces of each length. All that packing needs to know is
how many pieces of each length there are, a histogram of at most ``capacity`` rows however large the corpus. On it,
bins are built one by one: the longest length that is left, and with it the combination of the others that fills the
bin best, found by a bitset of reachable sums. As often as the histogram allows, the same combination is taken at once,
so the number of combinations follows the histogram, not the corpus. Pieces then find their place by their rank within
their length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, documents, map_batches, stored

#: Words whose ids a task remembers; once a text has gone beyond it, it starts anew.
CACHE_WORDS = 150_000


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are themselves, the others follow 255 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordCache(dict):
    """Ids of words, as little-endian 32-bit numbers, by the tokenizer's model; the ids of known words are remembered.

    The tokenizer's words don't depend on each other. Texts of plain Latin letters (below U+0180, without control
    characters; none of them becomes a letter beyond by lower-casing) are split here by the tokenizer's own rule; all
    others, and texts with the mark of a special token, go to the tokenizer whole.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        kinds: dict[str, list[str]] = {"L": [], "N": []}
        for c in map(chr, range(0x21, 0x180)):
            kinds.get(unicodedata.category(c)[0], []).append(c)
        letters, digits = (re.escape("".join(kinds[k])) for k in "LN")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+").findall
        self.special = re.compile(r"[^\t\n\r\x20-\x7e¡-ſ]|<\|").search

    def __missing__(self, word: str) -> bytes:
        pieces = self.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        self[word] = ids = array("I", [p.id for p in pieces]).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if self.special(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, self.words(text.lower())))


_tokenizers: dict = {}


def word_cache(path: str) -> WordCache:
    """A new cache, which ends with its task: Spark may keep many idle workers. They keep the tokenizer alone."""
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
    return WordCache(_tokenizers[path])


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32, and the task's part and the piece's rank among the pieces of its length in that part."""
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seen = word_cache(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows, ids = b.column("row").to_pylist(), b.column("doc_id").to_pylist()
            cut: list[tuple] = []
            for row, doc, tokens in zip(rows, ids, map(cache.encode, b.column("text").to_pylist()), strict=True):
                tokens += end
                for piece, at in enumerate(range(0, len(tokens) // 4, capacity)):
                    own = tokens[4 * at : 4 * (at + capacity)]
                    length = len(own) // 4
                    cut.append((row, doc, piece, at, length, zlib.crc32(own), part, int(seen[length]), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None))
                    seen[length] += 1
            columns = list(zip(*cut, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 8 + with_ids], names[: 8 + with_ids])

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    return map_batches(documents(docs), each, schema)


def fullest(counts: np.ndarray, lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, how many) that fill ``room`` best, at most ``counts`` of each: subset sums as bits of one integer.

    Longer lengths come first, so that short ones, which fit anywhere, are used last. The first sum that leaves no slack ends the search.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []  # bit s: the sum s can be made
    for length in lengths:
        if length > room:
            continue
        left = min(int(counts[length]), room // length)
        take = 1
        while left:  # 1, 2, 4, ... at a time make any number up to the count
            take = min(take, left)
            more = (reach | reach << length * take) & full
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def pack_histogram(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, first bin, how many a bin, offset in the bin), and the number of bins.

    Pieces of ``length`` from ``first rank`` on, up to the next slot of that length, go ``how many`` to a bin.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used, slots, bins = np.zeros(capacity + 1, np.int64), [], 0
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
    while lengths:
        counts[lengths[0]] -= 1
        pattern = dict(fullest(counts, lengths, capacity - lengths[0]))
        counts[lengths[0]] += 1
        pattern[lengths[0]] = pattern.get(lengths[0], 0) + 1
        times = min(int(counts[x]) // n for x, n in pattern.items())
        offset = 0
        for x, n in pattern.items():
            slots.append((x, int(used[x]), bins, n, offset))
            offset += x * n
            used[x] += n * times
            counts[x] -= n * times
        bins += times
        lengths = [x for x in lengths if counts[x]]
    return slots, bins


def placed(slots: list[tuple[int, int, int, int, int]]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From lengths and ranks to sequence ids and offsets."""
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    starts = table[:, 0] << 46 | table[:, 1]

    def place(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = table[np.searchsorted(starts, length << 46 | rank, side="right") - 1] if len(table) else np.zeros((0, 5), np.int64)
        nth = rank - s[:, 1]
        return s[:, 2] + nth // np.maximum(s[:, 3], 1), s[:, 4] + nth % np.maximum(s[:, 3], 1) * length

    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids), one row for each piece of each row of ``docs``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Longer ones than ``capacity`` are
    cut, the last piece being shorter. Rows that repeat are packed each, a null doc_id stays null, and an empty table
    gives no rows. Other columns are ignored. Sequences have no gap, and none is longer than ``capacity``.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.sparkContext.broadcast(pack_histogram(histogram, capacity)[0])  # a few for each length
    before = stored(by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")))
    ranked = pieces.join(F.broadcast(before) if before.count() <= BROADCAST_ROWS else before.hint("merge"), ["part", "length"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = placed(slots.value)
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = place(length, rank + b.column("before").to_numpy())
            found = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.record_batch([found[c] if c in found else b.column(c) for c in names], names)

    return map_batches(ranked, each, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
