"""Lines that many documents share, found by two Bloom filters.

Each task marks the keys of its lines in a filter of keys seen once and one of keys seen twice. Only the bits that are
set travel, by chunks of the filter; where they meet, a bit set by two tasks is a bit seen twice. A key in two
documents therefore has all its bits in the second filter. Only lines whose key the second filter knows shuffle, to be
counted exactly, by their text. The confirmed keys, with the document that keeps each, go to every task as long as they
are few, and texts don't move; beyond that, texts meet the keys they lose in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, looked_up, map_batches, stored

#: Bits of a filter for each row, their least and greatest number (64 MB) and hash functions. Beyond, more lines shuffle, and the result is the same.
BITS_PER_ROW, LEAST_BITS, MOST_BITS, HASHES = 64, 1 << 20, 1 << 29, 2

#: Bits of a chunk by which tasks' filters are merged, and set bits after which a task hands them on.
CHUNK_BITS, FLUSH = 1 << 19, 2_000_000

#: Confirmed keys that are sent to every task at most (24 bytes each).
SENT_KEYS = 1_000_000


def key_of(line: bytes) -> bytes:
    return line.strip().lower()  # bytes: [\x20\x09-\x0D] and A-Z alone


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """The bits of each key, a row each."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    step = h >> np.uint64(32) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)], axis=1).astype(np.int64)


def line_keys(text: bytes, least: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if len(k := key_of(line)) >= least and code_points(k) >= least}


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def seen_twice(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The second filter, packed: bits that keys of two documents or more may share. ``bits // 8`` bytes."""
    chunk_bits = min(bits, CHUNK_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            """The bits set, as places in their chunk: all of them, and those set twice."""
            at, times = np.unique(np.concatenate(held), return_counts=True)
            first = np.flatnonzero(np.diff(at // chunk_bits, prepend=-1))
            parts = [(at[i:j] % chunk_bits, times[i:j] > 1) for i, j in zip(first, [*first[1:], len(at)], strict=True)]
            lists = [pa.array([own[kept].astype("<u4").tobytes() for own, kept in of], pa.binary()) for of in ([(o, slice(None)) for o, _ in parts], parts)]
            return pa.record_batch([pa.array(at[first] // chunk_bits), *lists], ["chunk", "once", "twice"])

        for b in batches:
            for text in texts_of(b):
                if keys := list(line_keys(text, least)):
                    held.append(np.unique(places(keys, bits)))
            if sum(map(len, held)) > FLUSH:
                yield out()
                held = []
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["chunk", "twice"])

        for batch in batches:  # a chunk's rows follow each other
            for chunk, all_, two in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if chunk != at:
                    if at is not None:
                        yield out()
                    at, once, twice = chunk, np.zeros(chunk_bits, bool), np.zeros(chunk_bits, bool)
                own = np.frombuffer(all_, "<u4")
                twice[own[once[own]]] = True
                twice[np.frombuffer(two, "<u4")] = True
                once[own] = True
        if at is not None:
            yield out()

    marked = map_batches(docs.select("text"), mark, "chunk long, once binary, twice binary").repartition("chunk").sortWithinPartitions("chunk")
    filter_ = np.zeros((bits // chunk_bits, chunk_bits // 8), np.uint8)
    for r in map_batches(marked, merge, "chunk long, twice binary").collect():  # the filter: MOST_BITS at most
        filter_[r["chunk"]] = np.frombuffer(r["twice"], np.uint8)
    return filter_.reshape(-1)


def suspected_lines(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """(doc_id, key) of all lines whose key two documents may share, once for each row."""
    suspects = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, least, bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = suspects.value
        for b in batches:
            ids, keys = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                if own := list(line_keys(text, least)):
                    at = places(own, bits)
                    hit = np.flatnonzero((known[at >> 3] >> (7 - (at & 7)) & 1).all(axis=1))
                    ids += [doc] * len(hit)
                    keys += [own[i] for i in hit]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return map_batches(docs, probe, "doc_id long, key binary")


def rebuilt(text: bytes, gone) -> tuple[bytes, int, int]:
    """The text without the lines whose key is ``gone``, its number of lines, and how many are dropped."""
    lines = text.split(b"\n")
    kept = [x for x in lines if not gone(key_of(x))]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


RESULT = "doc_id long, text string, n_lines long, n_dropped long"


def result(b: pa.RecordBatch, found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    texts, counts, dropped = zip(*found, strict=True) if found else ((), (), ())
    return pa.record_batch([b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def drop_repeated_lines(docs: DataFrame, least: int = 40, documents_least: int = 5, bits: int | None = None, sent_keys: int = SENT_KEYS) -> DataFrame:
    """doc_id, text without the lines dropped, n_lines before, n_dropped: one row for each row of ``docs``.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``least`` code points or more in
    ``documents_least`` rows or more stay in the rows of the largest doc_id that has them, however often, and go
    elsewhere. A null text is an empty one, which is one empty line. Rows that share a doc_id each count and are
    treated alike; a null doc_id is smaller than any other. An empty table gives no rows. Other columns are ignored.
    """
    docs = documents(docs).select("doc_id", "text")
    bits = bits or min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ROW * docs.count()).bit_length()))
    lines = stored(suspected_lines(docs, least, bits))
    shared = stored(lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= documents_least))

    if shared.count() <= sent_keys:

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(k) for k in b.column("key").to_pylist()], pa.binary()), b.column("keeper")], ["key", "keeper"])

        rows = map_batches(shared.select("key", "keeper"), digests, "key binary, keeper long").toArrow()  # 24 bytes each, however long the lines
        sent = docs.sparkSession.sparkContext.broadcast(dict(zip(rows["key"].to_pylist(), rows["keeper"].to_pylist(), strict=True)))

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keepers = sent.value
            for b in batches:
                found = []
                for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                    found.append(rebuilt(text, lambda key, doc=doc: len(key) >= least and keepers.get(xxhash.xxh3_128_digest(key), doc) != doc))
                yield result(b, found)

        return map_batches(docs, sweep, RESULT)

    lost = looked_up(lines, shared, ["key"], "n").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_set("key").alias("keys"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield result(b, [rebuilt(text, set(keys or ()).__contains__) for text, keys in zip(texts_of(b), b.column("keys").to_pylist(), strict=True)])

    return map_batches(docs.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")), "left").select("doc_id", "text", "keys"), rebuild, RESULT)
