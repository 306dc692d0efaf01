"""Code length of documents by prediction by partial matching (PPM), beside a word unigram base.

The model is a trie of byte contexts up to ``ORDER`` bytes, counted over all training documents. A symbol is looked up
under its longest known context; each time it wasn't seen there an escape is paid (method C: as many escapes as
different symbols), and the symbols of the longer context are excluded from the shorter one. A trained trie doesn't
change while it scores, so a symbol after its context, an n-gram, has one probability in all documents.

The trie is nowhere whole. Documents are read once, in chunks; each chunk asks for its different n-grams and tells how
often they occur in its training documents. The n-grams are dealt into cells by the three bytes before their symbol, so
a cell has all that its longer contexts need, and the contexts of up to two bytes are few enough for every task. The
task of a cell adds the counts of all chunks, and answers each chunk with the log probabilities of its n-grams. Then
each chunk's documents meet its answers and are scored by table lookups.

A document is scored as its words, A-Z lower-cased, joined by one space, and an end symbol: what the base scores too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, map_batches, most_frequent, scratch, stored

ORDER = 5

#: Orders from this one on are dealt into cells; those below have at most 256 ** SPLIT n-grams (about 24 bytes each) and go to every task.
SPLIT = 3

#: A chunk ends with so many different n-grams, or bytes of text.
CHUNK_GRAMS, CHUNK_BYTES = 600_000, 1 << 24

#: Cells for each shuffle partition, and n-grams (of all chunks) that a task answers at once, in whole cells.
CELLS, ASKED_AT_ONCE = 64, 1_000_000

#: Words whose counts tasks hold (the most frequent ones); all others find theirs by a join.
FREQUENT_WORDS = 100_000

END = b"\n"  # no word holds it
FLUSH = 400_000
WINDOW = 1 << 19


def normal(text: bytes) -> tuple[list[bytes], bytes]:
    """The words of a text, and the text that is scored."""
    words = text.lower().split()  # bytes: A-Z and [\x20\x09-\x0D] alone
    return words, b" ".join(words)


def texts_of(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() for t in batch.column("text").cast(pa.large_binary()))


def windows(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All documents' bytes, one after the other with ``order`` end symbols before each, in windows of ``WINDOW`` symbols.

    For each window: its n-grams, which of them end in a symbol of a document (its end included), and the document of each.
    """
    pad = END * order
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.cumsum(lengths + order) - lengths - order  # where each document begins, among the n-grams
    data = np.frombuffer(pad + pad.join(texts) + END, np.uint8)
    for at in range(0, len(data) - order, WINDOW):
        part = data[at : at + WINDOW + order]
        place = np.arange(at, at + len(part) - order)
        doc = np.searchsorted(firsts, place, side="right") - 1
        yield grams(part, order), place - firsts[doc] <= lengths[doc], doc


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from the ``order``-th on, it and the ``order`` bytes before it as one number."""
    n = len(data) - order
    out = np.zeros(n, np.uint64)
    for i in range(order + 1):
        out <<= np.uint64(8)
        out |= data[i : i + n]
    return out


class Table:
    """An open hash table of distinct 64-bit keys, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.at[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.at[slot[won]] = keys[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], slot[rest] + 1 & (1 << self.bits) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 if it isn't there."""
        slot = self.slot(keys)
        out = self.at[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = slot + 1 & (1 << self.bits) - 1
            found = self.at[slot]
            out[todo] = found
            go = (found >= 0) & (self.keys[slot] != keys[todo])
            todo, slot = todo[go], slot[go]
        return out


class Level:
    """The n-grams of one order k: sorted keys of k + 1 bytes, their counts, and what their contexts need, as log10."""

    def __init__(self, k: int, keys: np.ndarray, n: np.ndarray, above: Level | None):
        contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
        self.keys, self.n, self.contexts = keys, n, contexts
        self.total = np.add.reduceat(n, first) if len(n) else np.zeros(0, np.int64)
        self.kinds = np.diff(np.append(first, len(n)))
        all_ = self.total + self.kinds
        self.start = np.log10(n) - np.repeat(np.log10(all_), self.kinds)
        self.escape = np.log10(self.kinds) - np.log10(all_)
        if above is not None:
            # the next shorter context, without the symbols seen in this one
            shorter = above.n[np.searchsorted(above.keys, keys & np.uint64((1 << 8 * k) - 1))]
            seen = np.add.reduceat(shorter, first) if len(n) else np.zeros(0, np.int64)
            at = np.searchsorted(above.contexts, contexts & np.uint64((1 << 8 * (k - 1)) - 1))
            new = above.kinds[at] - self.kinds
            left = above.total[at] - seen + new
            self.left = np.log10(np.maximum(left, 1))
            self.left_escape = np.where(new > 0, np.log10(np.maximum(new, 1)) - self.left, 0)


def places_of(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The position of each key, -1 if it isn't there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def shortened(keys: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams cut to their last ``size`` bytes, with the sums of their counts."""
    short, at = np.unique(keys & np.uint64((1 << 8 * size) - 1), return_inverse=True)
    return short, np.bincount(at, n, len(short)).astype(np.int64)


def levels_of(keys: np.ndarray, n: np.ndarray, orders: range, below: list[Level]) -> list[Level]:
    """``below`` and the levels of ``orders``, all from the grams of the highest order and their counts, all above zero."""
    levels = list(below)
    for k in orders:
        levels.append(Level(k, *shortened(keys, n, k + 1), levels[-1] if levels else None))
    return levels


def log10_of(levels: list[Level], g: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others."""
    out = np.zeros(len(g), np.float64)
    todo, chain, longer = np.arange(len(g)), np.full(len(g), -1, np.int64), None  # chain: the position of the longer context whose symbols are excluded, -1 if none is known
    for k in range(len(levels) - 1, -1, -1):
        level, key = levels[k], g[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
        at = places_of(level.keys, key)
        hit, held = at >= 0, chain >= 0
        plain, both, lost = hit & ~held, hit & held, ~hit & held
        out[todo[plain]] += level.start[at[plain]]
        if longer is not None:
            out[todo[both]] += np.log10(level.n[at[both]]) - longer.left[chain[both]]
            out[todo[lost]] += longer.left_escape[chain[lost]]
        context = places_of(level.contexts, key[~hit] >> np.uint64(8))
        fresh = (context >= 0) & ~held[~hit]
        out[todo[~hit][fresh]] += level.escape[context[fresh]]
        todo, chain, longer = todo[~hit], context, level
    out[todo] -= np.log10(max(256 - len(levels[0].keys), 1))
    return out


def by_context(g: np.ndarray, order: int) -> np.ndarray:
    """Grams with the bytes next to their symbol first: those of one cell lie together, and its bytes repeat."""
    near, far = 8 * SPLIT, 8 * (order - SPLIT)
    middle, front = g >> np.uint64(8) & np.uint64((1 << near) - 1), g >> np.uint64(8 + near)
    return middle << np.uint64(far + 8) | front << np.uint64(8) | g & np.uint64(255)


def by_place(r: np.ndarray, order: int) -> np.ndarray:
    """The inverse of ``by_context``."""
    near, far = 8 * SPLIT, 8 * (order - SPLIT)
    middle, front = r >> np.uint64(far + 8), r >> np.uint64(8) & np.uint64((1 << far) - 1)
    return front << np.uint64(8 + near) | middle << np.uint64(8) | r & np.uint64(255)


def packed(r: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Sorted numbers as differences of ``size`` bytes, each of ``starts`` beginning anew."""
    steps = np.diff(r, prepend=np.uint64(0))
    steps[starts] = r[starts]
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :size])


def unpacked(blobs: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several blobs of ``packed``, and how many each holds."""
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // size
    steps = np.zeros((int(lengths.sum()), 8), np.uint8)
    steps[:, :size] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, size)
    sums = np.cumsum(steps.view(np.uint64).reshape(-1), dtype=np.uint64)
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    offset = np.where(before > 0, sums[np.maximum(before, 1) - 1], np.uint64(0)) if len(sums) else np.zeros(len(blobs), np.uint64)
    return sums - np.repeat(offset, lengths), lengths


GATHERED = "word binary, gram long, n long, chunk long, cell int, grams binary, counts binary, row long, doc_id long, held_out boolean, text binary"


def gather(docs: DataFrame, order: int, cells: int) -> DataFrame:
    """Rows of four kinds: (word, n) and (gram, n), of ``SPLIT`` bytes, of the training documents, added up in each task as far as its memory allows;
    (chunk, cell, grams, counts), a chunk's n-grams and how often its training documents have them; and (chunk, row, doc_id, held_out, text), the texts as they are scored."""
    kinds = dict(pair.split() for pair in GATHERED.split(", "))
    types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[c], types[k]) if c in columns else pa.nulls(size, types[k]) for c, k in kinds.items()], list(kinds))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []  # grams, with a last bit for training documents, and counts
        chunk, size = TaskContext.get().partitionId() << 30, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            keys, n = merged()
            g, first = np.unique(keys >> np.uint64(1), return_index=True)
            n = np.add.reduceat(n * (keys & np.uint64(1)).astype(np.int64), first)
            low, low_n = shortened(g, n, SPLIT)
            low, low_n = low[low_n > 0], low_n[low_n > 0]
            yield rows(len(low), gram=low.astype(np.int64), n=low_n)
            r = by_context(g, order)
            cell = (r >> np.uint64(8 * (order - SPLIT) + 8)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            cell = (cell % np.uint64(cells)).astype(np.int32)
            by = np.lexsort((r, cell))
            r, cell, n = r[by], cell[by], n[by]
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            ends = np.append(starts[1:], len(cell))
            grams_, counts = packed(r, starts, order + 1), np.minimum(n, (1 << 32) - 1).astype("<u4")
            ends_of = list(zip(starts, ends, strict=True))
            yield rows(len(starts), chunk=np.full(len(starts), chunk), cell=cell[starts], grams=[grams_[i:j].tobytes() for i, j in ends_of], counts=[counts[i:j].tobytes() for i, j in ends_of])

        for b in batches:
            scored, trained = [], [not x for x in b.column("held_out").to_pylist()]
            for (own, text), counts in zip(map(normal, texts_of(b)), trained, strict=True):
                scored.append(text)
                if counts:
                    words.update(own)
                    words[END] += 1
            if not scored:
                continue
            yield rows(len(scored), chunk=np.full(len(scored), chunk), row=b.column("row"), doc_id=b.column("doc_id"), held_out=b.column("held_out"), text=scored)
            size += sum(map(len, scored))
            train = np.array(trained, np.uint64)
            for g, inside, doc in windows(scored, order):
                held.append(np.unique(g[inside] << np.uint64(1) | train[doc[inside]], return_counts=True))
                if sum(len(k) for k, _ in held) > 2 * CHUNK_GRAMS:
                    held = [merged()]
            if size > CHUNK_BYTES or len(held[0][0]) > CHUNK_GRAMS:
                yield from close()
                held, chunk, size = [], chunk + 1, 0
            if len(words) > FLUSH:
                yield rows(len(words), word=list(words), n=list(words.values()))
                words.clear()
        if words:
            yield rows(len(words), word=list(words), n=list(words.values()))
        if held:
            yield from close()

    return map_batches(docs, each, GATHERED)


def answers(asked: DataFrame, low: Broadcast, order: int) -> DataFrame:
    """(chunk, grams, logs): each chunk's n-grams with their log10 probabilities, from rows (chunk, cell, grams, counts).

    Rows of a cell lie in one task, one after the other; whole cells are worked out together up to ``ASKED_AT_ONCE`` n-grams.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = low.value
        held: list[tuple] = []
        size, at = 0, None

        def close() -> pa.RecordBatch:
            chunks, blobs, counts = zip(*held, strict=True)
            r, lengths = unpacked(blobs, order + 1)
            n = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
            g, place = np.unique(by_place(r, order), return_inverse=True)
            n = np.bincount(place, n, len(g)).astype(np.int64)
            logs = log10_of(levels_of(g[n > 0], n[n > 0], range(SPLIT, order + 1), below), g).astype("<f4")[place]
            ends = np.cumsum(lengths)
            return pa.record_batch([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary()), pa.array([logs[e - m : e].tobytes() for e, m in zip(ends, lengths, strict=True)], pa.binary())], ["chunk", "grams", "logs"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("cell", "chunk", "grams", "counts")), strict=True):
                if at != row[0] and size > ASKED_AT_ONCE:
                    yield close()
                    held, size = [], 0
                at = row[0]
                held.append(row[1:])
                size += len(row[2]) // (order + 1)
        if held:
            yield close()

    dealt = asked.repartition("cell").sortWithinPartitions("cell", "chunk")
    return map_batches(dealt, each, "chunk long, grams binary, logs binary")


def score(docs: DataFrame, held_out: Column, order: int = ORDER, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes: one row for each row of ``docs``.

    Rows where ``held_out`` (an expression on doc_id) is true are scored only, all others are trained on and scored. A
    null text is an empty one: its end is its only token. Rows that repeat are counted and scored each. With no
    training rows every token has probability 1 / (V + 1) = 1 in the base and every byte 1 / 256 in the trie. An empty
    table gives no rows. Other columns are ignored. ``order`` is ``SPLIT`` to 6.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept:
        cells = CELLS * int(spark.conf.get("spark.sql.shuffle.partitions"))
        gathered = stored(gather(documents(docs).withColumn("held_out", held_out), order, cells))
        vocabulary = kept(gathered.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")))
        total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        size = total["n"] + total["v"] + 1
        frequent = spark.sparkContext.broadcast({bytes(r["word"]): math.log10((r["c"] + 1) / size) for r in most_frequent(vocabulary, "c", frequent_words).collect()})
        short = gathered.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most 256 ** SPLIT rows
        low = spark.sparkContext.broadcast(levels_of(short["gram"].to_numpy().astype(np.uint64), short["n"].to_numpy().astype(np.int64), range(SPLIT), []))
        answered = answers(gathered.where("cell is not null").select("chunk", "cell", "grams", "counts"), low, order)
        texts = gathered.where("text is not null").select("chunk", "row", "doc_id", "held_out", "text")
        met = answered.unionByName(texts, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("text").isNotNull())

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent_logs = frequent.value
            part, uid = TaskContext.get().partitionId(), 0
            at, known, found, values = None, [], None, None  # the chunk, its answers, and the table made of them

            def scores_of(scored: list[bytes]) -> np.ndarray:
                out = np.zeros(len(scored))
                for g, inside, doc in windows(scored, order):
                    out += np.bincount(doc[inside], values[found.find(g[inside])], len(scored))
                return out

            for b in batches:
                chunks, is_text = b.column("chunk").to_numpy(), b.column("text").is_valid().to_numpy(zero_copy_only=False)
                edges = np.flatnonzero((chunks[1:] != chunks[:-1]) | (is_text[1:] != is_text[:-1])) + 1
                for lo, hi in zip([0, *edges], [*edges, len(chunks)], strict=True) if len(chunks) else ():
                    run = b.slice(lo, hi - lo)
                    if at != chunks[lo]:
                        at, known, found = chunks[lo], [], None
                    if not is_text[lo]:
                        known += zip(run.column("grams").to_pylist(), run.column("logs").to_pylist(), strict=True)
                        continue
                    if found is None:
                        blobs, logs = zip(*known, strict=True)
                        found, values, known = Table(by_place(unpacked(blobs, order + 1)[0], order)), np.frombuffer(b"".join(logs), "<f4"), []
                    scored = run.column("text").to_pylist()
                    tokens, base, hits, rare, ends = [], [], [], [], [0]
                    for text in scored:
                        words = [*text.split(b" "), END] if text else [END]
                        own = [frequent_logs[w] for w in words if w in frequent_logs]
                        tokens.append(len(words))
                        base.append(sum(own))
                        hits.append(len(own))
                        if len(own) < len(words):
                            rare += [w for w in words if w not in frequent_logs]
                        ends.append(len(rare))
                    uids = (np.int64(part) << 34) + np.arange(uid, uid + len(scored))
                    uid += len(scored)
                    yield pa.record_batch(
                        [pa.array(uids), run.column("row"), run.column("doc_id"), run.column("held_out"), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(scores_of(scored)), pa.array([len(t) + 1 for t in scored], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.binary()))],
                        ["uid", "row", "doc_id", "held_out", "n_tokens", "hits", "base", "score", "n_bytes", "rare"],
                    )

        schema = "uid long, row long, doc_id long, held_out boolean, n_tokens long, hits long, base double, score double, n_bytes long, rare array<binary>"
        scored = kept(map_batches(met, each, schema))
    asked = scored.select("uid", F.explode("rare").alias("word")).groupBy("uid", "word").agg(F.count("*").alias("times"))
    answered = asked.join(vocabulary, "word", "left")
    value = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(size)))
    rest = answered.groupBy("uid").agg(F.sum(F.col("times") * value).alias("more"), F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))), F.lit(0)).alias("more_known"))
    return scored.drop("rare").join(rest, "uid", "left").select(
        "row",
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hits") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
    )


def fold(doc_id: str = "doc_id") -> Column:
    """True for documents held out: crc32 of the id as text, modulo 7, is 2. A null id counts as an empty text, which is trained on."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2
