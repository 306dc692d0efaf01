"""Near duplicates by SimHash with pivot distance tables.

A bucket's pivot table holds each fingerprint's Hamming distance to many reference fingerprints. A pair whose
distances to some reference differ by more than the tolerance can't be within it (the triangle inequality) and is
discarded; the survivors are verified bit by bit. Two fingerprints at 3 or fewer differing bits agree in at least three
of six blocks of bits, so they are held against each other in one of twenty tables whose keys are three blocks each.

``drop_similar`` takes the pairs that this finds, verifies them by the similarity of their sets of shingles, and adds
those that it can't find, since texts of a similarity of 0.8 differ in 10 bits or so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import roots
from .shared import BROADCAST_ROWS, added, documents, drop_shuffles, looked_up, map_batches, numbered, scratch, sent_if_small, stored, without

SEED = 42
PIVOTS = 16

#: Cells in which texts with a shingle are counted, for the order of shingles.
FREQUENCY_CELLS = 1 << 24

#: Cells that tell which first shingles may repeat: 32 MB of bits. Beyond some thousand million first shingles more of them move than need to.
REPEAT_CELLS = 1 << 28

#: So many cells for each first shingle, by looking at parts of them one after the other, of which there are at most ``REPEAT_PARTS``.
CELLS_EACH, REPEAT_PARTS = 8, 8

#: A bucket with more fingerprints than this is dealt anew by the bits that its key leaves free.
BUCKET_ROWS = 65_536
SHINGLES_AT_ONCE = 65_536

#: A shingle of more rows than this is split by their sizes where they are held against each other.
LONG_KEY = 64

#: 64-bit numbers of a text's odd sketch.
SKETCH = 8


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()  # bytes: A-Z and [\x20\x09-\x0D] alone
    if len(words) <= shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64)


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit how many more hashes have it than not."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones - len(hashes)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, as a signed long; one is set if it is set in over half the hashes. No hashes: zero."""
    return int(np.packbits(votes(hashes) > 0, bitorder="little").view(np.int64)[0])


def bytes_of(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.as_buffer() else b""


def fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id, fp (the 64 bits as a signed long) from row, doc_id, text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(shingle_hashes(bytes_of(t), shingle)) for t in b.column("text")]
            yield pa.record_batch([b.column("row"), b.column("doc_id"), pa.array(fps, pa.int64())], ["row", "doc_id", "fp"])

    return map_batches(rows.select("row", "doc_id", "text"), each, "row long, doc_id long, fp long")


def block_masks(free: int, blocks: int, tolerance: int) -> list[int]:
    """Masks of ``blocks - tolerance`` blocks each, of the bits set in ``free``: any ``tolerance`` bits leave one mask untouched."""
    bits = [i for i in range(64) if free >> i & 1]
    parts = np.array_split(bits, blocks)
    own = [sum(1 << int(i) for i in part) for part in parts]
    return [sum(x) for x in combinations(own, blocks - tolerance)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pivots() -> list[int]:
    return [signed(int(x)) for x in np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, np.uint64, endpoint=False)]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """The distance of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ np.array(pivots(), np.int64).view(np.uint64)[None, :]).astype(np.int16)


def link_bucket(fps: np.ndarray, distances: np.ndarray, tolerance: int) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of one bucket exactly as all pairs within ``tolerance`` would; at most n - 1 of them.

    A found partner leaves the open set at once, so a dense group costs about one pass for each of its members over what is still open.
    """
    order = np.argsort(distances[:, 0], kind="stable")
    fps, distances = fps[order], distances[order]
    open_rows, links = np.arange(len(fps)), []
    while len(open_rows):
        todo, open_rows = [open_rows[0]], open_rows[1:]
        while todo and len(open_rows):
            x = todo.pop()
            first = distances[open_rows, 0]
            lo, hi = np.searchsorted(first, (distances[x, 0] - tolerance, distances[x, 0] + tolerance + 1))
            near = open_rows[lo:hi]
            near = near[(np.abs(distances[near] - distances[x]) <= tolerance).all(axis=1)]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= tolerance]
            if len(near):
                links += [(int(fps[x]), int(y)) for y in fps[near]]
                todo += near.tolist()
                open_rows = np.setdiff1d(open_rows, near, assume_unique=True)
    return links


def bucket_links(dealt: DataFrame, masks: list[int], tolerance: int, most: int | None) -> DataFrame:
    """(u, v, t) from rows (t, fp) and the masks t. u > v is a link; rows of a bucket of more than ``most`` come back as they are, with v null and their t.

    The rows of a bucket lie in one task, one after the other. A task holds one bucket of at most ``most`` rows at a time.
    Its keys and pivot table follow from the fingerprints and don't move.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[tuple[int, int]], over: list[np.ndarray], t: int) -> pa.RecordBatch:
            ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            more = np.concatenate([*over, np.empty(0, np.uint64)]).view(np.int64)
            u = np.concatenate([ends.max(axis=1, initial=-(1 << 63)), more])
            v = pa.concat_arrays([pa.array(ends.min(axis=1, initial=(1 << 63) - 1), pa.int64()), pa.nulls(len(more), pa.int64())])
            return pa.record_batch([pa.array(u, pa.int64()), v, pa.array(np.full(len(u), t, np.int32))], ["u", "v", "t"])

        held: list[np.ndarray] = []  # the bucket that may go on in the next batch
        at, passing = None, False  # its (t, key); whether it has turned out too large

        def close() -> list[tuple[int, int]]:
            fps = np.concatenate(held)
            return link_bucket(fps, pivot_table(fps), tolerance) if len(fps) > 1 else []

        for b in batches:
            t, key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(t):
                continue
            fp = fp.view(np.uint64)
            edges = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(t)]])
            links: list[tuple[int, int]] = []
            inner = (ends - starts > 1) | (starts == 0) | (ends == len(t))  # rows that are alone in the middle of a batch have no partner
            for lo, hi in zip(starts[inner], ends[inner], strict=True):
                if at != (t[lo], key[lo]):
                    if held and not passing:
                        links += close()
                    at, held, passing = (t[lo], key[lo]), [], False
                held.append(fp[lo:hi])
                if most and sum(map(len, held)) > most or passing:
                    passing = True
                    yield out([], held, int(t[lo]))
                    held = []
            yield out(links, [], 0)
        if held and not passing:
            yield out(close(), [], 0)

    key = F.col("fp").bitwiseAND(F.element_at(F.lit([signed(m) for m in masks]).cast("array<long>"), F.col("t") + 1))
    return dealt.repartition("t", key).select("t", key.alias("key"), "fp").sortWithinPartitions("t", "key").mapInArrow(each, "u long, v long, t int")


def dealt_by(masks: range, fps: DataFrame) -> DataFrame:
    """Each fingerprint under each mask: t (the mask's number), fp."""
    return fps.select(F.explode(F.sequence(F.lit(masks.start), F.lit(masks.stop - 1))).alias("t"), "fp")


def near_links(fps: DataFrame, tolerance: int, most: int = BUCKET_ROWS) -> DataFrame:
    """(u, v), u > v: links that connect distinct fingerprints as all pairs within ``tolerance`` bits would."""
    full = (1 << 64) - 1
    masks = block_masks(full, tolerance + 3, tolerance)
    found = stored(bucket_links(dealt_by(range(len(masks)), fps), masks, tolerance, most))
    links, over = found.where("v is not null"), found.where("v is null")
    if not over.isEmpty():
        # what is left free holds 31 bits or so at 3 of 6 blocks; half of those fixed again leaves at most 2**16 fingerprints a bucket
        again = [sub | m for m in masks for sub in block_masks(full & ~m, tolerance + 3, tolerance)]
        of = len(again) // len(masks)
        dealt = over.select((F.col("t") * of).alias("first"), F.col("u").alias("fp")).select(F.explode(F.sequence(F.col("first"), F.col("first") + (of - 1))).alias("t"), "fp")
        links = links.unionByName(bucket_links(dealt, again, tolerance, None))
    return links.select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int, tolerance: int = 3) -> DataFrame:
    """One row for each row of ``docs``: row, doc_id, fingerprint (16 hex digits), component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle, and
    one without words (also null) has fingerprint zero and links like any other. component_id is the smallest doc_id
    that links reach, rows with a null doc_id aside; it is null if there is none. Rows that repeat share a fingerprint
    and so a component. An empty table gives no rows. Other columns are ignored.
    """
    fps = stored(fingerprints(documents(docs), shingle))
    with scratch(docs.sparkSession) as kept:
        labels = kept(component_labels(fps, tolerance))
    return looked_up(fps, labels, ["fp"], "n").select("row", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def component_labels(fps: DataFrame, tolerance: int) -> DataFrame:
    """fp, n, component_id of each fingerprint, from rows (row, doc_id, fp)."""
    own = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    up = roots(near_links(own.select("fp"), tolerance))
    rooted = stored(own.join(up.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "n", "first_id", F.coalesce("v", "fp").alias("root")))
    ids = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("fps")))
    return looked_up(rooted, ids, ["root"], "fps").select("fp", "n", "component_id")


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of ``64 * SKETCH`` cells: whether an odd number of the hashes falls into it.

    Two sets differ in at least as many members as their sketches do in bits (Mitzenmacher, Pagh and Pham, 2014).
    """
    cells = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FREQUENCY_CELLS)).astype(np.int64)


def shingle_frequencies(docs: DataFrame, shingle: int) -> np.ndarray | None:
    """The number of bits of how many texts have shingles in each cell: 16 MB, whatever the corpus. None without texts.

    Each text counts each of its shingles once. Shingles of a cell count together, so a rare one may seem common in a
    large corpus; that costs comparisons alone, since any order of the shingles finds the same texts.
    """

    def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = x + y
        out[out < x] = np.iinfo(out.dtype).max
        return out

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held = np.zeros(FREQUENCY_CELLS, np.uint32)
        for b in batches:
            cells = [cells_of(np.unique(shingle_hashes(bytes_of(t), shingle))) for t in b.column("text")]
            at, n = np.unique(np.concatenate([*cells, np.empty(0, np.int64)]), return_counts=True)
            held[at] += n.astype(np.uint32)
        yield held

    def bits(found: np.ndarray) -> np.ndarray:
        out = np.zeros(len(found), np.uint8)
        for k in range(32):
            out += found >= 1 << k
        return out

    return added(docs.select("text"), counts, summed, bits)


def first_shingles(docs: DataFrame, shingle: int, similarity: float, frequencies: np.ndarray | None) -> DataFrame:
    """row, n, digest, fp, sketch, first: how many different shingles a text has, a digest of their set, its SimHash, its odd sketch, and the first of them.

    Shingles are in the order of their frequencies, rare ones first, then of their hashes. Two sets of at least this
    Jaccard similarity share ``similarity`` of each, so they share one of the first shingles of both, in any order that
    is the same for all texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequencies)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, fps, sketches, firsts = [], [], [], [], []
            for t in b.column("text"):
                own = np.unique(shingle_hashes(bytes_of(t), shingle))
                sizes.append(len(own))
                fps.append(simhash(own))
                sketches.append(odd_sketch(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes(), seed=SEED))
                if sent.value is not None:
                    own = own[np.argsort(sent.value[cells_of(own)], kind="stable")]
                firsts.append(own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1].view(np.int64))
            yield pa.record_batch([b.column("row"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))], ["row", "n", "digest", "fp", "sketch", "first"])

    return map_batches(docs.select("row", "text"), each, "row long, n int, digest binary, fp long, sketch array<long>, first array<long>")


def allows(x: str, y: str, similarity: float) -> Column:
    """Whether two sets, by their sizes and the places of a shared shingle, (n, at) of structs ``x`` and ``y``, can have the similarity if it is the first that they share.

    Then what both can share is it and what lies behind it. At their first shared shingle two similar sets pass; where
    they pass at one, they pass at those before it.
    """
    most = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
    return most * (1 + similarity) >= similarity * (F.col(f"{x}.n") + F.col(f"{y}.n")) - 1e-6


def reach(x: str, similarity: float) -> Column:
    """The size up to which a set can have a partner whose first shared shingle is that of struct ``x``, by its ``n`` and ``at``."""
    return F.floor((F.col(f"{x}.n") - F.col(f"{x}.at")) * ((1 + similarity) / similarity) + 1e-6).cast("int") - F.col(f"{x}.n")


def may_be_smaller(x: str, similarity: float) -> Column:
    """Whether a set can have such a partner of its own size or more; of two similar sets one can."""
    return reach(x, similarity) >= F.col(f"{x}.n")


def cell_of(s: np.ndarray, cells: int) -> np.ndarray:
    return (s >> np.uint64(7)) % np.uint64(cells)


def in_part(s: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Which of these shingles are in a part of them all, by bits that ``cell_of`` leaves out."""
    return (s & np.uint64(127)) * np.uint64(parts) >> np.uint64(7) == part


def met_twice(known: DataFrame, part: int = 0, parts: int = 1) -> np.ndarray | None:
    """A bit for each cell of first shingles of a part: whether two may lie in it, of different rows. ``REPEAT_CELLS`` bits, whatever the corpus; None without rows."""
    cells = REPEAT_CELLS

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        both = np.zeros((2, cells >> 3), np.uint8)
        once, twice = both
        for b in batches:
            s = b.column("first").flatten().to_numpy().view(np.uint64)
            at, n = np.unique(cell_of(s[in_part(s, part, parts)], cells), return_counts=True)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
            again = (n > 1) | ((once[byte] & bit) > 0)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
        yield both

    def either(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([x[0] | y[0], x[1] | y[1] | (x[0] & y[0])])

    return added(known.select("first"), bits, either, lambda x: x[1])


def repeated(known: DataFrame) -> DataFrame:
    """row, n, at, s, stored: the first shingles that other rows may have too, by ``met_twice``, with their places; most others don't leave their task."""
    firsts = known.agg(F.sum(F.size("first")).alias("n")).first()["n"] or 0
    parts = min(REPEAT_PARTS, max(1, -(-firsts * CELLS_EACH // REPEAT_CELLS)))
    found = [repeated_part(known, part, parts) for part in range(parts)]
    return reduce(DataFrame.unionByName, found)


def repeated_part(known: DataFrame, part: int, parts: int) -> DataFrame:
    cells, sent = REPEAT_CELLS, known.sparkSession.sparkContext.broadcast(met_twice(known, part, parts))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b.column("first")
            sizes, s = first.value_lengths().to_numpy(), first.flatten().to_numpy()
            cell = cell_of(s.view(np.uint64), cells)
            keep = (sent.value[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & in_part(s.view(np.uint64), part, parts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows, n = b.column("row").to_numpy(), b.column("n").to_numpy()
            yield pa.record_batch([pa.array(rows[owner[keep]]), pa.array(n[owner[keep]]), pa.array(at[keep].astype(np.int32)), pa.array(s[keep])], ["row", "n", "at", "s"])

    out = stored(map_batches(known.select("row", "n", "first"), each, "row long, n int, at int, s long"))
    sent.destroy()
    return out


def repeats(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``repeated``, stored, and of each shingle that several rows have their number ``of``, the least and the greatest of them by size, ``x`` and ``y`` (n, row, at)."""
    lists = repeated(known)
    row = F.struct("n", "row", "at")
    return lists, stored(lists.groupBy("s").agg(F.count("*").alias("of"), F.min(row).alias("x"), F.max(row).alias("y")).where("of > 1"))


def sharing(known: DataFrame) -> DataFrame:
    """s, x: each first shingle that several rows have, with each of them (row, n, at), ``at`` being its place."""
    return shared_by(1, *repeats(known))


def shared_by(more_than: int, lists: DataFrame, several: DataFrame) -> DataFrame:
    """``sharing``, of the shingles that more rows have, from ``repeats``."""
    return looked_up(lists, several.where(F.col("of") > more_than).select("s", "of"), ["s"], "of", few=BROADCAST_ROWS).select("s", F.struct("row", "n", "at").alias("x"))


#: What is known of a pair (a, b) by shingles that both have first: how many, their sizes and the last places.
SIDES = ["n_x", "at_x", "n_y", "at_y"]


def two_alone(several: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, both and ``SIDES``: the pairs that are the only two rows of a shingle, from ``repeats``, and can have the similarity."""
    return met_by_pair(several.where((F.col("of") == 2) & allows("x", "y", similarity)).select("x", "y"))


def met_by_pair(met: DataFrame, *more: DataFrame) -> DataFrame:
    """(a, b), a < b, both and ``SIDES`` of rows (x, y), x the smaller of two, and of tables of this form."""
    each = met.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b"), F.lit(1).cast("long").alias("both"), *[F.col(f"{s[-1]}.{s[:-2]}").alias(s) for s in SIDES])
    for x in more:
        each = each.unionByName(x)
    return each.groupBy("a", "b").agg(F.sum("both").alias("both"), *[F.max(s).alias(s) for s in SIDES])


def with_roots(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """``shared`` with the group of each row (row, root). A row that ``groups`` lacks is a group of its own."""
    return shared.withColumn("row", F.col("x.row")).join(sent_if_small(groups), "row", "left").select("s", "x", F.coalesce("root", "row").alias("root"))


def led_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: each row with one row of each of its shingles, if they can have the similarity. Only rows that may be the smaller of two lead."""
    leading = shared.where(may_be_smaller("x", similarity))
    leaders = stored(leading.groupBy("s").agg(F.min(F.struct(F.xxhash64("x.row", "s").alias("by"), "x"))["x"].alias("leader")))
    sizes = stored(leaders.join(shared.groupBy("s").agg(F.count("*").alias("of")), "s"))
    met = looked_up(shared, sizes, ["s"], "of").where((F.col("x.row") != F.col("leader.row")) & allows("x", "leader", similarity))
    return met.select(F.least("leader.row", "x.row").alias("a"), F.greatest("leader.row", "x.row").alias("b")).distinct()


def differ_little(x: str, y: str, similarity: float) -> Column:
    """Whether two sets, by their sizes and sketches, can differ in so few members as sets of the similarity do."""
    bits = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH)), F.lit(0))
    return bits * (1 + similarity) <= (1 - similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 1e-6


def opposed(mixed: DataFrame, similarity: float, long: int = LONG_KEY) -> tuple[DataFrame, DataFrame]:
    """The rows of ``mixed`` (s, x, and ``of``, the number of rows of s) as the smaller and as the larger of two sets, both with a cell of sizes in which they meet.

    So texts of one template that differ in more than the similarity allows are no smaller sets, not even for each
    other, however many they are. Only shingles of more than ``long`` rows are split by sizes.
    """
    n = F.col("x.n")

    def cell(size: Column) -> Column:  # [similarity * n, n] lies in three cells at most
        return F.floor(F.log(size) * (2 / math.log(1 / similarity))).cast("int")

    least, most = F.ceil(n * similarity - 1e-6).cast("int"), F.least(n, reach("x", similarity))
    cells = F.when(F.col("of") > long, F.sequence(cell(least), cell(most))).otherwise(F.array(F.lit(0)))
    larger = mixed.where(most >= least).withColumn("cell", F.explode(cells))
    return mixed.where(may_be_smaller("x", similarity)).withColumn("cell", F.when(F.col("of") > long, cell(n)).otherwise(0)), larger


def sharing_pairs(shared: DataFrame, sketches: DataFrame, groups: DataFrame, similarity: float, long: int = LONG_KEY, *, alone: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: all rows of different groups (row, root) that share a first shingle and can have the similarity.

    ``alone`` has the pairs of shingles that ``shared`` lacks (``two_alone``); they count, and some of them come out too.

    One of two rows of different groups isn't in the shingle's largest group, so its members never meet each other.
    Sketches are compared in the join itself, so that texts which share much and resemble each other little give few rows.
    """
    rooted = with_roots(shared, groups)
    by_root = rooted.groupBy("s", "root").agg(F.count("*").alias("held"), F.max(may_be_smaller("x", similarity)).alias("fit"))
    mixed = by_root.groupBy("s").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.sum("held").alias("of"), F.count("*").alias("roots"), F.max("fit").alias("fit"))
    mixed = stored(mixed.where("roots > 1 and fit").select("s", "main", "of"))
    met = looked_up(rooted, mixed, ["s"], "of").withColumn("row", F.col("x.row")).join(sketches, "row")
    rows = stored(met.select("s", "of", F.struct("x.*", "sketch").alias("x"), "root", (F.col("root") != F.col("main")).alias("aside")))
    smaller, larger = opposed(rows, similarity, long)
    larger = larger.select("s", "cell", F.col("x").alias("y"), F.col("root").alias("root_y"), F.col("aside").alias("aside_y"))
    fits = (F.col("root") != F.col("root_y")) & (F.struct("x.n", "x.row") < F.struct("y.n", "y.row")) & allows("x", "y", similarity) & differ_little("x", "y", similarity)
    met = smaller.where("aside").join(larger, ["s", "cell"]).where(fits).select("x", "y")
    met = met.unionByName(smaller.where("not aside").join(larger.where("aside_y"), ["s", "cell"]).where(fits).select("x", "y"))
    # what two sets share is these shingles, and what lies behind the last of them
    pairs = met_by_pair(met, *[] if alone is None else [alone])
    most = F.col("both") + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) - 1
    return pairs.where(most * (1 + similarity) >= similarity * (F.col("n_x") + F.col("n_y")) - 1e-6).select("a", "b")


def possible_pairs(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches (row, n, sketch) don't rule the similarity out."""
    sides = [sketches.select(F.col("row").alias(end), F.struct("n", "sketch").alias(side)) for end, side in (("a", "x"), ("b", "y"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(differ_little("x", "y", similarity)).select("a", "b")


def packed_words(text: bytes) -> bytes:
    """The words of a text, compressed: a third of what their hashes take."""
    words = b" ".join(text.lower().split())
    return len(words).to_bytes(8, "little") + pa.compress(words, codec="zstd", asbytes=True) if words else b""


def unpacked_words(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True) if packed else b""


def similar_pairs(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets of shingles have a Jaccard similarity of at least ``similarity``, worked out in full."""
    named = sent_if_small(stored(pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("row"), pa.array([packed_words(bytes_of(t)) for t in b.column("text")], pa.binary())], ["row", "words"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None  # rows of one b follow each other
        for b in batches:
            similar = []
            for row, one, other in zip(b.column("b").to_pylist(), b.column("x"), b.column("y"), strict=True):
                if row != last:
                    last, y = row, np.unique(shingle_hashes(unpacked_words(bytes_of(other)), shingle))
                x = np.unique(shingle_hashes(unpacked_words(bytes_of(one)), shingle))
                both = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(similar, pa.bool_()))

    known = stored(map_batches(docs.join(named, "row", "left_semi").select("row", "text"), packed, "row long, words binary"))
    left, right = known.select(F.col("row").alias("a"), F.col("words").alias("x")), known.select(F.col("row").alias("b"), F.col("words").alias("y"))
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), compared, "a long, b long")


def fingerprint_pairs(known: DataFrame, tolerance: int = 3) -> DataFrame:
    """(a, b), a < b: pairs of rows that the fingerprints (row, fp) link: each row with the first of its fingerprint, and those with each other."""
    own = stored(known.groupBy("fp").agg(F.min("row").alias("first_row"), F.count("*").alias("n")))
    same = looked_up(known.select("row", "fp"), own.where("n > 1"), ["fp"], "n").where("row > first_row").select(F.col("first_row").alias("a"), F.col("row").alias("b"))
    ends = [own.select(F.col("fp").alias(side), F.col("first_row").alias(f"row_{side}")) for side in "uv"]
    linked = near_links(own.select("fp"), tolerance).distinct().join(ends[0], "u").join(ends[1], "v")
    return same.unionByName(linked.select(F.least("row_u", "row_v").alias("a"), F.greatest("row_u", "row_v").alias("b")))


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, all its columns, with one row of each group of texts that are similar: that of the smallest doc_id (a null doc_id comes last).

    All pairs of that similarity or more are linked, and no others; every link is verified on the whole sets of
    shingles. Equal sets are linked by their digest, near ones by their fingerprints and the pivot table. What is left
    are pairs of different groups: two such texts share one of their first shingles. Where two texts are the only ones of
    a shingle, as most are, they are a pair at once. So that many copies of a text don't bring all their pairs together,
    the rows of other shingles are held against the first of them; then all pairs of rows that aren't in one group by then. Texts without words are similar to each other.
    """
    rows = numbered(docs)
    with scratch(docs.sparkSession) as kept:
        dropped = kept(all_but_first(rows, similar_groups(rows.select("row", "text"), shingle, similarity)))
    return without(rows, dropped)


def similar_groups(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(row, root) of rows (row, text) that ``drop_similar`` groups; roots themselves aren't listed."""
    known = stored(first_shingles(texts, shingle, similarity, shingle_frequencies(texts, shingle)))
    sets = stored(known.groupBy("digest").agg(F.min("row").alias("v"), F.count("*").alias("n")))
    equal = stored(looked_up(known.select("row", "digest"), sets.where("n > 1"), ["digest"], "n").where("row > v").select(F.col("row").alias("u"), "v"))
    single = known.join(sent_if_small(equal.select(F.col("u").alias("row"))), "row", "left_anti")

    def verified(pairs: DataFrame) -> DataFrame:
        possible = stored(possible_pairs(pairs, known.select("row", "n", "sketch"), similarity))
        return similar_pairs(texts, possible, shingle, similarity).select(F.col("b").alias("u"), F.col("a").alias("v"))

    def groups(links: DataFrame) -> DataFrame:
        return roots(links).select(F.col("u").alias("row"), F.col("v").alias("root"))

    lists, several = repeats(single)
    alone, shared = stored(two_alone(several, similarity)), stored(shared_by(2, lists, several))
    drop_shuffles(texts.sparkSession)
    tried = stored(fingerprint_pairs(single).unionByName(led_pairs(shared, similarity)).unionByName(alone.select("a", "b")).distinct())
    links = stored(verified(tried))
    drop_shuffles(texts.sparkSession)
    rest = stored(sharing_pairs(shared, known.select("row", "sketch"), groups(links), similarity, alone=alone).join(tried, ["a", "b"], "left_anti"))
    drop_shuffles(texts.sparkSession)
    return groups(stored(links.unionByName(verified(rest)).unionByName(equal)))


def all_but_first(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The row numbers of each group (row, root; roots themselves aren't listed) but for that of its smallest doc_id, nulls last."""
    members = groups.unionByName(groups.select(F.col("root").alias("row"), "root").distinct())
    ranked = stored(members.join(rows.select("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("place")), "row"))
    firsts = stored(ranked.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    return looked_up(ranked, firsts, ["root"], "n").where("place <> first").select("row")


def drop_near_duplicates(docs: DataFrame, shingle: int, tolerance: int = 3) -> DataFrame:
    """``docs``, all its columns, with one row of each component of ``near_duplicates``: that of the smallest doc_id (a null doc_id comes last)."""
    rows = numbered(docs)
    with scratch(docs.sparkSession) as kept:
        known = stored(fingerprints(rows, shingle))
        links = stored(fingerprint_pairs(known, tolerance).select(F.col("b").alias("u"), F.col("a").alias("v")))
        dropped = kept(all_but_first(rows, roots(links).select(F.col("u").alias("row"), F.col("v").alias("root"))))
    return without(rows, dropped)
