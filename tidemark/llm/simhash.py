"""SimHash near-duplicate detection by a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two bits.  The embedding holds each segment's number of set bits, so
the Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints.  The range join works on
a grid: the segments form ``bands``; if two embeddings are within ``distance``, at least ``bands - distance`` bands are
equal, so every pair within range shares a cell of some grid over that many bands.  Cells are sorted runs; inside a run
the lower bound filters pairs and the exact Hamming distance decides.  A run hands on a spanning set of its links, not
all its pairs, and a run too long for one task is dealt out in pairs of blocks.

``near_duplicates`` links fingerprints within a few bits, exactly.  ``similar_documents`` links texts whose sets of
shingles have a Jaccard similarity of 0.8 or more: such texts differ in some 39 of 256 bits, for which equal bands are
too short, so its grids are many random choices among the 128 segments of a 256-bit fingerprint; candidates within 64
bits are verified on the texts.  A node is a set of shingles, so only texts with equal sets are one node unverified.
First each text's nearest candidates are verified; then every candidate whose two texts are still in different
components and share enough shingles with any text at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, cut, fresh, schema_of, sliced, table

SEGMENTS = 32
#: 64-bit words of a wide fingerprint; a grid's random segments are drawn from all of them.
WORDS = 4
#: Bits of a wide fingerprint in which candidates may differ.  At a similarity of 0.8 the mean is 39, the deviation 6.
DISTANCE = 64
#: The bits of a cell that hold its grid.
_GRID = np.uint64(0xFFFF)
_WIDE = [f"w{j}" for j in range(WORDS)]
_LOW = np.uint64(0x5555555555555555)
#: Runs up to this length are compared by shifting whole arrays, longer ones by a search from pivots.
SHIFTS = 12
#: Runs over this length leave their task and are dealt out in pairs of blocks.
RUN_LIMIT = 50_000
BLOCK = 8_192
#: Edges of a partition between rounds of components; partitions grow with the edges, and few edges make few files.
EDGES_EACH = 200_000
#: Distances that a task computes at a time.
PAIRS_AT_ONCE = 100_000
#: Texts of up to so many distinct shingles have an exact way to candidates besides the random grids.
SHORT = 80


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of one UTF-8 text over word shingles, repeats included; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts, n = [b" ".join(words)], 1
    else:
        parts, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, n)
    return int(np.packbits(bit_totals(hashes) * 2 > n, bitorder="little").view("<u8")[0])


def wide_fingerprint(text: bytes, shingle: int) -> np.ndarray:
    """A SimHash of ``WORDS`` 64-bit words over a text's distinct shingles, as the Jaccard similarity counts them; the
    words after the first come from remixed hashes.  No words: zeros."""
    return _wide_of(_distinct_hashes(text, shingle))


def _distinct_hashes(text: bytes, shingle: int) -> np.ndarray:
    parts = shingles(text, shingle)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))


def _wide_of(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    more = [_mix(hashes + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)) for j in range(1, WORDS)]
    totals = bit_totals(np.stack([hashes, *more], axis=1))
    return np.packbits(totals * 2 > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def set_hash(hashes: np.ndarray) -> np.uint64:
    """One number for a set of hashes, in whatever order they come."""
    total = _mix(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return _mix(np.array([total + np.uint64(len(hashes))], np.uint64))[0]


def bit_totals(hashes: np.ndarray) -> np.ndarray:
    """For each bit of 64-bit hashes, or of rows of several, in how many it is set."""
    width = 8 * hashes.itemsize * (hashes.shape[1] if hashes.ndim > 1 else 1)
    totals = np.zeros(width, np.int64)
    for at in range(0, len(hashes), 16_384):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 16_384]).view(np.uint8).reshape(-1, width // 8), axis=1, bitorder="little")
        whole = len(bits) // 128 * 128
        totals += bits[:whole].reshape(-1, 128, width).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        totals += bits[whole:].sum(axis=0, dtype=np.int64)
    return totals


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, wide: bool = False) -> DataFrame:
    """(id, fp long, text_hash long) for every row; a null text counts as no words.  Other columns are dropped.  With
    ``wide``, ``fp`` names the text's set of distinct shingles, the words of a fingerprint over that set follow (w0 long,
    ...) and, of texts of up to ``SHORT`` distinct shingles, the shingles' hashes (short binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["id", "fp", "h"])

    def run_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary())
            hashes = [_distinct_hashes(t.as_py() or b"", shingle) for t in texts]
            words = np.array([_wide_of(h) for h in hashes], np.uint64).reshape(-1, WORDS)
            short = pa.array([h.astype("<u8").tobytes() if len(h) <= SHORT else None for h in hashes], pa.binary())
            fps = np.fromiter(map(set_hash, hashes), np.uint64, len(batch))
            every = [pa.array(np.ascontiguousarray(words[:, j]).view(np.int64)) for j in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2), *every, short], ["id", "fp", "h", *_WIDE, "s"])

    rows = docs.select(col(id_col), col(text_col), F.xxhash64(col(text_col)).alias("text_hash"))
    more = "".join(f", {w} long" for w in _WIDE) + ", short binary" if wide else ""
    schema = schema_of(docs, id_col, more="fp long, text_hash long" + more)
    return rows.mapInArrow(run_wide if wide else run, schema)


def embedding(fps: np.ndarray) -> np.ndarray:
    """Two-bit fields, each holding its segment's number of set bits."""
    return (fps & _LOW) + ((fps >> np.uint64(1)) & _LOW)


def unary(codes: np.ndarray) -> np.ndarray:
    """The embedding with counts 0, 1, 2 as 00, 01, 11, so that differing bits are the Manhattan distance."""
    return codes | ((codes >> np.uint64(1)) & _LOW)


def grids(bands: int, distance: int) -> list[np.uint64]:
    """A mask of two-bit fields for each choice of ``bands - distance`` bands."""
    ends = np.linspace(0, SEGMENTS, bands + 1).round().astype(int)
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(ends, ends[1:], strict=False)]
    return [np.uint64(sum(x)) for x in combinations(masks, bands - distance)]


def random_grids(tables: int, picks: int, seed: int = 11) -> list[np.ndarray]:
    """Masks, each of ``WORDS`` words, of ``picks`` random segments among all of a wide fingerprint's."""
    rng = np.random.default_rng(seed)
    chosen = [np.zeros(WORDS * SEGMENTS, np.uint64) for _ in range(tables)]
    for own in chosen:
        own[rng.choice(len(own), picks, replace=False)] = 3
    return [(own.reshape(WORDS, SEGMENTS) << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for own in chosen]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ; the words of one lie along the last axis."""
    total = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16)
    for j in range(1, a.shape[-1]):
        total += np.bitwise_count(a[..., j] ^ b[..., j])
    return total


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Where fingerprints, rows of words, are within ``distance``: first the lower bound, then the exact count for what
    is left."""
    hit = differing(unary(embedding(a)), unary(embedding(b))) <= distance
    if hit.any():
        where = np.flatnonzero(hit)
        x, y = (v if len(v) == 1 else v[where] for v in (a, b))
        hit[where] = differing(x, y) <= distance
    return hit


def spanning_links(fps: np.ndarray, words: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Links that connect what is connected among ``fps``, by a search from pivots; each fingerprint is a pivot once
    and looks only at those not reached yet, so a dense group costs about as many steps as it has members.  Arrays of
    two columns."""
    left, first = np.unique(fps, return_index=True)
    words = words[first]
    while len(left):
        root, front = left[0], [words[:1]]
        left, words = left[1:], words[1:]
        while front and len(left):
            hit = near(words, front.pop(), distance)
            if hit.any():
                reached = left[hit]
                front.extend(words[hit][:, None, :])
                yield np.stack([np.full(len(reached), root), reached], axis=1)
                left, words = left[~hit], words[~hit]


def nearest_links(fps: np.ndarray, words: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """For each fingerprint its nearest other within ``distance``, as (a, b, gap).  What this leaves out,
    ``across_links`` finds."""
    fps, first = np.unique(fps, return_index=True)
    words = words[first]
    step = max(1, PAIRS_AT_ONCE // max(1, len(fps)))
    for at in range(0, len(fps) if len(fps) > 1 else 0, step):
        gap = differing(words[at : at + step, None], words[None])
        own = np.arange(len(gap))
        gap[own, at + own] = 65_535
        best = gap.argmin(axis=1)
        gap = gap[own, best]
        hit = np.flatnonzero(gap <= distance)
        if len(hit):
            yield np.stack([fps[at + hit], fps[best[hit]], gap[hit].astype(np.uint64)], axis=1)


def across_links(fps: np.ndarray, words: np.ndarray, more: tuple[np.ndarray, ...], distance: int, least: float) -> Iterator[np.ndarray]:
    """All pairs of fingerprints within ``distance`` whose ``more`` (root, size, shared; see ``may_link``) lets them
    link, as arrays of (place of a, place of b, gap, what the two share with others).  ``fps`` are sorted, without
    repeats."""
    if len(fps) < 2 or (more[0] == more[0][0]).all():
        return
    step = max(1, PAIRS_AT_ONCE // len(fps))
    for at in range(0, len(fps), step):
        hit = may_link(tuple(v[at : at + step, None] for v in more), tuple(v[None, at:] for v in more), least)
        i, j = np.nonzero(hit)
        i, j = i[j > i], j[j > i]
        for k in range(0, len(i), PAIRS_AT_ONCE):
            x, y = at + i[k : k + PAIRS_AT_ONCE], at + j[k : k + PAIRS_AT_ONCE]
            gap = differing(words[x], words[y])
            close = gap <= distance
            x, y = x[close], y[close]
            if len(x):
                yield np.stack([x, y, gap[close].astype(np.int64), more[2][x] + more[2][y]], axis=1)


class Across:
    """Links between components: all pairs that ``may_link`` leaves or, with ``best``, in a long cell for each
    fingerprint only that of the highest score.  A pair that shares several of the grids ``masks`` is found in the
    first alone."""

    def __init__(self, least: float, masks: list[np.ndarray] | None = None, best: bool = False):
        self.least, self.masks, self.best = least, masks, best

    def first(self, cells: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Where a cell is of the first grid in which the two fingerprints share one."""
        out = np.ones(len(x), bool)
        if self.masks is None or self.best:
            return out
        apart, grid = embedding(x) ^ embedding(y), cells.view(np.uint64) & _GRID
        for k, mask in enumerate(self.masks[:-1]):
            out &= (grid <= k) | (apart & mask).any(axis=1)
        return out

    def __call__(self, cells: np.ndarray, fps: np.ndarray, words: np.ndarray, more: tuple[np.ndarray, ...], distance: int) -> Iterator[np.ndarray]:
        fps, own = np.unique(fps, return_index=True)
        cells, words, more = cells[own], words[own], tuple(v[own] for v in more)
        top, partner, its_gap = np.full(len(fps), -1, np.int64), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
        for found in across_links(fps, words, more, distance, self.least):
            x, y, gap, shared = found.T
            if self.best:
                ends, others = np.concatenate((x, y)), np.concatenate((y, x))
                score = np.tile(shared * 1024 + 1023 - gap, 2)
                order = np.lexsort((score, ends))
                last = order[np.append(ends[order][1:] != ends[order][:-1], True)]
                last = last[score[last] > top[ends[last]]]
                top[ends[last]], partner[ends[last]], its_gap[ends[last]] = score[last], others[last], np.tile(gap, 2)[last]
            else:
                keep = self.first(cells[x], words[x], words[y])
                yield np.stack([fps[x], fps[y], gap.astype(np.uint64), shared.astype(np.uint64)], axis=1)[keep]
        x = np.flatnonzero(top >= 0)
        if len(x):
            y = partner[x]
            yield np.unique(np.stack([np.minimum(fps[x], fps[y]), np.maximum(fps[x], fps[y]), its_gap[x].astype(np.uint64), (more[2][x] + more[2][y]).astype(np.uint64)], axis=1), axis=0)


def may_link(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], least: float) -> np.ndarray:
    """Where two texts have different roots and may reach a Jaccard similarity of ``least``: of a text's ``size``
    distinct shingles only ``shared`` occur in any other, so two texts have at most the smaller ``shared`` in common."""
    both = np.minimum(x[2], y[2])
    return (x[0] != y[0]) & (both >= least * (x[1] + y[1] - both))


def _cells(masks: list[np.uint64]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            codes = embedding(fps)
            for k, mask in enumerate(masks):
                cells = _mix((codes & mask) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), batch.column(0)], ["cell", "fp"])

    return run


def wide_cells(wide: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th grid's cell of each wide fingerprint, a row of words; its lowest bits are ``k``."""
    cells = np.full(len(wide), (k + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for j in np.flatnonzero(mask):
        cells = _mix(cells + (embedding(wide[:, j]) & mask[j]))
    return (cells & ~_GRID) | np.uint64(k)


def _wide(masks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in _WIDE], axis=1)
            for k, mask in enumerate(masks):
                cells = pa.array(wide_cells(wide, mask, k).view(np.int64))
                yield pa.RecordBatch.from_arrays([cells, *batch.columns], ["cell", *batch.schema.names])

    return run


def _inside(cells: np.ndarray, fps: np.ndarray, words: np.ndarray, more: tuple[np.ndarray, ...], distance: int, some) -> Iterator[np.ndarray]:
    """Links of a run, which is a cell's, or of two blocks of one, as arrays."""
    return some(cells, fps, words, more, distance) if isinstance(some, Across) else some(fps, words, distance)


def _parted(own: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Columns (fp, words..., more...) as fingerprints, rows of words, and the rest.  Without words fp is the word."""
    fps = own[0].view(np.uint64)
    words = np.stack([w.view(np.uint64) for w in own[1 : 1 + width]], axis=1) if width else fps[:, None]
    return fps, words, own[1 + width :]


def _sweep(distance: int, limit: int, some, width: int):
    """Over rows (cell, fp, ``width`` words, ...) sorted by cell: links inside each cell as (a, b, score, null); rows of
    too long runs as (null, fp, null, cell)."""

    def found(cells: np.ndarray, *own: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, words, more = _parted(list(own), width)
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        sizes = np.diff(np.append(starts, len(cells)))
        short = np.repeat(sizes <= SHIFTS + 1, sizes)
        for lag in range(1, min(SHIFTS, int(sizes.max()) - 1) + 1):
            i = np.flatnonzero((cells[lag:] == cells[:-lag]) & short[lag:])
            if more:
                i = i[may_link(tuple(v[i] for v in more), tuple(v[i + lag] for v in more), some.least)]
            i = i[near(words[i], words[i + lag], distance)] if len(i) else i
            i = i[some.first(cells[i], words[i], words[i + lag])] if more and len(i) else i
            if len(i):
                yield _links(fps[i], fps[i + lag], differing(words[i], words[i + lag]), more[2][i] + more[2][i + lag] if more else 0)
        for k in np.flatnonzero(sizes > SHIFTS + 1):
            part = slice(starts[k], starts[k] + sizes[k])
            for x in _inside(cells[part], fps[part], words[part], tuple(v[part] for v in more), distance, some):
                yield _links(*np.ascontiguousarray(x.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        long_cell = None
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if long_cell is not None:  # still inside a run that is dealt out
                same = int(np.searchsorted(own[0] != long_cell, True))
                if same:
                    yield _deferred(own[0][:same], own[1][:same])
                if same == len(own[0]):
                    continue
                own, long_cell = [v[same:] for v in own], None
            held = [np.concatenate(v) for v in zip(held, own, strict=True)] if held else own
            cells = held[0]
            last = int(np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))[-1]) if len(cells) else 0
            if last:
                yield from found(*(v[:last] for v in held))
                held = [v[last:] for v in held]
            if len(held[0]) > limit:
                yield _deferred(held[0], held[1])
                long_cell, held = held[0][0], []
        if held and len(held[0]):
            yield from found(*held)

    return run


def _links(a: np.ndarray, b: np.ndarray, gap: np.ndarray | int = 0, shared: np.ndarray | int = 0) -> pa.RecordBatch:
    """Links with a score: more shared shingles first, then fewer differing bits."""
    score = np.broadcast_to(np.asarray(shared).astype(np.int64) * 1024 - np.asarray(gap).astype(np.int64), a.shape)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(score), pa.nulls(len(a), pa.int64())], ["a", "b", "score", "cell"])


def _deferred(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(fps), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(fps), none, pa.array(cells)], ["a", "b", "score", "cell"])


def links(fps: DataFrame, *, distance: int = 4, bands: int = 7, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Distinct links (a, b) between the distinct fingerprints of column ``fp``: whatever is connected by pairs
    within ``distance`` is connected by them.  Empty input: no rows."""
    cells = fps.select("fp").distinct().mapInArrow(_cells(grids(bands, distance)), "cell long, fp long")
    return _grid_join(cells, distance, run_limit, spanning_links).select("a", "b")


def _grid_join(cells: DataFrame, distance: int, run_limit: int, some, known: DataFrame | None = None) -> DataFrame:
    """Distinct links (a, b, score) within ``distance`` between fingerprints that share a cell of (cell, fp, ...).

    Other columns of ``cells`` are those of ``known`` (fp, words, ...), one row for each fp; without it fp is the word.
    In long cells the links are those that the function ``some`` chooses.  If ``some`` is an ``Across``, ``known`` has
    the columns root, size and shared after the words, and in short cells too only pairs that ``may_link`` are links.
    """
    spark = cells.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [] if known is None else [c for c in known.columns if c != "fp"]
    width = sum(c in _WIDE for c in names)
    dealt = cells.select("cell", "fp", *names).repartition(n, "cell").sortWithinPartitions("cell", "fp")
    swept = table(dealt.mapInArrow(_sweep(distance, run_limit, some, width), "a long, b long, score long, cell long"))
    direct = swept.where("cell is null").select("a", "b", "score")
    late = swept.where("cell is not null").select("cell", F.col("b").alias("fp"))
    sizes = late.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    if not sizes.isEmpty():
        late = late if known is None else late.join(known, "fp")
        dealt = late.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("blocks", "own", "other")

        def block(t: pa.Table) -> pa.Table:
            fps, words, more = _parted([t.column(c).to_numpy() for c in ["fp", *names]], width)
            found = list(_inside(t.column("cell").to_numpy(), fps, words, tuple(more), distance, some))
            batches = [_links(*np.ascontiguousarray(x.T)) for x in found]
            return pa.Table.from_batches(batches or [_links(*np.empty((2, 0), np.uint64))]).drop_columns("cell")

        direct = direct.union(dealt.groupBy("cell", "x", "y").applyInArrow(block, "a long, b long, score long"))
    return direct.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct()


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) by alternating large and small stars: (node, root) for every node of an edge
    that isn't its component's smallest.  Each half round is cut, and its minima are, so hub nodes' rows can be split."""

    def smallest(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts))

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    parts = max(8, -(-before[0] // EDGES_EACH))
    for _ in range(max_rounds if before[0] else 0):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = smallest(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large.coalesce(parts))
        least = smallest(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct().coalesce(parts))
        after = state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    if before[0]:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, bands: int = 7, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(id, fingerprint, component_id, text_hash), one row for each row of ``docs``.

    ``component_id`` is the smallest id among the documents reachable over links of fingerprints that differ in at
    most ``distance`` bits.  Equal fingerprints are one node, so copies are never expanded into pairs.  A null text
    has no words and the fingerprint zero, as an empty one has; null ids keep their rows and never name a component
    unless all its ids are null.  Repeated rows stay repeated.  An empty table gives an empty result.
    """
    rows = table(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle).withColumnRenamed(id_col, "id"))
    out = _classes(rows, links(rows, distance=distance, bands=bands, run_limit=run_limit))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def _classes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (id, fp, ...) with their component under ``edges`` between fingerprints: its smallest fingerprint (root),
    which names it alone, and its smallest id (component_id), which is null or another's too where ids are."""
    first = table(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = stars(edges)
    rooted = first.join(roots, first.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return rows.join(cut(rooted.join(named, "root").select("fp", "root", "component_id")), "fp")


def shingles(text: bytes, size: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _similar(size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            keep = []
            for s, t in zip(x, y, strict=True):
                s, t = shingles(s.as_py() or b"", size), shingles(t.as_py() or b"", size)
                both = len(s & t)
                keep.append(both >= least * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = DISTANCE, tables: int = 150, picks: int = 11, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(id, component_id, text_hash), one row for each row of ``docs``: components of texts whose sets of word
    shingles have a Jaccard similarity of ``similarity`` or more.

    Texts with equal sets are one node.  Candidates share a cell of one of ``tables`` random grids and differ in at most
    ``distance`` of 256 bits; a pair of texts just at 0.8 shares a cell with a probability over 0.9, one at 0.9 nearly
    always.  Texts of up to ``SHORT`` distinct shingles are also candidates if they share one of their rarest shingles,
    which leaves out none of their pairs at ``similarity``.  A candidate is verified exactly.  First each node's nearest
    candidates are verified, then those with most shingles that other texts have too; a last pass over the grids
    verifies all candidates that are still in different components, but for those whose counts of shingles that no
    other text has already show that they stay under ``similarity``.  So none that could join two components is left
    out.  Nulls, repeated rows and empty tables as in ``near_duplicates``; other columns are dropped.
    """
    found = _similar_classes(docs, id_col, text_col, shingle, similarity, distance, tables, picks, run_limit)
    return found.select(F.col("id").alias(id_col), "component_id", "text_hash")


def _similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = DISTANCE, tables: int = 150, picks: int = 11, run_limit: int = RUN_LIMIT) -> DataFrame:
    """The rows of ``similar_documents`` as (id, text_hash, root, component_id, ...)."""
    rows = table(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, wide=True).withColumnRenamed(id_col, "id"))
    prints, masks = rows.select("fp", *_WIDE).distinct(), random_grids(tables, picks)
    types = "".join(f", {w} long" for w in _WIDE)
    found = table(_grid_join(prints.mapInArrow(_wide(masks), "cell long, fp long" + types), distance, run_limit, nearest_links, prints))
    short = table(_short_cells(rows, similarity))
    nodes = found.select(F.col("a").alias("fp")).union(found.select("b")).union(short.select("fp")).distinct()
    pick = F.min(F.struct("id", "text_hash")).alias("p")
    picked = rows.join(nodes, "fp").groupBy("fp").agg(pick).select("fp", F.col("p.id").alias("_i"), F.col("p.text_hash").alias("_h"))
    own = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text"), F.xxhash64(col(text_col)).alias("_hash"))
    texts = own.join(cut(picked), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).groupBy("fp").agg(F.first("_text").alias("t"))
    texts = table(texts)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(texts.select(F.col("fp").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("fp").alias("b"), F.col("t").alias("y")), "b")
        return table(pairs.select("a", "b", "x", "y").mapInArrow(_similar(shingle, similarity), "a long, b long"))

    sizes = table(_sizes(texts, shingle))
    sizes = sizes.where(F.col("shared") >= similarity * F.col("size"))

    def apart(links: DataFrame, best: bool = False) -> DataFrame:
        roots = cut(stars(links)).select(F.col("node").alias("fp"), "root")
        known = sizes.join(prints, "fp").join(roots, "fp", "left")
        known = table(known.select("fp", *_WIDE, F.coalesce("root", "fp").alias("root"), "size", "shared"))
        cells = known.mapInArrow(_wide(masks), f"cell long, fp long{types}, root long, size long, shared long")
        exact = short.join(known, "fp")
        every = _grid_join(cells, distance, run_limit, Across(similarity, masks, best), known).union(_grid_join(exact, 64 * WORDS, run_limit, Across(similarity, best=best), known))
        return every.dropDuplicates(["a", "b"])

    tested = table(_best(found))
    verified = verify(tested)
    hubs = table(_best(apart(verified, best=True)).join(tested, ["a", "b"], "left_anti"))
    tested, verified = tested.union(hubs), verified.union(verify(hubs))
    verified = verified.union(verify(apart(verified).join(tested, ["a", "b"], "left_anti")))
    return _classes(rows, verified)


def _short_cells(rows: DataFrame, least: float) -> DataFrame:
    """(cell, fp), the prefixes of short texts: of n distinct shingles, the rarest first, the first n - ceil(least * n)
    + 1.  Two texts with a Jaccard similarity of ``least`` have one of them in common, so they share a cell."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(s, "<i8") for s in batch.column(1).to_pylist()]
            n = np.array([len(h) for h in own], np.int64)
            fps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(np.concatenate(own)), pa.array(np.repeat(n, n))], ["fp", "h", "n"])

    texts = rows.groupBy("fp").agg(F.min_by("short", F.struct("id", "text_hash")).alias("short")).where("short is not null")
    found = table(texts.mapInArrow(hashes, "fp long, h long, n long"))
    often = found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")  # the others are first, and no one else's
    own = found.join(often, "h").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))  # ``SHORT`` at most
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - (F.col("n") - F.size("s"))
    return own.select(F.explode(F.slice("s", F.lit(1), F.greatest(F.lit(0), first).cast("int"))).alias("x"), "fp").select(F.col("x.h").alias("cell"), "fp")


def _best(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, score), for each end that one of the highest score."""
    by_a = pairs.groupBy("a").agg(F.max(F.struct("score", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    by_b = pairs.groupBy("b").agg(F.max(F.struct("score", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    return by_a.union(by_b).distinct()


def _sizes(texts: DataFrame, size: int) -> DataFrame:
    """(fp, size, shared) of texts (fp, t): how many distinct shingles each has, and how many of them another has too."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                own = shingles(t.as_py() or b"", size)
                h = np.fromiter({xxhash.xxh64_intdigest(x) for x in own}, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), fp.as_py(), np.int64)), pa.array(h)], ["fp", "h"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(shingles(t.as_py() or b"", size)) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["fp", "size"])

    once = texts.mapInArrow(hashes, "fp long, h long").groupBy("h").agg(F.min("fp").alias("fp"), F.count("*").alias("n")).where("n = 1")
    own = once.groupBy("fp").agg(F.count("*").alias("alone"))
    every = texts.mapInArrow(counts, "fp long, size long").join(own, "fp", "left")
    return every.select("fp", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate group: the smallest (id, text hash) stays, and of
    rows equal in both exactly one.  Columns are those of ``docs``, whatever their names; groups, nulls and empty tables
    as in ``similar_documents``."""
    found = table(_similar_classes(docs, id_col, text_col, **how).select("id", "text_hash", "root"))
    best = found.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("best")).select("best.*")
    times = found.groupBy(F.col("id").alias("i"), F.col("text_hash").alias("h")).agg(F.count("*").alias("n"))
    [own] = fresh(docs, "_keep")
    key = F.struct(F.col("id"), F.col("text_hash"), F.col("n"))
    best = cut(best.join(times, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).select(key.alias(own)))
    kept = docs.join(best, col(id_col).eqNullSafe(F.col(own)["id"]) & (F.xxhash64(col(text_col)) == F.col(own)["text_hash"]))
    names = [col(c) for c in docs.columns]
    single = kept.where(F.col(own)["n"] == 1).select(*names)
    if best.where(F.col(own)["n"] > 1).isEmpty():
        return single
    return single.union(kept.where(F.col(own)["n"] > 1).withColumn(own, F.struct(F.col(own)["id"], F.col(own)["text_hash"])).dropDuplicates([own]).select(*names))
