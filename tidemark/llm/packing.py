"""Best-fit packing with certified repacking.

Documents become token ids plus an end id; only those longer than a sequence are cut.  Pieces are dealt to partitions,
each packs its own by best-fit decreasing, and dual-feasible functions give a lower bound of its number of bins.  A
partition whose bins meet the bound and are full is done.  Others hand their emptiest bins' pieces over to fewer, mixed
partitions, which pack anew, until one partition packs the rest or the corpus-wide bound is met.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh, rows_per_partition, schema_of, table

#: Distinct words whose ids a Python worker keeps; beyond it the table starts anew, which costs time only.
KEPT = 300_000
#: Pieces that one task packs together.
EACH = 100_000
#: A certified partition hands over at most one bin in this many, the emptiest; one above its bound, one in two.
SHARE = 16
#: The bits that the end id and the piece columns take in the pieces' schema.
PIECES = "piece int, start long, length long, ids_crc32 long"
_RUN = re.compile(r"\s\s")
_BREAK = re.compile(r"(?<=\S)(?= )")


def byte_encoder(path: str) -> Callable[[str], bytes]:
    """A function giving a text's token ids as little-endian 32-bit words, equal to the tokenizer file's own library.

    Byte-level BPE breaks a text before each space that follows a non-space, so ids are found once per distinct word
    with its leading space.  The file's vocabulary serves as merge ranks if it has the merges' order; texts with added-token strings, and files
    of any other kind, go through the file's own library as a whole.
    """
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    def whole(text: str) -> bytes:
        return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not (plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")):
        return whole
    import public_tokenizers
    import tiktoken

    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in made or any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return whole  # the vocabulary's order isn't the merges'
    shown = _byte_letters()
    ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    special = re.compile("|".join(map(re.escape, added))) if added else None
    kept: dict[str, bytes] = {}

    def ids(text: str) -> bytes:
        return array("I", encode(text)).tobytes()

    def fill(words: list[str]) -> None:
        new = set(words).difference(kept)
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = set(words)
        kept.update((w, ids(" " + w)) for w in new)

    def run(text: str) -> bytes:
        if special and special.search(text):
            return whole(text)
        if _RUN.search(text):
            first, *words = _BREAK.split(text)
            words = [w[1:] for w in words]
        else:
            first, *words = text.split(" ")
        try:
            found = [kept[w] for w in words]
        except KeyError:
            fill(words)
            found = [kept[w] for w in words]
        return b"".join((ids(first), *found))

    return run


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE's letters: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): a document's ids and the end id, cut only if they exceed
    ``capacity``; then every piece but the first is full.  A null text counts as empty: one piece, the end id."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    data = encode(text or "") + end
                    n, start, k = len(data) // 4, 0, 0
                    size = (n % capacity or capacity) if n > capacity else n
                    while start < n:
                        own = data[4 * start : 4 * (start + size)]
                        rows.append((i, k, start, size, zlib.crc32(own), own if keep_ids else None))
                        start, size, k = start + size, capacity, k + 1
                where, *cols, own_ids = zip(*rows, strict=True)
                out = [part.column(0).take(pa.array(where, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                yield pa.RecordBatch.from_arrays(out + [pa.array(own_ids, pa.binary())] * keep_ids, names)

    schema = schema_of(docs, id_col, more=PIECES + ", ids binary" * keep_ids)
    names = [f"c{i}" for i in range(len(schema))]
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below, the best of two families of dual-feasible functions over the
    distinct lengths: thresholds (long items count as full, short ones not at all) and rounding in k-ths."""
    if not len(lengths):
        return 0
    size, n = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    return _bound(size, n, capacity)


def _bound(size: np.ndarray, n: np.ndarray, capacity: int) -> int:
    best = -(-int((size * n).sum()) // capacity)
    full, own = np.cumsum(n[::-1])[::-1], np.cumsum(size * n)
    for t in size[size * 2 <= capacity]:
        low, high = np.searchsorted(size, t), np.searchsorted(size, capacity - t, "right")
        big = int(full[high]) if high < len(size) else 0
        middle = int(own[high - 1] - (own[low - 1] if low else 0))
        best = max(best, big + -(-middle // capacity))
    for k in range(1, 21):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, size * k, (k + 1) * size // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's filled length.  Open bins lie in stacks by
    free space, and one integer's bits say which stacks hold any, so a fit is found in constant time."""
    order = np.argsort(-lengths, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, filled, mask = [0] * len(lengths), [0] * len(lengths), [], 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = mask >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(filled), capacity
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if free > size:
            stacks[free - size].append(b)
            mask |= 1 << (free - size)
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(filled, np.int64)


def _pack(at_length: int, capacity: int, round_: int, last: bool, share: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows.column(at_length).to_numpy().astype(np.int64)
        bins, offsets, filled = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        open_ = np.zeros(len(filled), bool)
        if not last:  # bins are handed over while they hold free space: it adds up between certified partitions too
            loose = np.flatnonzero(filled < capacity)
            loose = loose[np.argsort(filled[loose], kind="stable")]
            open_[loose[: max(4, len(filled) // (2 if len(filled) > bound else share))]] = True
        base = ((round_ << 20) + TaskContext.get().partitionId()) << 32
        more = [pa.array(base + bins), pa.array(offsets), pa.array(open_[bins]), pa.array(np.full(len(bins), len(filled) - bound))]
        for b in pa.Table.from_arrays([*rows.columns, *more], names=names).to_batches(max_chunksize=20_000):
            yield b

    return run


def pack(items: DataFrame, *, length_col: str = "length", capacity: int = 1024, each: int = EACH, max_rounds: int = 12, share: int = SHARE) -> DataFrame:
    """The rows of ``items`` with (sequence_id, offset, gap): offsets are gapless from 0 in each sequence, and
    ``gap`` is by how many bins the row's partition stood above its certified lower bound (0: proven optimal there).

    Every row is packed once, equal rows too; ``items`` should be a stored table, as rows are dealt by their places.  Lengths must lie in 1..capacity; a null or other length is an error.
    An empty table gives an empty result.
    """
    bad = items.where(f"`{length_col}` is null or `{length_col}` < 1 or `{length_col}` > {capacity}")
    if not bad.isEmpty():
        raise ValueError(f"lengths must lie in 1..{capacity}")
    spark = items.sparkSession
    more = "sequence_id long, offset long, _open boolean, gap long"
    schema = schema_of(items, *items.columns, more=more)
    names = [f.name for f in schema]
    sizes = items.groupBy(F.col(length_col).cast("long").alias("size")).count().orderBy("size").collect()  # capacity rows at most
    goal = _bound(np.array([r[0] for r in sizes], np.int64), np.array([r[1] for r in sizes], np.int64), capacity) if sizes else 0
    left, rest = sum(r[1] for r in sizes), items
    done, bins = [], 0
    for round_ in range(max_rounds):
        parts = rows_per_partition(spark, left, each) if round_ == 0 else max(1, -(-left // each))
        last = parts == 1 or round_ == max_rounds - 1
        [place] = fresh(items, "_place")  # so that equal rows are dealt to different tasks
        dealt = rest.withColumn(place, F.xxhash64(*[col(c) for c in items.columns], F.monotonically_increasing_id()))
        dealt = dealt.repartition(parts, F.xxhash64(place, F.lit(round_))).drop(place)
        run = _pack(items.columns.index(length_col), capacity, round_, last, share, names)
        packed = table(dealt.mapInArrow(run, schema))
        made, loose = packed.agg(F.sum(F.when(F.col("offset") == 0, 1)), F.sum(F.when(F.col("offset") == 0, F.col("_open").cast("int")))).first()
        bins += made or 0
        if last or bins <= goal:  # nothing is left to mix with, or the corpus-wide bound is met
            done.append(packed)
            break
        done.append(packed.where("not _open"))
        bins -= loose or 0
        rest = packed.where("_open").select(*items.columns)
        left = rest.count()
        if not left:
            break
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.drop("_open")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, each: int = EACH) -> DataFrame:
    """Documents cut into pieces and packed: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset, gap).
    Full pieces are sequences of their own.  Null texts count as empty, repeated rows are packed as often as they
    occur, and extra columns are dropped."""
    cut_up = table(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids))
    short = pack(cut_up.where(f"length < {capacity}"), capacity=capacity, each=each)
    full = cut_up.where(f"length = {capacity}")
    full = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"))
    return short.unionByName(full)
