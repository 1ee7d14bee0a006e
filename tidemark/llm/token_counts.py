"""Token counts without token ids.

A pre-token is a part of a text that the tokenizer encodes by itself.  One pass counts the distinct pre-tokens of all
documents; each is encoded once, and only its number of pieces is kept.  A second pass joins these numbers to every
document's pre-token frequencies: those of the ``TOP`` most frequent pre-tokens, a fixed bound, are broadcast; the other
frequencies are rows (document, pre-token, times) that are joined on the pre-token and added up.  Texts and ids are
never shuffled.

What may be parted is read from the tokenizer's file.  Where the file is of no known form, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, schema_of, ship, shipped, table
from .packing import _BREAK

#: Pre-tokens whose numbers of pieces are broadcast, and words whose numbers a Python worker keeps.
TOP, KEPT = 2**18, 200_000
#: Distinct words that a task counts before it hands its counts on.
FLUSH = 200_000
#: Texts that the library encodes in one call.
GROUP = 8_192
# The pattern of a tokenizer file that parts texts into words and drops white space, and what it finds in
# lower-case ASCII.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(r"[\x21-\x7e]+")


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """The number of pieces of each text, by the library that the file is for; special strings as its default."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    return lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]


def parting(path: str) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]] | None:
    """How the tokenizer of a file lets texts be parted: a text into words, and a word into pre-tokens; None: not at all.

    A file that drops white space (the pattern ``WORDS``) parts at white space, since nothing is joined across it; words
    of printable ASCII without added tokens are parted by the pattern itself, others stay whole, as what Unicode
    normalisation makes of them is up to the library.  Byte-level BPE parts before a space that follows a non-space.
    A text with an added token's string stays whole in byte-level BPE.
    """
    if path.endswith(".model"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, spec["model"]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    added = [x["content"] for x in spec["added_tokens"]]
    if any(x.get(k) for x in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) or any(re.search(r"\s", x) for x in added):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        whole = re.compile("|".join(map(re.escape, added))).search if added else lambda t: None
        return (lambda t: [t] if whole(t) else _BREAK.split(t)), (lambda w: [w])
    first, *rest = pre.get("pretokenizers") or [{}]
    steps = norm.get("normalizers") or []
    dropped = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORDS} and first.get("behavior") == "Removed" and first.get("invert")
    plain = [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": "\\s+"}, " ")
    if not (dropped and plain and [x.get("type") for x in rest] == ["ByteLevel"] and not rest[0].get("use_regex") and not rest[0].get("add_prefix_space")):
        return None

    def parts(word: str) -> list[str]:
        if not _PLAIN.fullmatch(word) or any(x in word for x in added):
            return [word]
        return ASCII_WORDS.findall(word.lower())

    return (lambda t: [w.decode() for w in t.encode().split()]), parts


def _pre_tokens(path: str):
    """Over (text): (unit, n), how often each pre-token occurs in a part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, parts = parting(path)
        seen: Counter[str] = Counter()

        def handed() -> Iterator[pa.RecordBatch]:
            units: Counter[str] = Counter()
            for w, n in seen.items():
                for u in parts(w):
                    units[u] += n
            keys, values = list(units), list(units.values())
            for at in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000], pa.string()), pa.array(values[at : at + 50_000], pa.int64())], ["unit", "n"])
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py() or ""))
                if len(seen) > FLUSH:
                    yield from handed()
        yield from handed()

    return run


def _summed(path: str, shared):
    """Over (row, id, text): (row, id, n_bytes, n) with the pieces of the broadcast pre-tokens, and (row, unit, times)
    for the others."""
    names = ["row", "id", "n_bytes", "n", "unit", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, parts = parting(path)
        pieces: dict[str, int] = shipped(shared)
        kept: dict[str, tuple[int, tuple[str, ...]]] = {}

        def worth(word: str) -> tuple[int, tuple[str, ...]]:
            units = parts(word)
            found = (sum(pieces.get(u, 0) for u in units), tuple(u for u in units if u not in pieces))
            if len(kept) >= KEPT:
                kept.clear()
            kept[word] = found
            return found

        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                sizes, sums, where, units, times = [], [], [], [], []
                for row, value in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    text, total = value.as_py() or "", 0
                    rare: Counter[str] = Counter()
                    for word, n in Counter(split(text)).items():
                        own, others = kept.get(word) or worth(word)
                        total += n * own
                        for u in others:
                            rare[u] += n
                    sizes.append(len(text.encode()))
                    sums.append(total)
                    where += [row] * len(rare)
                    units += rare
                    times += rare.values()
                n, k = len(batch), len(where)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], names)
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.nulls(k, batch.schema.field(1).type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(units, pa.string()), pa.array(times, pa.int32())], names)

    return run


def _counted(path: str):
    """Over (unit, c): with the unit's number of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(path)
        for batch in batches:
            for at in range(0, len(batch), GROUP):
                part = batch.slice(at, GROUP)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(count(part.column(0).to_pylist()), pa.int64())], ["unit", "c", "pieces"])

    return run


def most_frequent(counted: DataFrame, top: int) -> dict[str, int]:
    """Pieces of the most frequent of (unit, c, pieces), ``top`` at most: all whose count reaches a step of a fine
    logarithmic scale."""
    step = F.floor(F.log2("c") * 16).cast("int")
    least, room = None, top
    for k, n in sorted(counted.groupBy(step.alias("k")).count().collect(), reverse=True):  # a thousand rows at most
        if n > room:
            break
        least, room = k, room - n
    return {} if least is None else dict(counted.where(step >= least).select("unit", "pieces").collect())


def _whole(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(path)
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = count(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, top: int = TOP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``, over whole texts.

    A null text counts as empty: 0 bytes, 0 tokens.  Null ids and repeated rows keep their rows, extra columns are
    dropped whatever their names, an empty table gives an empty result.  With a tokenizer file whose texts can't be
    parted (see ``parting``), such as a sentencepiece model, each text is encoded as a whole.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    if parting(tokenizer_path) is None:
        result = schema_of(rows, "id", more="n_bytes long, n_tokens long, over_limit boolean")
        return rows.mapInArrow(_whole(tokenizer_path, limit), result).withColumnRenamed("id", id_col)
    units = rows.select("text").mapInArrow(_pre_tokens(tokenizer_path), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("c"))
    counted = table(units.mapInArrow(_counted(tokenizer_path), "unit string, c long, pieces long"))
    shared = ship(docs.sparkSession, most_frequent(counted, top))
    stream = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    both = table(stream.mapInArrow(_summed(tokenizer_path, shared), schema_of(stream, "row", "id", more="n_bytes long, n long, unit string, times int")))
    rare = both.where("unit is not null").select("row", "unit", "times")
    late = rare.join(counted.select("unit", "pieces"), "unit").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    out = both.where("unit is null").select("row", "id", "n_bytes", "n").join(late, "row", "left")
    tokens = F.col("n") + F.coalesce("more", F.lit(0))
    return out.select(F.col("id").alias(id_col), "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
