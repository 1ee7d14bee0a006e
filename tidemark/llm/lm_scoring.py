"""Scoring of texts by a log-bilinear neural language model trained with noise-contrastive estimation.

Every token's class is predicted from the two tokens before it: the most frequent words are classes of their own, the
others share a class per ending.  A word's probability is its class's times its add-one share of the class's counts,
so the model is normalised over all training words and one unseen word per ending class.  Words that are classes of
their own grow with the vocabulary.  Word counts and the neural part come from all training texts: a bounded sample of
positions gives the neural part its start, then every partition goes over all its positions and the partitions'
parameters are averaged by their numbers of positions.

Counts of the ``TOP`` most frequent words are broadcast (a fixed bound); all other words' counts are joined to the
documents' word frequencies on the word, so nothing that grows with the corpus is held in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, id_remainder, schema_of, ship, shipped, table

#: Words whose counts are broadcast.
TOP = 2**18
#: Words that are classes of their own up to ``OWN_TYPES`` different words (see ``own_classes``), and endings that are.
OWN, ENDINGS = 800, 160
OWN_TYPES = 100_000
#: Documents and positions per document that the neural part starts from, at most (in expectation for documents).
FIT_DOCS, FIT_POSITIONS = 6_000, 64
#: Noise words per batch in the pass over all positions, which draws them far more often; their weight is the same.
PASS_NOISE = 128
#: Positions that a task shuffles and learns from at a time, and tasks that add up partitions' parameters.
CHUNK, ADDERS = 262_144, 8
DIM, NOISE, EPOCHS, BATCH, RATE = 32, 512, 4, 1024, 0.15
#: Distinct words that a task counts before it hands its counts on.
FLUSH = 300_000
END = b""  # no word is empty


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def count_words(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(word binary, c): how often each word occurs in the texts, the end of a text counting as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def handed() -> Iterator[pa.RecordBatch]:
            keys, values = list(seen), list(seen.values())
            for at in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000], pa.binary()), pa.array(values[at : at + 50_000], pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                seen.update(words_of(text.as_py()))
                if len(seen) > FLUSH:
                    yield from handed()
            seen[END] += len(batch)
        yield from handed()

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words and their counts, and the classes of all words."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray  # of the frequent words
    endings: dict[bytes, int]  # class of words beyond them; others: ``other``
    other: int
    share: np.ndarray  # per class, log10 of what a count plus one is divided by; 0 for words of their own
    noise: np.ndarray  # per class, its share of all tokens
    tokens: int
    types: int

    @property
    def start(self) -> int:  # the class before a text's first token, in contexts only
        return len(self.noise)


def vocabulary(counts: DataFrame, *, top: int = TOP, own: int = OWN, endings: int = ENDINGS) -> Vocabulary:
    tokens, types = counts.agg(F.sum("c"), F.count("*")).first()
    bucket = F.floor(F.log2("c") * 16).cast("int")
    least, room = None, top
    for b, n in sorted(counts.groupBy(bucket.alias("b")).count().collect(), reverse=True):  # a thousand rows at most
        if n > room:
            break
        least, room = b, room - n
    rows = counts.where(bucket >= least).collect() if least is not None else []
    rows = sorted(((-c, bytes(w)) for w, c in rows))
    words, n = [w for _, w in rows], np.array([-c for c, _ in rows], np.int64)
    own = min(own, len(words))
    listed = counts.select(F.expr("substr(word, -2, 2)").alias("e"), "c").groupBy("e").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # 65,793 rows at most
    mass = {bytes(e): [int(c), int(v)] for e, c, v in listed}
    for w, c in zip(words[:own], n[:own].tolist(), strict=True):
        mass[w[-2:]][0] -= c
        mass[w[-2:]][1] -= 1
    ranked = sorted((e for e in mass if mass[e][1]), key=lambda e: (-mass[e][0], e))[:endings]
    of = {e: own + i for i, e in enumerate(ranked)}
    other = own + len(ranked)
    total = np.zeros((other + 1, 2), np.int64)
    for e, (c, v) in mass.items():
        total[of.get(e, other)] += c, v
    share = np.where(np.arange(other + 1) < own, 0.0, np.log10(total.sum(axis=1) + 1.0))
    part = np.concatenate((n[:own], total[own:, 0])).astype(float) + 0.5
    classes = np.array([i if i < own else of.get(w[-2:], other) for i, w in enumerate(words)], np.int32)
    return Vocabulary(words, n, classes, of, other, share, part / part.sum(), int(tokens or 0), int(types))


def own_classes(types: int, own: int = OWN) -> int:
    """``own`` words up to ``OWN_TYPES`` types, then more by the sixth root; contexts grow with the square of it."""
    return int(own * max(1.0, types / OWN_TYPES) ** (1 / 6))


@dataclass
class LogBilinear:
    """score(class | two classes before) = (first * r[b] + second * r[a]) . t[class] + bias[class]."""

    r: np.ndarray
    first: np.ndarray
    second: np.ndarray
    t: np.ndarray
    bias: np.ndarray

    def query(self, before: np.ndarray, two_before: np.ndarray) -> np.ndarray:
        return self.first * self.r[before] + self.second * self.r[two_before]

    def normaliser(self, before: np.ndarray, two_before: np.ndarray) -> np.ndarray:
        """The log of the sum of exponentials over all classes, by matrix products over batches of contexts."""
        out = np.empty(len(before), np.float32)
        for at in range(0, len(before), 2048):
            z = self.query(before[at : at + 2048], two_before[at : at + 2048]) @ self.t.T
            z += self.bias
            top = z.max(axis=1)
            z -= top[:, None]
            np.exp(z, out=z)
            out[at : at + 2048] = top + np.log(z.sum(axis=1))
        return out

    def normalisers(self) -> np.ndarray:
        """``normaliser`` of all contexts, at two before * (classes + 1) + before: the exponential of a score is a
        factor of each word before times one of the class, so the sums are one matrix product."""
        near = (self.first * self.r).astype(np.float64) @ self.t.T.astype(np.float64) + self.bias
        far = (self.second * self.r).astype(np.float64) @ self.t.T.astype(np.float64)
        tops = near.max(axis=1), far.max(axis=1)
        near, far = (np.exp(z - top[:, None], out=z) for z, top in zip((near, far), tops, strict=True))
        out = np.empty((len(far), len(near)), np.float32)
        for at in range(0, len(far), 256):
            total = far[at : at + 256] @ near.T
            # Where the two words before favour other classes, all products may underflow.
            low = np.argwhere(total < 1e-200)
            with np.errstate(divide="ignore"):
                out[at : at + 256] = np.log(total) + tops[0] + tops[1][at : at + 256, None]
            if len(low):
                out[at + low[:, 0], low[:, 1]] = self.normaliser(low[:, 1], at + low[:, 0])
        return out.ravel()


def fit(positions: np.ndarray, noise: np.ndarray, *, dim: int = DIM, seed: int = 7) -> LogBilinear:
    """Noise-contrastive estimation over rows (two before, before, class), by Adagrad; the noise is the classes' share
    of tokens, drawn once per batch for all its rows.  Without rows the model is the noise distribution."""
    rng = np.random.default_rng(seed)
    p, past = blank(noise, dim, rng)
    for _ in range(EPOCHS):
        learn(p, past, positions, noise, rng)
    return LogBilinear(**p)


def blank(noise: np.ndarray, dim: int, rng: np.random.Generator) -> tuple[dict, dict]:
    """Parameters by name before any learning, and Adagrad's sums of squares."""
    k = len(noise)
    p = {
        "r": rng.normal(0, 0.1, (k + 1, dim)), "t": rng.normal(0, 0.1, (k, dim)),
        "first": np.ones(dim), "second": np.full(dim, 0.5), "bias": np.log(noise),
    }
    p = {n: v.astype(np.float32) for n, v in p.items()}
    return p, {n: np.full_like(v, 1e-2) for n, v in p.items()}


def learn(p: dict, past: dict, positions: np.ndarray, noise: np.ndarray, rng: np.random.Generator, drawn_each: int = NOISE) -> None:
    """One pass over all ``positions`` in random order; changes ``p`` and ``past``."""
    k = len(noise)
    offset = np.log(noise).astype(np.float32)
    samples, negatives = 10.0, min(drawn_each, 8 * k)
    upto = np.cumsum(noise)

    def step(name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is not None:
            size, wide = len(p[name]), grad[0].size
            at = rows if grad.ndim == 1 else (rows[:, None] * wide + np.arange(wide)).ravel()
            grad = np.bincount(at, grad.ravel(), size * wide).astype(np.float32).reshape(p[name].shape)
        past[name] += grad * grad
        p[name] += RATE * grad / np.sqrt(past[name])

    def sigmoid(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, -30, 30)
        np.exp(np.negative(x, out=x), out=x)
        x += 1
        return np.reciprocal(x, out=x)

    shift = np.float32(math.log(samples))
    order = rng.permutation(len(positions))
    for at in range(0, len(order), BATCH):
        a, b, w = positions[order[at : at + BATCH]].T
        n = len(w)
        drawn = np.minimum(np.searchsorted(upto, rng.random(negatives), side="right"), k - 1)
        ra, rb = p["r"][a], p["r"][b]
        q = p["first"] * rb + p["second"] * ra
        tw, tn = p["t"][w], p["t"][drawn]
        up = 1 - sigmoid((q * tw).sum(axis=1) + p["bias"][w] - offset[w] - shift)
        down = sigmoid(q @ tn.T + (p["bias"][drawn] - offset[drawn] - shift))
        down *= np.float32(-samples / negatives)
        dq = up[:, None] * tw + down @ tn
        step("t", np.concatenate((up[:, None] * q, down.T @ q)) / n, np.concatenate((w, drawn)))
        step("bias", np.concatenate((up, down.sum(axis=0))) / n, np.concatenate((w, drawn)))
        step("r", np.concatenate((dq * p["first"], dq * p["second"])) / n, np.concatenate((b, a)))
        step("first", (dq * rb).sum(axis=0) / n)
        step("second", (dq * ra).sum(axis=0) / n)


class Reader:
    """Turns texts into frequent-word indexes and classes."""

    def __init__(self, v: Vocabulary):
        self.v, self.index = v, {w: i for i, w in enumerate(v.words)}

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index (or -1) and class of each word and of the end."""
        v, get = self.v, self.index.get
        at = np.fromiter((get(w, -1) for w in (*words, END)), np.int64, len(words) + 1)
        cls = v.classes[at] if len(v.classes) else np.full(len(at), v.other, np.int32)
        for i in np.flatnonzero(at < 0).tolist():
            cls[i] = v.endings.get(words[i][-2:] if i < len(words) else END, v.other)
        return at, cls


def contexts(cls: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate(([start], cls[:-1]))
    return before, np.concatenate(([start], before[:-1]))


def _sampled(shared, positions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shipped(shared))
        for batch in batches:
            out = []
            for text in batch.column(0).cast(pa.binary()):
                _, cls = reader.read(words_of(text.as_py()))
                before, two = contexts(cls, reader.v.start)
                at = np.unique(np.linspace(0, len(cls) - 1, min(positions, len(cls))).astype(int))
                out.append(np.stack((two[at], before[at], cls[at]), axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["rows"])

    return run


def _passed(shared, seed: int):
    """A row (positions, parameters) for a partition that has any: the parameters after a pass over all its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p, past = shipped(shared)
        reader, rng = Reader(v), np.random.default_rng(seed)
        held: list[np.ndarray] = []
        waiting = done = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                _, cls = reader.read(words_of(text.as_py()))
                before, two = contexts(cls, v.start)
                held.append(np.stack((two, before, cls), axis=1).astype(np.int32))
                waiting += len(cls)
                if waiting >= CHUNK:
                    learn(p, past, np.concatenate(held), v.noise, rng, PASS_NOISE)
                    held, waiting, done = [], 0, done + waiting
        if held:
            learn(p, past, np.concatenate(held), v.noise, rng, PASS_NOISE)
            done += waiting
        if done:
            every = np.concatenate([p[n].ravel() for n in p]).astype(np.float64) * done
            yield _part(done, every)

    return run


def _part(n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["n", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(data.as_py(), "<f8")
            n, total = n + k, own.copy() if total is None else total + own
    if total is not None:
        yield _part(n, total)


def train(training: DataFrame, v: Vocabulary, *, text_col: str, start: DataFrame, seed: int = 7) -> tuple[LogBilinear, int]:
    """A model of all positions of ``training``, and how many those are.  Positions of the rows of ``start`` (some of
    ``training``) give it its start; then each partition makes a pass over every position it has from there, and the
    partitions' parameters are averaged by their numbers of positions."""
    spark = training.sparkSession
    sample = start.select(text_col).mapInArrow(_sampled(ship(spark, v), FIT_POSITIONS), "rows binary")
    sample = sample.orderBy(F.xxhash64("rows")).limit(2 * FIT_DOCS).collect()  # repeated rows are chosen together
    found = np.concatenate([np.zeros((0, 3), np.int32), *(np.frombuffer(r[0], "<i4").reshape(-1, 3) for r in sample)])
    rng = np.random.default_rng(seed)
    p, past = blank(v.noise, DIM, rng)
    for _ in range(EPOCHS):
        learn(p, past, found, v.noise, rng)
    parts = training.select(text_col).mapInArrow(_passed(ship(spark, (v, p, past)), seed), "n long, total binary")
    parts = parts.repartition(ADDERS).mapInArrow(_added, "n long, total binary").collect()  # a row per adder
    n = sum(k for k, _ in parts)
    if n:
        mean = sum(np.frombuffer(data, "<f8") for _, data in parts) / n
        ends = np.cumsum([x.size for x in p.values()])[:-1]
        p = {name: own.reshape(p[name].shape).astype(np.float32) for name, own in zip(p, np.split(mean, ends), strict=True)}
    return LogBilinear(**p), n


def _scored(shared, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = shipped(shared)
        reader, m = Reader(v), len(v.noise) + 1
        log_c = np.append(np.log10(v.counts + 1.0), 0.0)  # the last: words beyond the frequent ones
        log_z = None
        ln10 = math.log(10)
        per_token = math.log10(v.tokens + v.types + 1)
        for whole in batches:
            for start in range(0, len(whole), 128):
                part = whole.slice(start, 128)
                docs = [words_of(t.as_py()) for t in part.column(2).cast(pa.binary())]
                read = [reader.read(d) for d in docs]
                sizes = np.array([len(d) + 1 for d in docs])
                first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                at, cls = (np.concatenate([r[i] for r in read]) for i in (0, 1))
                pairs = [contexts(r[1], v.start) for r in read]
                before, two = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
                key = two.astype(np.int64) * m + before
                if log_z is None:
                    log_z = model.normalisers()
                score = np.empty(len(cls))
                for i in range(0, len(cls), 65_536):
                    s = slice(i, i + 65_536)
                    score[s] = np.einsum("nd,nd->n", model.query(before[s], two[s]), model.t[cls[s]]) + model.bias[cls[s]]
                score = (score - log_z[key]) / ln10 - v.share[cls]
                score += np.where(v.share[cls] > 0, log_c[at], 0.0)
                total = lambda x: np.add.reduceat(x, first)
                known, base = total((at >= 0).astype(np.int64)), total(log_c[at]) - sizes * per_token
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(sizes, pa.int64()), pa.array(known), pa.array(base), pa.array(total(score)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], names
                )
                rare = [Counter(w for w, i in zip(d, r[0].tolist(), strict=False) if i < 0) for d, r in zip(docs, read, strict=True)]
                if END not in reader.index:
                    for r in rare:
                        r[END] += 1
                own = pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(r) for r in rare]))
                words, times = [w for r in rare for w in r], [t for r in rare for t in r.values()]
                k = len(words)
                none = [pa.nulls(k, t) for t in (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([own, *none, pa.array(words, pa.binary()), pa.array(times, pa.int32())], names)

    names = ["_row", "_id", "held_out", "n_tokens", "known", "base", "score", "word", "times"]
    return run


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, top: int = TOP, own: int = OWN, endings: int = ENDINGS, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, per_token) for every row of ``docs``.

    Rows whose crc32(id as text) mod ``modulus`` is ``held`` are scored but never learned from; a null id counts as
    the empty text.  A null text has no words but its end.  Repeated rows are learned from and scored as often as they
    occur, every position of them; extra columns are dropped.  With no training rows every base probability is 1, and the model has one class.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text"), (id_remainder(id_col, modulus) == held).alias("held_out"))
    training = rows.where("not held_out")
    counts = table(count_words(training, text_col="_text"))
    v = vocabulary(counts, top=top, own=own_classes(counts.count(), own), endings=endings)
    n = training.select("_id").count()
    chosen = F.pmod(F.xxhash64(F.lit("fit"), "_id", "_text"), F.lit(1_000_000)) < int(1e6 * min(1.0, fit_docs / max(1, n)))
    model, _ = train(training, v, text_col="_text", start=training.where(chosen))
    id_field = schema_of(rows, "_id", more="x int")
    stream = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_text", "held_out")
    from pyspark.sql.pandas.types import to_arrow_type

    schema = schema_of(stream, "_row", "_id", "held_out", more="n_tokens long, known long, base double, score double, word binary, times int")
    both = table(stream.mapInArrow(_scored(ship(spark, (v, model)), to_arrow_type(id_field["_id"].dataType)), schema))
    rare = both.where("word is not null").select("_row", "word", "times")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 1)
    late = rare.join(counts, "word", "left").groupBy("_row").agg(F.sum(F.col("times") * log_c).alias("_more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_known"))
    out = both.where("n_tokens is not null").drop("word", "times").join(late, "_row", "left")
    more, known = F.coalesce("_more", F.lit(0.0)), F.coalesce("_known", F.lit(0))
    score = F.col("score") + more
    return out.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + known).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), score.alias("score"), (score / F.col("n_tokens")).alias("per_token"),
    )
