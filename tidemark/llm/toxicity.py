"""Toxicity by weak supervision.

Many voters vote on a text or abstain: lexicon entries, which are words and word beginnings, and patterns of shouting,
masking and the like.  Given labels, of training rows alone, tell which lexicon entries are worth a voter and how large
the share of toxic texts is; no more.  The voters vote on every training document, labelled or not.  A generative label
model estimates from how they agree, by expectation maximisation over all votes, how often each votes on toxic and on
clean texts, and from what is left of their covariance given the label which voters repeat one another; such votes
count less.  Its posterior labels, and not the given ones, train a linear classifier on word features of a bounded
sample of labelled texts, which scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, cut, id_remainder, schema_of, ship, shipped, sliced, table

#: Labelled texts that voters are chosen and the classifier is fitted on, toxic and clean, at most.
FIT_TOXIC, FIT_CLEAN = 2_000, 3_000
SPACE = 2**20
PREFIXES = (3, 4, 5, 6, 7)
VOTERS, FEATURES = 120, 1_500
#: How many times likelier in toxic than in clean labelled texts a feature of the classifier and a voter must be.
FEATURE_LIFT, VOTER_LIFT = 6, 40
#: Voters whose unexplained correlation exceeds this repeat one another.
REPEATS = 0.5
THRESHOLD = 0.3
KEPT = 120_000
ROUNDS = 10
#: Tasks that sum statistics; each hands the driver one row of some 130 kB at first, then of 2 kB.
ADDERS = 64
#: Posteriors are added up as integers of this unit, so that sums don't depend on the order of rows.
UNIT = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")
#: What a pattern voter looks for, and how many of it among a hundred words it needs.
PATTERNS = (
    (re.compile(r"!"), 1.0),
    (re.compile(r"!"), 5.0),
    (re.compile(r"[!?]{2,}"), 0.0),
    (re.compile(r"\b[^\W\d_a-z]{3,}\b"), 10.0),
    (re.compile(r"([^\W\d_])\1\1"), 0.0),
    (re.compile(r"[^\W\d_][*@#$]+[^\W\d_]"), 0.0),
)


def words_of(text: str | None) -> set[str]:
    """The distinct lower-cased words, runs of letters, of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[int]:
    """A word's features: itself and its beginnings, hashed."""
    return [zlib.crc32(b"=" + word.encode("utf-8", "surrogatepass")) % SPACE] + [zlib.crc32(word[:n].encode("utf-8", "surrogatepass")) % SPACE for n in PREFIXES if len(word) >= n]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    scale: float = 0.5

    def of_word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def probability(self, total: float, words: int) -> float:
        z = self.bias + total / max(1.0, words) ** self.scale
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


@dataclass
class LabelModel:
    """P(vote | label) per voter, a discount per voter for what correlated voters repeat, and the share of toxic texts."""

    fires: np.ndarray  # voters x (clean, toxic)
    discount: np.ndarray
    share: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of toxic given the votes; a voter that abstains says nothing."""
        z = votes @ (np.log(self.fires[:, 1] / self.fires[:, 0]) * self.discount) + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Statistics:
    """What the label model needs of votes, as exact integers: sums over texts of the votes, of the posterior, of its
    square and of their products, and of the products of votes."""

    def __init__(self, voters: int):
        self.voters, self.pairs = voters, np.zeros((voters, voters), np.int64)
        self.n, self.q, self.qq = 0, 0, 0
        self.v, self.qv = np.zeros(voters, np.int64), np.zeros(voters, np.int64)

    def add(self, votes: np.ndarray, times: np.ndarray, q: np.ndarray, pairs: bool) -> None:
        """Votes of texts, a row each that occurs ``times``, and their posteriors; ``pairs`` only once in a model."""
        unit, votes = np.round(q * UNIT).astype(np.int64), votes.astype(np.int64)
        self.n += int(times.sum())
        self.q += int((unit * times).sum())
        self.qq += int((unit * unit // UNIT * times).sum())
        self.v += times @ votes
        self.qv += (unit * times) @ votes
        if pairs:
            self.pairs += (votes * times[:, None]).T @ votes

    def numbers(self, pairs: bool) -> np.ndarray:
        return np.concatenate(([self.n, self.q, self.qq], self.v, self.qv, self.pairs.ravel() if pairs else []))

    def take(self, numbers: np.ndarray) -> None:
        """Adds what another's ``numbers`` say."""
        n, own = self.voters, numbers
        self.n, self.q, self.qq = (a + int(b) for a, b in zip((self.n, self.q, self.qq), own[:3], strict=True))
        self.v += own[3 : 3 + n]
        self.qv += own[3 + n : 3 + 2 * n]
        if len(own) > 3 + 2 * n:
            self.pairs += own[3 + 2 * n :].reshape(n, n)

    def model(self, share: float) -> LabelModel:
        """The rates of each voter on toxic and clean texts, and a discount from the covariance that they don't explain."""
        n, q, qq, v, qv = max(self.n, 1), self.q / UNIT, self.qq / UNIT, self.v, self.qv / UNIT
        fires = np.stack(((v - qv + 0.05) / (n - q + 1.0), (qv + 0.05) / (q + 1.0)), axis=1)
        fires = np.clip(fires, 1e-6, 1 - 1e-4)
        low, rise = fires[:, 0], fires[:, 1] - fires[:, 0]
        mixed = np.outer(v, low) + np.outer(qv, rise)  # votes times expected votes
        expected = n * np.outer(low, low) + q * (np.outer(low, rise) + np.outer(rise, low)) + qq * np.outer(rise, rise)
        rest = (self.pairs - mixed - mixed.T + expected) / n
        spread = np.sqrt(np.maximum(np.diag(rest), 1e-12))
        correlation = rest / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        return LabelModel(fires, 1 / (1 + np.maximum(correlation - REPEATS, 0).sum(axis=1) / (1 - REPEATS)), share)


def first_guess(votes: np.ndarray, lexicon: int) -> np.ndarray:
    """Where expectation maximisation starts: the more lexicon entries vote, the likelier toxic."""
    return np.clip(0.01 + 0.3 * votes[:, :lexicon].sum(axis=1), 0, 0.97)


def fit_labels(votes: np.ndarray, share: float, lexicon: int, rounds: int = ROUNDS) -> LabelModel:
    """The label model of votes in memory, by the steps that ``label_model`` takes over a table."""
    times, model = np.ones(len(votes), np.int64), None
    for _ in range(rounds):
        found = Statistics(votes.shape[1])
        found.add(votes, times, model.posterior(votes) if model else first_guess(votes, lexicon), True)
        model = found.model(share)
    return model


def pattern_votes(text: str | None, words: int) -> list[bool]:
    """Whether each pattern is in the text, and often enough for its number of words."""
    return [(n := sum(1 for _ in p.finditer(text or ""))) > 0 and 100 * n >= least * words for p, least in PATTERNS]


def feature_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """A text's features, how many of its distinct words have each, and how many those are."""
    words = words_of(text)
    at, n = np.unique(np.array([f for w in words for f in features(w)], np.int32), return_counts=True)
    return at, n.astype(np.uint32), len(words)


def choose(texts: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that occur far more often in toxic than in clean labelled texts, the best first, and which of them do
    so often enough for a voter."""
    toxic, clean = labels.sum(), len(labels) - labels.sum()
    seen = np.zeros((2, SPACE), np.int32)
    for (at, _, _), y in zip(texts, labels, strict=True):
        seen[int(y), at] += 1
    often = np.flatnonzero(seen[1] >= max(3, 0.004 * toxic))
    lift = np.log((seen[1, often] + 0.3) / (toxic + 0.6)) - np.log((seen[0, often] + 0.3) / (clean + 0.6))
    worth = np.where(lift > np.log(FEATURE_LIFT), seen[1, often] * lift, 0)
    ranked = np.argsort(-worth, kind="stable")[:FEATURES]
    ranked = ranked[worth[ranked] > 0]
    return often[ranked], lift[ranked] > np.log(VOTER_LIFT)


def voters_among(texts: list[tuple[np.ndarray, np.ndarray, int]], chosen: np.ndarray) -> np.ndarray:
    """The first ``VOTERS`` of the chosen features, without those that mostly say what a better one says already: a word
    and its beginnings are one voter."""
    has = np.stack([np.isin(chosen, at) for at, _, _ in texts]).astype(np.float32)
    both, n = has.T @ has, has.sum(axis=0)
    alike = both >= 0.5 * (n[:, None] + n[None, :] - both)
    kept: list[int] = []
    for i in range(len(chosen)):
        if len(kept) < VOTERS and not alike[i, kept].any():
            kept.append(i)
    return chosen[kept]


def _voted(lexicon: np.ndarray):
    """Over (text): each text's votes as bits: lexicon entries, patterns, and that no lexicon entry votes."""
    place = {int(f): i for i, f in enumerate(lexicon)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, ...]] = {}
        for batch in sliced(batches):
            votes = np.zeros((len(batch), len(place) + len(PATTERNS) + 1), bool)
            for i, text in enumerate(batch.column(0).to_pylist()):
                words = words_of(text)
                if len(kept) > KEPT:
                    kept.clear()
                kept.update((w, tuple(place[f] for f in features(w) if f in place)) for w in words if w not in kept)
                for w in words:
                    if own := kept[w]:
                        votes[i, list(own)] = True
                votes[i, len(place) :] = [*pattern_votes(text, len(words)), not votes[i, : len(place)].any()]
            bits = np.packbits(votes, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bits], pa.binary())], ["votes"])

    return run


def _summed(voters: int, lexicon: int, model: LabelModel | None):
    """Over (votes, times): the statistics of a partition as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Statistics(voters)
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), -1)
            votes = np.unpackbits(bits, axis=1, count=voters)
            found.add(votes, batch.column(1).to_numpy(), model.posterior(votes) if model else first_guess(votes, lexicon), model is None)
        if found.n:
            yield pa.RecordBatch.from_arrays([pa.array([found.numbers(model is None).astype("<i8").tobytes()], pa.binary())], ["numbers"])

    return run


def label_model(docs: DataFrame, lexicon: np.ndarray, share: float, *, text_col: str = "text", rounds: int = ROUNDS) -> LabelModel:
    """The label model from the votes on all of ``docs``.  Texts of equal votes are counted together; each round sums
    over the distinct votes, and the driver gets the sums of ``ADDERS`` tasks."""
    voters = len(lexicon) + len(PATTERNS) + 1
    votes = docs.select(col(text_col).alias("text")).mapInArrow(_voted(lexicon), "votes binary")
    votes = table(votes.groupBy("votes").agg(F.count("*").alias("times"))).coalesce(ADDERS)
    model, pairs = None, np.zeros((voters, voters), np.int64)
    for _ in range(rounds):
        found = Statistics(voters)
        found.pairs = pairs  # filled in the first round
        for row in votes.mapInArrow(_summed(voters, len(lexicon), model), "numbers binary").collect():
            found.take(np.frombuffer(row[0], "<i8"))
        model = found.model(share)
    return model


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], chosen: np.ndarray, q: np.ndarray, weight: np.ndarray) -> Model:
    """The classifier from the feature counts of texts, their posterior labels and their weights in the sample."""
    column = np.full(SPACE, -1, np.int16)
    column[chosen] = np.arange(len(chosen))
    counts = np.zeros((len(texts), len(chosen)), np.float32)
    for i, (at, n, _) in enumerate(texts):
        c = column[at]
        counts[i, c[c >= 0]] = n[c >= 0]
    size = np.array([max(1, k) for *_, k in texts], np.float32)
    counts /= np.sqrt(size)[:, None]
    w, b = _logistic(counts, np.clip(q, 0.002, 0.998), weight)
    return Model({int(f): float(v) for f, v in zip(chosen, w, strict=True) if v}, float(b))


def _logistic(x: np.ndarray, q: np.ndarray, weight: np.ndarray, rounds: int = 250, l2: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft labels by Adam over the whole sample."""
    weight, q = (v.astype(np.float32) for v in (weight, q))
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log((weight @ q) / (weight @ (1 - q))))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = weight * (p - q) / len(q)
        g = np.append(x.T @ d + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = batch.column(0).to_pylist()
        found = [feature_counts(t) for t in texts]
        parts = [pa.array([x.tobytes() for x in c], pa.binary()) for c in list(zip(*found, strict=True))[:2]] if found else [pa.array([], pa.binary())] * 2
        marks = pa.array([bytes(pattern_votes(t, f[2])) for t, f in zip(texts, found, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*parts, pa.array([k for *_, k in found], pa.int32()), batch.column(1), marks], ["at", "n", "words", "y", "marks"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, held: int = 2) -> Model:
    """A model from the labels of rows whose crc32(id as text) mod ``modulus`` isn't ``held``, and from the votes on all
    documents of such ids.  An id with several labels is toxic if one says so; null labels and null ids are left out of
    the labels.  The fitting sample is the first ``FIT_TOXIC`` and ``FIT_CLEAN`` rows by hashes of ids and features.
    Without labels of both kinds, or if no feature tells them apart, every text has the same score."""
    given = labels.where((id_remainder(id_col, modulus) != held) & col(label_col).isNotNull() & col(id_col).isNotNull())
    given = cut(given.groupBy(col(id_col).alias("_id")).agg(F.max(col(label_col).cast("int")).alias("_y")))
    n = dict(given.groupBy("_y").count().collect())
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model({}, 8.0 if toxic else -8.0)
    share = float(np.clip(toxic / (toxic + clean), 0.001, 0.999))
    order = F.xxhash64(F.lit("fit"), F.col("_id"))
    few = [given.where(F.col("_y") == y).orderBy(order, "_id").limit(most) for y, most in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    sample = table(few[0].union(few[1]))
    rows = docs.select(col(text_col).alias("_text"), col(id_col).alias("_id")).join(F.broadcast(sample), "_id")  # FIT_TOXIC + FIT_CLEAN rows at most
    rows = table(rows.select("_text", "_y").mapInArrow(_counted, "at binary, n binary, words int, y int, marks binary"))
    few = [rows.where(F.col("y") == y).orderBy(F.xxhash64("at", "n"), "words").limit(most) for y, most in ((1, FIT_TOXIC), (0, FIT_CLEAN))]  # ids may repeat in ``docs``
    found = few[0].collect() + few[1].collect()
    texts, y = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.uint32), r.words) for r in found], np.array([r.y for r in found])
    marks = [r.marks for r in found]
    del found
    if not len(y) or y.min() == y.max():
        return Model({}, float(np.log(share / (1 - share))))
    chosen, strong = choose(texts, y)
    if not strong.any():
        return Model({}, float(np.log(share / (1 - share))))
    lexicon = voters_among(texts, chosen[strong])
    model = label_model(docs.where(id_remainder(id_col, modulus) != held), lexicon, share, text_col=text_col)
    words = [np.isin(lexicon, at) for at, _, _ in texts]
    votes = np.array([[*w, *m, not w.any()] for w, m in zip(words, marks, strict=True)], float)
    # The sample is stratified; weights bring back the share of toxic texts.
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    return fit(texts, chosen, model.posterior(votes), weight)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``; null texts score as empty ones, repeated rows alike,
    extra columns are dropped."""
    shared = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kept = shipped(shared), {}
        for batch in sliced(batches):
            scores = []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                new = [w for w in words if w not in kept]
                if len(kept) + len(new) > KEPT:
                    kept.clear()
                    new = words
                kept.update((w, m.of_word(w)) for w in new)
                scores.append(m.probability(sum(map(kept.__getitem__, sorted(words))), len(words)))
            out = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["id", "held_out", "score", "predicted"])

    rows = docs.select(col(id_col), (id_remainder(id_col, modulus) == held).alias("held_out"), col(text_col))
    return rows.mapInArrow(run, schema_of(docs, id_col, more="held_out boolean, score double, predicted int"))


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns, in one pass."""
    shared = ship(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kept = shipped(shared), {}
        for batch in sliced(batches):
            keep = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                if len(kept) > KEPT:
                    kept.clear()
                kept.update((w, m.of_word(w)) for w in words if w not in kept)
                keep.append(m.probability(sum(map(kept.__getitem__, sorted(words))), len(words)) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
