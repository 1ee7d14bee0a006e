"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become hashed counts of character 1- to 3-grams.  Document frequencies cover all training texts; the regression
is fitted on a bounded sample of each language's labelled texts, with the languages' shares restored afterwards, by follow-the-regularised-leader with an elastic-net penalty, and a
temperature fitted on texts kept apart calibrates its probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, id_remainder, schema_of, ship, shipped, table

BUCKETS = 2**15
#: Labelled texts that the regression is fitted on, at most (in expectation), dealt equally to the languages; a
#: language has ``FIT_EACH`` at least, or all of its texts.
FIT_DOCS, FIT_EACH = 3_000, 200
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"
_LETTERS = np.array([i if chr(i).isalpha() else 32 for i in range(128)], np.uint32)


def buckets(text: str) -> np.ndarray:
    """The bucket of every 1-, 2- and 3-gram of the lower-cased text; ASCII characters but letters count as spaces."""
    cp = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    cp = np.where(cp < 128, _LETTERS[np.minimum(cp, 127)], cp)
    one = cp * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + one[2:]
    every = np.concatenate((one, two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)))
    return (every ^ (every >> np.uint32(16))) * np.uint32(0x45D9F3B) >> np.uint32(32 - 15)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, and how often."""
    n = np.bincount(buckets(text), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf[at]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return vector(at, n, self.idf) @ self.weights[at] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(examples: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, sizes: dict[str, int] | None = None, *, seed: int = 3) -> Model | None:
    """FTRL-proximal over the examples in random order; every seventh of a language is kept apart to fit the
    temperature.  ``sizes`` are the languages' numbers of texts, of which the examples may be uneven samples: biases
    and the temperature's weights restore their shares."""
    drawn = Counter(y for *_, y in examples)
    languages = sorted(drawn)
    if not languages:
        return None
    k = len(languages)
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)
    order = np.random.default_rng(seed).permutation(len(examples))
    apart, learned, met = [], [], Counter()
    for i in order:
        met[examples[i][2]] += 1
        (learned if met[examples[i][2]] % 7 else apart).append(i)
    apart = apart or learned
    share = np.array([(sizes or drawn)[y] / drawn[y] for y in languages])
    share *= len(examples) / (share @ [drawn[y] for y in languages])
    gain = 8.0  # unit vectors have small entries; scaled, the penalties act on weights of ordinary size

    def proximal(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(z: np.ndarray, n: np.ndarray, w: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        more = n + g * g
        return z + g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w, more

    for _ in range(EPOCHS):
        for i in learned:
            at, times, y = examples[i]
            x = gain * vector(at, times, idf)
            w, wb = proximal(z[at], n[at], L1), proximal(zb, nb, 0.0)
            p = softmax(x @ w + wb)
            p[languages.index(y)] -= 1
            z[at], n[at] = update(z[at], n[at], w, x[:, None] * p)
            zb, nb = update(zb, nb, wb, p)
    model = Model(languages, idf.astype(np.float32), (gain * proximal(z, n, L1)).astype(np.float32), proximal(zb, nb, 0.0) + np.log(share))
    logits = np.array([model.logits(*examples[i][:2]) for i in apart])
    truth = np.array([languages.index(examples[i][2]) for i in apart])
    loss = lambda t: -(share[truth] * np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
    return model


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies as (bucket, df, null, null), and chosen texts' counts as (null, null, language, data)."""
    df, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        langs, data = [], []
        for text, lang, chosen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, n = gram_counts(text)
            df[at] += 1
            docs += 1
            if chosen:
                langs.append(lang)
                data.append(np.concatenate((at, n)).astype("<u4").tobytes())
        yield _learned(pa.nulls(len(langs), pa.int32()), pa.nulls(len(langs), pa.int64()), pa.array(langs, pa.string()), pa.array(data, pa.binary()))
    at = np.flatnonzero(df)
    where, values = np.append(at, -1).astype(np.int32), np.append(df[at], docs)
    yield _learned(pa.array(where), pa.array(values), pa.nulls(len(where), pa.string()), pa.nulls(len(where), pa.binary()))


def _learned(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["bucket", "df", "lang", "data"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, held: int = 1, fit_docs: int = FIT_DOCS) -> Model | None:
    """A model from the rows whose crc32(id as text) mod ``modulus`` isn't ``held``; None without labelled texts."""
    names = {"id": id_col, "text": text_col, "lang": lang_col}
    rows = docs.select(*[col(c).alias(n) for n, c in names.items()])
    rows = rows.where((id_remainder("id", modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(rows.groupBy("lang").count().collect())  # a row per language
    each = max(FIT_EACH, fit_docs // max(1, len(sizes)))
    large = {y: int(1e9 * each / n) for y, n in sizes.items() if n > each}
    rate = F.lit(1_000_000_000)
    if large:
        rate = F.coalesce(F.create_map(*(F.lit(x) for pair in large.items() for x in pair))[F.col("lang")], rate)
    chosen = F.pmod(F.xxhash64(F.lit("fit"), "id", "text"), F.lit(1_000_000_000)) < rate
    learned = table(rows.select("text", "lang", chosen).mapInArrow(_learn, "bucket int, df long, lang string, data binary"))
    df = dict(learned.where("bucket is not null").groupBy("bucket").agg(F.sum("df")).collect())  # a row per bucket
    total = df.pop(-1, 0)
    found = np.zeros(BUCKETS)
    found[list(df)] = list(df.values())
    idf = np.log((1 + total) / (1 + found)) + 1
    examples = []
    most = 2 * (fit_docs + FIT_EACH * len(sizes))  # repeated rows are chosen together, so a hash alone bounds nothing
    for lang, data in learned.where("data is not null").select("lang", "data").orderBy(F.xxhash64("data"), "lang").limit(most).collect():
        pair = np.frombuffer(data, "<u4").astype(np.int64).reshape(2, -1)
        examples.append((pair[0], pair[1], lang))
    examples.sort(key=lambda e: (e[2], len(e[0]), e[1].tobytes()))
    return fit(examples, idf, sizes)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, held: int = 1, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of ``docs``: the language of the whole text and its calibrated
    probability.

    Null texts and texts without a letter are ``und`` with score 0, as all are if nothing was labelled.  Rows without
    a language are predicted but not learned from; a null id counts as the empty text.  Extra columns are dropped.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, modulus=modulus, held=held, fit_docs=fit_docs)
    shared = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped(shared)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(2).to_pylist():
                if m is None or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax(m.logits(*gram_counts(text)) / m.temperature)
                best = int(p.argmax())
                langs.append(m.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(col(id_col), (id_remainder(id_col, modulus) == held).alias("held_out"), col(text_col))
    return rows.mapInArrow(run, schema_of(docs, id_col, more="held_out boolean, lang_pred string, score double"))
