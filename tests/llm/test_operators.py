"""Each operator against a brute-force version, a round trip or held-out figures, and over awkward rows."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from conftest import SMALL, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language_id, line_dedup, lm_scoring, mixing, ogg, packing, quality, queries, simhash, token_counts, toxicity
from tidemark.llm.oracle import oracle_sql

from .conftest import TEXTS, prose

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SMALL), duck, oracle_sql()[name])


# -- packing


def test_encoder_equals_library():
    encode, tok = packing.byte_encoder(BYTE), Tokenizer.from_file(BYTE)
    r = random.Random(1)
    odd = ["".join(r.choice("ab 's\n\t \x1c\x85é1,.!<|endoftext|>") for _ in range(r.randrange(60))) for _ in range(3000)]
    for t in [*odd, *(t or "" for t in TEXTS)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing(spark, awkward, nothing):
    out = packing.pack_documents(awkward, BYTE, each=7)
    rows = out.collect()
    tok, want = Tokenizer.from_file(BYTE), Counter()
    for i, t in texts(awkward):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = np.array([r.length for r in rows])
    assert packing.lower_bound(lengths, 1024) <= len(by) <= packing.lower_bound(lengths, 1024) + 1
    assert packing.pack_documents(nothing, BYTE).count() == 0


def test_bounds_and_best_fit():
    r = np.random.default_rng(2)
    for _ in range(40):
        lengths = r.integers(1, 11, r.integers(1, 9))
        bins, offsets, filled = packing.best_fit(lengths, 10)
        assert (filled <= 10).all() and np.bincount(bins, lengths).tolist() == filled.tolist()
        best = min(k for k in range(1, len(lengths) + 1) if _fits(sorted(lengths.tolist(), reverse=True), [10] * k))
        assert packing.lower_bound(lengths, 10) <= best <= len(filled)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3


def _fits(items, free):
    if not items:
        return True
    return any(_fits(items[1:], [*free[:i], f - items[0], *free[i + 1 :]]) for i, f in enumerate(free) if f >= items[0] and f not in free[:i])


def test_exchange_closes_gaps(spark):
    items = spark.range(4000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).cast("int").alias("length"))
    lengths = np.array([r.length for r in items.collect()])
    bins = lambda out: out.select("sequence_id").distinct().count()
    mixed, alone = packing.pack(items, each=200), packing.pack(items, each=200, max_rounds=1)
    assert mixed.count() == 4000 and mixed.select("id").distinct().count() == 4000
    assert bins(mixed) < bins(alone)
    assert bins(packing.pack(items, each=4000)) <= packing.lower_bound(lengths, 1024) * 1.01 + 1
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2000)], "id int, length int"))


# -- mixing


def test_mixing_counts_and_rates(spark, awkward, nothing):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"))
    got = dict(mixing.mix(many, weights={"rare": 1, "hot": 1}, seed=1).groupBy("source").count().collect())
    assert abs(got["rare"] - 10_000) < 500 and abs(got["hot"] - 10_000) < 500
    assert mixing.mix(many, weights={"rare": 1}, seed=1).select("source").distinct().count() == 1
    large = mixing.mix(many.limit(20), weights={"rare": 1, "hot": 1}, budget=1500.0, seed=1).count()
    assert abs(large - 30_000) < 1500
    out = mixing.mix(awkward, budget=2.0, seed=3, keep_order_key=True)
    assert out.columns == [*(c for c in awkward.columns if c != "copy"), "copy", "order_key"] and mixing.mix(nothing).count() == 0
    u = spark.range(3000).select(mixing.uniform(F.col("id").cast("string")).alias("u"), mixing.poisson_cdf(F.lit(2.5)).alias("c")).toPandas()
    assert abs(u.u.mean() - 0.5) < 0.02 and abs(u.c[0][-1] - 1) < 1e-12


def test_mixing_small_weights_and_null_ids(spark, tmp_path):
    """Neither the weights' scale nor null, shared or repeated ids cost rows, and more sources than are broadcast give
    the same counts."""
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 500 + 1000).cast("string")).alias("text"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("source"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    for seed in range(4):
        one, small = (mixing.mix(rows, weights={"a": w, "b": w}, seed=seed).groupBy("source").count().collect() for w in (1.0, 1e-7))
        assert sorted(one) == sorted(small) and abs(sum(r["count"] for r in one) - 2000) < 200
    nulls = rows.select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), "source")
    assert abs(mixing.mix(nulls, seed=1).count() - 2000) < 150
    for bad in ({"a": -1.0}, {"a": float("nan")}, {"c": 1.0}, {}):
        with pytest.raises(ValueError):
            mixing.mix(rows, weights=bad)


def test_mixing_many_sources(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") > 9, (F.col("id") % 50).cast("string")).alias("source"))
    want = mixing.mix(rows, temperature=0.5, seed=2).groupBy("doc_id").count().collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert sorted(mixing.mix(rows, temperature=0.5, seed=2).groupBy("doc_id").count().collect()) == sorted(want)


CLASHES = ("_side", "_key", "_copy", "_order", "_part", "copy", "order_key", "_keep", "_at", "_docs", "_runs", "_id", "_hash", "_gone", "_own", "lines_after", "_times", "_source", "a.b")


@pytest.fixture(scope="session")
def clashing(spark):
    """A user's columns called like an operator's own."""
    rows = [(i, prose(70, i % 3) + "\n" + prose(60, 99), "s", *(f"{c}{i}" for c in CLASHES)) for i in range(6)]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", *CLASHES])


def test_clashing_names(spark, clashing, tmp_path):
    """Input columns come out as they went in, but those that a result column replaces, and results can be written."""
    out = {
        "mix": mixing.mix(clashing, budget=3.0, keep_order_key=True),
        "lines": line_dedup.drop_repeated_lines(clashing),
        "one": simhash.keep_one(clashing),
    }
    for name, df in out.items():
        df.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}").collect()
        assert rows
        for r in rows:
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES if c not in ("copy", "order_key", "lines_after"))
    assert out["one"].columns == clashing.columns and {r.doc_id for r in out["one"].collect()} == {0, 1, 2}


# -- language model


def test_language_model(spark, awkward, nothing):
    out = {r.doc_id: r for r in lm_scoring.score_texts(docs(spark), top=500).collect()}
    rows = texts(docs(spark))
    words = {i: [*t.encode().lower().split(), b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * max(1, len(ws))
    apart = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)
    assert lm_scoring.score_texts(awkward).count() == awkward.count() and lm_scoring.score_texts(nothing).count() == 0


def test_model_is_normalised(spark):
    counts = lm_scoring.count_words(docs(spark)).cache()
    v = lm_scoring.vocabulary(counts, top=300, own=20, endings=5)
    model = lm_scoring.fit(np.random.default_rng(0).integers(0, len(v.noise), (500, 3)), v.noise)
    before = np.arange(4)
    z = model.query(before, before) @ model.t.T + model.bias - model.normaliser(before, before)[:, None]
    assert np.allclose(np.exp(z).sum(axis=1), 1, atol=1e-4)
    inside = Counter()  # the words of each ending class, and one unseen, share its probability
    for w, c in counts.collect():
        w = bytes(w)
        if w not in v.words[:20]:
            k = v.endings.get(w[-2:], v.other)
            inside[k] += (c + 1) / 10 ** v.share[k]
    for k in inside:
        assert abs(inside[k] + 1 / 10 ** v.share[k] - 1) < 1e-9


def test_language_model_learns_all_positions(spark):
    """Every training position is learned from at any size, classes grow with the vocabulary, and a pattern that only
    texts outside the start have is learned."""
    start = [(i, " ".join(["red", "blue", "green", "grey"] * 20)) for i in range(20)]
    late = [(i, " ".join(["red", "grey", "blue", "green"] * 60)) for i in range(20, 320)]
    d = spark.createDataFrame(start + late, "doc_id long, text string").repartition(4)
    v = lm_scoring.vocabulary(lm_scoring.count_words(d))
    model, n = lm_scoring.train(d, v, text_col="text", start=d.where("doc_id < 20"))
    alone = lm_scoring.train(d.where("doc_id < 20"), v, text_col="text", start=d.where("doc_id < 20"))[0]
    assert n == sum(len(t.split()) + 1 for _, t in start + late)
    red, grey, green = (v.words.index(w) for w in (b"red", b"grey", b"green"))
    chance = lambda m: float((m.query(np.array([red]), np.array([green])) @ m.t.T + m.bias - m.normaliser(np.array([red]), np.array([green]))[:, None])[0, grey])
    assert chance(model) > chance(alone) + 1
    assert lm_scoring.own_classes(50_000) == lm_scoring.OWN and lm_scoring.own_classes(6_400_000) == 2 * lm_scoring.OWN


def test_normalisers_of_all_contexts():
    r = np.random.default_rng(3)
    for scale in (0.3, 30):  # the second underflows in some products
        m = lm_scoring.LogBilinear(*(scale * r.normal(size=s).astype(np.float32) for s in ((301, 8), (8,), (8,), (300, 8), (300,))))
        two, before = np.divmod(np.arange(301 * 301), 301)
        assert np.allclose(m.normalisers(), m.normaliser(before, two), rtol=1e-4, atol=1e-3)


def _captured(monkeypatch, module, name):
    kept, real = [], getattr(module, name)

    def run(*args, **how):
        kept.append((args, real(*args, **how)))
        return kept[-1][1]

    monkeypatch.setattr(module, name, run)
    return kept


def test_language_model_scores_by_hand(spark, monkeypatch):
    """``score`` against loops over each text's words and all classes, in double precision."""
    kept = _captured(monkeypatch, lm_scoring, "train")
    rows = texts(docs(spark))[:40] + [(None, "No id"), (900, None), (900, "the The tHe"), (901, "Zebra zebra")]
    got = Counter()
    for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), top=150, own=50, endings=20).collect():
        got[r.doc_id, r.n_tokens] = r.score
    (_, v), (m, _) = kept[0]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in rows]
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    r, t, bias = (x.astype(float) for x in (m.r, m.t, m.bias))
    for i, ws in words:
        before = two = v.start
        total = 0.0
        for w in ws:
            k = int(v.classes[v.words.index(w)]) if w in v.words else v.endings.get(w[-2:], v.other)
            z = (m.first * r[before] + m.second * r[two]) @ t.T + bias
            total += np.log10(np.exp(z[k]) / np.exp(z).sum())
            if v.share[k] > 0:
                total += np.log10((c[w] + 1) / 10 ** v.share[k])
            before, two = k, before
        assert abs(got[i, len(ws)] - total) < 1e-4 * len(ws)


# -- language identification


def test_language_id(spark, awkward, nothing):
    d = docs(spark)
    out = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.85 and out.score.between(0, 1).all()
    got = {r.doc_id: r for r in language_id.identify(awkward).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[3].lang_pred == "en"
    assert language_id.identify(nothing).count() == 0


def test_language_id_scores_by_hand(spark, monkeypatch):
    """Prediction and score against the model's sums over dictionaries of grams; a text with over 65,535 of one gram is
    learned and scored by the same counts."""
    kept = _captured(monkeypatch, language_id, "train")
    rows = [(r.doc_id, r.text, r.lang) for r in docs(spark).collect()] + [(5000 + i, "a " * 70_000 + "zwei" * i, "de") for i in range(3)]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    m = kept[0][1]
    assert len(out) == len(rows)
    for x, (i, t, _) in zip(sorted(out, key=lambda x: x.doc_id), sorted(rows, key=lambda x: x[0]), strict=True):
        if not language_id.has_letter(t):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        grams = Counter(int(b) for b in language_id.buckets(t))
        weight = {b: np.log(1 + n) * float(m.idf[b]) for b, n in grams.items()}
        norm = sum(w * w for w in weight.values()) ** 0.5
        z = [(sum(w / norm * float(m.weights[b, k]) for b, w in weight.items()) + m.bias[k]) / m.temperature for k in range(len(m.languages))]
        p = np.exp(np.array(z) - max(z))
        p /= p.sum()
        assert x.lang_pred == m.languages[int(p.argmax())] and abs(x.score - p.max()) < 1e-5


def test_language_id_finds_rare_languages(spark):
    """A language with one text in 600 is learned and predicted, also where the sample is small or ids are null."""
    r = random.Random(6)
    rare = [" ".join("".join(r.choice("бвгдежзклмн") for _ in range(5)) for _ in range(30)) for _ in range(20)]
    rows = [(i, prose(20, 1000 + i), "en") for i in range(6000)] + [(i, prose(20, 1000 + i) + " zwölf größer", "de") for i in range(6000, 12000)]
    rows += [(12000 + i, t, "ru") for i, t in enumerate(rare[:10])] + [(None, t, "ru") for t in rare[10:]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    m = language_id.train(d, fit_docs=60)
    assert m.languages == ["de", "en", "ru"]
    best = lambda t: m.languages[int(m.logits(*language_id.gram_counts(t)).argmax())]
    assert all(best(t) == "ru" for t in rare) and sum(best(t) == y for _, t, y in rows[:12000:100]) >= 110


# -- repeated lines


def _repeated(rows, least=50):
    """Lines in runs of ``least`` words that occur at an earlier place, by comparing every run with every earlier one."""
    seen, gone = {}, set()
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = [(k, x.strip(" \t\x0b\f\r")) for k, x in enumerate(t.split("\n"))]
        lines = [(k, x) for k, x in lines if x]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.encode().split()) for x in run) >= least:
                    if seen.setdefault(run, (i, a)) < (i, a):
                        gone |= {(i, k) for k in range(lines[a][0], lines[b][0] + 1)}
    return gone


def test_line_dedup(spark, awkward, nothing):
    r = random.Random(5)
    lines = [prose(r.choice((3, 12, 30, 55)), s) for s in range(12)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for i in range(40)]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: x.text for x in out.collect()}
    gone = _repeated(rows)
    assert gone
    for i, t in rows:
        assert got[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
    out = line_dedup.drop_repeated_lines(awkward)
    assert out.count() == awkward.count() and out.columns == [*awkward.columns, "lines_before", "lines_after"]
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


# -- token counts


ODD = ["It's Don't we'LL \u2019s", "a1b22 ,'s x,'S 9.5%", "Stra\u00dfe e\u0301 \u00e9 \u0130stanbul \u03a3\u03a3", "x<|endoftext|>y <|startoftext|> <|END", "a\x1cb\x85c\u3000d\x7f", "tab\tand\x0bmore  spaces   ", "7" * 3000, " lead"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, awkward, nothing, name):
    """Each file's counts are its library's, over the documents, awkward rows and odd texts, however many pre-tokens
    are broadcast."""
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    r = random.Random(2)
    odd = ODD + ["".join(r.choice("ab 's\n\t\x1c\x85\u00e9e\u03011,.!<|endoftext|>TL") for _ in range(r.randrange(60))) for _ in range(300)]
    rows = texts(awkward) + [(100 + i, t) for i, t in enumerate(odd)] + [(1000 + i, t) for i, t in texts(docs(spark))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((i or -1, len(t.encode()), count(t), count(t) > 50) for i, t in rows)
    for top in (0, 300, 10**6):
        got = token_counts.count_tokens(table, path, limit=50, top=top).collect()
        assert sorted((x.doc_id or -1, x.n_bytes, x.n_tokens, x.over_limit) for x in got) == want
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_token_counts_reads_the_file(tmp_path):
    """A file of another form isn't parted."""
    spec = json.load(open(WORD))
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    assert token_counts.parting(str(tmp_path / "other.json")) is None and token_counts.parting(WORD) is not None


# -- SimHash


def _fingerprint(t, k):
    w = t.encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("limit", [50_000, 3])
def test_simhash(spark, limit):
    rows = texts(docs(spark)) + [(1000 + i, prose(40, 9) + " x" * (i % 3) + f" {i % 7}") for i in range(40)]
    r = random.Random(1)
    got = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), run_limit=limit).collect()}
    fps = [_fingerprint(t, 4) for _, t in rows]
    comp = _components(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for c, (i, _) in zip(comp, rows, strict=True):
        least[c] = min(i, least.get(c, i))
    for c, f, (i, _) in zip(comp, fps, rows, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", least[c])
    base = r.getrandbits(64)
    x = np.array([base ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) for _ in range(200)], np.uint64)
    pairs = [(int(a), int(b)) for part in simhash.spanning_links(x, x[:, None], 4) for a, b in part]
    at = {int(v): k for k, v in enumerate(dict.fromkeys(x.tolist()))}
    have = _components(len(at), [(at[a], at[b]) for a, b in pairs])
    want = _components(len(at), [(at[a], at[b]) for a, b in combinations(at, 2) if (a ^ b).bit_count() <= 4])
    assert len(set(zip(have, want, strict=True))) == len(set(have)) == len(set(want))


def test_simhash_awkward(spark, awkward, nothing):
    out = {r.doc_id: r for r in simhash.near_duplicates(awkward).collect()}
    assert out[0].fingerprint == "0" * 16 and out[0].component_id == out[1].component_id == out[2].component_id == 0
    kept = simhash.keep_one(awkward)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == awkward.columns and ids.count(4) == 1 and 5 not in ids and 6 in ids and 7 not in ids
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_similar_documents(spark):
    r, rows = random.Random(4), []
    for g in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(150)]
        rows.append((2 * g, " ".join(words)))
        words[r.randrange(150)] = "changed"
        rows.append((2 * g + 1, " ".join(words)))
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == i - i % 2 for i in got) >= 116 and all(got[i] in (i, i - i % 2) for i in got)


def test_similar_documents_down_to_the_threshold(spark):
    """Pairs of several similarities against a brute-force Jaccard: none below it joined, few at or above it missed."""
    r, texts = random.Random(5), []
    for k in range(300):
        words = [f"w{r.randrange(3000)}" for _ in range(200)]
        other = list(words)
        for at in r.sample(range(200), 1 + k % 7):
            other[at] = f"w{r.randrange(3000)}"
        texts += [" ".join(words), " ".join(other)]
    sets = [simhash.shingles(t.encode(), 5) for t in texts]
    alike = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    found = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x.doc_id: x.component_id for x in found.collect()}
    joined = [got[2 * i + 1] == 2 * i for i in range(300)]
    assert 100 < sum(alike) < 300 and not any(j and not w for j, w in zip(joined, alike, strict=True))
    assert sum(j for j, w in zip(joined, alike, strict=True) if w) >= 0.93 * sum(alike)


def test_similar_documents_finds_all_short_pairs(spark):
    """Pairs of short texts at 0.8 or a little more, one a longer version of the other: every one is joined."""
    r, pairs = random.Random(8), [(8, 9), (9, 10), (24, 29), (40, 49)]
    texts = []
    for k in range(120):
        a, b = pairs[k % 4]
        words = [f"w{r.randrange(3000)}" for _ in range(b)]
        texts += [" ".join(words[:a]), " ".join(words)]
    found = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(x.component_id == x.doc_id // 2 * 2 for x in found) and len(found) == 240


def test_similar_documents_repeats_do_not_hide_differences(spark):
    """Texts that share one line many times over but little else stay apart: distinct shingles are what counts."""
    line = prose(12, 7)
    rows = [(i, "\n".join([line] * 200 + [prose(80, 100 + i)])) for i in range(6)]
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.component_id == x.doc_id for x in found)


def _linked_roots(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


@pytest.mark.parametrize("run_limit", [simhash.RUN_LIMIT, 40])
def test_similar_documents_in_a_dense_group(spark, run_limit):
    """One text with up to eight words changed, 150 times: nearly all are candidates of each other, some link only
    through others and some not at all.  Components are those of all pairs by brute force, but for pairs that the
    random grids may miss at the threshold."""
    r = random.Random(9)
    base, texts = [f"w{r.randrange(3000)}" for _ in range(150)], []
    for k in range(150):
        words = list(base)
        for at in r.sample(range(150), k % 9):
            words[at] = f"w{r.randrange(3000)}"
        texts.append(" ".join(words))
    sets = [simhash.shingles(t.encode(), 5) for t in texts]
    want = _linked_roots(len(sets), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    found = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), run_limit=run_limit)
    got = {x.doc_id: x.component_id for x in found.collect()}
    assert 10 < len(set(want)) < 120 and max(Counter(want).values()) > 30
    assert all(want[i] == want[c] for i, c in got.items())  # nothing joined that brute force keeps apart
    assert sum(got[i] != want[i] for i in got) <= 3


def test_across_links():
    r = np.random.default_rng(2)
    fps = np.unique(np.uint64(0x0F0F) ^ (np.uint64(1) << r.integers(0, 64, 120).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 120).astype(np.uint64)))
    n = len(fps)
    roots, size, shared = r.integers(0, 4, n), np.full(n, 100), r.integers(70, 101, n)
    cells, more = np.zeros(n, np.int64), (roots, size, shared)
    found = lambda **how: {(int(a), int(b)) for x in simhash.Across(0.8, **how)(cells, fps, fps[:, None], more, 3) for a, b, *_ in x}
    got, best = found(), found(best=True)
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            both = min(shared[i], shared[j])
            if roots[i] != roots[j] and int(fps[i] ^ fps[j]).bit_count() <= 3 and both >= 0.8 * (200 - both):
                want.add((int(fps[i]), int(fps[j])))
    assert want and got == want
    assert best <= want and {x for p in best for x in p} == {x for p in want for x in p}
    assert not list(simhash.Across(0.8)(cells[:0], fps[:0], fps[:0, None], tuple(v[:0] for v in more), 3))


def test_across_finds_a_pair_in_its_first_grid():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**64, simhash.WORDS, np.uint64)
    words = np.stack([base ^ np.array([sum(1 << int(b) for b in r.choice(64, 4, replace=False)) for _ in base], np.uint64) for _ in range(30)])
    fps, masks = np.arange(30, dtype=np.uint64), simhash.random_grids(40, 6)
    more = (np.arange(30), np.full(30, 9), np.full(30, 9))
    some, times, shared = simhash.Across(0.8, masks), Counter(), set()
    for k, mask in enumerate(masks):
        cells = simhash.wide_cells(words, mask, k).view(np.int64)
        for c in np.unique(cells):
            own = np.flatnonzero(cells == c)
            shared |= set(combinations(own.tolist(), 2))
            for x in some(cells[own], fps[own], words[own], tuple(v[own] for v in more), 64):
                times.update((int(a), int(b)) for a, b, *_ in x)
    assert set(times) == shared and set(times.values()) == {1}


def test_keep_one_with_null_and_shared_ids(spark):
    """Unrelated texts all stay, whatever their ids; of copies one does."""
    alike = [prose(60, 300 + i) for i in range(6)]
    rows = [(None, t) for t in alike] + [(7, prose(60, 400 + i)) for i in range(4)] + [(None, alike[0]), (9, alike[1])]
    kept = [r.text for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted({t for _, t in rows})


# -- quality


def test_quality_awkward(spark, awkward, nothing):
    rows = [(1, "Home | About | Contact | Help\n" + prose(40, 8) + "."), (2, "Accept cookies\n" * 3 + prose(12, 1)), (3, prose(12, 1) + ".\n" + "Read more\n" + prose(80, 2) + ".")]
    got = {r.doc_id: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_lines_removed, got[1].kept, got[2].kept, got[3].n_lines_removed, got[3].kept) == (1, True, False, 1, True)
    assert got[1].clean_text == rows[0][1].split("\n")[1]
    out = {r.doc_id: r for r in quality.clean_lines(awkward).collect()}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (out[i].n_words, out[i].n_repeat_words, out[i].word_chars) == (len(w), len(again), sum(len(x.decode()) for x in w))
    assert quality.clean_lines(nothing).count() == 0


# -- Ogg


def _slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_ogg_round_trip():
    r = random.Random(3)
    for n in (1, 576, 577, 576 * 85, 576 * 171 + 1, 60_000, 200_000):
        payload = ogg.pad(r.randbytes(n))
        stored = ogg.write_ogg(payload)
        media = ogg.read_samples(stored)
        assert media.payload == payload and media.times == list(range(0, len(payload), 576))
        assert ogg.checksum(stored[:99]) == _slow_crc(stored[:99])
    for at in (30, len(stored) // 2, len(stored) - 1):
        with pytest.raises(ogg.OggError):
            ogg.read_samples(stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.read_samples(stored[:-100])


def test_ogg_packets_over_pages():
    packet = bytes(range(256)) * 3
    lacing = ogg.lace(len(packet))
    pages = [ogg.page(9, 0, -1, 2, lacing[:2], packet[:510]), ogg.page(9, 1, 7, 1 | 4, lacing[2:] + b"\x00", packet[510:])]
    got = list(ogg.read_packets(ogg.read_pages(b"".join(pages))))
    assert [p.data for p in got] == [packet, b""] and [p.granule for p in got] == [None, 7]
    with pytest.raises(ogg.OggError):
        list(ogg.read_packets(ogg.read_pages(pages[0])))


def test_ogg_columns(awkward, nothing):
    for r in ogg.media_columns(awkward, keep_media=True).collect():
        t = next((t for i, t in texts(awkward) if i == r.doc_id), "").encode()
        assert r.n_bytes == len(t) and r.payload_bytes == len(ogg.pad(t)) and r.tail_crc32 == zlib.crc32(ogg.pad(t)[-32:])
        assert ogg.read_samples(bytes(r.media)).payload == ogg.pad(t)
    assert ogg.media_columns(nothing).count() == 0


# -- toxicity


def test_toxicity(spark, awkward, nothing):
    d = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    model = toxicity.train(d, labels)
    out = toxicity.score(d, model).join(labels, "doc_id").toPandas()
    apart = out[out.held_out]
    caught, clean = apart[apart.toxic == 1].predicted.mean(), apart[apart.toxic == 0].predicted.mean()
    assert caught > 0.6 and clean < 0.03
    assert toxicity.score(awkward, model).count() == awkward.count()
    kept = toxicity.drop_toxic(awkward, model)
    assert kept.columns == awkward.columns and toxicity.score(nothing, model).count() == 0
    assert toxicity.train(nothing, labels).weights == {} and toxicity.train(awkward, labels.where("toxic = 0")).weights == {}
    rows = texts(awkward)
    assert len(rows) > len(dict(rows))  # repeated rows score alike
    for x in toxicity.score(awkward, model).collect():
        t = next(t for i, t in rows if i == x.doc_id)
        words, total = set(re.findall(r"[^\W\d_]+", t.lower())), 0.0
        for w in sorted(words):
            for key in ("=" + w, *(w[:n] for n in range(3, 8) if len(w) >= n)):
                total += model.weights.get(zlib.crc32(key.encode()) % 2**20, 0.0)
        want = 1 / (1 + np.exp(-(model.bias + total / max(1, len(words)) ** 0.5)))
        assert abs(x.score - want) < 1e-9 and x.predicted == (want >= 0.3) and x.held_out == (zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode()) % 4 == 2)


def test_label_model_over_a_table(spark):
    """Votes on all documents, counted and summed over a table, give the label model of the same votes in memory, and
    a document without a label changes it."""
    r = random.Random(3)
    words = [f"{a}{b}x" for a in "abcdefgh" for b in "aeiou"]
    rows = [" ".join(r.sample(words, 12) + (["vile", "scum"] if i % 9 == 0 else []) + ["WHAT!!"] * (i % 5 == 0)) for i in range(400)]
    lexicon = np.array([zlib.crc32(x) % 2**20 for x in (b"=vile", b"=scum", b"aax")])
    naive = []
    for t in rows:
        w = t.lower().split()
        own = ["vile" in w, "scum" in w, "aax" in w]
        naive.append([*own, *toxicity.pattern_votes(t, len(toxicity.words_of(t))), not any(own)])
    want = toxicity.fit_labels(np.array(naive, float), 0.1, 3)
    got = toxicity.label_model(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3), lexicon, 0.1)
    assert np.allclose(got.fires, want.fires) and np.allclose(got.discount, want.discount)
    q = want.posterior(np.array(naive, float))
    assert q[::9].min() > 3 * np.median(np.delete(q, np.arange(0, 400, 9)))
    more = toxicity.label_model(spark.createDataFrame([(t,) for t in [*rows, *["vile"] * 300]], "text string"), lexicon, 0.1)
    assert not np.allclose(more.fires, want.fires)


def test_label_model_finds_good_voters():
    r = np.random.default_rng(1)
    y = r.random(2000) < 0.2
    good = (y[:, None] & (r.random((2000, 4)) < 0.7)) | (r.random((2000, 4)) < 0.02)
    copies = np.repeat(r.random((2000, 1)) < 0.3, 5, axis=1)
    votes = np.concatenate((good, copies, ~good.any(axis=1)[:, None]), axis=1).astype(float)  # the last: no lexicon entry votes
    model = toxicity.fit_labels(votes, 0.2, 4)
    q = model.posterior(votes)
    known = good.any(axis=1)  # what abstaining voters allow to know, if one knows the good ones
    assert ((q > 0.5) == y).mean() >= (known == y).mean() > 0.9 and (np.argsort(np.argsort(q))[y].mean() > 1700)
    assert model.discount[4:9].max() < 0.3 < model.discount[:4].min()


# -- pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = docs(spark)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, d, SMALL)
        assert out.columns == list(pipeline.COLUMNS)
        before, d = d.count(), spark.createDataFrame(out.toPandas(), out.schema)
        assert 0.5 * before <= d.count() <= (1.5 if name == "mixing" else 1) * before
    out = pipeline.run(spark, SMALL)
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_pipeline_by_brute_force(spark, monkeypatch):
    """Every stage's rows on the documents and made near copies, and those of all stages, against plain Python."""
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = _captured(monkeypatch, toxicity, "train")
    base = docs(spark).select(*pipeline.COLUMNS)
    rows = [tuple(r) for r in base.collect()]
    made = [(900 + i, prose(90, 40 + i // 2) + (" changed" if i % 2 else ""), "en", "made", 1) for i in range(8)] + [(950, None, None, None, None), (951, "", "en", "made", 0)]
    d = spark.createDataFrame(rows + made, base.schema).repartition(3)
    now = {r[0]: r for r in rows + made}

    def step(k, d):
        out = pipeline.STAGES[k][1](spark, d, SMALL)
        return spark.createDataFrame([tuple(r) for r in out.collect()], out.schema)

    d, model = step(0, d), kept[0][1]
    value = lambda t: sum(model.weights.get(zlib.crc32(k.encode()) % 2**20, 0.0) for w in toxicity.words_of(t) for k in ("=" + w, *(w[:n] for n in range(3, 8) if len(w) >= n)))
    now = {i: r for i, r in now.items() if 1 / (1 + np.exp(-(model.bias + value(r[1]) / max(1, len(toxicity.words_of(r[1]))) ** 0.5))) < 0.3}
    assert {r.doc_id: tuple(r) for r in d.collect()} == now and len(now) > 180

    d = step(1, d)
    gone, left = _repeated([(i, r[1] or "") for i, r in now.items()]), {}
    for i, r in now.items():
        text = None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if (i, k) not in gone)
        if text == r[1]:
            left[i] = r
        elif text.encode().split():
            left[i] = (i, text, *r[2:4], len(text))
    now = left
    assert {r.doc_id: tuple(r) for r in d.collect()} == now and gone

    d = step(2, d)
    ids = sorted(now)
    sets = [simhash.shingles((now[i][1] or "").encode(), 5) for i in ids]
    root = _linked_roots(len(ids), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    now = {ids[k]: now[ids[k]] for k in set(root)}
    assert {r.doc_id: tuple(r) for r in d.collect()} == now and len(now) < len(ids)

    d = step(3, d)
    size = Counter()
    for r in now.values():
        size[r[3]] += max(1, len(r[1] or ""))
    aim = {s: n**0.5 for s, n in size.items()}
    want = Counter()
    for r in now.values():
        mean = sum(size.values()) * aim[r[3]] / sum(aim.values()) / size[r[3]]
        key = f"42:{r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}:1"
        u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, total = 0, math.exp(-mean), math.exp(-mean)
        while total < u:
            n += 1
            p *= mean / n
            total += p
        want[r] += n
    assert Counter(tuple(r) for r in d.collect()) == +want

    tok, pieces = Tokenizer.from_file(BYTE), Counter()
    for r in d.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        first = n if n <= 1024 else n % 1024 or 1024
        for k, start in enumerate([0, *range(first, n, 1024)]):
            pieces[r.doc_id, k, start, first if k == 0 else 1024] += 1
    out = pipeline.STAGES[4][1](spark, d, SMALL).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in out) == pieces
    whole = Counter((r.doc_id, r.piece, r.length) for r in pipeline.run(spark, SMALL).collect())
    assert whole and {i for i, *_ in whole} <= {r[0] for r in rows}


def test_pipeline_stages_with_awkward_rows(spark, awkward, nothing):
    """Nulls, ties, repeated rows, clashing columns and empty tables pass every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES:
        out = stage(spark, awkward, SMALL)
        assert out.count() > 0 and (name == "packing" or out.columns == list(pipeline.COLUMNS))
        assert stage(spark, nothing, SMALL).count() == 0
