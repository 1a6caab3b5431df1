"""Language ID, n-gram models and toxicity against brute force and held-out accuracy."""

import collections
import math
import pickle
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldloom.llm import kneser_ney, langid, lm_score, toxicity
from foldloom.llm.entry_queries import QUERIES

from .conftest import documents

SYLLABLES = {"en": "the an on er th in re at or sh".split(), "de": "ung ein sch ver der ich keit au ge pf".split(), "fr": "eau que oi la re ment en il dou ce".split()}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def held_out(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k == 2


# language ID


def block_of(**counts):
    """The trees of languages given by the counts of their codes."""
    grown = {name: langid.Tree.of(np.array(sorted(c), np.int64), np.array([c[g] for g in sorted(c)], float)) for name, c in counts.items()}
    return langid.ContextTrees(list(grown), [pickle.dumps(t) for t in grown.values()])


def test_no_context_is_left_out(monkeypatch):
    """Code lengths don't depend on which contexts are laid out, nor on the languages of the same block."""
    rng = random.Random(10)
    texts = {name: "".join(rng.choices(letters, k=4000)) for name, letters in (("a", "abcdefgh "), ("b", "ghijké "), ("c", "xyzabß "))}
    counts = {}
    for name, text in texts.items():
        codes, starts, ends = langid._grams([text])
        counts[name] = collections.Counter(codes[starts[0] : ends[0]].tolist())
    unseen = [*texts.values(), "zzz qqq", "".join(rng.choices("abxyzqé ", k=500))]
    wide = block_of(**counts).lengths(unseen)
    monkeypatch.setattr(langid, "DENSE_ROWS", 12)
    narrow = block_of(**counts)
    assert np.array_equal(narrow.lengths(unseen), wide) and len(narrow.cost) == 4 * 256
    assert np.array_equal(block_of(b=counts["b"]).lengths(unseen)[:, 0], wide[:, 1])


def test_code_lengths_are_those_of_ppm():
    texts = ["abracadabra abra", "banana band"]
    codes, starts, ends = langid._grams(texts)
    counts = collections.Counter(int(c) for s, e in zip(starts, ends, strict=True) for c in codes[s:e])
    trees = block_of(x=counts)
    tables = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for g, n in counts.items():
        data = g.to_bytes(4, "big")
        for k in range(4):
            tables[k][data[3 - k : 3]][data[3]] += n

    def chance(context, symbol, ruled_out=frozenset()):
        """Method C with exclusion, from the longest context down."""
        def whole(ctx):
            seen = tables[len(ctx)][ctx]
            lower = whole(ctx[1:]) if ctx else [1 / 256] * 256
            if not seen:
                return lower
            total, kinds = sum(seen.values()), len(seen)
            left = sum(lower[s] for s in range(256) if s not in seen)
            return [seen[s] / (total + kinds) if s in seen else kinds / (total + kinds) * lower[s] / left for s in range(256)]
        return whole(context)[symbol]

    text = "abra cab é"
    data = b"\n\n\n" + text.encode()
    bits = -sum(math.log2(chance(data[k - 3 : k], data[k])) for k in range(3, len(data)))
    assert trees.lengths([text])[0, 0] == pytest.approx(bits, rel=1e-5)
    assert np.exp2(-trees.cost[256:].reshape(-1, 256)).sum(axis=1) == pytest.approx(1, rel=1e-4)
    assert trees.lengths(["", text]).tolist()[0] == [0.0]


def test_held_out_languages(spark, folder):
    rng = random.Random(0)
    rows = [(k, prose(lang, rng.randrange(4, 80), rng), lang if k % 7 else None, "s", 0) for k in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    truth = {r[0]: next(name for name, s in SYLLABLES.items() if r[1][:2] and all(w for w in s) and r[2] == name) if r[2] else None for r in rows}
    rows += [(900, None, "en", "s", 0), (901, "12 !!", "en", "s", 0), (902, "", "de", "s", 0)]
    found = {r["doc_id"]: r for r in QUERIES["op4_ppm_language_id"](spark, folder(rows)).collect()}
    told = [k for k, v in truth.items() if v and held_out(k, 4)]
    assert len(told) > 40 and np.mean([found[k]["lang_pred"] == truth[k] for k in told]) > 0.98
    assert all(found[k]["held_out"] == held_out(k, 4) for k in found)
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_any_number_of_languages(spark, monkeypatch):
    """600 languages, each of syllables of its own, in blocks; scores are those of one block with all of them."""
    rng = random.Random(8)
    kinds = {f"l{k:03}": [chr(0x3400 + 40 * k + j) + rng.choice("aeiou") for j in range(12)] for k in range(600)}
    make = lambda lang, n: " ".join("".join(rng.choices(kinds[lang], k=3)) for _ in range(n))
    rows = [(k, make(lang, 30), lang) for k, lang in enumerate(list(kinds) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 600"), block_languages=150)
    assert len(model.names) == 600 and len(model.blocks) == 4
    found = langid.predict(model, docs.where("doc_id >= 600").select("doc_id", "text", F.col("lang").alias("truth")), F.col("text")).collect()
    assert len(found) == 600 and np.mean([r["lang_pred"] == r["truth"] for r in found]) > 0.99 and all(0 < r["score"] <= 1 for r in found)
    few = docs.where("lang < 'l020'")
    one, many = (langid.predict(langid.fit(few.where("doc_id < 600"), block_languages=n), few, F.col("text")) for n in (50, 6))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"], r["bits_per_byte"]) for r in x.collect()} for x in (one, many))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], rel=1e-3) for k in a)


def test_long_texts_are_scored_whole(monkeypatch):
    counts = collections.Counter()
    text = "".join(random.Random(9).choices("abcdeé ", k=2000))
    codes, starts, ends = langid._grams([text])
    counts.update(codes[starts[0] : ends[0]].tolist())
    trees = block_of(x=counts)
    whole = trees.lengths([text, "b"])
    monkeypatch.setattr(langid, "CHUNK_BYTES", 97)
    bits, sizes = trees.whole_lengths([text, "b", ""])
    assert np.allclose(bits[:2], whole) and bits[2] == 0 and sizes.tolist() == [len(text.encode()), 1, 0]


# weighted backoff automaton


def plain_backoff(rows, k):
    """Tokens of each row, training counts by n-gram, and the probability function of the smoothed model, all without thresholds."""
    tokens = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r[1] or "")) + [None] for r in rows}
    training = [t for d, t in tokens.items() if not held_out(d, 7)]
    counts = collections.Counter(tuple(t[i : i + n]) for t in training for n in (1, 2, 3) for i in range(len(t) - n + 1))
    total, kinds = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def p(history, w):
        if not history:
            return (counts[w,] + 1) / (total + kinds + 1)
        lower, c = p(history[1:], w), counts[history]
        return (counts[*history, w] + k[len(history) - 1] * lower) / (c + k[len(history) - 1]) if c else lower

    return tokens, counts, total, p


@pytest.mark.parametrize(("block_bytes", "piece_bytes", "shard_bytes"), [(16_000_000, 1 << 20, 8_000_000), (900, 150, 700)])
def test_automaton_against_plain_backoff(spark, monkeypatch, block_bytes, piece_bytes, shard_bytes):
    monkeypatch.setattr(lm_score, "PIECE_BYTES", piece_bytes)
    monkeypatch.setattr(lm_score, "SHARD_BYTES", shard_bytes)
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "x" * 70, "x" * 64 + "y" * 6, "x" * 200]
    texts = [" ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(1, 90))) for _ in range(300)] + ["", None, " \n ", "Never seen words", "W1 w2 never", "rare\x0btriple\tonce", "rare triple once", "rare triple other"]
    texts += [" ".join(rng.choices(vocabulary, k=n)) for n in (lm_score.STRETCH - 1, lm_score.STRETCH, 3 * lm_score.STRETCH + 5)]
    rows = documents(*texts)
    k = (60.0, 4.0)
    docs = spark.createDataFrame([(r[0], r[1], held_out(r[0], 7)) for r in rows], "doc_id long, text string, held_out boolean")
    found = {r["doc_id"]: r for r in lm_score.scored(docs, k, block_bytes).collect()}
    tokens, counts, total, p = plain_backoff(rows, k)
    assert set(found) == set(tokens)
    for d, t in tokens.items():
        r = found[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum((w,) in counts for w in t), total, held_out(d, 7))
        assert r["base_score"] == pytest.approx(sum(math.log10(p((), w)) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t)))
    for history in [(), ("w0",), ("w0", "w1"), ("w11", "w0"), ("rare", "triple")]:
        assert sum(p(history, g[0]) for g in counts if len(g) == 1) + p(history, "unseen") == pytest.approx(1)


def test_one_trigram_of_rare_words_changes_a_score(spark, folder):
    rng = random.Random(7)
    filler = [prose("en", 30, rng) for _ in range(60)]
    ids = [d for d in range(1, 200) if not held_out(d, 7)]
    test = next(d for d in range(200, 300) if held_out(d, 7))
    make = lambda last, name: folder([(d, t, "en", "s", 0) for d, t in zip(ids, [*filler, last], strict=False)] + [(test, "zebra quartz onyx", "en", "s", 0)], name=name)
    score = lambda path: next(r["score"] for r in QUERIES["op5_backoff_automaton"](spark, path).collect() if r["doc_id"] == test)
    assert score(make("zebra quartz onyx", "a")) > score(make("quartz zebra onyx", "b")) + 0.3


# Kneser-Ney


def test_probabilities_add_up(spark):
    rng = random.Random(2)
    texts = [(prose("en", 40, rng).encode(), True) for _ in range(20)] + [(bytes(range(256)) * 2, False)]
    counted = kneser_ney.count_trigrams(spark.createDataFrame(texts, "data binary, trusted boolean"))
    contexts = sorted({t[i : i + 2] for t, m in texts[:1] for i in range(60)})[:10] + [b"\0\0", b"\xff\xff"]
    asked = spark.createDataFrame([(c[0] << 16 | c[1] << 8 | s, 0) for c in contexts for s in range(256)], "gram int, n long")
    whole = counted.unionByName(asked).groupBy("gram").sum("n").toDF("gram", "n")
    logp = {r["gram"]: r["logp"] for r in kneser_ney.probabilities(whole).collect()}
    # all middle bytes must have all last bytes asked for their context to add up at the lower order
    full = spark.range(0, 1 << 16).selectExpr("cast(id as int) as gram", "0L as n")
    logp = {r["gram"]: r["logp"] for r in kneser_ney.probabilities(whole.unionByName(full).groupBy("gram").sum("n").toDF("gram", "n")).collect()}
    for c in contexts:
        assert sum(math.exp(logp[c[0] << 16 | c[1] << 8 | s]) for s in range(256)) == pytest.approx(1, abs=1e-9)


def test_scores_are_sums_over_texts(spark):
    rng = random.Random(3)
    texts = [(k, "en", bytearray(prose("en", rng.randrange(1, 50), rng).encode()), k % 2 == 0) for k in range(50)] + [(50, None, bytearray(b""), False), (51, None, None, False)]
    rows = spark.createDataFrame(texts, "doc_id long, lang string, data binary, trusted boolean")
    model = kneser_ney.probabilities(kneser_ney.count_trigrams(rows))
    logp = {r["gram"]: r["logp"] for r in model.collect()}
    found = {r["doc_id"]: r for r in kneser_ney.log_probabilities(rows, model, 3, 2).collect()}
    assert set(found) == set(range(50))
    for k, _, data, trusted in texts[:50]:
        padded = b"\0\0" + bytes(data)
        expected = sum(logp[padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]] for i in range(len(data)))
        assert found[k]["logp"] == pytest.approx(expected) and found[k]["n_bytes"] == len(data) and found[k]["trusted"] == trusted


def test_junk_is_told_from_prose(spark, folder):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        junk = k % 5 == 0
        text = prose("en", 60, rng)
        rows.append((k, " ".join(w + "###" for w in text.split()).upper() if junk else text, "en", "s", 0))
        if k % 2 == 0:
            labels.append((k, 0 if junk else 1, 0))
    found = {r["doc_id"]: r["keep"] for r in QUERIES["op3_kneser_ney_quality"](spark, folder(rows, labels)).collect()}
    assert not any(found[k] for k in range(0, 400, 5))
    assert np.mean([found[k] for k in range(400) if k % 5]) > 0.97


def plain_kneser_ney(texts):
    """Modified Kneser-Ney of order three over bytes, as published: probabilities of (context of two bytes, byte)."""
    counts = collections.Counter(p[i : i + 3] for t in texts for p in [b"\0\0" + t] for i in range(len(t)))
    tables = {3: counts}
    for n in (2, 1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])  # in how many contexts a shorter one stands

    def cut(table):
        n1, n2, n3, n4 = (sum(c == k for c in table.values()) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return 0.5, 1.0, 1.5
        y = n1 / (n1 + 2 * n2)
        return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))

    cuts = {n: cut(t) for n, t in tables.items()}

    def chance(context, byte):
        n = len(context) + 1
        lower = chance(context[1:], byte) if context else 1 / 256
        own = {g[-1]: c for g, c in tables[n].items() if g[:-1] == context}
        if not own:
            return lower
        d = lambda c: cuts[n][min(c, 3) - 1]
        total = sum(own.values())
        c = own.get(byte, 0)
        return (c - d(c) if c else 0) / total + sum(map(d, own.values())) / total * lower

    return chance


def test_query_against_plain_kneser_ney(spark):
    """Counts, discounts, continuation counts, sums and quantiles, over trusted, other good, bad and unlabelled texts."""
    rng = random.Random(11)
    rows = [(k, prose(rng.choice(["en", "de"]), rng.randrange(1, 40), rng) if k % 9 else "~~" * rng.randrange(1, 9), rng.choice(["en", "de", None])) for k in range(90)] + [(90, "", "en"), (91, None, "en"), (92, "rare", "xx")]
    labels = [(k, int(k % 9 > 0)) for k in range(0, 90, 2)] + [(92, 1)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r["doc_id"]: r for r in kneser_ney.quality(docs, told, quantile=0.9, slack=1.0, trusted=20).collect()}
    good = {k for k, q in labels if q}
    share = min(0.5, 20 / len(good))
    picked = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(1 << 30)).alias("h")).collect()
    trusted = {r["doc_id"] for r in picked if r["h"] < int((1 << 30) * share)} & good
    assert 0 < len(trusted) < len(good)
    text = {k: (t or "").encode() for k, t, _ in rows}
    chance = plain_kneser_ney([text[k] for k in sorted(trusted)])
    costs = {}
    for k, t in text.items():
        p = b"\0\0" + t
        if t:
            costs[k] = math.exp(-sum(math.log(chance(p[i : i + 2], p[i + 2])) for i in range(len(t))) / len(t))
            assert found[k]["perplexity"] == pytest.approx(costs[k]), k
    lang = {r[0]: r[2] for r in rows}
    held = lambda some: sorted(math.ceil(math.log2(costs[k]) * 1000) for k in some)
    for name in ("en", "de", None, "xx"):
        some = [k for k in good - trusted if lang[k] == name] or [k for k in good if lang[k] == name]
        limit = 2 ** (math.ceil(np.percentile(held(some), 90)) / 1000)
        for k in costs:
            if lang[k] == name:
                assert found[k]["threshold"] == pytest.approx(limit) and found[k]["keep"] == (found[k]["perplexity"] <= found[k]["threshold"])
    assert not found[90]["keep"] and found[91]["perplexity"] is None


def test_every_good_text_counts(spark):
    """Models of both halves, and thresholds of all good texts."""
    rng = random.Random(12)
    rows = [(k, prose(rng.choice(["en", "de"]), rng.randrange(1, 30), rng), rng.choice(["en", "de", None])) for k in range(60)]
    good = {k for k in range(60) if k % 3}
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, int(k in good)) for k in range(60)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in kneser_ney.quality(docs, told, quantile=0.9).collect()}
    half = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("text").cast("binary")), F.lit(2)).alias("h")).collect()}
    text = {k: t.encode() for k, t, _ in rows}
    halves = [{k for k in good if half[k] == h} for h in (0, 1)]
    chances = [plain_kneser_ney([text[k] for k in some]) for some in halves]
    costs = {}
    for k, t in text.items():
        p = b"\0\0" + t
        one, two = (sum(math.log(chance(p[i : i + 2], p[i + 2])) for i in range(len(t))) / len(t) for chance in chances)
        costs[k] = math.exp(-(two if k in halves[0] else one if k in halves[1] else (one + two) / 2))
        assert found[k]["perplexity"] == pytest.approx(costs[k]), k
    for name in ("en", "de", None):
        limit = 2 ** (math.ceil(np.percentile([math.ceil(math.log2(costs[k]) * 1000) for k in good if rows[k][2] == name], 90)) / 1000)
        assert all(found[k]["threshold"] == pytest.approx(limit) for k in text if rows[k][2] == name)


# toxicity


def test_toxic_words_are_learned(spark, folder):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 6 == 0
        words = prose("en", 40, rng).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobblezak", "snerfwit", "plonkzak"]) + rng.choice(["", "s", "ish"]))
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    found = {r["doc_id"]: r for r in QUERIES["op6_compression_toxicity"](spark, folder(rows, labels)).collect()}
    out = [k for k in found if held_out(k, 4)]
    assert np.mean([found[k]["predicted"] == (k % 6 == 0) for k in out]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())


def test_scores_against_plain_ones(spark):
    """Dictionaries of the shares they name, and distances, features and curve worked out word by word."""
    rng = random.Random(6)
    rows = [(k, " ".join([prose("en", 30, rng), *(["grobblezak snerfwit"] if k % 3 == 0 else []), prose("de", 5, rng)]), int(k % 3 == 0)) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), parts=2)
    dealt = {r["doc_id"]: (r["half"], r["part"]) for r in docs.select("doc_id", F.expr("pmod(xxhash64(doc_id, 'half'), 2)").alias("half"), F.expr("pmod(xxhash64(doc_id, 'part'), 2)").alias("part")).collect()}
    for side, bad, size in ((model.toxic, 1, 65_536), (model.ordinary, 0, 262_144)):
        assert side == [toxicity.train(sorted(t for d, t, x in rows if x == bad and dealt[d] == (0, p)), size, 32_000_000) for p in (0, 1)]
    lengths = lambda side, w: [len(toxicity._compressor(d).compress(toxicity.framed(w))) for d in side]

    def plain(text):
        words = sorted({w for w in (x.strip(toxicity.EDGE) for x in text.lower().encode().split()) if w})
        d = np.array([[min(o) - max(t), min(o) - np.median(t), np.mean(o) - np.mean(t)] for w in words for o, t in [(lengths(model.ordinary, w), lengths(model.toxic, w))]])
        d.sort(axis=0)
        x = [1.0, math.log1p(len(words)), *np.maximum(d[-1], 0), *(math.log1p((d[:, j] >= s).sum()) for s in (2, 4, 6) for j in range(3)), *d.mean(axis=0), *d[int(0.95 * (len(d) - 1))]]
        z = sum((a - m) / s * w for a, m, s, w in zip(x, model.middle, model.scale, model.weights, strict=True)) - model.shift
        return 1 / (1 + math.exp(-z))

    some = docs.where("doc_id < 12")
    found = {r["doc_id"]: r["s"] for r in some.select("doc_id", toxicity.score(model, some, F.col("text")).alias("s")).collect()}
    assert all(found[d] == pytest.approx(plain(t), rel=1e-4) for d, t, _ in rows[:12])


def test_calibrated_threshold():
    """At most the given share of ordinary rows reach the level."""
    rng = np.random.default_rng(7)
    bad = (np.arange(2000) % 4 == 0).astype(float)
    rows = np.stack([np.ones(2000), rng.normal(0, 1, 2000) + bad], 1)
    model = toxicity.Model([b"x"], [b"y"])
    model.calibrate(rows, bad, np.ones(2000), 0.01)
    scores = model.scores(rows)
    assert (scores[bad == 0] >= toxicity.LEVEL).mean() <= 0.0101 and (scores[bad == 1] >= toxicity.LEVEL).mean() > 0.02


def test_remembered_distances(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 5)
    words = [b"word%d" % k for k in range(12)]
    texts = ["word1 word2 and more words here " * 20]
    model = toxicity.Model([toxicity.train(texts, 1024, 10**6)], [toxicity.train(["quite another text, of other kinds " * 20], 1024, 10**6)])
    first = model.distances(words)
    assert np.array_equal(first, np.concatenate([model.distances([w]) for w in words])) and len(model.met) <= 5


def test_windows():
    assert toxicity.windows(None) == [] and toxicity.windows(" !! ") == []
    assert toxicity.windows("Ab, 'cd'") == [b"ab", b"cd"]
    assert [len(w) for w in toxicity.windows("x" * 100)] == [32, 32, 32, 4]
