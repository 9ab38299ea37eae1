import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from invented import prose
from pyspark.sql import functions as F

from tablestate.llm import bloom_lm, language_id


def held(i, folds, k):
    return i is not None and zlib.crc32(str(i).encode()) % folds == k


def test_trigrams_and_bundles():
    g, n = language_id.trigrams("Ab, ab!")
    assert sorted(zip([chr(x >> 42) + chr(x >> 21 & 0x1FFFFF) + chr(x & 0x1FFFFF) for x in g.tolist()], n.tolist())) == [(" ab", 2), ("ab ", 2), ("b a", 1)]
    assert not len(language_id.trigrams("12 .. 🙂")[0])
    a, b, c = (language_id._vector(ord(x), 64) for x in "abc")
    key = np.array([ord("a") << 42 | ord("b") << 21 | ord("c")])
    assert (language_id.bind(key, 64)[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identified(docs).collect()}
    rows = [r for r in docs.collect() if held(r.doc_id, 3, 1)]
    assert all(got[r.doc_id].held_out for r in rows) and sum(r.held_out for r in got.values()) == len(rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def brute_languages(rows, dimensions=language_id.DIMENSIONS):
    """Predictions from the definition: trigrams of letters bound by rotation, bundled, centred prototypes, cosine."""

    def counts(text):
        c = "".join(x if x.isalpha() else " " for x in f" {(text or '').lower()} ")
        while "  " in c:
            c = c.replace("  ", " ")
        return Counter(zip(c, c[1:], c[2:]))

    def bundle(grams):
        out = np.zeros(dimensions)
        for (a, b, c), n in grams.items():
            a, b, c = (language_id._vector(ord(x), dimensions).astype(float) for x in (a, b, c))
            out += n * np.roll(a, 2) * np.roll(b, 1) * c
        return out

    unit = lambda v: v / (np.linalg.norm(v) or 1)
    sums = {}
    for i, lang, text in rows:
        if not held(i, 3, 1) and lang is not None and text is not None:
            sums[lang] = sums.get(lang, np.zeros(dimensions)) + bundle(counts(text))
    names = sorted(sums)
    protos = np.array([unit(sums[k]) for k in names])
    mean = protos.mean(0) if len(names) > 1 else np.zeros(dimensions)
    centred = np.array([unit(p - mean) for p in protos])
    out = []
    for i, _, text in rows:
        g = counts(text)
        if not any(x.isalpha() for x in text or "") or not g:
            out.append((i, "und", 0.0))
            continue
        cosine = centred @ unit(unit(bundle(g)) - mean)
        k = int(cosine.argmax())
        out.append((i, names[k], min(1.0, max(0.0, float(cosine[k])))))
    return out


def test_predictions_by_brute_force(spark, sf_dir, odd_docs, monkeypatch):
    monkeypatch.setattr(language_id, "_TOGETHER", 300)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select("doc_id", "lang", "text").unionByName(odd_docs.where("doc_id is null or doc_id not in (7, 8)").limit(30).selectExpr("doc_id + 1000000 as doc_id", "lang", "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: r for r in language_id.identified(spark.createDataFrame(rows, docs.schema)).collect() if r.doc_id is not None}
    for i, lang, score in brute_languages(rows):
        if i is not None and sum(x[0] == i for x in rows) == 1:
            assert got[i].lang_pred == lang and math.isclose(got[i].score, score, abs_tol=1e-4)


def test_odd_rows(spark, odd_docs, no_docs):
    out = language_id.identified(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r.doc_id: r for r in out if r.doc_id in (4, 5, 6)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in by.values())
    assert all(0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "und") for r in out)
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in out)
    assert language_id.identified(no_docs).count() == 0
    assert {r.lang_pred for r in language_id.identified(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_base(rows):
    split = lambda t: (t or "").encode().lower().split()
    train = [split(t) for i, t in rows if not held(i, 7, 2)]
    c = Counter(w for t in train for w in t)
    ends = len(train)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    out = []
    for i, t in rows:
        w = split(t)
        score = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        out.append((i, held(i, 7, 2), len(w) + 1, sum(x in c for x in w) + (ends > 0), n, round(score, 4)))
    return sorted(map(repr, out))


def test_base_score(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for block in (1_000_000, 300):
        out = bloom_lm.scored(odd_docs, block_words=block).collect()
        assert sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in out) == brute_base(rows)
        assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert bloom_lm.scored(no_docs).count() == 0


def brute_scores(rows, folds=7, k=2):
    """Scores of all rows from dictionaries of exact counts, by the model's definition."""
    value, split = bloom_lm.level_values(), lambda t: (t or "").encode().lower().split()
    lv = lambda c: 0 if not c else 1 + math.floor(math.log(c) / math.log(bloom_lm.LOG_BASE) + 1e-9)
    texts = [(["<", "<", *split(t), ">"], held(i, folds, k)) for i, t in rows]
    grams = lambda w: [(i, tuple(w[i - n + 1 : i + 1])) for i in range(2, len(w)) for n in (1, 2, 3)]
    c = Counter(g for w, out in texts if not out for _, g in grams(w))
    n = sum(v for g, v in c.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in c)
    c[("<",)] = c[("<", "<")] = sum(not out for _, out in texts)
    seen, types = Counter(), Counter()
    for w, out in texts:
        if not out:
            for _, g in grams(w):
                seen[len(g), lv(c[g[:-1]])] += 1
                types[len(g), lv(c[g[:-1]])] += 1 / value[lv(c[g])]
    d = {}
    for m in (1, 2, 3):
        once, twice = (sum(v == k for g, v in c.items() if len(g) == m and g[-1] != "<") for k in (1, 2))
        d[m] = once / (once + 2 * twice) if once and twice else 0.5
    out = []
    for (i, _), (w, _) in zip(rows, texts):
        score = 0.0
        for j in range(2, len(w)):
            p = 1 / (kinds + 1)
            for m in (1, 2, 3):
                g = tuple(w[j - m + 1 : j + 1])
                q, qc = lv(c[g]), lv(c[g[:-1]]) if m > 1 else 0
                if m == 1:
                    p = max(value[q] - d[1], 0) / n + d[1] * kinds / n * p if n else p
                elif qc:
                    p = max(min(value[q], value[qc]) - d[m], 0) / value[qc] + d[m] * types[m, qc] / max(seen[m, qc], 1) * p
            p = min(p, 1.0)
            score += math.log10(p)
        out.append((i, round(score, 3)))
    return sorted(map(repr, out))


def test_score_by_brute_force(spark, odd_docs, sf_dir):
    """With many bits to an entry, so that false positives are rare; in one part and block, in many, and with keys sent to the parts."""
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 60"))
    rows = [tuple(r) for r in docs.collect()]
    want = brute_scores(rows)
    many = {"block_words": 3000, "shard_grams": 20_000, "part_bytes": 400_000}
    for sizes in ({}, many, many | {"whole_parts": 0}):
        got = bloom_lm.scored(docs, entry_bits=400, **sizes).collect()
        assert sorted(repr((r.doc_id, round(r.score, 3))) for r in got) == want


def test_both_ways_to_probe_give_the_same_rows(spark, sf_dir, odd_docs, no_docs):
    """The same levels, so the same scores to the last digit, whatever the sizes of blocks, shards and parts."""
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    by_row = lambda out: sorted(map(repr, out.collect()))
    for sizes in ({}, {"block_words": 5000, "shard_grams": 30_000, "part_bytes": 60_000}, {"block_words": 700, "shard_grams": 30_000, "part_bytes": 1}):
        assert by_row(bloom_lm.scored(docs, **sizes, whole_parts=0)) == by_row(bloom_lm.scored(docs, **sizes, whole_parts=1 << 30))
    assert bloom_lm.scored(no_docs, whole_parts=0).count() == 0
    nothing = spark.createDataFrame([(i, None) for i in range(30)], "doc_id long, text string")
    assert by_row(bloom_lm.scored(nothing, whole_parts=0)) == by_row(bloom_lm.scored(nothing))
    held_only = spark.createDataFrame([(i, "a b c") for i in range(200) if held(i, 7, 2)], "doc_id long, text string")
    assert all(r.score == 0 and r.train_tokens == 0 for r in bloom_lm.scored(held_only, whole_parts=0).collect())


def test_keys_go_to_the_part_that_holds_them(spark, sf_dir):
    """By the first shards of the parts, every key of a block finds the part with its own shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "doc_id % 7 = 2 as held_out", "text")
    table = bloom_lm.blocks(docs, 4000)
    model = bloom_lm.Model(table, 30_000, 100_000)
    assert len(model.parts) > 3 and table.count() > 3
    for row in table.collect():
        b = bloom_lm.Block(row.asDict())
        part = np.searchsorted([files[0][0] for files in model.parts], model.layout.shard(bloom_lm._wanted(b, model.layout, 3)), "right") - 1
        assert set(np.unique(part)) <= set(range(len(model.parts)))
        assert all({s for s, _, _ in model.parts[p]} >= set(model.layout.shard(bloom_lm._wanted(b, model.layout, 3)[part == p]).tolist()) for p in np.unique(part))
    out = bloom_lm.levels_by_part(table, model)
    assert out.count() == table.count()


def test_words_in_another_order_score_otherwise(spark):
    rng = random.Random(7)
    texts = [prose(rng, 60) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(texts * 3)] + [(1000 + i, " ".join(sorted(t.split()))) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in bloom_lm.scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(40):
        a, b = out[i], out[1000 + i]
        assert a.n_tokens == b.n_tokens and (b.held_out is False or a.score > b.score + 10)


def test_filter_levels_are_quantised_counts(spark):
    rng = np.random.default_rng(0)
    layout = bloom_lm.Layout(1_000_000, 100_000)
    hashes = np.arange(30_000, dtype=np.uint64)
    keys = layout.short(layout.keys(hashes, 2))
    assert len(np.unique(keys)) == len(keys)
    n = rng.integers(1, 5000, len(keys))
    pieces = [(int(s), bloom_lm.filter_words(keys[own], bloom_lm.level(n[own]))) for s in np.unique(layout.shard(keys)) for own in [layout.shard(keys) == s]]
    part = bloom_lm.Part(layout, pieces, sum(len(w) for _, w in pieces))
    got = np.zeros(len(keys), np.uint8)
    part.fill(hashes, 2, got)
    assert (got >= bloom_lm.level(n)).all() and (got == bloom_lm.level(n)).mean() > 0.96  # a filter may overstate, never understate
    other = np.zeros(100_000, np.uint8)
    part.fill(np.arange(1 << 40, (1 << 40) + 100_000, dtype=np.uint64), 2, other)
    assert 0 < (other > 0).mean() < 0.03
    bloom_lm.Part(layout, [], 0).fill(hashes, 2, none := np.zeros(len(keys), np.uint8))
    assert not none.any()
    value = bloom_lm.level_values()
    assert all(value[bloom_lm.level(np.array([c]))[0]] == pytest.approx(c, rel=0.25) for c in range(1, 3000))


def test_an_empty_filter_changes_scores(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    full = {r.doc_id: r.score for r in bloom_lm.scored(docs).collect()}
    monkeypatch.setattr(bloom_lm.Part, "fill", lambda self, hashes, order, out: None)
    table = bloom_lm.blocks(docs.selectExpr("doc_id", "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2 as held_out", "text"))
    model = bloom_lm.Model(table)
    model.parts = []
    found = bloom_lm.levels(table, model)
    scorer = bloom_lm.Scorer(model.tokens, model.kinds, *bloom_lm.discounts(found, model))
    seen = 0
    for row in found.collect():
        for _, b, one, two, three in bloom_lm._rows(pa.RecordBatch.from_pylist([row.asDict()], schema=bloom_lm._LEVELS)):
            scores = np.add.reduceat(scorer.log10(one, two, three, *bloom_lm._contexts(b, one, two, model.texts)), b.starts)
            seen += sum(abs(full[i] - s) > 0.1 for i, s in zip(b.ids[:, 1].tolist(), scores.tolist()))
    assert seen >= 0.99 * len(full)


def test_model_prefers_its_language(spark):
    """Texts in which a word leaves few choices for the next: held-out texts score above the base, strange ones below them."""
    rng = random.Random(6)
    words = sorted(set(prose(rng, 400).split()))
    after = {w: [rng.choice(words) for _ in range(3)] for w in words}

    def text(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    docs = [(i, text(300)) for i in range(80)]
    odd = [(1000 + i, "".join(rng.choice("qxzjwvkpy") for _ in range(6)) + " zzq") for i in range(20)]
    out = {r.doc_id: r for r in bloom_lm.scored(spark.createDataFrame(docs + odd, "doc_id long, text string")).collect()}
    fresh = [r for i, r in out.items() if i < 1000 and r.held_out]
    strange = [r for i, r in out.items() if i >= 1000 and r.held_out]
    mean = lambda rows: sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert fresh and strange and mean(fresh) > mean(strange)
    assert mean(fresh) > sum(r.base_score for r in fresh) / sum(r.n_tokens for r in fresh) + 1
