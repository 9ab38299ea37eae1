import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from invented import prose

from tablestate.llm import kneser_ney, quality_rules
from tablestate.llm.common import trusted_ids


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_base_counts(spark, odd_docs, odd_labels, no_docs, sf_dir):
    ratio = np.zeros(quality_rules.BUCKETS)
    texts = ["a b c d e f g h a b c d e f g h", "x\nx\n \nx", "# * $ % & | < >", "a\x85b c d\x1ce", None, ""] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(80).collect()]
    for t in texts:
        assert quality_rules.measure(t or "", ratio)[:6] == base(t)
    got = quality_rules.quality_rules(odd_docs, odd_labels).collect()
    want = [(r.doc_id, *base(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(no_docs, odd_labels).count() == 0
    assert quality_rules.quality_rules(odd_docs, odd_labels.limit(0)).count() == odd_docs.count()
    assert quality_rules.keep_good(odd_docs, odd_labels).columns == odd_docs.columns


def test_likelihood_ratio_by_brute_force(spark, odd_docs, odd_labels):
    rows = odd_docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in odd_labels.collect() if r.doc_id is not None} - {2, 3, 4} - {100 + i for i in range(60) if i % 3 == 0}
    target, raw = Counter(), Counter()
    for r in rows:
        b = quality_rules.buckets_of(quality_rules.word_hashes((r.text or "").encode().split()), quality_rules.BUCKETS).tolist()
        raw.update(b)
        if r.doc_id in good:
            target.update(b)
    ratio = quality_rules.fit(odd_docs, trusted_ids(odd_labels))
    n, m, k = sum(target.values()), sum(raw.values()), quality_rules.BUCKETS
    for b in list(raw)[:200]:
        assert math.isclose(ratio[b], math.log((target[b] + 1) / (n + k)) - math.log((raw[b] + 1) / (m + k)), abs_tol=1e-9)


def test_scores_and_verdicts_by_brute_force(spark, odd_docs, odd_labels):
    """The mean log ratio over a text's words and pairs, from dictionaries, and the threshold on it."""
    rows = odd_docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in odd_labels.collect() if r.doc_id is not None} - {2, 3, 4} - {100 + i for i in range(60) if i % 3 == 0}
    grams = lambda t: quality_rules.buckets_of(quality_rules.word_hashes((t or "").encode().split()), quality_rules.BUCKETS).tolist()
    target, raw = Counter(), Counter()
    for r in rows:
        raw.update(grams(r.text))
        target.update(grams(r.text) if r.doc_id in good else [])
    n, m, k = sum(target.values()), sum(raw.values()), quality_rules.BUCKETS
    want = []
    for r in rows:
        b = grams(r.text)
        score = sum(math.log((target[x] + 1) / (n + k)) - math.log((raw[x] + 1) / (m + k)) for x in b) / len(b) if b else 0.0
        want.append((r.doc_id, round(score, 6), not base(r.text)[5] and score >= quality_rules.THRESHOLD))
    got = quality_rules.quality_rules(odd_docs, odd_labels).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, round(r.score, 6), r.kept)) for r in got)


def test_verdicts_separate_junk(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 200), "aa") for i in range(60)] + [(1000 + i, " ".join(x.upper() + "!!" for x in prose(rng, 200).split()), "aa") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    for out in (quality_rules.quality_rules(docs, labels), kneser_ney.classified(docs, labels)):
        verdict = {r.doc_id: r.kept for r in out.collect()}
        assert sum(verdict[i] for i in range(60)) >= 58 and not any(verdict[1000 + i] for i in range(20))


def brute_kn(train, texts, order=4):
    """Interpolated modified Kneser-Ney over characters, straight from its definition."""
    code = lambda t: [0] * (order - 1) + [ord(c) + 1 if ord(c) < kneser_ney.OWN else kneser_ney.OWN + 1 + (ord(c) & 1023) for c in t] + [0]
    grams = lambda t, k: [tuple(code(t)[i - k + 1 : i + 1]) for i in range(order - 1, len(code(t)))]
    counts = [Counter(g for t in train for g in grams(t, order))]
    for _ in range(order - 1):
        counts.append(Counter(g[1:] for g in counts[-1]))
    tables = []
    for c in counts:
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
            d = [min(max(x, 0.05), k) for x, k in zip(d, (1, 2, 3))]
        else:
            d = [0.5, 1.0, 1.5]
        total, freed = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3) - 1]
        tables.append((c, d, total, freed))

    def p(g):
        k = order - len(g)
        if not g:
            return 1 / (1 << kneser_ney.BITS)
        c, d, total, freed = tables[k]
        low = p(g[1:])
        if not total[g[:-1]]:
            return low
        v = c[g]
        return (max(v - d[min(v, 3) - 1], 0) if v else 0) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * low

    return [sum(-math.log(p(g)) for g in grams(t, order)) for t in texts]


@pytest.mark.parametrize("limit", [2_000_000, 100])
def test_kneser_ney_by_brute_force(spark, odd_docs, odd_labels, limit):
    """Once with one shard, once with many."""
    docs = odd_docs.where("length(text) < 20000 or text is null")
    model = kneser_ney.Model(docs, odd_labels, shard_grams=limit)
    assert (len(model.shards) > 1) == (limit == 100)
    good = {1} | {100 + i for i in range(60) if i % 3}
    rows = docs.select("doc_id", "text").collect()
    train = [r.text for r in rows if r.doc_id in good]
    want = brute_kn(train, [r.text or "" for r in rows])
    got = sorted(r.total for r in model.summed(docs.select("doc_id", "text")).collect())
    assert np.allclose(sorted(want), got, rtol=2e-5)
    kept = kneser_ney.keep_fluent(docs, odd_labels, shard_grams=limit)
    assert kept.columns == docs.columns
    verdicts = kneser_ney.classified(docs, odd_labels, shard_grams=limit)
    assert verdicts.count() == docs.count() and kept.count() == verdicts.where("kept").count()


def test_pieces_of_long_texts(monkeypatch):
    """Grams and sums do not depend on where a batch is cut."""
    rng = random.Random(8)
    texts = ["", prose(rng, 40), "x", prose(rng, 400), "\0a\uffff\U0010ffff日本", prose(rng, 3), ""]
    whole, n = kneser_ney.grams_of(texts, [(i, 0, len(t)) for i, t in enumerate(texts)])
    assert n.tolist() == [len(t) + 1 for t in texts]
    g = np.unique(whole)
    table = kneser_ney.GramTable(g, np.arange(1, len(g) + 1) / 7)
    want = table.sums(texts)
    assert np.allclose(table.lookup(g), np.arange(1, len(g) + 1) / 7) and (table.lookup(np.array([-5, 1 << 47])) == 0).all()
    for size in (7, 50, 300):
        monkeypatch.setattr(kneser_ney, "PIECE", size)
        cut = [kneser_ney.grams_of(texts, spans)[0] for spans in kneser_ney.pieces(texts)]
        assert np.concatenate(cut).tolist() == whole.tolist()
        got = table.sums(texts)
        assert np.allclose(got[0], want[0]) and got[1].tolist() == want[1].tolist()


def test_classifier_without_rows_or_labels(spark, odd_docs, odd_labels, no_docs):
    assert kneser_ney.classified(no_docs, odd_labels).count() == 0
    assert kneser_ney.classified(odd_docs, odd_labels.limit(0)).where("not kept").count() == 0


def test_thresholds_are_quantiles(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 60), "aa") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = kneser_ney.classified(docs, labels, quantile=0.9, margin=0.0).collect()
    assert 178 <= sum(r.kept for r in out) <= 184


def test_languages_without_trusted_text_are_kept(spark):
    rng = random.Random(4)
    other = ["".join(chr(0x4E00 + rng.randrange(500)) for _ in range(300)) for _ in range(10)]
    docs = spark.createDataFrame([(i, prose(rng, 60), "aa") for i in range(60)] + [(100 + i, t, "zz") for i, t in enumerate(other)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = kneser_ney.classified(docs, labels).collect()
    assert all(r.kept and math.isinf(r.threshold) for r in out if r.lang == "zz")
    assert all(math.isfinite(r.threshold) for r in out if r.lang == "aa")
    assert kneser_ney.keep_fluent(docs, labels).where("lang = 'zz'").count() == 10


def test_thresholds_have_no_step():
    """A language's threshold changes by little with each trusted document, and is never below its own quantile."""
    from tablestate.llm.kneser_ney import raised

    by_n = [raised(1000, n, 1500) for n in range(1, 5000)]
    assert max(a - b for a, b in zip(by_n, by_n[1:])) < 5 and by_n == sorted(by_n, reverse=True)
    assert by_n[0] > 1490 and by_n[-1] < 1010
    assert all(raised(1500, n, 1000) == 1500 for n in (1, 50, 5000))
