import random
import re

import numpy as np
import xxhash

from tablestate.llm import simhash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, bits=3):
    points = list(points)
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(points):
        for q in points[i + 1 :]:
            if (p ^ q).bit_count() <= bits:
                root[find(p)] = find(q)
    return {p: find(p) for p in points}


def test_fingerprints(spark, sf_dir):
    for (t,) in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect():
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    for t in (None, "", " \n", "one", "One two", "a b c", "É a\x1cb c d"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_covering_meets_every_link():
    rng = np.random.default_rng(1)
    for k in range(4):
        for _ in range(200):
            x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            y = x
            for b in rng.choice(64, k, replace=False).tolist():
                y ^= 1 << b
            i, a, h = simhash.anchors(np.array([x, y], np.uint64))
            homes = {int(v) for v in a[(i == 0) & h]}
            assert homes & {int(v) for v in a[i == 1]}
            assert len(set(a[i == 0].tolist())) == (i == 0).sum()


def test_components_of_crowds_and_chains(spark):
    rng = random.Random(4)
    points = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):  # crowds
        c = rng.getrandbits(64)
        points |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    x = rng.getrandbits(64)
    for _ in range(60):  # a chain of steps of three bits
        x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | 1 << rng.randrange(64)
        points.add(x)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in points], "fp long"))
    got = {r.fp: r.root for r in simhash.components(edges).collect()}
    want = brute_components(points)
    groups = {}
    for p, r in want.items():
        groups.setdefault(r, set()).add(signed(p))
    for g in groups.values():
        assert len({got.get(p, p) for p in g}) == 1
    assert len({got.get(signed(p), signed(p)) for p in points}) == len(groups)


def test_a_crowd_that_does_not_link():
    """Many points of one anchor, cut by bytes, give the groups that comparing all of them gives."""
    rng = random.Random(9)
    for half in (0, 1):
        word = rng.getrandbits(32)
        points = {word << 32 * half | rng.getrandbits(32) << 32 * (1 - half) for _ in range(600)}
        points |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(points)[:200]}
        points = {p for p in points if (p >> 32 * half & 0xFFFFFFFF ^ word).bit_count() <= 1}
        edges = simhash.link(np.array(sorted(points), np.uint64), half, crowd=50)
        assert all((u ^ v).bit_count() <= 9 and v < u for u, v in edges)
        want, root = brute_components(points), {p: p for p in points}

        def find(p):
            while root[p] != p:  # noqa: B023
                p = root[p]  # noqa: B023
            return p

        for u, v in edges:
            root[find(u)] = find(v)
        assert len({find(p) for p in points}) == len(set(want.values()))
        assert len({(find(p), want[p]) for p in points}) == len(set(want.values()))


def test_hot_keys_and_one_large_cluster(spark, monkeypatch):
    """Half of all rows in one cluster, a third copies of one text, many null ids; with few keys that may be broadcast."""
    monkeypatch.setattr(simhash, "HOT_KEYS", 8)
    rng = random.Random(11)
    center = rng.getrandbits(64)
    points = {center} | {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in points], "fp long"))
    got = {r.fp: r.root for r in simhash.components(edges).collect()}
    want = brute_components(points)
    assert len({got.get(signed(p), signed(p)) for p in points}) == len(set(want.values()))
    assert len({(got.get(signed(p), signed(p)), r) for p, r in want.items()}) == len(set(want.values()))
    rows = [(i if i % 5 else None, "all the same words here") for i in range(300)] + [(None, f"word{i} other{i} third{i} fourth{i}") for i in range(50)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr(r.doc_id) for r in out) == sorted(repr(i) for i, _ in rows)
    same = [r for r in out if r.fingerprint == f"{brute_fingerprint(rows[0][1]):016x}"]
    assert len(same) == 300 and {r.component_id for r in same} == {1}


def test_near_duplicates(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    fp = [brute_fingerprint(r.text) for r in rows]
    root = brute_components(set(fp))
    least = {}
    for r, f in zip(rows, fp):
        if r.doc_id is not None:
            least[root[f]] = min(least.get(root[f], 1 << 60), r.doc_id)
    want = [(r.doc_id, f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fp)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each(spark, odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert 1 in ids and 2 not in ids and 4 in ids and 6 not in ids  # copies; texts without words
    assert len({simhash.fingerprint(r.text) for r in rows}) == len(rows)
    assert simhash.one_of_each(no_docs).count() == 0
    odd = odd_docs.withColumnRenamed("n_words", "row_number").withColumnRenamed("fingerprint", "id_")
    assert simhash.one_of_each(odd).columns == odd.columns and simhash.one_of_each(odd).count() == len(rows)
