import hashlib
import random
import re

import pytest
from invented import prose

from tablestate.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                of = windows.get(tuple(w[k : k + n]))
                if of:
                    hit.update(range(k, k + n))
                    found |= of
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(8)
    items = [(str(i), prose(rng, rng.randint(12, 30))) for i in range(12)] + [("s", "ba ko"), ("n", None), ("e", "-- !"), ("t", "the"), ("s2", "BA, ko!")]
    docs = []
    for i in range(40):
        t = prose(rng, 60)
        if i % 4 == 0:
            w = items[i % 12][1].split()
            t = f"{t} {' '.join(w[1:12])}. {prose(rng, 5)} {' '.join(w[:10]).upper()}"
        docs.append((i, t))
    docs += [(None, items[0][1]), (3, items[3][1]), (3, items[3][1]), (50, None), (51, ""), (52, "À" + items[1][1]), (53, prose(rng, 20_000) + " " + items[2][1])]
    return docs, items


@pytest.mark.parametrize("shard_words,block", [(4_000_000, 500_000), (150, 40)])
def test_against_brute_force(spark, case, shard_words, block):
    """Once in one shard and block, once with shards of few documents and items in several blocks."""
    docs, items = case
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, items string, n_hit int")
    b = spark.createDataFrame(items, "item_id string, text string")
    out = decontaminate.contamination(d, b, shard_words=shard_words, block=block).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]))) for r in out) == brute(docs, items)


def test_empty_tables_and_clean(spark, case):
    docs, items = case
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id string, text string")
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    none = decontaminate.contamination(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none)
    kept = decontaminate.clean(d.withColumnRenamed("items", "Row_Number"), b.where("item_id not in ('t', 's', 's2')"))
    assert kept.columns[-1] == "Row_Number"
    kept = decontaminate.clean(d, b.where("item_id not in ('t', 's', 's2')"))
    want = [x for x in brute(docs, [i for i in items if i[0] not in ("t", "s", "s2")]) if x.endswith(", 0, ())")]
    assert kept.columns == d.columns and kept.count() == len(want)


def near(docs, items, size=10, slack=2):
    """Documents' items with a window whose words all stand within slack of their places after some start."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            for k in range(max(1, len(v) - size + 1) if v else 0):
                win = v[k : k + size]
                if any(all(u in w[max(0, s + j - slack) : max(0, s + j + slack + 1)] for j, u in enumerate(win)) for s in range(-slack, len(w) + slack)):
                    out.setdefault(d, set()).add(i)
    return out


def test_proximity_by_brute_force(spark):
    """Whatever shards the documents are in: which word is rarest there does not change the answer."""
    rng = random.Random(18)
    items = [(str(i), " ".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7)))) for i in range(15)]
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(40))) for i in range(60)]
    want = near(docs, items, 5)
    for shard_words in (4_000_000, 100):
        out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=5, slack=2, shard_words=shard_words).collect()
        assert {r.doc_id: set(r.near_items) for r in out if r.near_items} == want


def test_items_without_an_id_hit_unnamed(spark):
    docs = spark.createDataFrame([(1, "x ba ko ri"), (2, "tu")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "ba ko"), ("", "tu"), ("a", "ri"), ("a", "x")], "item_id string, text string")
    out = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, items).collect()}
    assert out == {1: (4, ["a"]), 2: (1, [""])}


def test_proximity(spark):
    item = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"
    docs = [(1, item), (2, item.replace("a5", "a5 x")), (3, item.replace("a5", "a5 x y z q r")), (4, "a10 a9 a8 a7 a6 a5 a4 a3 a2 a1"), (5, item.replace("a5", "a5 x y z q"))]
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id int, text string"), slack=2)
    near = {r.doc_id: (list(r["items"]), list(r.near_items)) for r in out.collect()}
    assert near == {1: (["7"], ["7"]), 2: ([], ["7"]), 3: ([], []), 4: ([], []), 5: ([], ["7"])}


def test_query(spark, sf_dir):
    from tablestate.llm.queries import op6_decontamination

    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select("doc_id" if t == "documents" else "item_id", "text").collect()]
    want = brute(read("documents"), [(str(i), t) for i, t in read("benchmark")])
    got = op6_decontamination(spark, sf_dir).collect()
    sha = {r.doc_id: r.items_sha256 for r in got}
    assert len(got) == len(want) and any(r.contaminated for r in got)
    for d, n, h, items in map(eval, want):
        assert sha[d] == hashlib.sha256(",".join(items).encode()).hexdigest()
