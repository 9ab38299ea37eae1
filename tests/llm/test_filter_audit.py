"""The filter audit against filters applied one after another, and against its SQL."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
from invented import prose

from tablestate.llm import filter_audit as fa
from tablestate.llm.queries import op11_filter_audit, oracle_sql

FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plainly(docs, labels):
    """Rows of (doc_id, text, lang) through every order of the filters, one document at a time."""
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    firsts = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            firsts[text or ""] = min(doc_id, firsts.get(text or "", doc_id))
    marks = defaultdict(list)
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > firsts[text],
        }
        marks[lang or ""].append(({f for f, failed in fails.items() if failed}, doc_id in good, doc_id in toxic))
    out = {}
    for part, rows in marks.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                kept = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                failing = sum(f in r[0] for r in rows)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                left = kept
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in FIGURES] for r in df.collect()}


def test_against_filters_one_after_another(spark, odd_docs, odd_labels):
    rng = random.Random(3)
    extra = []
    for i in range(300):
        text = prose(rng, rng.choice([5, 190, 199, 200, 201, 230]))
        if rng.random() < 0.4:
            text = text.upper() if rng.random() < 0.5 else text.replace("the", "The")
        if rng.random() < 0.3:
            text += rng.choice("#$%&*|<")
        if rng.random() < 0.3:
            text = " ".join(text.split()[:20] * 12)
        extra += [(1000 + i, text, rng.choice(["aa", "bb", None, ""]))] * rng.choice([1, 1, 2])
        if rng.random() < 0.3:
            extra.append((rng.choice([3000 + i, 5000 - i, None]), text, rng.choice(["aa", "cc"])))
    docs = odd_docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"), allowMissingColumns=True)
    labels = odd_labels.unionByName(spark.createDataFrame([(1000 + i, i % 2, i % 3 // 2) for i in range(300)], "doc_id long, quality int, toxic int"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = plainly(rows, [tuple(r) for r in labels.collect()])
    assert found(fa.filter_audit(docs, labels)) == want
    assert {k[0] for k in want} == {"", "aa", "bb", "cc"} and all(sum(v[i] for v in want.values()) for i in range(7))


def test_labels_that_are_not_broadcast(spark, odd_docs, odd_labels, monkeypatch):
    want = found(fa.filter_audit(odd_docs, odd_labels))
    monkeypatch.setattr(fa, "small", lambda *_: False)
    assert found(fa.filter_audit(odd_docs, odd_labels)) == want


def test_empty_tables(no_docs, odd_docs, odd_labels):
    assert fa.filter_audit(no_docs, odd_labels).count() == 0
    assert {r.good_lost + r.toxic_lost for r in fa.filter_audit(odd_docs, odd_labels.limit(0)).collect()} == {0}


def test_one_text_everywhere(spark):
    """A text of a third of all rows: all but the smallest id are copies, in every part."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', 'text ' || id) AS text", "if(id % 2 = 0, 'aa', 'bb') AS lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.part: r for r in fa.filter_audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").collect()}
    assert (rows["aa"].removed, rows["bb"].removed) == (499, 500)


def test_any_number_of_filters_and_parts():
    """Contractions against sums over cells, three filters."""
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (3, 4, 8))
    orders, filters, *_ = fa._steps(3)
    got = fa.figures(counts, 3)
    for p in range(4):
        for s, f in enumerate(filters):
            earlier = orders[s // 3][: s % 3]
            here = [m for m in range(8) if not any(m >> g & 1 for g in earlier)]
            assert got["kept"][p, s] == sum(counts[0, p, m] for m in here if not m >> f & 1)
            assert got["removed"][p, s] == sum(counts[0, p, m] for m in here if m >> f & 1)
            assert got["toxic_lost"][p, s] == sum(counts[2, p, m] for m in here if m >> f & 1)
            assert got["unique_fails"][p, s] == counts[0, p, 1 << f]


def test_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rows = c.execute(oracle_sql()["op11_filter_audit"])
    names = [d[0] for d in rows.description]
    want = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in FIGURES] for r in (dict(zip(names, x, strict=True)) for x in rows.fetchall())}
    assert len(want) % 600 == 0 and found(op11_filter_audit(spark, sf_dir)) == want
