"""Fill-in-the-middle against tokens cut by a regular expression, round trips, and its SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tablestate.llm import fill_middle as fm
from tablestate.llm.queries import op12_fill_in_middle, oracle_sql

TEXTS = ["", "a", " ", "ab cd", "Ünï cödé 🙂🙂 日本語\r\n\ttail", "x" * 5000, "1 2 3\n" * 700, "holds <P> one", "almost < P> <M <S", "<<", ">S><", "a\x00b"]


def plainly(text, doc_id, seed=1, rate=90, spm_rate=20):
    """(n, form, prefix, middle, suffix, output)"""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", p, m, s, text
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return n, form, p, m, s, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_against_tokens(spark, odd_docs):
    rng = random.Random(2)
    drawn = ["".join(rng.choice("abZ 1<>PSM\né🙂") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TEXTS * 8 + drawn)], "doc_id long, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True).selectExpr("*", "'clash' AS output", "3 AS N", "text AS original")
    out = fm.restore(fm.fill_middle(docs).drop("text")).collect()
    assert len(out) == docs.count()
    forms = set()
    for r in out:
        n, form, p, m, _, output = plainly(r.original, r.doc_id)
        forms.add(form)
        assert (r.n, r.form, r.output) == (n, form, output)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored == (r.original or "") and r.restored_sha256 == hashlib.sha256((r.original or "").encode()).hexdigest()
    assert forms == {"plain", "psm", "spm"}


def test_rates_and_seed(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'some words here' AS text")
    for rate, spm, want in ((0, 20, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})):
        assert {r.form for r in fm.fill_middle(docs, rate=rate, spm_rate=spm).collect()} == want
    one, two = (fm.fill_middle(docs, seed=s).select("output").collect() for s in (1, 2))
    assert one != two and one == fm.fill_middle(docs.repartition(7), seed=1).orderBy("doc_id").select("output").collect()


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks(monkeypatch, block):
    """Tokens and cuts don't depend on the blocks in which a text is looked at."""
    monkeypatch.setattr(fm, "BLOCK", block)
    for i, text in enumerate(TEXTS[:11]):
        data = np.frombuffer(text.encode(), np.uint8)
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        n, counts = fm.count_tokens(data)
        assert n == len(tokens)
        for k in {0, 1, n // 2, n}:
            if k <= n:
                assert fm.token_places(data, counts, k) == [len("".join(tokens[:k]).encode())]
        assert fm.rearrange(text.encode(), i)[2].render().decode() == plainly(text, i)[5]


def test_piece_table():
    whole = fm.PieceTable(b"abcdef")
    cut = whole.cut(0, 2, 2, 6)
    assert [bytes(cut.bytes_of(p)) for p in cut.pieces] == [b"", b"ab", b"", b"cdef", b""]
    assert cut.cut(1, 4).render() == b"abcdef" and whole.pieces == [fm.Piece(0, 0, 6)]
    three = whole.cut(1, 3)
    for form in ("psm", "spm"):
        out = three.arranged(form)
        assert fm.PieceTable(out.render()).restored(form).render() == b"abcdef"
        assert out.sha256() == hashlib.sha256(out.render()).hexdigest()


def test_no_rows(no_docs):
    assert fm.restore(fm.fill_middle(no_docs)).count() == 0


def test_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = c.execute(oracle_sql()["op12_fill_in_middle"])
    names = [d[0] for d in rows.description]
    got = op12_fill_in_middle(spark, sf_dir)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, rows.fetchall()))
