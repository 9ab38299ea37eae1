import base64
import hashlib
import math
import random
import time
from collections import Counter

import pytest
import zstandard
from invented import prose

from tablestate.llm import html_extract, warc


def text(html):
    return html_extract.Page(html).text()


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a &amp; b&nbsp;c &#233;&lt;</p>", "a & b c é<"),
        ("<article><h1>T</h1><p>one<b>two</b>\n  three<br>four</p></article><footer>f</footer>", "T onetwo three four"),
        ("<body><nav><ul><li>m</ul></nav><main><p>x<p>y</main><aside>s</aside>", "x y"),
        ("<article><p>x</p><div class='comments'><p>c</p></div><section id=respond>r</section><form>f</form></article>", "x"),
        ("<header>h</header><article><header><h1>t</h1></header>x</article>", "t x"),
        ("<div class='ad-slot'>a</div><div class='cookie-notice'>n</div><div class=sidebar>s</div><div>x</div>", "x"),
        ("<article class='post comments-open'>x<!-- > <p>no</p> --><script>var t='</p>';</script><style>p{}</style>y", "xy"),
        ("<article><p title='a>b'>x</p><img alt='y'><p hidden>z</p></article>", "x"),
        ("<article>a < b <3 c</article>", "a < b <3 c"),
        ("<div><p>a<div>b</div></p>c</div>", "a b c"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>i<li>j</ul></article>", "1 2 3 i j"),
        ("<article><p>cut off", "cut off"),
        ("<title>t</title><article>" + "x" * 500_000, "x" * 500_000),
    ],
)
def test_pages_alone(html, want):
    assert text(html) == want


def site(rng, n, host="h.example"):
    """Pages without telling names: menu, body and footer are divs; the menu and footer repeat."""
    rows = []
    for i in range(n):
        body = "".join(f"<p>{prose(rng, 12)}</p>" for _ in range(3))
        rows.append((i, f"http://{host}/{i}", f"<body><div class=x1><a>home</a><a>shop</a></div><div class=x2>{body}</div><div class=x3>all rights</div></body>", body))
    return rows


def strip(body):
    return body.replace("<p>", "").replace("</p>", " ").strip()


def extracted(spark, rows):
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.main_texts(pages).collect()}


def test_style_tree_removes_what_repeats(spark):
    rows = site(random.Random(1), 40)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.main_texts(pages).collect()}
    for i, _, _, body in rows:
        assert out[i].text == strip(body) and out[i].n_chars == len(strip(body))
    tree = html_extract.style_tree(pages).collect()
    assert {r.host for r in tree} == {"h.example"} and all(0 <= r.importance <= 1 for r in tree)


def test_the_tree_finds_articles_without_telling_names(spark):
    """The boilerplate differs from page to page, no name tells: what is outside the main branch goes."""
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(30):
        title, body = prose(rng, 4), [prose(rng, 30) for _ in range(rng.randint(2, 6))]
        want[i] = " ".join([title, *body])
        rows.append((i, f"http://plain.example/{i}", f"<body><div class=a1><a>{prose(rng, 1)}</a> <a>{prose(rng, 1)}</a></div><div class=a2>{prose(rng, 6)}</div><div class=a3><h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in body)}</div><div class=a4>{prose(rng, 3)}</div></body>"))
    assert extracted(spark, rows) == want


def test_the_tree_overrules_misleading_names(spark):
    """The article stands in an element named like boilerplate, and one that repeats is named an article."""
    rng = random.Random(13)
    rows, want = [], {}
    for i in range(30):
        body = [prose(rng, 30) for _ in range(rng.randint(2, 6))]
        want[i] = " ".join(body)
        rows.append((i, f"http://odd.example/{i}", f"<body><nav>menu</nav><div class=article>read our {prose(rng, 2)}</div><div class=promo>{''.join(f'<p>{x}</p>' for x in body)}<div class=comments>{prose(rng, 9)}</div></div></body>"))
    assert extracted(spark, rows) == want


def brute_tree(pages):
    """Importance, mass and pages of each node from the definition, on trees of (label, [children or texts])."""
    html = lambda n: n if isinstance(n, str) else f"<div class={n[0]}>{''.join(map(html, n[1]))}</div>"
    seen = {}

    def walk(page, path, elements):
        """elements: all elements of the page that are this node, merged."""
        kids, texts, styles = {}, set(), []
        for e in elements:
            for x in e[1]:
                if isinstance(x, str):
                    texts.add(x)
                else:
                    kids.setdefault(x[0], []).append(x)
                    if not styles or styles[-1] != x[0]:
                        styles.append(x[0])
        seen.setdefault(path, {})[page] = (tuple(styles), texts, sorted(kids))
        for name, own in kids.items():
            walk(page, (*path, name), own)

    for i, page in enumerate(pages):
        walk(i, (), [("", page)])
    h = lambda counts, m: -sum(c / m * math.log(c / m, m) for c in counts)
    out = {}
    for path in sorted(seen, key=len, reverse=True):
        own = seen[path]
        m = len(own)
        styles, texts = Counter(s for s, _, _ in own.values()), Counter(x for _, t, _ in own.values() for x in t)
        look = h(styles.values(), m) if m > 1 else 1.0
        content = 1 - sum(math.log(c, m) for c in texts.values()) / max(len(texts), 1) if m > 1 else 1.0
        inner = any(k for _, _, k in own.values())
        means = [x for _, t, k in own.values() if k or t for x in [([out[(*path, c)][0] for c in k] + [content] * bool(t))]]
        weight = len(means)
        inside = sum(sum(x) / len(x) for x in means) / weight if weight else 1.0
        share = 0.9 ** len(styles)
        kids = {(*path, c) for _, _, k in own.values() for c in k}
        mass = sum(len(x) * c for x, c in texts.items()) * content + sum(out[c][1] for c in kids)
        out[path] = ((1 - share) * look + share * inside if inner else content, mass, m)
    return out, ["<body>" + "".join(map(html, p)) + "</body>" for p in pages]


def test_importance_by_brute_force(spark):
    rng = random.Random(14)

    def element(depth):
        kids = [element(depth + 1) if depth < 4 and rng.random() < 0.6 else rng.choice(["same", "text", prose(rng, 3)]) for _ in range(rng.randint(0, 3))]
        kids = [x for k, x in enumerate(kids) if not (isinstance(x, str) and k and isinstance(kids[k - 1], str))]  # neighbours would be one text
        return (rng.choice(["ka", "kb", "kc"]), kids)

    want, html = brute_tree([[element(0) for _ in range(rng.randint(1, 3))] for _ in range(25)])
    pages = spark.createDataFrame([(i, f"http://t.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    names = {}
    for path in want:
        node = 0
        for label in path:
            node = html_extract._node(node, f"div.{label}")
        names[node] = path
    got = {names[r.node]: (r.importance, r.mass, r.pages) for r in html_extract.style_tree(pages).collect()}
    assert set(got) == set(want)
    for path, (importance, mass, m) in want.items():
        assert got[path][2] == m and math.isclose(got[path][0], importance, abs_tol=1e-9) and math.isclose(got[path][1], mass, abs_tol=1e-6)


def test_deep_pages(spark):
    deep = "<div>w " * 20_000
    out = extracted(spark, [(1, "http://d.example/1", deep), (2, "http://d.example/2", deep), (3, "http://d.example/3", "<article><p>x</article>")])
    assert out == {1: "w " * 19_999 + "w", 2: "w " * 19_999 + "w", 3: "x"}


def test_broadcast_and_join_agree(spark, monkeypatch):
    pages = spark.createDataFrame([r[:3] for r in site(random.Random(2), 20) + site(random.Random(3), 3, "few.example")], "page_id long, url string, html string")
    near = sorted(map(repr, html_extract.main_texts(pages).collect()))
    monkeypatch.setattr(html_extract, "small", lambda *a: False)
    assert sorted(map(repr, html_extract.main_texts(pages).collect())) == near


def test_odd_pages(spark):
    rows = [(1, "http://a.b/", None, "x"), (2, None, "<p>t</p>", "x"), (None, "no host", "<p>u</p>", None), (2, None, "<p>t</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(repr((r.page_id, r.text, r.n_chars)) for r in html_extract.main_texts(pages).collect()) == sorted(map(repr, [(1, "", 0), (2, "t", 1), (None, "u", 1), (2, "t", 1)]))
    assert html_extract.main_texts(pages.limit(0)).count() == 0


def test_a_site_of_copies_keeps_its_articles(spark):
    rows = [(i, f"http://c.example/{i}", "<nav>n</nav><article><h1>T</h1><p>same words on each page</p></article>") for i in range(30)]
    out = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"T same words on each page"}


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    out = []
    for i, _, h in rows:
        n, m = len((h or "").encode()), last.get(h or "")
        copies = sum((x[2] or "") == (h or "") for x in rows)
        response = copies == 1 or n < least or m is None or i == m
        out.append((i, n, sha(h), "response" if response else "revisit", None if response else m))
    return sorted(map(repr, out))


WARC = [(i, f"http://w/{i}\r\nX: y", f"<p>{i % 7}</p>" * (i % 7 + 1)) for i in range(60)] + [(70, None, None), (71, "u", ""), (None, "u", "<p>1</p><p>1</p>"), (None, "u", "alone"), (72, "é", "ü" * 300_000), (5, "again", "<p>5</p>" * 6)]


@pytest.mark.parametrize("least,joined", [(0, False), (20, False), (0, True)])
def test_warc_round_trip(spark, monkeypatch, least, joined):
    if joined:
        monkeypatch.setattr(warc, "small", lambda *a: False)
    pages = spark.createDataFrame([(*r, "x") for r in WARC], "page_id long, url string, html string, record_type string")
    out = warc.archived(pages, least).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out) == brute(WARC, least)
    assert warc.archived(pages.limit(0)).count() == 0


def test_bundle_is_seekable_and_plain_zstandard():
    w = warc.BundleWriter(frame_bytes=500)
    records = [warc.record(i, f"http://x/{i}", b"p" * i, sha("p" * i), True, None) for i in range(50)]
    for i, r in enumerate(records):
        w.add(i, r)
    data = w.finish()
    reader = warc.BundleReader(data)
    assert len(reader.sizes) > 5
    assert reader.find(33)["payload"] == b"p" * 33 and reader.find(99) is None
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as f:
        assert f.read() == b"".join(records)


@pytest.mark.parametrize(
    "source,texts",
    [
        ('<p>good</p><a title="foo>bar</a><p>more</p>', ["good", "bar", "more"]),
        ("x <a <a y", ["x"]),
        ("<p>1 < 2 and it's <b class='x>y</b>z</p><div>w</div>", ["1 < 2 and it's yz", "w"]),
        ('<div id="q>one</div><div>two</div>three', ["one", "two", "three"]),
        ("a<!-- open <p>b</p>", ["a"]),
        ("<p>a<div title='1 > 0'>b</div>", ["a", "b"]),
    ],
)
def test_no_markup_in_texts(source, texts):
    """Quotes that never close, tags without an end: what is dropped ends at the next angle bracket."""
    assert [t for t, _ in html_extract.Page(source).blocks] == texts


@pytest.mark.parametrize("part", ["<form>x", "<div>", "<a ", '<a "', "<a \"'", "<!", "<li><div><x>", "<p><x>", "<!--", "<b><i></b>", "<", '<div class="x\'>', "</", "<table><tr><td>", "<x></y>"])
def test_hostile_pages_take_linear_time(part):
    """A quarter of a megabyte of one piece, and closing tags after it that find nothing: well under what a square would take."""
    began = time.process_time()
    html_extract.Page(part * (250_000 // len(part)) + "</z>" * 5000)
    assert time.process_time() - began < 3


def test_long_hostile_pages_whole(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", p * (200_000 // len(p))) for i, p in enumerate(["<form>x", "<a ", "<div>", "<b><i></b>"])], "page_id long, url string, html string")
    got = {r.page_id: r.n_chars for r in html_extract.main_texts(pages).collect()}
    assert len(got) == 4 and got[1] == got[2] == 0
