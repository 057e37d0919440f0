"""Main text of pages, phrase collocations and spelling variants."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartolake.llm import html_text, phrases, spelling

SITE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<div id="cookie-banner">We use cookies. <button>OK</button></div><header><a href=/>Site</a></header><nav class=main-nav><a href=/a>A</a> <a href=/b>B</a></nav>
<main><article><header><h1>Big   news</h1></header><p>First &amp; best&nbsp;para,<br>a &lt; b <!-- no > --> end.</p><p>To.</p><div class="ad">Buy now</div><pre>x
y</pre><form>Sign up<input></form>
<section id="comments"><p>Nice article, I read the whole thing twice.</p></section></article></main><aside>Hot stuff</aside><footer>&copy; 2020</footer></body></html>"""
CLASSES = """<body><div class=top><a href=1>Home</a> <a href=2>News</a></div><div class="post-content"><h2>Title here</h2><p>One two three four five six seven eight nine ten.
<p>Short one.<p>Another paragraph with several words in it, to be sure of it.</div><div class="comment-list"><p>I like this very much indeed and so on.</p></div><div class=footer>Terms"""


def texts(spark, pages):
    rows = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.main_text(rows).orderBy("page_id").collect()]


def test_main_text_of_written_pages(spark):
    plain = "just text without a tag, which is a page of its own and goes on for a while"
    got = texts(spark, [SITE, CLASSES, None, "", plain, "<article><p>cut &am", "<article>1 < 2 & <3 <b title='a>b'>x</b></article>", "<script>never ends <article>x</article>", "<p>" * 3000 + "<article>deep " + "word " * 60_000])
    assert got[0].split("\n\n") == ["Big news", "First & best para, a < b end.", "To.", "x y"]
    assert got[1].split("\n\n") == ["Title here", "One two three four five six seven eight nine ten.", "Short one.", "Another paragraph with several words in it, to be sure of it."]
    assert got[2:8] == ["", "", plain, "cut &am", "1 < 2 & <3 x", ""]
    assert got[8] == "deep " + ("word " * 60_000).strip()


def test_main_text_of_other_layouts_held_out(spark):
    pages = html_text.labelled_pages(200, 99)
    got = texts(spark, [p for _, p, _ in pages])
    found = kept = right = 0
    for (_, _, main), text in zip(pages, got, strict=True):
        have, want = Counter(x for x in text.split("\n\n") if x), Counter(main)
        right += sum((have & want).values())
        found += sum(have.values())
        kept += sum(want.values())
    assert right / found > 0.97 and right / kept > 0.97


def test_main_text_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, SITE, "x"), (1, None, SITE, "x"), (None, "u", None, None)], "page_id long, url string, html string, blocks string")
    got = html_text.main_text(rows).collect()
    assert len(got) == 3 and {r.n_chars for r in got} == {0, len(next(r.text for r in got if r.text))}
    assert html_text.main_text(rows.limit(0)).count() == 0


def plain_collocations(rows, min_count, top):
    import re

    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, c in counts.items():
        found = {p: f for p, f in c.items() if len(p) > 1 and f >= min_count}
        inside = set()
        for p, f in found.items():
            for n in range(2, len(p)):
                inside |= {p[i : i + n] for i in range(len(p) - n + 1) if 100 * f >= 100 * c[p[i : i + n]]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, x, y, totals[lang], s) for i, (s, a, p, x, y) in enumerate(rows[:top])]
    return sorted(out)


def test_collocations_equal_plain_counts(spark, real, odd, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 20_000)
    twice = real.limit(80).select("text", F.when(F.col("lang") != "de", F.col("lang")).alias("lang")).unionByName(odd.select("text", "lang"))
    twice = twice.unionByName(spark.createDataFrame([("x\ty z, X Y\t\tz! x y z? über\n x y Über", "a\nb"), ("x y z " * 50, "a\nb"), (None, None)], "text string, lang string"))
    rows = [(r.text, r.lang) for r in twice.collect()]
    got = phrases.collocations(twice, min_count=3, top=500)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 3, 500)


def test_collocations_empty(spark, empty):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en"), (" ,. ", "en")], "text string, lang string")).count() == 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    import re

    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {w: best for w, vs in near.items() if vs and n[best := min(vs, key=lambda v: (-n[v], v))] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def test_variants_equal_plain_search(spark, real, odd):
    docs = real.limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(90, "Straße strasse ÄRGER ärger houses house houses house mouse " * 40), (91, "hause hause hause hauses hauses hauses haus×e×÷aa " * 3)], "doc_id long, text string"))
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted((tuple(r) for r in spelling.variants(docs).collect()), key=lambda r: r[0])
    assert [tuple(r) for r in got] == want and any(r[1] for r in want)


@pytest.mark.parametrize("split_pairs", [1, 5, 2_000])
def test_near_pairs_split_keys_lose_nothing(spark, split_pairs):
    import itertools
    import random

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(260)} | {"prefix" + "".join(rng.choice("xy") for _ in range(5)) for _ in range(40)})
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(rows, split_pairs).collect())
    assert got == sorted(p for p in itertools.combinations(words, 2) if min(map(len, p)) > 1 and one_edit(*p))


def test_roots_follow_long_ways(spark):
    rows = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string")
    assert {r.root for r in spelling.roots(rows).collect()} == {"w40"}


def test_variants_empty(spark, empty):
    assert spelling.variants(empty).count() == 0
