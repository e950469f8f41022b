"""Nearest neighbours, chat, HTML, URLs, mixing and the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import ann, chat, graph, html_extract, mixing, queries, url_filter
from chronolith.llm.graph import components


# Nearest neighbours


def brute(ids, x, query, k):
    s = x @ x[ids.index(query)]
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-s[i], ids[i]))[:k]
    return [(ids[i], s[i]) for i in order]


def test_nearest_with_copies_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 20)).astype(np.float32)
    x[300:600] = x[7]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 20), (1040, [float("nan")] + [1.0] * 19), (1060, [float("inf")] + [1.0] * 19), (1080, [None] + [1.0] * 19), (1100, [1.0] * 3), (None, [1.0] * 20), (40, x[40].tolist())]
    df = spark.createDataFrame([(*r, "e") for r in rows + odd], "vec_id long, embedding array<float>, e string").repartition(5)
    got = defaultdict(list)
    for q in ann.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
        assert q.rank == len(got[q.query_id])
    assert sorted(got) == list(range(0, 900, 20))
    y, hit = x.astype(np.float64), 0
    for q, found in got.items():
        want = brute(list(range(900)), y, q, 20)
        hit += len({i for i, _ in found} & {i for i, _ in want})
        for i, s in found:
            assert math.isclose(s, float(y[q] @ y[i]), rel_tol=1e-9)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit / (20 * len(got)) >= 0.9
    assert [i for i, _ in got[300]][:20] == [7, *range(301, 320)] or [i for i, _ in got[300]][:20] == [7, *(i for i in range(301, 320))]


@pytest.mark.parametrize("clusters", [200, 0])
def test_recall_of_a_part_of_the_cells(spark, clusters):
    """20,000 vectors, clustered and without any structure: recall against brute
    force where each query meets only a part of them."""
    r = np.random.default_rng(3)
    d = 16 if clusters else 32
    x = r.normal(size=(20_000, d)).astype(np.float32)
    if clusters:
        x = (2 * r.normal(size=(clusters, d))[r.integers(0, clusters, len(x))] + 0.4 * x).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)})).repartition(4)
    report: dict = {}
    found = defaultdict(set)
    for q in ann.search(df, F.col("vec_id") % 100 == 0, k=20, report=report).collect():
        found[q.query_id].add(q.vec_id)
    asked = np.arange(0, len(x), 100)
    scores = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, 1, kind="stable")[:, :20]
    recall = np.mean([len(found[q] & set(b.tolist())) / 20 for q, b in zip(asked.tolist(), best)])
    print("recall", recall, report)
    assert recall >= 0.9
    assert report["visited_share"] < (0.1 if clusters else 0.7)
    assert report["cells"] == 4 * math.isqrt(len(x))


def test_recall_on_the_tables(spark, sf):
    """The query itself against brute force over its whole table."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = defaultdict(set)
    for r in queries.op1_ann(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
        assert math.isclose(r.score, float(x[ids.index(r.query_id)] @ x[ids.index(r.vec_id)]), rel_tol=1e-9)
    want = {q: {i for i, _ in brute(ids, x, q, 20)} for q in ids if q % 20 == 0}
    assert set(got) == set(want)
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(20 * i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 3), (20, 3), (40, 3), (60, 3)]
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_tables_equal_inner_products_of_codes():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 10)).astype(np.float32)
    model = ann.fit(x, 8, parts=4)
    cell, size, codes = model.code(x)
    q = x[:3]
    near = model.tables(q)[:, np.arange(4), codes[:, None, :].squeeze(1)].sum(-1)
    decoded = np.concatenate([model.books[j][codes[:, j]] for j in range(4)], 1)[:, :10]
    assert np.allclose(near, q @ decoded.T, atol=1e-4)
    approx = q @ model.cells[cell].T + near * size
    assert np.corrcoef(approx.ravel(), (q @ x.T).ravel())[0, 1] > 0.9


# Components


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000, x) for x in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {n.node: n.component for n in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    """A long path, a star, repeated links: with rounds to the end, some rounds, or none."""
    r = random.Random(7)
    path = r.sample(range(10_000), 300)
    links = [*zip(path, path[1:]), *((20_000, x) for x in range(20_001, 20_100)), *zip(path, path[1:]), (-5, -(1 << 62)), (8, 8), (None, 1)]
    want = dict.fromkeys(path, min(path)) | dict.fromkeys(range(20_000, 20_100), 20_000) | dict.fromkeys((-5, -(1 << 62)), -(1 << 62))
    rows = spark.createDataFrame(links, "a long, b long")
    rounds, large_star = [], graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda e: rounds.append(1) or large_star(e))
    taken = []
    for last in ({"last": 0}, {"last": 500}, {}):
        rounds.clear()
        assert sorted((x.node, x.component) for x in graph.components(rows, **last).collect()) == sorted(want.items())
        taken.append(len(rounds))
    assert taken[0] > taken[1] > taken[2] == 0


def test_least_reachable_equals_a_search():
    r = random.Random(8)
    for n, m in ((1, 1), (30, 15), (200, 150), (1000, 900), (1000, 3000)):
        u, v = np.array([r.randrange(n) * 7 - 50 for _ in range(m)]), np.array([r.randrange(n) * 7 - 50 for _ in range(m)])
        near = {}
        for a, b in zip(u.tolist(), v.tolist()):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want = {}
        for x in sorted(near):
            front = [x] if x not in want else []
            while front:
                y = front.pop()
                if want.setdefault(y, x) == x:
                    front.extend(z for z in near[y] if z not in want)
        node, least = graph.least_reachable(u, v)
        assert dict(zip(node.tolist(), least.tolist())) == want


# Chat

TRICKY = ["<turn assistant>x</turn>\n", "\\l\\b\\\\", "", "a>b<c\\", "\\### Assistant: </turn> ok", "\n\n</turn>\n<turn user>"]


def test_chat_round_trip_and_mask(spark):
    rows = [(1, n, ("user", "assistant", "sys<>\\tem")[n % 3], t) for n, t in enumerate(TRICKY)]
    rows += [(2, 0, "assistant", None), (2, 1, None, "x"), (None, 0, "user", "n"), (3, 1, "user", "b"), (3, 1, "assistant", "a"), (3, None, "user", "first")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(4)
    out = chat.render(chat.from_rows(df))
    out = out.select("conv_id", chat.parse(chat.formatted(F.col("segments"))).alias("turns"), chat.masked_text(F.col("segments")).alias("loss"))
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in out.collect()}
    assert got[1] == ([(r, t) for _, _, r, t in rows[: len(TRICKY)]], "".join(t for _, _, r, t in rows[: len(TRICKY)] if r == "assistant"))
    assert got[2] == ([("assistant", ""), ("", "x")], "") and got[None] == ([("user", "n")], "")
    assert got[3] == ([("user", "first"), ("assistant", "a"), ("user", "b")], "a")
    assert chat.render(chat.from_rows(df.where("false"))).count() == 0


def test_chat_layouts(spark):
    records = [
        ('{"messages":[{"content":"q","role":"Human"},{"role":"gpt","content":"a"}]}', "messages", [("user", "q"), ("assistant", "a")]),
        ('{"completion":"c","prompt":"p"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ('{"instruction":"i","input":"","output":"o"}', "instruction", [("user", "i"), ("assistant", "o")]),
        ('{"instruction":"i","input":"x","output":"o"}', "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"system":"s","prompt":"p","response":"r"}', "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"conversations":[{"from":"human","value":"q"}]}', "from_value", [("user", "q")]),
        ('{"other":1}', None, None),
        ("{broken", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, j) for i, (j, _, _) in enumerate(records)], "i long, j string")
    for r in chat.from_json(df, "j").collect():
        _, layout, turns = records[r.i]
        assert (r.layout, r.turns and [tuple(t) for t in r.turns]) == (layout, turns)
    d = spark.createDataFrame([("p", "r", 1)], "prompt string, response string, extra int")
    assert [tuple(t) for t in chat.canonical(d, ("prompt", "response")).first().turns] == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError):
        chat.canonical(d, ("prompt", "extra"))
    m = spark.createDataFrame([(5, 1, "assistant", "b"), (5, 0, "user", "a")], "conversation_id long, position long, role string, content string")
    assert [tuple(t) for t in chat.canonical(m, tuple(m.columns)).first().turns] == [("user", "a"), ("assistant", "b")]


# HTML

PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<div id="cookie-notice"><p>We use cookies to make this site work for you.</p><button>OK</button></div>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav>
<!-- an ad --><div class="ad">Buy now, only today, the best offers.</div>
{main}
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/x">Another story about things</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all, sorry to say.</p></div></section>
<form class="search"><label>Search</label><input name="q"><textarea>type here</textarea></form>
<footer>&copy; 2024 Example &middot; All rights reserved.</footer></body></html>"""


@pytest.mark.parametrize(
    "main,want",
    [
        ("<article><h1>Title of it</h1><p><b>First  paragraph,\n with &lt;marks&gt;.<br><p>Second one is here.</p><p>Yes.</p></article>", ["Title of it", "First paragraph, with <marks>.", "Second one is here.", "Yes."]),
        ("<main><h1>A headline of some length</h1><p>One sentence here, and then another one. It goes on for a while.</p><blockquote>Quoted words, said by someone who was there.</blockquote></main>", ["A headline of some length", "One sentence here, and then another one. It goes on for a while.", "Quoted words, said by someone who was there."]),
    ],
)
def test_main_text(main, want):
    assert html_extract.main_text(PAGE.format(main=main), html_extract.trained()).split("\n\n") == want


def labelled_texts(source):
    """The main text of a training page, and the page without its marks."""
    p = html_extract.Page(source)
    bare = lambda t: t.replace("\x01", "").replace("\x02", "")
    return "\n\n".join(bare(t).strip() for t in p.text.values() if "\x01" in t or "\x02" in t), bare(source)


def test_accuracy_on_pages_not_trained_on(monkeypatch):
    """Words of made pages that no training page had, with many stray names."""
    model = html_extract.trained()
    monkeypatch.setattr(html_extract, "STRAY", 0.2)
    hit = kept = wanted = exact = 0
    pages = html_extract.training_pages(150, seed=4321)
    for want, bare in map(labelled_texts, pages):
        got = html_extract.main_text(bare, model)
        a, b = Counter(got.split()), Counter(want.split())
        hit, kept, wanted, exact = hit + sum((a & b).values()), kept + sum(a.values()), wanted + sum(b.values()), exact + (got == want)
    print("precision", hit / kept, "recall", hit / wanted, "exact", exact / len(pages))
    assert hit / kept > 0.95 and hit / wanted > 0.95 and exact / len(pages) > 0.6


def test_odd_pages():
    text = lambda s: html_extract.main_text(s, html_extract.trained())
    assert "be kind to one another" in text("<article class='post-comment-policy'><h1>Rules of this place</h1><p>First of all, be kind to one another. It helps.</p><p>Second, stay on the subject.</p></article>")
    assert text(f"<p a='{'x' * 5000}>b'>Text of a paragraph that is here.</p>") == "Text of a paragraph that is here."
    page = "<article><header><h1>Title here</h1></header><p>One sentence here, and then another one. It goes on.</p><figure><img src=x><figcaption>A caption of the picture.</figcaption></figure><p>Where a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is given. That is all.</p></article>"
    assert text(page).split("\n\n") == ["Title here", "One sentence here, and then another one. It goes on.", "A caption of the picture.", "Where a x=2 is given. That is all."]


def test_quotes_that_never_close_are_read_in_linear_time():
    p = html_extract.Page("<p>one</p>" + "<p a=\"b" * 40_000)
    assert next(iter(p.text.values())) == "one"


def test_decoding_never_contradicts_itself():
    r = random.Random(3)
    for s in html_extract.training_pages(30, seed=5):
        p = html_extract.Page(s)
        odds = np.array([r.uniform(-3, 3) for _ in p.tag])
        keep = html_extract.decode(p, odds)
        assert all(keep[p.parent[i]] for i in range(1, len(p.tag)) if keep[i])


def test_decoding_is_optimal():
    p = html_extract.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div>")
    n, r = len(p.tag), random.Random(9)
    for _ in range(20):
        odds = np.array([r.uniform(-2, 2) for _ in range(n)])
        gain = [o * (1 + min(4.0, len(p.text[i]) / 200)) if i in p.text else o for i, o in enumerate(odds)]
        best = max(sum(gain[i] for i in range(1, n) if m >> i & 1) for m in range(0, 1 << n) if all(not m >> i & 1 or p.parent[i] == 0 or m >> p.parent[i] & 1 for i in range(1, n)))
        got = html_extract.decode(p, odds)
        assert math.isclose(best, sum(gain[i] for i in range(1, n) if got[i]), abs_tol=1e-9)


def test_markup_is_read_leniently():
    for s in ("", "<", "<p", "<p><b>x", "<!-- never closed", "<script>x", "a < b", "</p></div>x", "<p a='b", "<ul><li>a<li>b</ul>", "<" * 3000, "<div>" * 2000 + "x", '<p a="' * 500):
        p = html_extract.Page(s)
        assert len(p.tag) == len(p.parent) == len(p.end) and all(p.parent[i] < i for i in range(1, len(p.tag)))
    assert list(html_extract.Page("<p>a<p>b &amp; c<br>d").text.values()) == ["a", "b & c d"]


def test_extracted_text_of_the_tables(spark, sf):
    """The pages' articles, whose elements are named in their markup."""
    import re

    got = {r.page_id: r for r in queries.op6_html(spark, sf).collect()}
    import html as h

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", b.replace("<br>", "\n"))).split()) for b in re.split("</?p>|</?h1>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_html_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>", "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df, keep=("url",)).collect()
    assert sorted(r.text for r in got) == ["", "", ""]
    assert html_extract.extract(df.where("false")).count() == 0


# URLs


def test_url_parts_and_rules(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/7?x#y", "www.example.com", "/en/7", "example.com/en/7", "allow"),
        (2, "http://a.com", "a.com", "", None, "allow"),
        (3, "http://com/en/", "com", "/en/", "com/en/", "block"),
        (4, "http://xcom/en/", "xcom", "/en/", None, "allow"),
        (5, "no scheme/en/", "", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "http://b.example.net/de/8", "b.example.net", "/de/8", "example.net/de/8", "block"),
        (8, "http://b.example.net/de/1://x/", "b.example.net", "/de/1://x/", "net/de/", "allow"),
        (9, "http://q.org?a/es/", "q.org", "", None, "allow"),
        (10, "http://Ä.ORG/es/1", "Ä.org", "/es/1", "org/es/", "block"),
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u, *_ in rows], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, queries.RULES, F.lit(None).cast("boolean")).collect()}
    assert got == {i: tuple(x) for i, _, *x in rows}
    assert url_filter.judge(df.where("false"), queries.RULES, F.lit(None).cast("boolean")).count() == 0


def test_templates_and_purity(spark):
    rows = [(i, f"http://h.x/good/{i}.html", False) for i in range(30)] + [(100 + i, f"http://h.x/bad/{i}", True) for i in range(30)]
    rows += [(200 + i, f"http://h.x/tag/{''.join(chr(97 + (i * k) % 26) for k in (1, 3, 7))}{i}x", i % 2 == 0) for i in range(40)]
    rows += [(300, "http://h.x/bad/999999", None), (301, "http://h.x/good/31.html", None), (302, "http://other.x/bad/1", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    out = {r.page_id: r for r in url_filter.judge(df, (), F.col("bad")).collect()}
    assert out[300].verdict == "block" and out[301].verdict == "allow" and out[302].verdict == "allow"
    assert len({out[i].template for i in range(200, 240)}) == 1 and out[0].template == out[301].template
    # Purity by hand: host 30 + 20 bad of 100, template 30 of 30.
    host = (50 + url_filter.SMOOTHING * url_filter.PRIOR) / (100 + url_filter.SMOOTHING)
    assert math.isclose(out[300].purity, 1 - (30 + url_filter.SMOOTHING * host) / (30 + url_filter.SMOOTHING))


def test_unlabelled_branches_do_not_join_those_that_differ(spark):
    """Siblings with 0 bad of 5, none labelled, and 5 bad of 5."""
    rows = [(i, f"http://h.x/{'abc'[i % 3]}/page", (False, None, True)[i % 3]) for i in range(15)]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), (), F.col("bad")).collect()}
    assert [out[i].verdict for i in range(3)] == ["allow", "allow", "block"]
    assert len({out[i].template for i in range(3)}) == 3
    alike = [(i, f"http://h.x/{'ab'[i % 2]}/page", i % 4 < 2) for i in range(40)]
    out = url_filter.judge(spark.createDataFrame(alike, "page_id long, url string, bad boolean"), (), F.col("bad"))
    assert out.select("template").distinct().count() == 1


def test_url_sql_on_bushy_trees(spark, tmp_path):
    """Spark and SQL agree where levels are generalised and siblings merge."""
    import duckdb

    r = random.Random(5)
    hosts = ["a.example.com", "b.example.net", "spam.c.org", "d.io", "www.d.io"]
    paths = [f"/p/{i}" for i in range(40)] + [f"/tag/w{'xyz'[i % 3]}{i}q/list" for i in range(60)] + ["/de/8", "/en/7", "", "/", "/a/b/c/d/e/f/g", "/x//y/2024-01-02", "/f.html", "/123abc45f.php"]
    urls = [(i, f"http{'s' * (i % 2)}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=1', '#t'])}") for i in range(1500)] + [(9000, None), (9001, "nothing"), (9002, "://")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, i % 2, int(i < 20)) for i in range(30)] + [(3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(queries.ORACLE_SQL["op8_url_filter"]).fetchall()
    got = [tuple(x) for x in queries.op8_url_filter(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want) and {x[-1] for x in got} == {"allow", "block"}


# Mixing


def test_targets_equal_repeated_resharing(spark):
    r = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i}": r.choice([0, 5, 100, 1000, 40_000]) + r.randrange(50) * (r.random() < 0.7) for i in range(r.randint(1, 9))} | {None: r.randrange(100)}
        names = [*sorted(k for k in sizes if k is not None), None]
        weight = {n: i % 3 + 1 for i, n in enumerate(names)}
        total, capped = sum(sizes.values()), set()
        while True:
            left, w = total - sum(3 * sizes[n] for n in capped), sum(weight[n] for n in names if n not in capped)
            share = {n: 3 * sizes[n] if n in capped else left * weight[n] / w for n in names}
            over = {n for n in names if n not in capped and share[n] > 3 * sizes[n]}
            if not over:
                break
            capped |= over
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x.source: x.target for x in mixing.targets(df).collect()}
        assert all(math.isclose(got[n], share[n], rel_tol=1e-9, abs_tol=1e-6) for n in names)


def test_mix_takes_what_it_should(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(1000, None, "a"), (1001, "x y", "tiny"), (None, "x", "a")]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, source string, target double").repartition(4)
    q = spark.createDataFrame([(i, 2.0 if i % 2 else None) for i in range(600)], "doc_id long, weight double")
    got = mixing.mix(df, q).collect()
    assert Counter((x.doc_id, x.size) for x in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    by = defaultdict(list)
    for x in got:
        by[x.source].append(x)
        assert 0 <= x.taken <= 3 * x.size and x.taken == x.size * x.copies
    for docs in by.values():
        epochs = int(docs[0].target // docs[0].source_size)
        assert {x.copies for x in docs if x.size} <= {epochs, epochs + 1}
        assert abs(sum(x.taken for x in docs) - docs[0].target) <= max(x.size for x in docs) / 2
    again = mixing.mix(df.repartition(7), q, slices=3)
    assert Counter((x.doc_id, x.taken, x.size) for x in again.collect()) == Counter((x.doc_id, x.taken, x.size) for x in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_quality_makes_documents_likelier(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    q = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(df, q, weights=(1, 7)).where("source = 'a'").groupBy(F.col("doc_id") % 2).agg(F.sum("copies").alias("n")).collect()
    n = {r[0]: r.n for r in got}
    assert n[0] > 1.5 * n[1] > 0


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(8)
    en, de = (["".join(r.choices(a, k=r.randint(2, 6))) for _ in range(120)] for a in ("abcdefgh", "mnopqrst"))
    rows = [(i, " ".join(r.choices((en, de)[i % 2], k=80)), ("en", "de")[i % 2], f"s{i % 3}") for i in range(90)]
    rows += [(100, rows[0][1] + " \n", "en", "s0"), (101, rows[1][1], "de", "s1"), (102, "123 !!", "en", "s0"), (103, None, None, None), (104, "", "en", "s2")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    kept = stages["language_id"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {*range(90), 100, 101}
    kept = stages["exact_dedup"](spark, kept, str(tmp_path))
    assert {x.doc_id for x in kept.collect()} == ({*range(1, 90)} | {100})  # the longer original of a class stays
    kept = stages["simhash_near_dedup"](spark, kept, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 90
    mixed = stages["source_mixing"](spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns and 80 <= mixed.count() <= 100
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {x.doc_id: x.text for x in mixed.collect()}
    assert len(out) == mixed.count() and all(x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest() for x in out)


def test_pipeline_stages_with_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(120)]
    texts = [" ".join(r.choices(words, k=80)) for _ in range(40)]
    ids = [None] * 10 + [7] * 10 + list(range(100, 120))
    rows = [(i, t, "en", "s0", len(t)) for i, t in zip(ids, texts)]
    rows += [(None, texts[25], "en", "s0", 0), (7, texts[26], "en", "s0", 0), (7, texts[12], "en", "s0", 0), (None, "12 !!", "en", "s0", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    kept = stages["language_id"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and pairs(kept) == sorted(((x[0], x[1]) for x in rows[:-1]), key=str)
    kept = stages["exact_dedup"](spark, kept, str(tmp_path))
    want = list(zip(ids, texts))
    want[26] = (7, texts[26])  # the smaller id stays; one without an id goes
    assert kept.columns == docs.columns and pairs(kept) == sorted(want, key=str)
    near = stages["simhash_near_dedup"](spark, kept, str(tmp_path))
    assert near.columns == docs.columns and pairs(near) == sorted(want, key=str)
    mixed = stages["source_mixing"](spark, near, str(tmp_path))
    copies = mixing.mix(near, queries.quality_weights(spark.read.parquet(str(tmp_path / "labels.parquet")))).agg(F.sum("copies")).first()[0]
    assert mixed.columns == docs.columns and mixed.count() == copies
    assert {i for i, _ in pairs(mixed)} >= {None, 7}


# Elements that hold text beside markup of their own


def page_text(source):
    return " ".join(html_extract.Page(source).text.values())


@pytest.mark.parametrize("tag", "object noscript canvas svg".split())
def test_text_in_embedded_elements_is_left_to_the_trees(tag):
    assert page_text(f"<article><p>one</p><{tag}><p>two</p></{tag}><p>three</p></article>") == "one two three"
    assert page_text(f"<article><{tag}><p>one</p><p>two</p></article><p>three</p>") == "one two three"


def test_embedded_elements_stay_within_their_paragraph():
    page = html_extract.Page("<p>one <svg><path d='x'/><text>two</text></svg> three <math><mi>x</mi><br/></math> four</p><p>five</p>")
    assert page.tag.count("p") == 2 and " ".join(page.text.values()) == "one two three x four five"
    first = page.tag.index("p")
    assert [t for i, t in page.text.items() if first < i < page.end[first]] == ["one", "two", "three x four"]


def test_only_raw_text_runs_to_the_end_of_the_page():
    for tag in ("template", "select"):
        assert page_text(f"<p>one</p><{tag}>two</{tag}><p>three</p>") == "one three"
        assert page_text(f"<p>one</p><{tag}><p>two</p><p>three</p>") == "one two three"
    for tag in ("script", "style", "title", "textarea"):
        assert page_text(f"<p>one</p><{tag}><p>two</p>") == "one"
