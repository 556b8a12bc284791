from __future__ import annotations

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import html_extraction as H
from veilspark.llm import language_id, toxicity, vptree

DATA = "/root/testdata/sf0.1"


# -- toxicity --------------------------------------------------------------------------------------


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out(spark):
    """Text decides the labels of insults only in part here, so the bar is on English rows."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = toxicity.toxicity(docs, labels)
    assert out.count() == docs.count() and out.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    rows = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id)
    label = rows.toxic.to_numpy()
    assert auc(rows.score.to_numpy(), label) > 0.75 and (rows.predicted == label).mean() > 0.93
    assert rows[rows.predicted == 1].toxic.mean() > 0.9


def test_edges(spark, docs, texts, none):
    labels = spark.createDataFrame([(0, 1, 9), (1, None, 9), (None, 0, 9)], "doc_id long, toxic int, score int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(none, labels).count() == 0
    empty = labels.filter("false")
    assert {r.score for r in toxicity.toxicity(docs, empty).collect()} == {0.0}
    kept = toxicity.score(docs, toxicity.fit(docs, empty), keep=0.5)
    assert kept.columns == docs.columns and kept.count() == len(texts)


def test_features_see_through_disguise():
    lexicon = {b"idiot": 9.0}
    plain, hidden, spaced, clean = (toxicity.features(t, lexicon) for t in ("you are an idiot", "you are an 1diot id1ot", "you are an i.d.i.o.t", "you are an artist"))
    assert plain[0] > 0 and plain != clean and hidden[-5] > 0 and spaced[-5] > 0 and clean[-5] == 0
    assert len({len(x) for x in (plain, toxicity.features("", lexicon))}) == 1


def test_rows_without_and_with_repeated_ids(spark):
    """A null id is never held out; ids that repeat count once in the fit, whichever their texts."""
    rows = [(i, "you idiot clown" if i % 2 else "a fine day") for i in range(60)] * 2 + [(None, "x"), (7, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(r.held_out is (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == (r.doc_id % 2) for r in out if r.doc_id is not None and r.doc_id != 7)


def plain_margin(trees, x):
    """One row's margin, tree by tree and level by level."""
    out = trees.base
    for tree, leaf in trees.trees:
        node = 0
        for column, cut in tree:
            c = column[node]
            node = node * 2 + (sum(e <= x[c] for e in trees.edges[c]) > cut[node])
        out += leaf[node]
    return out


def test_trees_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    own = toxicity.Boosted().fit(x, (x[:, 1] + x[:, 2] > 0.5).astype(float))
    assert np.allclose(own.margin(x[:40]), [plain_margin(own, r) for r in x[:40]])


def test_isotonic():
    x, p = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(p) >= 0).all() and np.interp(4, x, p) > np.interp(2.5, x, p) > np.interp(1, x, p)


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    assert ((toxicity.Boosted().fit(x, y).margin(x) > 0) == (y > 0)).mean() > 0.98


# -- languages -------------------------------------------------------------------------------------


def test_languages(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    out = language_id.identify(docs, pages, language_id.fit(docs)).toPandas()
    assert len(out) == docs.count() + pages.count()
    want = docs.select("doc_id", F.col("lang").alias("want")).toPandas()
    own = out[out.doc_id.notna()].merge(want, on="doc_id")
    assert (own.lang == own.want).mean() > 0.98
    web = out[out.page_id.notna()]
    assert (web.lang == web.declared).mean() > 0.9 and out.confidence.between(0, 1.0000001).all()


def test_evidence_decides_where_text_is_silent(spark):
    docs = spark.createDataFrame([(i, "the and of with from", "en", "s") for i in range(20)] + [(20 + i, "der und das nicht mit", "de", "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs)
    pages = [(i, f"http://a.example.{'de' if i % 2 else 'com'}/x", f"<html lang='{'de' if i % 2 else 'en'}'><p>{'der und das nicht' if i % 2 else 'the and of with'}</p>") for i in range(60)]
    pages += [(100, "http://a.example.de/y", "<html lang=de><p>123</p>"), (101, None, None), (102, "::::", "")]
    got = {r.page_id: r for r in language_id.identify(None, spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert got[100].lang == "de" and len(got) == 63 and got[101].lang in ("de", "en")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.identify(None, none, model).count() == 0 and language_id.fit(docs.filter("false"))[0] == ["und"]


def test_declared_language_after_a_long_comment(spark):
    docs = spark.createDataFrame([(i, "the and of with from", "en", "s") for i in range(20)] + [(20 + i, "der und das nicht mit", "de", "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "http://a.example/x", f"<!-- {'x ' * 4000}--><html lang='de'><p>der und</p>")], "page_id long, url string, html string")
    assert language_id.identify(None, pages, language_id.fit(docs)).first().declared == "de"


def test_declared_codes(spark):
    docs = spark.createDataFrame([(i, "the and of with from", "en", "s") for i in range(20)] + [(20 + i, "der und das nicht mit", "de", "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    codes = {"de-AT": "de", "EST": "et", "deu": "de", "gsw": "gsw", "x": None, "english": None, "'es'": "es"}
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", f"<html class=a lang={c}><p>der und") for i, c in enumerate(codes)], "page_id long, url string, html string")
    assert [r.declared for r in language_id.identify(None, pages, language_id.fit(docs)).orderBy("page_id").collect()] == list(codes.values())


def plain_fusion(rows, k):
    """Posteriors by hand: rows (kind, host, suffix, declared, p)."""
    def prior(i, j):
        kind, host, suffix, _, p = rows[i]
        pick = lambda same: [r[4][j] for n, r in enumerate(rows) if n != i and same(r)]
        every, near, own = pick(lambda r: True), pick(lambda r: r[0] == kind and (r[2] or "") == (suffix or "")), pick(lambda r: r[:2] == (kind, host))
        base = (sum(every) + 1) / (len(every) + k)
        parent = (sum(near) + 5 * base) / (len(near) + 5)
        return (sum(own) + 5 * parent) / (len(own) + 5)

    values = {r[3] for r in rows} - {None}
    for i, (_, _, _, declared, p) in enumerate(rows):
        score = []
        for j in range(k):
            like = 0.0
            if declared is not None:
                total = sum(r[4][j] for r in rows if r[3] is not None)
                like = np.log((sum(r[4][j] for r in rows if r[3] == declared) + 1) / (total + len(values) + 1))
            score.append(np.log(p[j]) + like + np.log(prior(i, j)))
        post = np.exp(np.array(score) - max(score))
        yield int(np.argmax(score)), float(post.max() / post.sum())


def test_fusion_by_hand(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        p = [rng.random() + 0.01 for _ in range(3)]
        html = rng.random() < 0.7
        rows.append(("host" if html else "source", rng.choice(["a.de", "b.de", "c.com", "x"]), rng.choice(["de", "com", None]) if html else None, rng.choice(["de", "en", None]) if html else None, [x / sum(p) for x in p]))
    # A suffix is its host's.
    rows = [(a, h, h.rpartition(".")[2] if a == "host" and "." in h else None, d, p) for a, h, _, d, p in rows]
    df = spark.createDataFrame([(i, a == "host", h, s, d, p) for i, (a, h, s, d, p) in enumerate(rows)], "i int, is_html boolean, host string, suffix string, declared string, p array<double>").repartition(3)
    got = {r.i: (r.lang, r.confidence) for r in language_id.fuse(df, ["l0", "l1", "l2"]).collect()}
    for i, (lang, confidence) in enumerate(plain_fusion(rows, 3)):
        assert got[i][0] == f"l{lang}" and abs(got[i][1] - confidence) < 1e-9


def test_every_labelled_language_can_be_the_answer(spark):
    rng = random.Random(8)
    names = [f"{a}{b}" for a in "abcdefghij" for b in "abcdefg"]
    words = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for x in names}
    rows = [(100 * i + j, " ".join(rng.choices(words[x], k=30)), x, f"s{i}") for i, x in enumerate(names) for j in range(3 if i < 65 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs)
    assert model[0] == sorted(names) and len(names) == 70
    got = {r.doc_id: r.lang for r in language_id.identify(docs, None, model).collect()}
    assert got == {i: x for i, _, x, _ in rows}


# -- pages -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<script>x<p>y</script>b", "a b"),
        ("<nav>menu</nav><div class='side-bar sidebar'>no</div><p>yes &lt;p&gt; &amp;amp;", "yes <p> &amp;"),
        ("<ul><li>a<li>b</ul>x < y", "a b x < y"),
        ("", ""),
        ("<article><header>h</header><h1>T</h1><p>t<b>u</b>\n\t v<br>w</p><div id=comments>c</div></article><p>o</p>", "T tu v w"),
        ("a<!-- x", "a"),
        ("<p title='a>b'>q</p>", "q"),
        ("<form>f</form><div role=navigation>n</div><div hidden>h</div><style>p{}</style><p>ok", "ok"),
        ("<p>&#233;&eacute;&nope; &amp", "éé&nope; &"),
        ("<title>t</title><textarea>x</textarea></p></div>rest", "rest"),
        ("<div class='page with-sidebar'><p>kept</p><div class='sidebar'>s</div></div>", "kept"),
        ("<main><p>m</p></main><footer>f</footer>", "m"),
        ("<form><div>f</div><article><p>x</p><input><nav>n</nav></article><p>y</p></form>", "x"),
        ("<nav><article>n</article></nav><p>p</p>", "p"),
    ],
)
def test_main_text(page, want):
    assert H.main_text(page) == want


def test_style_tree_removes_templates(spark):
    rng = random.Random(4)
    words = lambda: " ".join(rng.choices("alpha beta gamma delta omega sigma kappa".split(), k=12))
    rows = [(i, f"http://h.example/{i}", f"<body><div class=c1><p>Same on every page</p></div><div class=c2><p>{words()}</p><p>{words()}</p></div></body>") for i in range(30)]
    rows += [(100 + i, "http://copies.example/", "<body><div><p>one and the same page</p></div></body>") for i in range(20)]
    rows += [(200, None, None), (201, "http://h.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert len(got) == 52 and not any("Same" in got[i] or not got[i] for i in range(30))
    assert got[100] == "one and the same page" and got[200] == got[201] == ""
    assert H.extract(df.filter("false")).count() == 0


@pytest.mark.parametrize("n", [3, 5, 300])
def test_style_tree_tells_unnamed_siblings_apart(spark, n):
    """Menu and legal text without ids, classes or <article>, on hosts of few and of many pages; what repeats in one page only stays."""
    menu, legal = "<div>Home News Sport</div>", "<div><p>All rights</p><p>reserved</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{menu}<div><p>story {i}</p><p>goes on {i * i + 1}</p></div>{legal}</body></html>") for i in range(n)]
    rows += [(1000, "http://one.example/", "<body>" + "<p>again</p>" * 20 + "<p>end</p></body>")]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"story {i} goes on {i * i + 1}" for i in range(n)}, 1000: "again " * 20 + "end"}


ODD_URLS = ("http://h{0}.example/{1}", " http://H{0}.example/{1}", "//u:p@x@h{0}.example:80/{1}", "http://[2001:db8::{0}]:8080/{1}", "https://h{0}.example?{1}", "h{0}.example/{1}")


def test_style_tree_without_broadcast(spark, monkeypatch):
    rows = [(i, ODD_URLS[i % 6].format(i % 2, i), f"<body><div class=c1>Same</div><p>text {i}</p></body>") for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(H.extract(df).collect())
    monkeypatch.setattr(H, "BROADCAST_NODES", 0)
    assert sorted(H.extract(df).collect()) == want and [r.text for r in want] == [f"text {i}" for i in range(120)]


def test_hosts(spark):
    urls = {"http://A.example/x": "a.example", " https://a.example": "a.example", "//b@c@d.example:81?q": "d.example", "http://[2001:DB8::1]:80/": "[2001:db8::1]", "a.example/x": "", "::::": "", "": "", "mailto:x@y": ""}
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "u string")
    assert {r.u: r.h for r in df.select("u", H.host(F.col("u")).alias("h")).collect()} == {**urls, None: ""}


def varied_pages(n: int, variants: int):
    """Pages whose menu, notice and footer are drawn from a few variants and aren't named; the story is each page's own."""
    rng = random.Random(n)
    words = lambda k: " ".join(rng.choices("alpha beta gamma delta omega sigma kappa lambda theta iota".split(), k=k))
    menus = [f"<div><ul>{''.join(f'<li>{words(2)}' for _ in range(rng.randint(4, 6)))}</ul></div>" for _ in range(variants)]
    notices, feet = [words(6) for _ in range(variants)], [words(9) for _ in range(variants)]
    for i in range(n):
        story = [words(rng.randint(20, 60)) for _ in range(rng.randint(2, 7))]
        html = f"<html><body>{rng.choice(menus)}<div>{rng.choice(notices)}</div><div><h1>Story {i}</h1>{''.join(f'<p>{x}</p>' for x in story)}</div><div>{rng.choice(feet)}</div></body></html>"
        yield i, f"http://h.example/{i}", html, " ".join([f"Story {i}", *story])


def test_the_tree_alone_removes_varied_templates(spark):
    """No marks, no names: what menus, notices and footers read tells less than which page it is."""
    rows = list(varied_pages(60, 8))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for marks in (True, False):
        assert {r.page_id: r.text for r in H.extract(df, marks=marks).collect()} == {r[0]: r[3] for r in rows}


def plain_tree(pages):
    """The tree by dictionaries, from texts and shapes themselves; nodes are told apart by their spelled-out paths."""
    seen: dict = {}
    for host, page in pages:
        p = H.Page(page)
        plain, placed, merged = [""], [""], {}
        shape = lambda x, p=p: p.label[x] + "(" + ",".join(shape(c) for c in p.children[x]) + ")"
        for x in range(1, len(p.parent)):
            up = p.parent[x]
            plain.append(f"{plain[up]}/{p.label[x]}")
            placed.append(f"{placed[up]}/{p.label[x]}@{'>'.join(p.label[c] for c in p.children[up])}.{p.children[up].index(x)}")
            text = tuple(t for _, t in p.blocks[p.first[x] : p.last[x]])
            if text:
                seen.setdefault((host, "placed", placed[x]), []).append((shape(x), text))
                own = merged.setdefault((host, "plain", plain[x]), ([], []))
                own[0].append(shape(x))
                own[1].append(text)
        for key, (a, b) in merged.items():
            seen.setdefault(key, []).append((tuple(a), tuple(b)))
    out = []
    for (host, _, _), rows in seen.items():
        n = len(rows)
        if n > 1:
            entropy = lambda xs, n=n: -sum(c / n * np.log2(c / n) for c in Counter(xs).values()) / np.log2(n)
            out.append((host, n, round(float(H.PRESENTATION * entropy([r[0] for r in rows]) + (1 - H.PRESENTATION) * entropy([r[1] for r in rows])), 9)))
    return sorted(out)


def test_style_tree_by_brute_force(spark):
    rows = [r[:3] for r in varied_pages(25, 4)] + [(100 + i, "http://g.example/", f"<nav>n</nav><p>a<p>{i % 3}<div class='x y'>t<table><tr><td>{i}<td>2</table></div>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.host, r.n, abs(round(r.importance, 9))) for r in H.style_tree(df).collect())
    assert got == [(h, n, abs(x)) for h, n, x in plain_tree([(r[1].split("/")[2], r[2]) for r in rows])]


def test_named_branches_of_their_own_on_every_page_stay(spark):
    """A class that says sidebar is evidence, not proof: the counts overrule it; reader comments go all the same."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        body = "".join(f"<{t}>{i} {rng.random()}</{t}>" for t in [f"h{2 + int(c)}" for c in f"{i:06b}"])
        rows.append((i, f"http://h.example/{i}", f"<body><div class='{'sidebar' if i < 40 else ''}'>{body}</div><div class=comments>{body.replace('.', ' ')}</div></body>"))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"{i} 0.") and got[i].count("0.") == 6 for i in range(40))


def test_deep_and_long_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<div class=content>" * 20_000 + "deep", "<p>" * 20_000 + "deep", "<div>" * 20_000 + "</b></x></p>" * 20_000 + "deep", "<ul><li>" * 20_000 + "deep"):
        p = H.Page(page)
        assert p.main_text({1: 1}) == "deep" and len(list(p.counted())) >= 1
    assert time.perf_counter() - began < 30


# -- nearest neighbours ----------------------------------------------------------------------------


def plain_nearest(rows, k, kind=np.float32):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    asked = [(i, np.array(v, kind).astype(float)) for i, v in rows if i is not None and ok(v)]
    own = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v.tolist())) for i, v in asked)]
    for q, v in asked:
        if q % 50 == 0:
            s = sorted((-float(vptree.cosine(v, w[None])[0]), i) for i, w in own if i != q and len(w) == len(v))
            yield from ((q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k]))


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=12)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(40)] + [(800, rows[50][1]), (801, [0.0] * 12), (802, None), (850, [None] * 12), (900, [float("nan")] * 12), (901, [1.0, 2.0]), (950, [2.0, 1.0]), (None, rows[0][1]), (1000, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, shard int")
    want = sorted(plain_nearest(rows, 5))
    for shard, block in ((8192, 4096), (60, 4)):
        got = vptree.nearest(df, "vec_id % 50 = 0", shard=shard, block=block).collect()
        assert sorted(tuple(r) for r in got) == want
    assert vptree.nearest(df.filter("false"), "vec_id % 50 = 0").count() == 0


def test_nearest_of_almost_parallel_vectors(spark):
    """Scaled copies, rounded to floats, differ in their last bits only; rounding must not choose among them."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(100)]
    rows += [(100 + i, [float(np.float32(x * s)) for x in rows[50 * (i % 2)][1]]) for i, s in enumerate(rng.uniform(0.2, 5, size=400))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vptree.nearest(df, "vec_id % 50 = 0").collect()) == sorted(plain_nearest(rows, 5))


@pytest.mark.parametrize("copies", [vptree.COPIES, 5])
def test_nearest_of_copies_and_repeated_ids(spark, monkeypatch, copies):
    """A vector that many rows hold, rows that repeat, ids with several vectors, zeros of both signs, numbers whose squares overflow."""
    monkeypatch.setattr(vptree, "COPIES", copies)
    rng = np.random.default_rng(6)
    hot = [float(x) for x in rng.integers(-3, 4, size=6)]
    rows = [(i, [float(x) for x in rng.integers(-2, 3, size=6)] if i % 3 else hot) for i in range(300)]
    rows += [(100, rows[1][1]), (100, rows[2][1]), (100, rows[100][1]), (7, rows[7][1]), (400, [1e200] * 6), (401, [1e200, 1e200, 1e200, 1e200, 1e200, -1e200]), (402, [1e-200] * 6), (450, [0.0, -0.0, 1.0, 0.0, 0.0, 0.0]), (451, [-0.0, 0.0, 2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = sorted(plain_nearest(rows, 5, float))
    for shard, block in ((8192, 4096), (40, 3)):
        assert sorted(tuple(r) for r in vptree.nearest(df, "vec_id % 50 = 0", shard=shard, block=block).collect()) == want


def test_regions_skip_what_is_far(spark):
    """Clustered vectors: most regions hold nothing within a query's bound, and factor 1 loses nothing."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(32, 16))
    x = np.repeat(centres, 100, axis=0) + rng.normal(size=(3200, 16)) * 0.02
    unit = vptree.units(x)
    regions = vptree.Regions(unit[::4], 32)
    home = regions.home(unit)
    assert regions.count == 32 and np.bincount(home, minlength=32).max() < 400
    d = vptree._squared(unit[:200], unit)
    tau = np.sort(d, axis=1)[:, 5]
    others = regions.others(unit[:200], tau, 1.0)
    assert np.mean([len(o) for o in others]) < 8
    for i, own in enumerate(others):
        assert set(home[d[i] <= tau[i]].tolist()) <= set(own)


def test_random_trials_are_exact():
    """Near-parallel, integer and scaled vectors: the tree's candidates hold the exact ranking each time."""
    rng = np.random.default_rng(11)
    for trial in range(200):
        kind, dim = trial % 3, int(rng.integers(2, 20))
        x = rng.normal(size=(300, dim)) if kind else rng.integers(-2, 3, size=(300, dim)).astype(float)
        if kind == 1:
            x[100:200] = x[:1] * rng.uniform(0.1, 9, size=(100, 1))
        if kind == 2:
            x[100:200] = (x[:1] + rng.normal(size=(100, dim)) * 1e-9).astype(np.float32)
        x = np.unique(x[(x != 0).any(axis=1)], axis=0)
        ids = [np.array([i]) for i in rng.permutation(len(x)).tolist()]
        tree = vptree.Tree(vptree.units(x), leaf=16)
        got, _ = vptree._answers(tree, x, ids, x[:10], 6, 1.0, None)
        for q, own in zip(x[:10], got):
            assert own == sorted((-float(s), int(i[0])) for s, i in zip(vptree.cosine(q, x), ids))[:6]


def test_factor_trades_recall_for_work():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    q = x[:100] + rng.normal(size=(100, 8)) * 0.05
    q /= np.sqrt((q * q).sum(1, keepdims=True))
    exact = [set(np.argsort(-(v @ x.T), kind="stable")[:5]) for v in q]
    work, recall = [], []
    for factor in (1.0, 0.5):
        tree = vptree.Tree(x, leaf=32)
        found, _ = tree.search(q, 5, factor)
        work.append(tree.visited)
        recall.append(np.mean([len(e & set(f)) / 5 for e, f in zip(exact, found)]))
    assert recall[0] == 1.0 and recall[1] >= 0.9 and work[1] < work[0] < 100 * 6000
