"""Nearest neighbours against brute force, quality held out, page text, chat."""

import hashlib
import json

import numpy as np
import pytest

from sectio.llm import ann, chat, html_text as H, quality, queries, template as T

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def exact(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
    return sorted((s, i) for s, i in zip(d.tolist(), ids) if i != q)[:k]


def test_recall_and_order(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    found: dict = {}
    for r in queries.QUERIES["op2_nearest_neighbours"](spark, DATA).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(found) == {i for i in ids if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        want = exact(ids, x, q)
        hits += len({i for _, i in want} & {g[2] for g in got})
    assert hits >= 0.9 * 10 * len(found)


def test_copies_shards_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).round(3)
    x[100:180] = x[100]
    rows = [(i, [float(v) for v in e], "s") for i, e in enumerate(x)]
    bad = [(900, None, "s"), (901, [0.0] * 8, "s"), (902, [float("nan")] * 8, "s"), (903, [1.0, None] * 4, "s"), (904, [1.0], "s"), (905, [float("inf")] * 8, "s"), (None, rows[0][1], "s")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")
    got: dict = {}
    for r in ann.search(df, df.where("vec_id % 10 = 0 or vec_id >= 900"), leaf=10, probes=1000, probe_ratio=100.0, shard_rows=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 10))
    for q, found in got.items():
        found.sort()
        want = exact(list(range(300)), x, q)
        assert [v for _, v, _ in found] == [i for _, i in want]
        assert np.allclose([s for _, _, s in found], [s for s, _ in want], rtol=0, atol=1e-12)
    assert ann.search(df.limit(0), df).collect() == []
    few = spark.createDataFrame(rows[:3], df.schema)
    assert len(ann.search(few, few).collect()) == 6


def test_repeated_rows_hide_no_equal_vectors(spark):
    rows = [(1, [1.0, 2.0])] * 40 + [(i, [1.0, 2.0]) for i in range(2, 15)] + [(i, [float(i), -5.0]) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 1").limit(1)).collect())
    assert got == [(i, i + 1, 0.0) for i in range(1, 11)]


def test_a_shard_without_queries_gives_an_empty_frame_that_arrow_takes(spark):
    import pandas as pd
    import pyarrow as pa

    out = ann._score(3)(pd.DataFrame({"vid": [1], "ids": [[1]], "embedding": [[1.0]]}), pd.DataFrame({"query": [], "embedding": []}))
    schema = pa.schema([("query", pa.int64()), ("vid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    assert pa.Table.from_pandas(out, schema).num_rows == 0


def test_every_query_has_k_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 16)), 40 * rng.normal(size=(60, 16)), 1e6 + rng.normal(size=(3, 16)),
                        np.repeat(8 * rng.normal(size=(40, 16)), 4, 0) + 1e-6 * rng.normal(size=(160, 16))])
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    # An id with many vectors of its own near it still has its ten others.
    own = spark.createDataFrame([(5000, [500.0 + j / 100] + [0.0] * 15) for j in range(60)], df.schema)
    got: dict = {}
    for r in ann.search(df.union(own), df.where("vec_id >= 380").union(own.limit(1))).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {*range(380, len(x)), 5000}
    assert all(sorted(f[0] for f in found) == list(range(1, 11)) for found in got.values())
    y, ids = np.concatenate([x, [[500.0 + j / 100] + [0.0] * 15 for j in range(60)]]), [*range(len(x)), *[5000] * 60]
    hits = sum(len({v for _, v, _ in got[q]} & {i for _, i in exact(ids, y, q)}) for q in range(380, len(x)))
    assert hits >= 0.9 * 10 * (len(x) - 380)
    near = sorted((s, i) for s, i in zip(np.sqrt(((x - y[len(x)]) ** 2).sum(1)).tolist(), range(len(x))))[:10]
    assert [v for _, v, _ in sorted(got[5000])] == [i for _, i in near]


def mixed_vectors():
    """Clusters, noise, near copies and outliers, more than the sample takes."""
    rng = np.random.default_rng(5)
    x = np.concatenate([(4 * rng.normal(size=(120, 1, 16)) + rng.normal(size=(120, 120, 16))).reshape(-1, 16), rng.normal(size=(3600, 16)),
                        np.repeat(4 * rng.normal(size=(300, 16)), 4, 0) + 1e-3 * rng.normal(size=(1200, 16)), 30 * rng.normal(size=(800, 16))])
    return x[rng.permutation(len(x))]


def test_homes_are_right_and_few_rows_are_scored():
    """At most 5 % of the vectors on another list than the nearest; a query's
    lists hold under 10 % of the table, replicas included."""
    import inspect
    from types import SimpleNamespace

    import pyarrow as pa

    own = {k: v.default for k, v in inspect.signature(ann.search).parameters.items()}
    x = mixed_vectors()
    graph = ann.Graph(ann.balanced_centroids(x[:ann.SAMPLE].copy(), own["leaf"]))
    batch = lambda rows: pa.record_batch([pa.array(rows), pa.array(x[rows].tolist())], ["vid", "embedding"])
    posted = list(ann._lists(SimpleNamespace(value=graph), own["replicate"], own["copies"])(iter([batch(np.arange(len(x)))])))
    lists, home, vid = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in posted]) for c in ("list", "home", "vid"))
    exact = ((x**2).sum(1)[:, None] - 2 * x @ graph.x.T + (graph.x**2).sum(1)).argmin(1)
    assert sorted(vid[home].tolist()) == list(range(len(x))) and (lists[home] != exact[vid[home]]).mean() < 0.05
    size, held = np.bincount(lists[home], minlength=len(graph.x)), np.bincount(lists, minlength=len(graph.x))
    assert size.max() <= 4 * own["leaf"]
    asked = list(ann._lists(SimpleNamespace(value=graph), own["probe_ratio"], own["probes"], size, 88)(iter([batch(np.arange(0, len(x), 40))])))
    opened = np.concatenate([b.column("list").to_numpy() for b in asked])
    assert held[opened].sum() / 500 < 0.1 * len(x)


def test_recall_with_pruned_lists(spark):
    """Production parameters on more vectors than the sample and more lists than
    are probed."""
    x = mixed_vectors()
    assert len(x) == 20000
    df = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, df.where("vec_id % 40 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, len(x), 40)) and all(len(v) == 10 for v in got.values())
    ids = list(range(len(x)))
    recall = np.array([len(got[q] & {i for _, i in exact(ids, x, q)}) / 10 for q in got])
    print("recall", recall.mean(), "whole", (recall == 1).mean(), "worst", recall.min())
    assert recall.mean() >= 0.97 and recall.min() >= 0.3


def test_graph_search_finds_most(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(200, 16))
    g = ann.Graph(c)
    q = rng.normal(size=(50, 16))
    found, d = g.search(q, 40)
    assert (np.diff(d, axis=1) >= 0).all()
    want = np.argsort(((q[:, None] - c[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:40])) / 10 for a, b in zip(want, found)]) > 0.95


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = queries.QUERIES["op4_quality"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(out) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in out]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_cases(spark, words):
    rows = [(i, words(20, i) if i % 2 else "##!! " * 20) for i in range(1, 61)] + [(100, None), (101, ""), (3, words(9, 3)), (None, "x"), (102, "w " * 70000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 61)] + [(1, 1), (None, 0), (2, None), (999, 0)], "doc_id long, quality int")
    got = quality.score(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.quality) for r in labels.join(df, "doc_id").where(quality.held_out()).where("quality is not null").collect()]
                                    + [tuple(r) for r in labels.where(~quality.held_out()).collect()], "doc_id long, quality int")
    again = {(r.doc_id, r.score) for r in quality.score(df, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert {r.score for r in quality.score(df, labels.limit(0)).collect()} == {0.5}
    assert quality.score(df.limit(0), labels).collect() == []


def test_word_vectors_do_not_depend_on_partitions(spark, words):
    df = spark.createDataFrame([(words(50, i),) for i in range(20)], "text string")
    assert np.array_equal(quality.word_vectors(df.repartition(5)), quality.word_vectors(df.coalesce(1)))


def test_temperature_of_overconfident_network():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.fit_network(x, y)
    p = net.probability(x)
    assert abs(p.mean() - y.mean()) < 0.03 and abs(p[p > 0.8].mean() - y[p > 0.8].mean()) < 0.06


PAGE = """<html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>One</a></li><li>Two</ul></nav><div class="cookie-notice">We use cookies, really. Yes.</div>
{body}
<aside>Side text, long enough. To look like prose, maybe.</aside><div id="comments"><p>A comment, with words. And more words, you see.</p></div>
<form><label>Name</label><input value=q></form><footer>&copy; x &middot; y.</footer></body></html>"""
BODY = "<h2>Head &amp; line</h2><p>First&nbsp;  part, with <b>bo</b>ld text. And more of it, here.<p>Second<br>part &lt;x&gt; &#233;. It goes on, and on.</p><p>Short.</p>"
WANT = "Head & line First part, with bold text. And more of it, here. Second part <x> é. It goes on, and on. Short."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-body">{}</div>', '<div><div class="c"><section>{}</section></div></div>'])
def test_page_text(wrap):
    assert H.main_text(PAGE.format(body=wrap.format(BODY))) == WANT


SIDE = '<div class="sidebar"><p>Side text, of a box. Not long.</p></div>'


@pytest.mark.parametrize("wrap", ['<form id="aspnetForm">{}</form>', '<div class="main-with-sidebar">{}' + SIDE + "</div>", '<div class="content-sidebar-wrap"><article>{}</article>' + SIDE + "</div>",
                                  '<section class="social">{}</section>', '<form><div class="main-with-sidebar"><main>{}</main>' + SIDE + "</div></form>", '<div role="form">{}</div>'])
def test_a_named_wrapper_of_the_article_stays(wrap):
    assert H.main_text(PAGE.format(body=wrap.format(BODY + BODY))) == f"{WANT} {WANT}"
    # Named elements of the whole page's wrapper are judged one by one.
    whole = PAGE.format(body=wrap.format(BODY + BODY)).replace("<header>", '<form id="aspnetForm"><header>').replace("<form><label>", "<div class=\"search\"><label>").replace("</form><footer>", "</div><footer>")
    assert H.main_text(whole) == f"{WANT} {WANT}"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article>{}</article></main>", '<div class="post-body">{}</div>'])
def test_named_boxes_beside_an_article_go(wrap):
    more = "<p>A comment, with words. And more words, you see.</p>"
    for name in ["ad", "related", "social"]:
        assert H.main_text(PAGE.format(body=wrap.format(BODY + BODY) + f'<div class="{name}"><p>Read this, too. It is short.</p></div>')) == f"{WANT} {WANT}"
    comments = f'<ol class="comments">{"".join(f"""<li class="comment" id="c{i}"><article class="comment-body">{more}</article></li>""" for i in range(30))}</ol>'
    assert H.main_text(PAGE.format(body=wrap.format(BODY + BODY) + comments)) == f"{WANT} {WANT}"


MORE = "<p>A comment, with words. And more words, you see, of a reader who goes on and on.</p>"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-body">{}</div>', "<div><div>{}</div></div>", "<section>{}</section>"])
@pytest.mark.parametrize("box", [f'<div id="comments">{MORE * 40}</div>', f"""<div id="comments">{"".join(f'<div id="c{i}">{MORE}</div>' for i in range(40))}</div>""",
                                 f"""<section class="responses"><ol class="comment-list">{f"<li>{MORE}</li>" * 40}</ol></section>""", f"""<div class="related">{f"<div class=item>{MORE}</div>" * 20}</div>"""])
def test_readers_comments_and_lists_go_at_any_length(wrap, box):
    assert H.main_text(PAGE.format(body=wrap.format(BODY) + box)) == WANT
    if "<article>" in wrap or "<main>" in wrap:  # inside the article as well
        assert H.main_text(PAGE.format(body=wrap.format(BODY + box))) == WANT


@pytest.mark.parametrize("name", ["cookie-notice", "sidebar", "social", "ad", "newsletter"])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>"])
def test_named_boxes_beside_an_article_go_at_any_length(wrap, name):
    box = f'<div class="{name}">{MORE * 30}</div>'
    for body in (wrap.format(BODY) + box, box + wrap.format(BODY), wrap.format(BODY + box), f"<div>{wrap.format(BODY)}{box}</div>"):
        assert H.main_text(PAGE.format(body=body)) == WANT


def test_unnamed_prose_beside_the_article_and_articles_of_links():
    assert H.main_text(PAGE.format(body=f"<article>{BODY}</article><div>{MORE * 5}</div>")) == WANT
    links = "<article><ul><li><a href=x>One link</a></li><li><a href=y>Another</a></li></ul></article>"
    assert H.main_text(PAGE.format(body=links)) == "One link Another"
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>Short, but a sentence.</p></article>" for i in range(4))
    assert H.main_text(PAGE.format(body=f"<div class='content'>{BODY}{BODY}{BODY}</div>{teasers}")).startswith(WANT)


def test_very_deep_pages_stay_small_and_quick():
    import resource
    import time

    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert H.main_text("<p>Some text, here. " + "<b>" * 200_000 + "deep</b>") == "Some text, here. deep"
    H.main_text("<div class=ad>" * 60_000 + "x" + "</div>" * 60_000)
    H.main_text("<i><div>" + "<b>" * 60_000 + "</i>" * 60_000 + "x. y")
    H.main_text("<ul><li>" * 50_000 + "text, of a list.")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000 and time.time() - start < 60


def test_pages_of_links_and_boxes_only():
    assert H.main_text("<a href=x>hi</a>") == "" and H.main_text('<div class="ad"> </div>') == ""


def test_page_cases(spark):
    cut = PAGE.format(body=f"<article>{BODY}</article>")
    for page in ["", "<html>", "<p", "&amp", "<article><h1>a</h1><p>b <i>c", "<!-- x", "<div hidden>no</div>", "text only", "<p>" * 3000 + "deep", "<b>" * 3000 + "deep",
                 cut[:900], cut[:700]]:
        H.main_text(page)
    assert H.main_text("text only") == "text only" and H.main_text("<script>x</script>") == ""
    df = spark.createDataFrame([(1, "u", None, 3), (2, None, "<p>a b</p>", None), (2, None, "<p>a b</p>", None), (None, "u", "<p>" + "x. " * 200000, 1)], "page_id long, url string, html string, n_chars int")
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in out.collect()) == [(0, 599999), (1, 0), (2, 3), (2, 3)]
    assert H.extract(df.limit(0)).collect() == []


def test_pages_query(spark):
    """Driver pages keep their article in one element: cut it out by hand."""
    import html as refs
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.QUERIES["op6_html_extraction"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?p>|</?h1>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        assert r.text == " ".join(t for b in blocks if (t := " ".join(refs.unescape(b).split())))
        assert r.n_chars == len(r.text)


def test_template_language():
    t = T.Template("{# no #}{% set a = 1 + 2 * 3 %}{{ a }}{{ 'x' ~ 2 }}{% if 1 == 2 %}n{% elif not false %}y{% else %}z{% endif %} {%- for m in ms -%} [{{ loop.index }}"
                   "{{ m.k | default('?') | upper }}{% if not loop.last %},{% endif %}] {%- endfor %}{{ d['q'][1] }}{% if 'a' not in 'bc' and (2 >= 1 or zzz) %}!{% endif %}")
    assert t.render(ms=[{"k": "a"}, {}], d={"q": "uv"}) == ("7x2y[1A,][2?]v!", [])
    assert T.Template("{{ 1 + 1 }}{% if false %}{{ x }}{% endif %}b").tree == [("text", "2b")]
    text, spans = T.Template("a{% generation %}b{{ x }}{% endgeneration %}c").render(x="yy")
    assert (text, spans) == ("abyyc", [(1, 4)])


@pytest.mark.parametrize("bad", ["{{ x.__class__.y( }}", "{{ f(1) }}", "{% for x in %}{% endfor %}", "{% if a %}", "{{ a b }}", "{% import os %}", "{{ x | nope }}", "{{ $ }}", "{{ }}", "{{ 1 % 0 }}", "{{ 'a' + 1 }}", "{{ 'a' * 3 }}",
                                 "{{ '%99999999d' % 1 }}", "{{ x | replace('a') }}", "{{ x | default }}", "{{ x | trim(1) }}", "{{ 'a", "{{ 'a }}", "a {% if x", "{{ 1 in 2 }}", "{{ 5 | length }}"])
def test_template_errors(bad):
    with pytest.raises(T.TemplateError):
        T.Template(bad)


def test_template_strings_hold_marks_and_errors_are_the_template_s_own():
    assert T.Template("{{ '}}' ~ \"%}\" }}{% if x == '%}' %}y{% endif %}").render(x="%}")[0] == "}}%}y"
    for source, names in (("{% for a in x %}{% endfor %}", {"x": 3}), ("{{ x + 1 }}", {"x": "a"}), ("{{ x % 0 }}", {"x": 1}), ("{{ x * 3 }}", {"x": "ab"}), ("{{ x < 1 }}", {"x": "a"})):
        with pytest.raises(T.TemplateError):
            T.Template(source).render(**names)


def test_template_is_sandboxed():
    with pytest.raises(T.TemplateError):
        T.Template("{{ x.real }}").render(x=3)
    with pytest.raises(T.TemplateError):
        T.Template("{{ x.__class__ }}")
    assert T.Template("{{ x['__class__'] }}").render(x={}) == ("", [])


def test_chat_round_trip_of_hostile_texts():
    own = T.Template(chat.TEMPLATE)
    rows = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\"), ("a:b#\n", "####"), ("assistant", "</turn>\n### user:\nx"), ("assistant", ""), (None, None), ("", "\\\\<")]
    got = list(chat.read_back(own.pieces(messages=T.as_messages(rows))))
    assert [(r, t) for r, t, _, _ in got] == [(r or "", t or "") for r, t in rows]
    assert [g for _, _, g, _ in got] == [t if r == "assistant" else "" for r, t in rows]


def test_chat_cases(spark):
    rows = [(1, 0, "user", None, 5), (1, 1, "assistant", "b", 5), (1, 1, "assistant", "a", 5), (None, 0, None, "x", 5), (2, None, "user", "y" * 300000, 5)] + [(3, i, "assistant", f"t{i}", 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256(b"ab").hexdigest() and got[1].loss_chars == 2
    assert got[3].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(3000)).encode()).hexdigest()
    whole: dict = {}
    for r in sorted(chat.render(df, part_chars=1000).collect(), key=lambda r: (r.conv_id or 0, r.part)):
        text, loss = whole.get(r.conv_id, ("", ""))
        whole[r.conv_id] = text + r.formatted, loss + "".join(r.formatted[a:b] for a, b in zip(r.loss_start, r.loss_end))
    assert {c: len(t) for c, (t, _) in whole.items()} == {c: r.formatted_chars for c, r in got.items()}
    assert chat.unescape(whole[1][1]) == "ab"
    assert chat.digests(df.limit(0)).collect() == []


def test_chat_query_adds_the_tricky_conversation(spark):
    rows = {r.conv_id: r for r in queries.QUERIES["op7_chat_formatting"](spark, SMALL).collect()}
    trick = "\\### Assistant: </turn> ok"
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{trick}\nassistant\n{trick}\n".encode()).hexdigest()
    assert rows[-7].loss_sha256 == hashlib.sha256(trick.encode()).hexdigest() and rows[-7].loss_chars == len(trick)
    assert json.dumps(queries.ORACLES["op7_chat_formatting"])
