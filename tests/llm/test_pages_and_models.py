"""URL filters, HTML extraction, weak supervision, neighbours, the language model and the pipeline."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fixtures import SHAPE, documents, rows_of, sentence, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge_brute(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("rows,blocks", [(10_000, 1 << 17), (0, 2)])
def test_url_filter(spark, monkeypatch, rows, blocks):
    from canopyframe.llm import url_filter
    from canopyframe.llm.queries import URL_RULES
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", rows)
    urls = [None, "", "no scheme", "http://", "http://com", "HTTP://A.Com/en/1", "http://xcom/en/", "http://com/en/x?y#z", "http://a.b.example.com/en/7x", "http://example.com/en/6", "http://example.com?/en/7",
            "ftp://x.net/de/8", "ftp://y.example.net/de/8#", "ftp://example.net/de/81/", "http://u.org/es", "http://u.org/es/", "x://a://b.com/en/", "http://é.com/en/", "http://a..com/en/", "http://.com/en/", "http://com./en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)] + [(None, urls[7], "h")], "page_id long, url string, host string")
    rules = spark.createDataFrame([*URL_RULES, URL_RULES[0], (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = rows_of(url_filter.judge(pages, rules, blocks=blocks), "page_id", "host", "path", "rule", "verdict")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert got == sorted([(i, *judge_brute(u, URL_RULES)) for i, u in enumerate(urls * 2)] + [(None, *judge_brute(urls[7], URL_RULES))], key=key)
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_blocked_filter_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    from canopyframe.llm.url_filter import build_filter, may_hold
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    probe = may_hold(spark, build_filter(keys, 1 << 9))
    assert keys.where(~probe("h")).count() == 0
    other = spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h"))
    assert other.where(probe("h")).count() < 1500


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) {{ "</p>" }}</script><style>p{{}}</style></head><body><header>Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>Head {i} &amp; &lt;more&gt;</h1><p>First&nbsp;line {i}<br>goes   on <b>bold<p>Second &#233; &unknown; {i}<div class="sponsored"><p>inner ad</div>
<form><label>Mail</label><input><button>Go</button></form><p>Third</p><section class="comments"><article class="comment"><p>me too</p></article></section></article>
<aside>Side</aside><footer>&copy; all</footer></body></html>"""


def test_main_text(spark):
    from canopyframe.llm import template
    plain = """<div id=top>Brand</div><div class=story><p>Body {i} text, long enough to be told apart.</p><p>End {i}.</p></div><div id=low>Imprint</div>"""
    rows = [(i, "http://a.org/%d" % i, PAGE.format(i=i), "t", 1) for i in range(4)] + [(10 + i, "http://b.org/%d" % i, plain.format(i=i), "t", 1) for i in range(5)]
    rows += [(20, None, None, "t", 1), (21, "x", "", "t", 1), (22, "http://c.org/", "just text &amp; no tags <", "t", 1), (23, "http://c.org/2", "<main><p>in main</main><p>out", "t", 1),
             (24, "http://d.org", "<p>" * 3000 + "deep" + "</div>" * 50, "t", 1), (25, "http://d.org", "<!-- open comment <p>no", "t", 1), (26, "http://d.org", "<article><p>cut &am", "t", 1),
             (27, "http://d.org", "<article><p>" + "word " * 100_000 + "</article>", "t", 1), (27, "http://d.org", "<article><p>same</article>", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, template int")
    out = template.extract(pages)
    assert out.columns == ["page_id", "url", "template", "text"]
    got = out.collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got if r.page_id != 27}
    for i in range(4):
        assert text[i] == f"Head {i} & <more>\nFirst line {i} goes on bold\nSecond é &unknown; {i}\nThird"
    for i in range(5):
        assert text[10 + i] == f"Body {i} text, long enough to be told apart.\nEnd {i}."
    assert text[20] == text[21] == "" and text[22] == "just text & no tags <" and text[23] == "in main" and text[24] == "deep" and text[25] == "" and text[26] == "cut &am"
    assert sorted(len(r.text) for r in got if r.page_id == 27) == [4, 499_999]
    assert template.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("before,after", [("<form id=aspnetForm>", "</form>"), ("<div class='has-sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"), ("<div id='page' class='with-banner'>", "</div>"),
                                          ("<div class='search-results'>", "</div>"), ("<div class='no-comments'>", "</div>")])
def test_wrappers_leave_regions_whole(before, after):
    from canopyframe.llm import template
    inner = "<p>Body <math><mi>x</mi><mo>=</mo><mn>2</mn></math> end</p><noscript>still</noscript><div class='has-sidebar'>wide</div><div class='share'>Share</div>"
    for name in ("article", "main"):
        page = template.Page(f"<body>{before}<div class=menu>Menu</div><{name}>{inner}</{name}>{after}</body>")
        assert page.text(set()) == "Body x=2 end\nstill\nwide", name
    assert template.Page(f"<main><form><article>{inner}</article></form></main>").text(set()) == "Body x=2 end\nstill\nwide"
    for around in ("nav", "aside", "footer", "section class=comments"):
        page = template.Page(f"<article><p>Own</p></article><{around}><article><p>Other</p></article></{around.split()[0]}>")
        assert page.text(set()) == "Own"


def test_malformed_pages_cost_their_length():
    import time

    from canopyframe.llm import template
    for piece in ('<a "', "<title>", "<!x", "<span class=ad>", "<p class='"):
        began = time.perf_counter()
        template.Page("<article>kept</article>" + piece * 60_000).text(set())
        assert time.perf_counter() - began < 10, piece


def test_regions_beside_each_other():
    from canopyframe.llm import template
    page = lambda s: template.Page(s).text(set())
    assert page("<main><p>The whole long text of the page.</p></main><article><p>Teaser</p></article>") == "The whole long text of the page."
    assert page("<main><p>Intro of some length to the article</p><article><p>Own</p></article></main>") == "Own"
    assert page("<article><p>one <span class='ad'>AD <span>y</span> tail</span>two</p></article>") == "one two"
    assert page("<article><p>a <b title='x>y'>b</b> c < d</p></article>") == "a b c < d"


def labelled(spark, n=900):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        w = sentence(rng, rng.randrange(30, 200)).split()
        if toxic:
            for _ in range(rng.randrange(2, 8)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "zorgblat", "zorgful", "zorgling", "grumpf"]))
        t = " ".join(w) if good else "".join(f"{x}{rng.choice(['%%%', '###', '$$$'])} " for x in w)
        rows.append((i, t, None, "s", None, 1.0, "h", 1, "w"))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    rows += [(None, None, None, None, None, None, None, None, None), (n, "", None, None, None, None, None, None, None), (n + 1, "long " * 50_000, None, None, None, None, None, None, None), rows[0]]
    return documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), labels[0]], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("name,target,column,threshold", [("toxicity", "toxic", 2, 0.7), ("quality", "quality", 1, 0.3)])
def test_classifiers_on_held_out_rows(spark, name, target, column, threshold):
    import importlib

    from pyspark.sql import functions as F

    from canopyframe.llm.common import crc_rest
    op = importlib.import_module(f"canopyframe.llm.{name}")
    docs, table, labels = labelled(spark)
    model = op.fit(docs, table, crc_rest(F.col("doc_id"), 3) != 1)
    out = op.score(docs, model)
    assert set(out.columns) == set(docs.columns)
    rows = out.select("doc_id", "score").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows}
    held = [(score[r[0]] >= threshold) == bool(r[column]) for r in labels if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 150 and sum(held) / len(held) > 0.93
    # nothing to learn from, nothing to score
    bare = op.fit(docs, table.limit(0), F.lit(True))
    assert all(0 <= r.score <= 1 for r in op.score(docs, bare).select("score").collect())
    assert op.score(docs.limit(0), model).count() == 0
    assert op.score(docs.limit(3), op.fit(docs.limit(0), table, F.lit(True))).count() == 3


def test_label_model_recovers_rates_and_correlation():
    from canopyframe.llm.toxicity import fit_label_model
    rng = np.random.default_rng(2)
    n, prior = 200_000, 0.2
    y = rng.random(n) < prior
    high, low = np.array([0.8, 0.6, 0.7, 0.5, 0.9, 0.4, 0.6]), np.array([0.05, 0.1, 0.02, 0.08, 0.05, 0.03, 0.04])
    v = (rng.random((n, 7)) < np.where(y[:, None], high, low)).astype(float)
    v = np.column_stack([v, np.where(rng.random(n) < 0.9, v[:, 6], rng.random(n) < 0.1)])
    second = np.column_stack([v, np.ones(n)]).T @ np.column_stack([v, np.ones(n)]) / n
    model = fit_label_model(second, prior)
    assert model.correlated[6, 7] and model.correlated[:6, :6].sum() == 0
    assert np.abs(model.high[:6] - high[:6]).max() < 0.05 and np.abs(model.low[:6] - low[:6]).max() < 0.02
    assert ((model.posterior(v) >= 0.5) == y).mean() > 0.95


def test_neighbour_votes_are_exact():
    from canopyframe.llm.quality import EXTRA, NEIGHBOURS, POWER, TERMS, Model, latent_axes
    rng = np.random.default_rng(1)
    x = rng.random((200, TERMS + EXTRA)).astype(np.float32)
    axes = latent_axes(x)
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-3)
    m = Model(np.ones(TERMS + EXTRA, np.float32), axes, np.zeros((0, 1)), rng.integers(0, 2, 150).astype(np.float32), 0.5)
    m.known = m.place(x[:150])
    got = m.vote(x[150:])
    for q, s in zip(x[150:], got):
        z = q @ axes
        cos = [float(z @ k / np.linalg.norm(z)) for k in m.known]
        near = sorted(range(150), key=lambda i: -cos[i])[:NEIGHBOURS]
        w = [max(cos[i], 0) ** POWER for i in near]
        assert abs(s - (sum(a * m.labels[i] for a, i in zip(w, near)) + 0.25) / (sum(w) + 0.5)) < 1e-3


def test_attention_gradients_and_causality():
    from canopyframe.llm import attention_lm as lm
    rng = np.random.default_rng(0)
    model = lm.Attention()
    model.w = {n: v.astype(np.float64) for n, v in model.w.items()}
    x, y = rng.integers(0, lm.SYMBOLS, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW))
    use = (rng.random((3, lm.WINDOW)) < 0.7).astype(np.float64)
    _, g = model.gradients(x, y, use)
    for name, w in model.w.items():
        i = tuple(np.unravel_index(np.abs(g[name]).argmax(), w.shape))
        step, old = 1e-5, w[i]
        w[i] = old + step
        up, _ = model.gradients(x, y, use)
        w[i] = old - step
        down, _ = model.gradients(x, y, use)
        w[i] = old
        assert g[name][i] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=1e-7), name
    before, _ = model.forward(x)
    x2 = x.copy()
    x2[:, 20:] = 1
    after, _ = model.forward(x2)
    assert np.allclose(before[:, :20], after[:, :20])
    p = 10 ** np.stack([model.log10(x, np.full_like(y, c), np.ones(y.shape, bool)) for c in range(lm.CLASSES)])
    assert np.allclose(p.sum(0), 1, atol=1e-5)


def test_windows_score_each_position_once():
    from canopyframe.llm import attention_lm as lm
    sizes = [0, 1, 31, 32, 33, 55, 56, 57, 400]
    bound = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.arange(bound[-1]) % 50
    classes = lm.make_classes(np.arange(1.0, 301.0))
    assert np.bincount(classes.of, weights=10.0 ** classes.within) == pytest.approx(np.ones(lm.CLASSES), rel=1e-4)
    inputs, target, at, scored, row = lm.windows(ids, bound, classes, 299)
    assert sorted(at[scored].tolist()) == list(range(len(target))) and len(target) == bound[-1] + len(sizes)
    assert (scored.sum(1) > 0).all()
    whole = lm.score_texts(lm.Attention(), classes, ids, bound, 299)
    for r in range(len(sizes)):
        own = lm.score_texts(lm.Attention(), classes, ids[bound[r]: bound[r + 1]], np.array([0, sizes[r]]), 299)
        assert whole[r] == pytest.approx(own[0], rel=1e-4)


@pytest.mark.parametrize("frequent", [1 << 17, 3])
def test_word_model(spark, monkeypatch, frequent):
    from pyspark.sql import functions as F

    from canopyframe.llm import attention_lm as lm
    from canopyframe.llm.common import crc_rest
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "STEPS", 20)
    docs = documents(spark)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    out = lm.score_documents(docs.select("doc_id", "text"), crc_rest(F.col("doc_id"), 10) == 0, fit_docs=8).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    c = Counter(w for r in texts() if r[0] is not None and not held(r[0]) for w in split(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((len(split(r[1])), sum(c[w] > 0 for w in split(r[1])), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(r[1])), 4)) for r in texts())
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == want
    assert all(r.train_tokens == n and -1e6 < r.score < 0 for r in out)
    empty = lm.score_documents(docs.select("doc_id", "text").limit(0), F.lit(False), fit_docs=8)
    assert empty.count() == 0


def test_attention_learns_from_all_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    from canopyframe.llm import attention_lm as lm
    monkeypatch.setattr(lm, "STEPS", 5)
    ranks = spark.sparkContext.broadcast(lm.read_ranks(lm.VOCABULARY_PATH))
    rng = random.Random(9)
    lines = [(i, sentence(rng, 150)) for i in range(40)]
    lines += [(40, None), (41, ""), (3, lines[3][1])]
    first = spark.createDataFrame(lines, "doc_id long, text string").orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    # the same words in another order, everywhere but in the document the driver begins with: all counts stay
    turned = [(i, t if i == first or not t else " ".join(reversed(t.split()))) for i, t in lines]
    models = [lm.fit(spark, spark.createDataFrame(x, "doc_id long, text string").repartition(3), F.lit(True), ranks, fit_docs=1)[0] for x in (lines, turned)]
    assert (models[0].classes.of == models[1].classes.of).all()
    assert any(np.abs(models[0].attention.w[n] - models[1].attention.w[n]).max() > 1e-5 for n in models[0].attention.w)
    subs = lm.Subwords(ranks.value)
    sizes = [sum(len(subs._encode(" " + w)) for w in (t or "").translate(LOWER).split()) + 1 for _, t in lines]
    assert models[0].learnt == models[1].learnt == sum(1 + max(0, -(-(n - lm.WINDOW) // lm.STRIDE)) for n in sizes)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs, labels, _ = labelled(spark, 400)
    bench = " ".join(f"q{i}" for i in range(30))
    extra = spark.createDataFrame([(5000, sentence(random.Random(1), 50) + " " + bench, "en", "src1", 1), (5001, sentence(random.Random(2), 80), "en", "src0", 1), (5002, sentence(random.Random(2), 80), "en", "src0", 1)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert 5000 not in ids and 5001 in ids and 5002 not in ids
    assert not [r for r in rows if r.text and re.search("zorg|idiot|moron", r.text) and len(re.findall("zorg|idiot|moron", r.text)) > 2]
    assert set(docs.columns) <= set(out.columns) and len(corpus_pipeline.STAGES) == 5
    assert 150 < len(rows) < 330


def test_sql_twins(spark):
    from check import compare, connect

    from canopyframe.llm.queries import ORACLES, QUERIES
    folder = "/root/testdata/sf0.001"
    con = connect(folder)
    for name, sql in ORACLES.items():
        message, _, ok = compare(spark, con, folder, name, QUERIES[name], sql)
        assert ok, (name, message)
