"""Near-copy joins and vector search against brute force; page extraction on built pages."""

import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from annospan.llm import candidates, lattice, nearest, neartext, webpage
from annospan.llm.components import components

from tests.llm.data import classes, frame, ngrams, rows, text


def near_rows():
    rng = random.Random(3)
    data = rows(40)
    for g in range(8):
        base = text(rng, "en", rng.choice([30, 60, 120])).split()
        for k in range(rng.randint(2, 12)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["changed", "other"])
            data.append((2000 + 100 * g + k, " ".join(words), "en", "a", 0, "", "", "", ""))
    data += [(5000 + k, f"word {k % 2}", "en", "a", 0, "", "", "", "") for k in range(4)]
    return data


def brute_force(data, threshold):
    sets = [ngrams(d[1]) for d in data]
    linked = [
        [j for j, b in enumerate(sets) if i != j and a and b and len(a & b) / len(a | b) >= threshold] for i, a in enumerate(sets)
    ]
    return sets, linked, classes(len(data), linked)


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(candidates, "BLOCK_ROWS", block_rows)
    data = near_rows()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_links) for r in neartext.ngram_jaccard_join(frame(spark, data)).collect())
    _, linked, _ = brute_force(data, 0.8)
    assert got == sorted((d[0] is None, d[0] or 0, len(linked[i])) for i, d in enumerate(data))


def test_jaccard_classes_equal_brute_force(spark):
    data = [d for d in near_rows() if d[0] is not None]
    data = list({d[0]: d for d in data}.values())
    data.sort()
    _, _, root = brute_force(data, 0.8)
    got = {r.doc_id: r for r in neartext.ngram_jaccard_join(frame(spark, data)).collect()}
    assert {i: r.class_id for i, r in got.items()} == {d[0]: data[root[k]][0] for k, d in enumerate(data)}
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    kept = neartext.one_per_class(frame(spark, data + data[:2]))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_jaccard_join_of_nothing(spark):
    assert neartext.ngram_jaccard_join(frame(spark, [])).collect() == []
    assert neartext.one_per_class(frame(spark, [])).collect() == []


@pytest.mark.parametrize("threshold,recall", [(0.8, 0.9999), (0.8, 0.99), (0.5, 0.95), (0.95, 0.999)])
def test_band_plan_reaches_its_recall(threshold, recall):
    bands, per_band = neartext.band_plan(threshold, recall)
    assert 1 - (1 - threshold**per_band) ** bands >= recall - 1e-12 and bands * per_band <= neartext.MOST_HASHES


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 299), (299, 300)]
    edges += [(rng.randint(500, 700), rng.randint(500, 700)) for _ in range(150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    linked = [[] for _ in nodes]
    for u, v in edges:
        linked[at[u]].append(at[v])
        linked[at[v]].append(at[u])
    root = classes(len(nodes), linked)
    assert got == {x: nodes[root[i]] for i, x in enumerate(nodes) if root[i] != i}


VECTORS = "vec_id long, embedding array<float>, label int, id string, vec string, bucket string"


def vector_rows(seed=0, width=32):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(12):
        base = rng.normal(size=width)
        for _ in range(int(rng.integers(1, 9))):
            out.append((base + rng.normal(size=width) * rng.choice([0.02, 0.1, 0.2]), int(rng.integers(0, 2))))
    out += [(rng.normal(size=width), 0) for _ in range(60)]
    data = [(i * 5, [float(x) for x in np.float32(v)], label, "", "", "") for i, (v, label) in enumerate(out)]
    inf, nan = [math.inf] + [1.0] * (width - 1), [math.nan] + [1.0] * (width - 1)
    odd = [None, [], [0.0] * width, [None] + [1.0] * (width - 1), inf, nan]
    data += [(9000 + i, v, 0, "", "", "") for i, v in enumerate(odd)]
    return data + [(9100, data[0][1], None, "", "", ""), (9101, data[0][1], data[0][2], "", "", ""), (9102, data[0][1], data[0][2], "", "", "")]


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 8, 12, 16, 17, 24, 48, 64, 200, 768])
def test_lattice_recall_at_every_width(width):
    """Pairs at the threshold itself, other than those the plan was made with, share a cell."""
    rng = np.random.default_rng(77)
    for cosine in (0.98, 0.9):
        a, b = lattice.pairs_at(width, cosine, 1500, rng)
        tables = lattice.tables_for(width, cosine)
        x, y = lattice.cell_codes(a, tables, cosine=cosine), lattice.cell_codes(b, tables, cosine=cosine)
        met = np.array([np.intersect1d(p, q).size > 0 for p, q in zip(x, y)])
        assert met.mean() >= 0.995


@pytest.mark.parametrize("width", [24, 64, 768])
def test_lattice_cells_part_unlike_vectors(width):
    x = np.random.default_rng(5).normal(size=(1000, width))
    codes = lattice.cell_codes(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert np.unique(codes, return_counts=True)[1].max() < 100


@pytest.mark.parametrize("width", [2, 5, 12])
def test_narrow_vectors_equal_brute_force(spark, width):
    rng = np.random.default_rng(width)
    x = np.repeat(rng.normal(size=(40, width)), 5, axis=0) + rng.normal(size=(200, width)) * 0.12
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(spark.createDataFrame([(i, v.tolist(), i % 2, "", "", "") for i, v in enumerate(x)], VECTORS)).collect()}
    x = np.float32(x).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.arange(200)[:, None] % 2 == np.arange(200) % 2)
    assert [got[i] for i in range(200)] == (near.sum(axis=1) - 1).tolist()


def test_lattice_links_equal_brute_force(spark):
    data = vector_rows()
    unit = [np.array(d[1]) / np.linalg.norm(d[1]) if good(d[1]) else None for d in data]
    linked = [
        [j for j in range(len(data)) if j != i and unit[i] is not None and unit[j] is not None and data[i][2] is not None and data[i][2] == data[j][2] and unit[i] @ unit[j] >= 0.98]
        for i in range(len(data))
    ]
    root = classes(len(data), linked)
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(data, VECTORS)).collect()}
    assert {i: r.n_links for i, r in got.items()} == {d[0]: len(linked[k]) for k, d in enumerate(data)}
    assert {i: r.component_id for i, r in got.items()} == {d[0]: data[root[k]][0] for k, d in enumerate(data)}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert lattice.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_e8_decoder_finds_the_nearest_point():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    got = lattice.nearest_e8(x)
    twice = np.rint(2 * got).astype(int)
    assert ((twice % 2 == 0).all(1) | (twice % 2 != 0).all(1)).all() and (np.rint(got.sum(1)).astype(int) % 2 == 0).all()
    around = got[:, None, :] + lattice.SHORTEST[None]
    assert (((x[:, None] - around) ** 2).sum(-1).min(1) >= ((x - got) ** 2).sum(-1) - 1e-9).all()
    assert len(np.unique(lattice.SHORTEST, axis=0)) == 240


def test_search_equals_brute_force_on_a_table_within_the_sample(spark):
    data = vector_rows(5)
    got = nearest.nearest_vectors(spark.createDataFrame(data, VECTORS), nearest=7).collect()
    usable = [(d[0], np.array(d[1], dtype=np.float64)) for d in data if good(d[1])]
    want = []
    for q, x in usable:
        if q % 20 == 0:
            ranked = sorted(((-float(x @ y), i) for i, y in usable if i != q))[:7]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(ranked)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)
    assert nearest.nearest_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_search_returns_all_candidates_of_a_small_table(spark):
    data = [(20 * i, [1.0, float(i)], 0, "", "", "") for i in range(4)]
    got = nearest.nearest_vectors(spark.createDataFrame(data, VECTORS)).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(20 * i, k) for i in range(4) for k in (1, 2, 3)]


@pytest.mark.parametrize("fit_rows", [4096, 150])
def test_copies_rank_by_id_with_equal_scores(spark, monkeypatch, fit_rows):
    monkeypatch.setattr(nearest, "LIST_ROWS", 120)
    x = np.random.default_rng(8).normal(size=(200, 24))
    data = [(3 * i + c, v.tolist(), 0, "", "", "") for i, v in enumerate(x) for c in range(3)]
    got = nearest.nearest_vectors(spark.createDataFrame(data, VECTORS), fit_rows=fit_rows).collect()
    x = np.repeat(np.float32(x).astype(np.float64), 3, axis=0)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        assert r.score == (x[r.query_id] * x[r.vec_id]).sum()
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, 600, 20):
        scores = (x[q] * x).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:20]
        assert len(found[q]) == 20 and [scores[i] for i in found[q]] == sorted((scores[i] for i in found[q]), reverse=True)
        assert found[q] == sorted(found[q], key=lambda i: (-scores[i], i))
        hits += len(set(found[q]) & set(want))
    assert hits >= 0.9 * 30 * 20


def test_search_recall_beyond_the_sample(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1))
    data = spark.createDataFrame([(i, v.tolist(), 0, "", "", "") for i, v in enumerate(x)], VECTORS)
    old, nearest.LIST_ROWS = nearest.LIST_ROWS, 200
    try:
        got = nearest.nearest_vectors(data, fit_rows=600).collect()
    finally:
        nearest.LIST_ROWS = old
    x = np.float32(x).astype(np.float64)
    scores = x[::20] @ x.T
    scores[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    want = {(20 * q, int(i)) for q, row in enumerate(scores) for i in np.argsort(-row)[:20]}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)
    assert all(r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-12) for r in got)


PARAGRAPHS = ["A first paragraph that is long enough to matter on any page, with &amp; and &eacute;.", "Short one.", "The last\n  paragraph   of the text, again with a good number of words in it."]
WANT = "\n\n".join(["Title", "A first paragraph that is long enough to matter on any page, with & and é.", "Short one.", "The last paragraph of the text, again with a good number of words in it."])
BODY = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
FURNITURE = [
    '<nav><ul><li><a href="/a">Home</a><li><a href="/b">A rather long link text that looks like a sentence of text</a></ul></nav>',
    "<header><p>The site header says many things about the site and its long and eventful history.</p></header>",
    '<div class="cookie-notice">We use cookies and explain it here at some length so that it looks like text.</div>',
    '<div class="ad">Buy this wonderful thing now, it is only here for you and for a very short time.</div>',
    '<form action="/x"><label>Your name</label><input name="n"><textarea>some default text</textarea></form>',
    "<script>var x = '<p>not a paragraph</p>';</script><style>p { margin: 0 }</style><!-- <p>comment</p> -->",
    '<section id="comments"><p>First! This comment is long, as comments go, and must not be part of the text.</p></section>',
    "<aside><p>In the sidebar there is a long list of other things that you may want to read.</p></aside>",
    "<footer>&copy; all rights reserved, imprint, contact, privacy, terms and a lot more of such words</footer>",
]


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', "%s"])
def test_main_text_without_furniture(wrap):
    for k in range(len(FURNITURE) + 1):
        page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(FURNITURE[:k]) + wrap % BODY + "".join(FURNITURE[k:])
        assert webpage.main_text(page) == WANT
        assert webpage.main_text(page + "</body></html>") == WANT


def test_broken_markup():
    assert webpage.main_text("<article><h1>T</h1><p><b>bold text<br><p>next <i>it</i>em</article><footer>f") == "T\n\nbold text\n\nnext item"
    assert webpage.main_text("no markup &lt; at all") == "no markup < at all"
    assert webpage.main_text('<p title="a > b">x') == "x"
    assert webpage.main_text("a <b") == "a"
    assert webpage.main_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert webpage.main_text('<div class="ad">only an advert</div>') == ""


LONG = "A paragraph of more than one hundred characters, which alone is enough for its run of lines to reach the surge of a page."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', "%s"])
@pytest.mark.parametrize("furniture", ['<div class="ad">x</div>', "<aside><p>More of it</p></aside>", '<div class="ad">x</div><nav><a href="/">Home</a></nav>'])
def test_short_paragraphs_between_furniture(wrap, furniture):
    body = furniture.join(["<h1>T</h1>", f"<p>{LONG}</p>", "<p>Just so.</p>", "<p>That is all.</p>"])
    assert webpage.main_text(wrap % body) == f"T\n\n{LONG}\n\nJust so.\n\nThat is all."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>"])
def test_lines_of_links_in_a_marked_article(wrap):
    links = [f"Reference {i}" for i in range(5)]
    items = "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(links))
    last = '<p><a href="/r">Full report</a></p>'
    assert webpage.main_text(wrap % f"<p>{LONG}</p>{last}") == f"{LONG}\n\nFull report"
    assert webpage.main_text(wrap % f"<p>{LONG}</p><ol>{items}</ol><p>End.</p>{last}") == "\n\n".join([LONG, *links, "End.", "Full report"])


@pytest.mark.parametrize("begin", ["<body>", "<body class=x>", "", "<BODY>", "<noscript><body>"])
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "%s"])
def test_head_without_end_tag(begin, wrap):
    head = "<!DOCTYPE html><html><head>\n<meta charset=utf-8><title>T</title><link rel=x><style>p { margin: 0 }</style><noscript><img src=x></noscript>\n"
    for end in ("", "</head>"):
        assert webpage.main_text(f"{head}{begin}{wrap % BODY}{end}</body></html>") == WANT
    assert webpage.main_text("<head><title>T</title>plain text") == "plain text"


WRAPPERS = [
    '<div class="content-sidebar-wrap">%s</div>', '<div class="layout has-sidebar">%s</div>', '<div class="no-sidebar">%s</div>',
    '<div class="post-content share-enabled">%s</div>', '<form id="aspnetForm" action="/x">%s</form>',
]


@pytest.mark.parametrize("inner", ["<article>%s</article>", "<main>%s</main>", '<main><div class="layout has-sidebar"><article>%s</article></div></main>', "%s"])
@pytest.mark.parametrize("wrap", WRAPPERS)
def test_layout_wrappers_keep_the_text(wrap, inner):
    page = wrap % (FURNITURE[0] + inner % BODY + FURNITURE[6])
    assert webpage.main_text(page) == WANT
    assert webpage.main_text(f'<body><a href="#text">Skip to the text</a>{FURNITURE[4]}<div>{page}</div></body>') == WANT


def test_furniture_words_inside_names():
    sections = "".join(f'<section id="{x}"><p>{x}</p></section>' for x in ("related-work", "share-price", "notice-of-change"))
    assert webpage.main_text(f"<article><p>{LONG}</p>{sections}</article>") == "\n\n".join([LONG, "related-work", "share-price", "notice-of-change"])
    names = "ad ad-slot-2 cookie-notice main-nav related-posts comment-list site-footer sidebar sticky_ad_wrapper navbar-collapse".split()
    for x in names:
        assert webpage.main_text(f'<article><p>{LONG}</p><div class="x {x}"><p>{LONG}</p></div></article>') == LONG


def test_articles_inside_furniture():
    page = f"<article><p>{LONG}</p>%s</article>"
    for x in ("<aside><article>Teaser</article></aside>", '<div id="comments"><article>First!</article></div>'):
        assert webpage.main_text(page % x) == LONG
    assert webpage.main_text(f'<b><div class="sidebar"><article><p>{LONG}</b><p>two</p><p>three</p></article>aside</div>') == f"{LONG}\n\ntwo\n\nthree"
    comments = '<div id="comments"><article class="comment-body">First!</article></div>'
    assert webpage.main_text(f"<main>{page % ''}{comments}</main>") == LONG
    assert webpage.main_text(f'<div class="sidebar">aside{page % FURNITURE[3]}aside</div>after') == LONG


@given(st.lists(st.sampled_from([0, 0, 0, 1, 20, 40, 90]), max_size=30), st.integers(1, 5), st.integers(1, 120))
def test_runs_between_surge_and_dive(weights, window, surge):
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    least, want, i = min(surge, max(sums, default=0)), [], 0
    while i < len(sums):
        run = []
        while i < len(sums) and sums[i] > 0:
            run.append(i)
            i += 1
        if run and any(sums[j] >= least for j in run):
            want += run
        i += 1
    blocks = webpage.line_blocks(np.array(weights, dtype=np.int64), window)
    assert blocks.tolist() == sums and webpage.kept_lines(blocks, surge).tolist() == want


def test_line_blocks_choose_the_text_of_unmarked_pages():
    short = [f'<div class="z{i}">{x}</div>' for i, x in enumerate(["Buy this now.", "All news of the day.", "Imprint and contact."])]
    page = f'<body>{short[0]}{short[1]}<div class="q"><h1>T</h1><p>{LONG}</p><p>Just so.</p></div>{short[2]}</body>'
    assert webpage.main_text(page) == f"T\n\n{LONG}\n\nJust so."
    alike = "".join(f'<div class="p">{x}</div>' for x in (LONG, "Just so.", "That is all."))
    assert webpage.main_text(f'<div class="t"><h1>T</h1></div>{alike}{short[2]}') == f"T\n\n{LONG}\n\nJust so.\n\nThat is all."
    assert webpage.main_text("".join(short)) == "All news of the day.\n\nImprint and contact."  # equal highest sums


def test_articles_without_a_surge_go():
    teaser = "<article><h2>More</h2><p>A teaser.</p></article>"
    assert webpage.main_text(f"<article><p>{LONG}</p><p>End.</p></article>{teaser}outside") == f"{LONG}\n\nEnd."
    assert webpage.main_text(teaser + "outside, longer than all that the article says") == "More\n\nA teaser."


def test_forms_are_text_if_nothing_else_surges():
    assert webpage.main_text(f"<p>Short.</p><form><p>{LONG}</p></form>") == f"Short.\n\n{LONG}"
    assert webpage.main_text(f"<p>{LONG}</p><form><p>{LONG * 3}</p></form>") == LONG
    assert webpage.main_text("<form><p>Only this.</p></form>") == "Only this."


def test_pages_of_any_kind(spark):
    data = [(1, "u", "<p>hello world</p>", "t", "x"), (1, "u", "<p>hello world</p>", "t", "x"), (2, None, None, None, None), (None, "v", "", "t", "x"), (3, "w", "<p>" + "long text " * 50_000, "t", "x")]
    out = webpage.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string, text string, extra string"))
    assert sorted(out.columns) == ["extra", "n_chars", "page_id", "text", "url"]
    got = sorted((r.page_id or 0, len(r.text), r.n_chars) for r in out.collect())
    assert got == [(0, 0, 0), (1, 11, 11), (1, 11, 11), (2, 0, 0), (3, 499_999, 499_999)]
    assert webpage.extract_pages(spark.createDataFrame([], "page_id long, html string")).collect() == []
