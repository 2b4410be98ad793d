"""Blocks of difficult pages, and the recurrent labeller against plain versions of its passes."""

import random
import time

import numpy as np
import pytest

from strandlake.llm import html_extract as H


def texts(page):
    return [b[0] for b in H.blocks_of(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p class="x>Body two.', ["Body two."]),
        ("<p title=it's>One<p class='a' id=\"b\">Two</p><a href=\"x\"class='y'>Three</a>", ["One", "Two", "Three"]),
        ('<p title="a > b" alt=\'c > "d"\'>Quoted', ["Quoted"]),
        ("<p>One <svg viewBox='0'/> two <svg><text>no</text></svg>three", ["One two three"]),
        ("<div><p>A<object data=x>no</p><p>B</p></div><p>C", ["A", "B", "C"]),
        ("<datalist><option>no<option>no</datalist><p>Yes<select><option>no</select> more", ["Yes more"]),
        ("<p>A<template><div>no</div></template>B<script>x='</p>'</script>C<math/>D", ["ABCD"]),
        ("<p>A<script>never ends <p>B", ["A"]),
        ("a<", ["a<"]),
        ("<p>Open tag <b at the end", ["Open tag"]),
        ("<figure><img><figcaption>Caption</figcaption></figure>&lt;p&gt; &amp;amp; &#233;", ["Caption", "<p> &amp; é"]),
        ("<![CDATA[raw]]><!-- no --><p>x<!-- open", ["raw", "x"]),
        ("", []),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_deep_nesting_is_linear():
    began = time.time()
    blocks = H.blocks_of("<div class=a>x" * 60_000 + "<p>end</b></i>" * 1000)
    assert len(blocks) == 61_000 and time.time() - began < 10


def test_labels_from_names_and_figures():
    body = "".join(f"<p>Sentence number {k} of a text that goes on for some more words than a menu does.</p>" for k in range(3))
    page = H.blocks_of(f"<header>H</header><article><header><h1>T</h1></header><figure><figcaption>C</figcaption></figure><aside>S</aside><footer>F</footer></article><div class=qwk><h2>Head</h2>{body}</div><ul class=pfz><li><a href=x>A long row of linked words that would else be a sentence of an article.</a><li>Two</ul>")
    assert [(t[:9], x) for (t, _, _), x in zip(page, H.weak_labels(page))] == [("H", 0), ("T", 1), ("C", 1), ("S", 0), ("F", 0), ("Head", 1), *[("Sentence ", 1)] * 3, ("A long ro", 0), ("Two", 0)]
    again = frozenset(t for t, _, _ in page)
    assert [x for x in H.weak_labels(page, again)] == [0, 1, 1] + [0] * 8


def tiny(seed=0):
    m, rng = H.Labeller(seed), np.random.default_rng(seed)
    for k in m.w:
        m.w[k] = rng.normal(size=m.w[k].shape).astype(np.float64) * 0.3
    return m, rng


def test_passes_against_plain_ones():
    m, rng = tiny()
    x = rng.normal(size=(6, 1, m.w["fx"].shape[0])) * 0.2
    sig = lambda z: 1 / (1 + np.exp(-z))

    def plain(k, rows):
        state, cell, out, h = np.zeros(H.HIDDEN), np.zeros(H.HIDDEN), [], H.HIDDEN
        for r in rows:
            z = r @ m.w[f"{k}x"] + state @ m.w[f"{k}h"] + m.w[f"{k}0"]
            cell = sig(z[h : 2 * h]) * cell + sig(z[:h]) * np.tanh(z[3 * h :])
            state = sig(z[2 * h : 3 * h]) * np.tanh(cell)
            out.append(state)
        return np.array(out)

    both = np.concatenate([plain("f", x[:, 0]), plain("b", x[::-1, 0])[::-1]], axis=1)
    got = m._run(x, np.ones((6, 1), bool))[0][:, 0]
    assert np.allclose(got, sig(both @ m.w["o"] + m.w["o0"]), atol=1e-5)


def test_gradients_against_differences():
    m, rng = tiny(1)
    x, mask = rng.normal(size=(4, 2, m.w["fx"].shape[0])) * 0.2, np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    weight = rng.normal(size=(4, 2, H.HIDDEN))

    def loss(k):
        out, *_ = m._direction(k, x, mask, False)
        return float((out * weight * mask[:, :, None]).sum())

    for k in "fb":
        _, saved, _ = m._direction(k, x, mask, True)
        grads = m._backward(k, x, mask, saved, weight * mask[:, :, None])
        for name in (f"{k}x", f"{k}h", f"{k}0"):
            for _ in range(5):
                at = tuple(rng.integers(0, s) for s in m.w[name].shape)
                old, step = m.w[name][at], 1e-3
                m.w[name][at] = old + step
                up = loss(k)
                m.w[name][at] = old - step
                down = loss(k)
                m.w[name][at] = old
                assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3


def test_long_pages_keep_all_context(monkeypatch):
    m = H.Labeller()
    page = H.blocks_of("".join(f"<div class=c{k % 7}><p>Text {k} of it.</p></div>" for k in range(150)))
    whole = m.probabilities([H.vectors([page])])[0]
    monkeypatch.setattr(H, "RUN", 16)
    assert np.allclose(m.long_page(page), whole, atol=1e-4)
    assert [len(p) for p in m.label([page, [], page[:3]])] == [150, 0, 3] and np.allclose(m.label([page[:3], page])[1], whole, atol=1e-4)


def test_network_goes_beyond_names(spark):
    def page(k, box, side):
        rng = random.Random(k)
        word = lambda n: " ".join(rng.choice("alder birch cedar dogwood elm fir gum hazel ivy juniper".split()) for _ in range(n))
        menu = "".join(f"<li><a href=/{j}>{word(2)}</a></li>" for j in range(6))
        body = "".join(f"<p>{word(25)}.</p>" for _ in range(4))
        return f"<html><body><{side}><ul>{menu}</ul></{side.split()[0]}><{box}><h1>{word(4)}</h1>{body}</{box.split()[0]}><footer>&copy; {word(5)}</footer></body></html>"

    rows = [(k, "u", page(k, "article", "nav") if k % 4 else page(k, "div class=zzkx", "div class=wq")) for k in range(80)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = H.train(docs)
    good, named = 0, 0
    for k in range(200, 260):
        blocks = H.blocks_of(page(k, "div class=ghtp" if k % 2 else "section", "div class=pnv"))
        want = [1 if b[1].leaf in ("h1", "p") else 0 for b in blocks]
        good += [int(p >= 0.5) for p in model.label([blocks])[0]] == want
        named += any(b[1].main for b in blocks)
    assert good >= 57 and named == 0


def test_class_names_and_scripts_without_spaces():
    assert H.name_parts("page social-news-site ad-box") == [".page", ".site", ".ad", ".box"]
    page = H.blocks_of("<div class='page social-news-site'><article><p>Text</p></article></div><div class='page-social-share'>Share</div>")
    assert [(p.main, p.side) for _, p, _ in page] == [(True, False), (False, True)]
    text = "这是一个关于森林和河流的长句子它没有任何空格但是有很多字。"
    page = H.blocks_of(f"<div><h2>标题</h2><p>{text}</p></div><div><a href=x>首页</a></div>")
    assert H.weak_labels(page) == [1, 1, 0]


def test_articles_keep_lists_tables_and_headings(spark):
    model = H.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    rng = random.Random(3)
    word = lambda n: " ".join(rng.choice("alder birch cedar dogwood elm fir gum hazel ivy juniper the of and in with".split()) for _ in range(n))
    exact = 0
    for k in range(24):
        body, want = [], []

        def add(tag, text):
            want.append(text)
            return f"<{tag}>{text}</{tag.split()[0]}>"

        body.append(add("h1", word(4)))
        for j in range(rng.randint(2, 4)):
            body.append(add("p", "这片森林里有很多高大的树木和清澈的小河。" * 3 if k % 8 == 7 else word(rng.randint(15, 50)) + "."))
            kind = (k + j) % 4
            if kind == 0:
                body.append(add("h2", word(3)))
            elif kind == 1:
                body.append("<ul>" + "".join(add("li", word(rng.randint(2, 8))) for _ in range(3)) + "</ul>")
            elif kind == 2:
                body.append("<table><tr>" + "".join(add("td", word(2)) for _ in range(2)) + "</tr></table>")
        body.append(add("p", word(20) + "."))
        shell = ["article", "main", "div class=content", "div class='post-content'"][k % 4]
        outer = ["div class='page social-news-site'", "div id=wrapper", "div", "div class=has-sidebar-left"][k // 4 % 4]
        menu = "".join(f"<li><a href=/{j}>{word(2)}</a></li>" for j in range(5))
        html = f"<html><body><{outer}><nav><ul>{menu}</ul></nav><{shell}>{''.join(body)}</{shell.split()[0]}><div class=related><p>{word(20)}.</p></div><footer><p>&copy; {word(6)}</p></footer></div></body></html>"
        blocks = H.blocks_of(html)
        got = [b[0] for b, p in zip(blocks, model.label([blocks])[0], strict=True) if p >= 0.5]
        exact += got == want
    assert exact >= 21
