"""HTML extraction: held-out pages, the articles of the table, odd markup and the decoding."""

import html as entities
import itertools
import random
import re
import time

import numpy as np
import pytest

from wiring.llm import html, queries


def test_held_out_pages():
    trees, right, runs = html.model(), 0, 0
    for k in range(80):
        nodes, parents, x, y = html.labelled(77_000_000 + k)
        kept = html.decode(parents, trees.predict(x))
        run = np.array([n.tag is None for n in nodes])
        right, runs = right + (kept == y)[run].sum(), runs + run.sum()
    assert right / runs > 0.95


def test_decoding_is_the_likeliest_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = 9
        parents = [-1, *[int(rng.integers(0, k)) for k in range(1, n)]]
        p = rng.uniform(0.02, 0.98, n)
        best = max((c for c in itertools.product([0, 1], repeat=n) if all(u < 0 or c[k] <= c[u] for k, u in enumerate(parents))),
                   key=lambda c: sum(np.log(p[k] if c[k] else 1 - p[k]) for k in range(n)))
        assert html.decode(parents, p).astype(int).tolist() == list(best)


def test_articles_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = dict(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect())
    for r in queries.op9_main_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]+>", " ", x))).strip() for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text)


def test_markup():
    def runs(page):
        nodes, _, _ = html.nodes_of(html.parse(page))
        return [n.text for n in nodes if n.tag is None]

    assert runs("<p>a <b>b</p><p>c&amp;d &lt;x&gt; e<br>f</b> g") == ["a b", "c&d <x> e f g"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x") == ["a", "b", "c", "d", "x"]
    assert runs("<script>var a='<p>no</p>'</script>yes<!-- <p>no --><style>p{}</style> and") == ["yes and"]
    assert runs("<div a='>'>x</div></p></div>y < z <p") == ["x", "y < z <p"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table><![CDATA[q & r]]>") == ["a", "b", "c", "q & r"]
    assert runs("<script>never closed") == [] and runs("") == []
    assert runs("<div>" * 3000 + "deep") == ["deep"]


def test_markup_inside_a_paragraph_does_not_cut_it():
    def runs(page):
        nodes, _, _ = html.nodes_of(html.parse(page))
        return [n.text for n in nodes if n.tag is None]

    assert runs("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be real") == ["Let x=1 be real"]
    assert runs("<p>see <svg><text>drawn</text></svg>the icon<p>next") == ["see the icon", "next"]
    assert runs("<p>a <noscript>b <i>c</i></noscript> d") == ["a b c d"]
    assert runs("<p>a <object data='x'>told <b>here</b></object> d") == ["a told here d"]
    assert runs("<p>a <iframe src='x'>no</iframe>b <video>no</video>c <select><option>no</select>d") == ["a b c d"]
    assert runs("<div><noscript><p>one</p></noscript><p>two</div>") == ["one", "two"]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>" * 50, "t"), (3, "u", "x", "t")], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == 4 and all(r.text == "" and r.n_chars == 0 for r in got[:3])
    assert html.extract(df.limit(0)).count() == 0


def test_self_closed_and_unclosed_raw_elements():
    def said(page):
        found = html.nodes_of(html.parse(page))
        return " ".join(n.text for n in found[0])

    for tag in ("svg", "math"):
        assert "after" in said(f"<p>before <{tag} width='1'/> after</p>")
        assert "after" in said(f"<p>before</p><{tag}/><p>after</p><{tag}><title>no</title></{tag}>")
    for tag in ("object", "video", "audio", "canvas"):
        assert "after" in said(f"<p>before</p><{tag}><p>after</p>")
    for tag in ("script", "style", "textarea", "title", "iframe"):
        assert "after" not in said(f"<p>before</p><{tag}><p>after</p>")


def test_kept_trees_are_those_of_the_fit(tmp_path):
    made, kept = html.fit(), html.model()
    x = html.labelled(5)[2]
    made.save(str(tmp_path / "t.npz"))
    assert (html.Boosted.load(str(tmp_path / "t.npz")).predict(x) == made.predict(x)).all()
    assert np.allclose(made.predict(x), kept.predict(x), atol=0.05)


@pytest.mark.parametrize("unit", ["<a ", "<x>", "<canvas>", "</x>", "<b><div></b>", "<a \"", "<p><i>", "<li><x>", "<", "<!", "<table><tr><td>", "&amp;<x"])
def test_time_grows_with_the_page(unit):
    took = []
    for n in (20_000, 80_000):
        page = unit * n + '">end'
        began = time.time()
        html.nodes_of(html.parse(page))
        took.append(time.time() - began)
    assert took[1] < max(10 * took[0], 2.0)  # with the square it would be sixteen times


def test_ends_of_tags_are_those_of_the_pattern():
    rng = random.Random(9)
    for _ in range(400):
        page = "".join(rng.choices(["<a", " ", '"', "'", ">", "x", "<b", "="], k=rng.randint(0, 30)))
        ends = html._Ends(page)
        for at in range(len(page) + 1):
            m = html._REST.match(page, at)
            assert ends.after(at) == (m.end() - 1 if m else None), (page, at)


def test_misleading_words_on_an_article():
    body = "<h1>How we treat remarks</h1><p>" + "We read every remark before it is shown, and we answer those that ask for it. " * 5 + "</p>"
    for words in ("comment-policy content", "no-ads post", "share-history article", "cookie-guide entry"):
        page = f'<html><body><nav><a href="/">Home</a> <a href="/n">News</a></nav><article class="{words}">{body}</article><div class="comments"><div class="comment"><p>I like it.</p></div></div><footer>&copy; us</footer></body></html>'
        text = html.main_texts([page], html.model())[0]
        assert text.startswith("How we treat remarks\nWe read every") and "I like it" not in text and "us" not in text.split("\n")


#: Pages written by hand, in styles that the generator does not have: the page and its blocks of main text.
BY_HAND = [
    ("""<!DOCTYPE html><html lang="en"><head><title>T</title><script>var a=1</script></head><body class="home blog"><header id="masthead"><a href="/">The Daily Grain</a><nav><ul><li><a href="/a">Farm</a></li><li><a href="/b">Field</a></li></ul></nav></header>
<main id="main"><article class="hentry"><h1 class="entry-title">Rain returns to the valley</h1><div class="entry-meta">By A. Writer on 3 May</div><div class="entry-content"><p>After eleven dry weeks the rain came back on Sunday, and with it the birds that had left in March.</p>
<p>Farmers said that the first two hours alone had filled the upper pond, which had been <em>empty</em> since winter.</p><blockquote><p>We had nearly given up on the barley, said one of them, whose fields lie by the river.</p></blockquote><p>More rain is expected on Thursday, though less of it, and the wind should turn to the west.</p></div></article></main>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten ways to stack hay</a></li><li><a href="/2">Owls of the barn</a></li></ul></aside><footer class="site-footer"><p>Copyright The Daily Grain. All rights reserved.</p></footer></body></html>""",
     ["Rain returns to the valley", "After eleven dry weeks", "Farmers said that the first", "We had nearly given up", "More rain is expected"]),
    ("""<html><body><div id="cookie-banner"><p>We use cookies to make this site work. Accept or decline.</p><button>Accept</button></div><div class="container"><div class="row"><div class="col-8 post-body"><h2>Setting up the kiln</h2>
<p>Before the first firing the shelves have to be washed with a thin coat, or the pots will stick to them and crack.</p><ol><li>Mix the wash with water until it runs like cream.</li><li>Brush on three coats, each across the last.</li></ol><p>Let the shelves dry for a whole day in a warm room, away from the draught of the door.</p>
<div class="advert"><a href="/buy">Buy shelves now, half price!</a></div><p>Then fire them empty once, slowly, and look for flakes when they have cooled.</p></div><div class="col-4"><form class="newsletter"><label>Your email</label><input><button>Sign up</button></form></div></div></div></body></html>""",
     ["Setting up the kiln", "Before the first firing", "Mix the wash with water", "Brush on three coats", "Let the shelves dry", "Then fire them empty"]),
    ("""<html><body><table width="100%"><tr><td class="menu"><a href="a.html">Index</a><br><a href="b.html">Letters</a><br><a href="c.html">Maps</a></td><td class="content"><h1>A walk to the mill</h1><p>The road to the mill leaves the village by the old bridge and climbs for a mile between hedges.</p>
<p>At the top there is a bench, and from it one can see both the sea and the hills, if the day is clear.</p><p>The mill itself has not turned since the flood, but its wheel was mended last year by people from the town.</p></td></tr></table><div class="footer"><a href="/">Home</a> | <a href="/contact">Contact</a></div></body></html>""",
     ["A walk to the mill", "The road to the mill", "At the top there is a bench", "The mill itself has not turned"]),
    ("""<html><body><div class="topbar"><a href="/login">Log in</a> <a href="/join">Join</a></div><section class="story"><h1>Notes on a small engine</h1><p>The engine came in a box, without a manual, and with two screws more than it had holes for.</p><figure><img src="e.jpg"><figcaption>The engine on the bench, seen from its left side.</figcaption></figure>
<p>I began with the valve, since it was the only part that I had seen before, and cleaned it with spirit.</p></section><section class="comments"><h3>3 comments</h3><div class="comment"><p>Great read, thank you for the pictures!</p></div><div class="comment"><p>Mine had three screws too many.</p></div></section><div class="share"><a href="/s">Share</a> <a href="/t">Post</a></div></body></html>""",
     ["Notes on a small engine", "The engine came in a box", "The engine on the bench", "I began with the valve"]),
]


def test_pages_written_by_hand():
    right = kept = wanted = 0
    for page, blocks in BY_HAND:
        found = html.main_texts([page], html.model())[0].split("\n")
        hits = sum(any(line.startswith(b) for b in blocks) for line in found)
        right, kept, wanted = right + hits, kept + len(found), wanted + len(blocks)
    assert right / kept >= 0.9 and right / wanted >= 0.9, (right, kept, wanted)
