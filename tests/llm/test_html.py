import html as lib
import re
import time

import pytest

from quire.llm import html


def text_of(page):
    return html.extract([page], html.train())[0]


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r["page_id"]: r for r in html.extract_pages(pages).collect()}
    for r in pages.collect():
        body = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [" ".join(lib.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        expected = "\n".join(b for b in blocks if b)
        assert found[r["page_id"]]["text"] == expected and found[r["page_id"]]["n_chars"] == len(expected)


def test_made_pages_that_it_was_not_trained_on():
    right = total = 0
    for page in html.sample_pages(80, seed=1234):
        nodes, runs = html.parse(page)
        state = []
        for n in nodes:
            state.append(n.label if n.label is not None else n.parent >= 0 and state[n.parent])
        expected = "\n".join(r.text for r in runs if state[r.node])
        right += text_of(re.sub(r' data-part="\w+"', "", page)) == expected
        total += 1
    assert right / total > 0.85


def test_parser():
    nodes, runs = html.parse('<body><p>a<b>b</b> &amp;lt;<br>c<p>d\n\n e<ul><li>f<li>g</ul><script>if (a<b) "</p>"</script><!-- x --><title>t</title>h < i <a href="x>y">j</a>')
    assert [r.text for r in runs] == ["ab &lt; c", "d e", "f", "g", "h < i j"]
    assert [nodes[r.node].tag for r in runs] == ["p", "p", "li", "li", "body"]
    assert runs[-1].linked == 1
    for odd in ("", "<", "<<<>>>", "</p></div>", "<p", "<!--", "<script>x", "<a><a><a>x", "<div>" * 3000 + "x", "<table><tr><td>1<td>2<tr><td>3</table>", '<p class="' + "x" * 1000, "&#0; &bogus; &#x1F600;"):
        html.extract([odd], html.train())


def test_kept_nodes_have_kept_parents():
    for page in html.sample_pages(20, seed=5):
        nodes, runs = html.parse(page)
        kept = html.decode(nodes, html.train().log_odds(html.features(nodes, runs)))
        assert all(kept[n.parent] for n, k in zip(nodes, kept) if k and n.parent >= 0)


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t"), (3, "<article><h1>T</h1><p>" + "word " * 60_000 + "</p></article>", "t")], "page_id long, html string, text string")
    found = sorted((r["page_id"], r["n_chars"]) for r in html.extract_pages(pages).collect())
    assert found == [(1, 0), (2, 0), (2, 0), (3, 2 + 60_000 * 5 - 1)]
    assert html.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ['<a "x ', "<a ", "<div><b></i>", "<b><div></b>", "<head>", '<a b="x>', "<i><hr>", "<li><i>", "<a><p>", '<p x="\'> ', "<!", "<script>x", "&amp;<", "<tr><td><table>", "<div " + "x" * 50 + ">"])
def test_broken_pages_take_linear_time(shape):
    page = shape * (1_000_000 // len(shape))
    began = time.time()
    nodes, runs = html.parse(page)
    assert time.time() - began < 15 and len(nodes) >= 1


def test_quotes_and_broken_tags():
    text = lambda page: " / ".join(r.text for r in html.parse(page)[1])
    assert text('<p title="a>b">x</p><p title=\'c>d\'>y') == "x / y"
    assert text('<p "q>x</p>y') == "x / y" and text('<p a="b>x<p>y') == "x / y"
    assert text("1 < 2 <b>and</b> 3 > 2") == "1 < 2 and 3 > 2" and text("<p>a<!-- b --> c<!-- d") == "a c"
    assert text("<b><p>a</b>b</p>c") == "ab / c" and text("<ul><li>a<li>b</ul>c") == "a / b / c"
