import html as entities
import re

import duckdb
import numpy as np

from vecsight.llm import maintext, queries

SF = "/root/testdata/sf0.01"


def article(page):
    """The article of the generated pages, read off their markup."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.sub(r"<[a-zA-Z/!][^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\0", inner)).split("\0")
    return " ".join(" ".join(entities.unescape(b).split()) for b in blocks if entities.unescape(b).split())


def test_query_on_held_out_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op2_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)
    assert np.mean([r.text == article(pages[r.page_id].html) for r in got]) > 0.99


def test_unlabelled_layouts():
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()]
    chain = maintext.fit(pages[:120])
    body = ("<h1>A heading of some words</h1><p>The first paragraph is long enough to be read, and it says something. It goes on.</p>"
            "<p>Second   one with <a href=x>a link</a>&nbsp;&eacute; and more words to read in it.</p>")
    want = ("A heading of some words The first paragraph is long enough to be read, and it says something. It goes on. "
            "Second one with a link é and more words to read in it.")
    around = ("<body><header><a href=/>Home</a></header><div class='cookie-notice'>We use cookies to show you this page.</div>{}"
              "<aside class=sidebar><p>Other stories you may like to read today.</p></aside><section class=comments><div class=comment>"
              "<p>Thanks for this, I liked it a lot. Great.</p></div><form><label>Name</label></form></section>"
              "<footer>&copy; 2024 All rights reserved.</footer><script>var a='<p>no</p>';</script></body>")
    for holder in ("article", "main", "div class=content", "div class='post body'", "div"):
        tag = holder.split()[0]
        assert maintext.main_text(around.format(f"<{holder}>{body}</{tag}>"), chain) == want, holder


def test_reader():
    blocks = maintext.leaf_blocks("<p>a<b>b</b> c<p>d &amp; e<br>f<style>x{}</style><!-- no --><ul><li>g<li>h</ul><td>i")
    assert [b[2] for b in blocks] == ["ab c", "d & e", "f", "g", "h", "i"]
    assert maintext.leaf_blocks(None) == maintext.leaf_blocks("") == maintext.leaf_blocks("<p> <br></p>") == []
    assert [b[2] for b in maintext.leaf_blocks("x < y </nothing> <p")][:1] == ["x < y"]


def test_viterbi_and_gradient_against_enumeration():
    from itertools import product
    rng = np.random.default_rng(3)
    chain = maintext.Chain({"a": 0, "b": 1, "c": 2})
    chain.emit[:3], chain.move, chain.edge = rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=(2, 2))
    page = [["a"], ["b", "c"], [], ["c", "x"], ["a", "b"]]
    s = chain.scores(page)

    def score(y):
        return (chain.edge[0, y[0]] + chain.edge[1, y[-1]] + sum(s[i, k] for i, k in enumerate(y))
                + sum(chain.move[p, q] for p, q in zip(y, y[1:])))
    best = max(product((0, 1), repeat=5), key=score)
    assert tuple(chain.decode(page)) == best
    all_y = list(product((0, 1), repeat=5))
    p = np.exp([score(y) for y in all_y])
    p /= p.sum()
    gold = (0, 1, 1, 0, 1)
    index = np.array([[[0, 3], [1, 2], [3, 3], [2, 3], [0, 1]]])
    emit, move, edge = chain._slopes(index, np.array([gold]), np.array([5]))
    want = np.zeros((2, 2))
    for q, y in zip([*(-p), 1.0], [*all_y, gold]):
        for a, b in zip(y, y[1:]):
            want[a, b] += q
    assert np.allclose(move, want) and np.allclose(edge[0], np.eye(2)[0] - [sum(q for q, y in zip(p, all_y) if y[0] == k) for k in (0, 1)])
    assert np.isclose(emit[0, 0], 1 - sum(q * ((y[0] == 0) + (y[4] == 0)) for q, y in zip(p, all_y)))


def test_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "t", 5), (2, None, "", "t", 5), (2, None, "", "t", 5), (None, "w", "<p>only &lt;this&gt;</p>", "t", 5),
                                   (3, "x", "<article><p>" + "word " * 200_000 + "end.</p></article>", "t", 5)],
                                  "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.n_chars, len(r.text)) for r in maintext.extract(pages).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2)] == [(1, 0, 0), (2, 0, 0), (2, 0, 0)] and (3, 1_000_004, 1_000_004) in got
    empty = maintext.extract(pages.limit(0))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars"]
    plain = spark.createDataFrame([(1, "u", "<p>one</p><p>two</p>")], "page_id long, url string, html string")
    assert maintext.extract(plain).first().text == "one two"  # nothing labelled: every block
