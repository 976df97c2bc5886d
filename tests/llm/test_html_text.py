import html
import random
import re

import duckdb
import pytest

from millrace.llm import html_text as ht

PAGES = "'/root/testdata/sf0.01/pages.parquet'"


def article(page):
    """The blocks of the one article element, by plain means."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


@pytest.fixture(scope="module")
def field(spark):
    return ht.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_all_articles_are_found(spark, field):
    pages = dict(duckdb.connect().execute(f"SELECT page_id, html FROM {PAGES}").fetchall())
    got = ht.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), field).collect()
    assert {r.page_id: r.text for r in got} == {k: article(h) for k, h in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_held_out_layouts(field):
    pages = [h for (h,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    texts = sorted({b.text for h in pages for b in ht.blocks(h)})
    rng = random.Random(99)
    wrong = total = 0
    for _ in range(200):
        page, labels = ht.layout(rng, texts)
        wrong += sum(a != b for a, b in zip(ht.decode(field, page), labels))
        total += len(labels)
    assert total > 3000 and wrong / total < 0.04


def test_blocks():
    def texts(page):
        return [b.text for b in ht.blocks(page)]

    assert texts(None) == texts("") == texts(" \n ") == []
    assert texts("a &amp; b&nbsp;&eacute;&#233;<br>c") == ["a & b éé c"]
    assert texts("<p>one<p>two<b>bold</b>x</p>three<div>four</div>") == ["one", "twoboldx", "three", "four"]
    assert texts("<script>if(a<b){'</p>'}</script>t<style>p{}</style><!-- x <p> -->u<title>no</title>") == ["tu"]
    assert texts("<p>a < b and c > d</p>") == ["a < b and c > d"]
    assert texts('<p class="a>b">x</p><a href=\'>\'>y</a>') == ["x", "y"]
    assert texts("<script>never closed <p>x") == []
    assert texts("<ul><li>a<li>b</ul></div></p>c") == ["a", "b", "c"]
    assert texts("<a " * 300_000 + "<p>x</p>") == [("<a " * 300_000).strip(), "x"]  # in linear time
    assert texts("<!-- " * 100_000 + "x") == [] and len(texts("<p \"" * 100_000)) <= 1
    deep = ht.blocks("<div>" * 3000 + "x" + "<b>" * 3000 + "y")
    assert [b.text for b in deep] == ["xy"] and len(deep[0].features) < 20


def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(7)
    for _ in range(50):
        names = [f"f{k}" for k in range(6)]
        field = ht.Field({f: rng.gauss(0, 1) for f in names}, tuple(tuple(rng.gauss(0, 1) for _ in "ab") for _ in "ab"), rng.gauss(0, 1))
        page = [ht.Block("x", tuple(rng.sample(names, 2))) for _ in range(6)]

        def score(y):
            own = sum(field.state[f] for b, v in zip(page, y) if v for f in b.features)
            return own + field.start * y[0] + sum(field.step[a][b] for a, b in zip(y, y[1:]))

        best = max(score([k >> i & 1 for i in range(6)]) for k in range(64))
        assert abs(score([int(v) for v in ht.decode(field, page)]) - best) < 1e-9


def test_odd_rows(spark, field):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, None, "<article><p>" + "Long text, with words. " * 20000 + "</p></article>", "x"), (3, "u", "no mark at all", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.main_text(pages, field).collect()
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in got)[:4] == [(0, False), (1, False), (1, False), (2, True)]
    assert max(r.n_chars for r in got) == len(("Long text, with words. " * 20000).strip())
    nothing = ht.train(pages.where("false"))
    assert {r.text for r in ht.main_text(pages, nothing).collect()} == {""}
    assert ht.main_text(pages.where("false"), field).count() == 0


def test_a_very_long_page_is_learned_from_in_part(spark):
    parts = [f"<p class=\"{'q' * 50} {' '.join(f'k{chr(97 + j % 26)}{chr(97 + j // 26)}' for j in range(90))}\">Menu entry {k}</p>" for k in range(2000)]
    page = "".join(parts) + "<article>" + "".join(f"<p>{'Long text with words, and a stop. ' * 60}{k}</p>" for k in range(2500)) + "</article>"
    assert len(page) > 5_000_000
    run, labels = ht.labelled_run(page)
    assert len(run) == len(labels) == ht.RUN_BLOCKS and 0 < sum(labels) < ht.RUN_BLOCKS
    assert max(len(b.text) for b in run) <= ht.RUN_CHARS and max(len(b.features) for b in run) <= ht.RUN_FEATURES
    assert len(str(run)) < 400_000
    short = "<nav>menu</nav><article><p>text of it</p></article>"
    assert ht.labelled_run(short) == (ht.blocks(short), ht.own_labels(ht.blocks(short)))
    assert ht.labelled_run("") == ([], None) and ht.labelled_run("<p>x</p>")[1] is None
    rows = spark.createDataFrame([(1, "u", page)] + [(k, "u", short) for k in range(2, 6)], "page_id long, url string, html string")
    found = ht.main_text(rows.where("page_id > 1"), ht.train(rows)).collect()
    assert {r.text for r in found} == {"text of it"}
