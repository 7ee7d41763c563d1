"""Operator 1 on the fixture's pages, on layouts it hasn't seen, and on broken markup."""

import html
import itertools
import time
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallymill.llm import html_text
from tallymill.llm.html_pages import pages

from .conftest import SF


@pytest.fixture(scope="module")
def extractor():
    return html_text.Extractor()


def article(source):
    inside = source[source.index("<article>") + 9 : source.index("</article>")]
    parts = re.split(r"</?(?:p|h1)>", inside)
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in parts]
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_fixture(spark):
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    found = {r["page_id"]: r for r in html_text.extract(table).collect()}
    rows = table.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["page_id"]]["text"] == article(r["html"])
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


def test_layouts_not_seen(extractor):
    sources = pages(150, seed=4242)
    hit = out = want = 0
    for source, text in zip(sources, extractor.texts(sources), strict=True):
        forest = html_text.Forest()
        forest.add(source)
        gold = forest.gold[:]
        for i, (tag, above) in enumerate(zip(forest.tag, forest.parent, strict=True)):
            if tag in html_text.INLINE:
                gold[i] = gold[above]
        truth = Counter(" ".join(html.unescape(t) for n, _, t in forest.segments if gold[n]).split())
        mine = Counter(text.split())
        hit += sum((truth & mine).values())
        out += sum(mine.values())
        want += sum(truth.values())
    assert hit / out > 0.98 and hit / want > 0.98


def test_a_page_by_hand(extractor):
    body = "A long sentence of the story, with some words and a few more, and then an end. " * 4
    source = (
        "<html><head><title>T</title><style>p{}</style></head><body><div class='cookie-banner'><p>We use cookies. Accept?</p><button>OK</button></div>"
        "<header class=site-header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav>"
        f"<article><h1>A&nbsp;title &amp; more</h1><p>{body}<p>Second\n\n para&#233;graph <a href=x>with a link</a>,<br>and a line. {body}"
        f"<div class='advert'>Buy now</div><p>Third <!-- hidden --> one. {body}</p><script>var x = '<p>no</p>';</script></article>"
        "<aside class='sidebar'><h3>Related</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></aside>"
        "<section id=comments><h3>Comments</h3><div class=comment><b>Joe</b><p>I liked this a lot, thanks for it.</p></div></section>"
        "<form><label>Mail</label><input><button>Send</button></form><footer>&copy; Site</footer></body></html>"
    )
    one = re.sub(r"\s+", " ", body).strip()
    assert extractor.texts([source])[0].split("\n\n") == ["A title & more", one, f"Second paraégraph with a link, and a line. {one}", f"Third one. {one}"]


def test_skipped_elements_that_close_themselves_or_never(extractor):
    body = "A long sentence of the story, with some words and a few more, and then an end. " * 4
    one = re.sub(r"\s+", " ", body).strip()
    for odd in ("<svg class='i'/>", "<iframe src='x' />", "<object data=x />", "<video src=x/>", "<audio/>", "<canvas/>", "<textarea/>", "<video src=x>", "<canvas>", "<object data=x>", "<svg><svg><path/></svg><text>no</text></svg>", "<object><object>no</object>no</object>", "<script>no</script>"):
        source = f"<html><body><header class=site-header><a href=/>Site</a></header>{odd}<article><h1>Title of it</h1><p>{body}</p><p>{body}</p></article><footer>&copy; Site</footer></body></html>"
        assert extractor.texts([source])[0].split("\n\n") == ["Title of it", one, one], odd


def test_a_thousand_levels(extractor):
    forest = html_text.Forest()
    forest.add("<div>" * 1000 + "<p>deep<span>" + "<i>" * 20 + "x<div>y" + "</div>" * 500 + "<p>z")
    assert max(forest.depth) >= 1022
    paragraph = forest.tag.index("p")
    assert forest.end[paragraph] == paragraph + 22  # the <div> ended it, however far up it was opened
    assert forest.depth[-1] == 501 + 1


def test_decoding_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = 7
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        odds = rng.standard_normal(n) * 2
        yes, no = -np.log1p(np.exp(-odds)), -np.log1p(np.exp(odds))

        def value(state, yes=yes, no=no, parent=parent):
            total = sum(yes[i] if s == 1 else no[i] for i, s in enumerate(state))
            if state[0] == 2:
                return -np.inf
            for i in range(1, len(state)):
                step = (state[parent[i]], state[i])
                if step not in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2)):
                    return -np.inf
                total += {(0, 1): html_text.ENTER, (1, 2): html_text.LEAVE}.get(step, 0)
            return total

        best = max(value(s) for s in itertools.product((0, 1, 2), repeat=n))
        found = html_text.decode(odds, np.zeros(n, bool), parent, levels)
        assert abs(value(tuple(found.tolist())) - best) < 1e-9


@pytest.mark.parametrize("source", ["", None, "   ", "plain text", "<", "<<p>", "<p", "<!--", "<p class='x>a", "</p></div>", "<div>" * 3000 + "deep", "<p>" * 2000, "<script>never closed", "a < b & c &unknown; &#xZZ;", "<table><tr><td>x<td>y<tr><td>z", "\x00<b>\x00"])
def test_broken_markup(extractor, source):
    assert isinstance(extractor.texts([source, "<p>x"])[0], str)


def test_odd_tables(spark, extractor):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<article><p>" + "word, and another. " * 20_000), (2, "u", "<article><p>" + "word, and another. " * 20_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars")})
    found = html_text.extract(table, extractor).collect()
    assert sorted(r["n_chars"] for r in found) == [0, 0, 20_000 * 19 - 1, 20_000 * 19 - 1]
    assert html_text.extract(table.limit(0), extractor).collect() == []


def test_many_unclosed_elements_take_little_time():
    began = time.time()
    forest = html_text.Forest()
    forest.add("<svg>" * 30_000 + "<p>kept</p>" + "<video><p>" * 30_000 + "</video></svg>")
    assert time.time() - began < 10


def test_skipped_elements_are_matched():
    forest = html_text.Forest()
    forest.add("<p>a<svg><g><svg/>no<svg>no</svg>no</svg>b<svg>c<object>no<object>no</object></object>d</object>e</svg>f<math>g")
    assert "".join(text for _, _, text in forest.segments) == "abf" + "g"
