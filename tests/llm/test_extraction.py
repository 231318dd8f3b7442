"""Main text of hand-made pages and of the given ones."""

import html
import random
import re
import time

import pytest

from salesloom.llm import extraction

PARAGRAPHS = [
    "The first paragraph is long enough, it has commas, and it ends well.",
    "Short.",
    "Another one follows; it says more, and more, than the heading above it did.",
]


def page(body, head="<title>T</title><style>p{a:b}</style><script>var x='<p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


ARTICLE = "<h1>Head &amp; line</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n".join(["Head & line", *PARAGRAPHS])
MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(9)) + "</ul></nav>"
LONG = "Buy this, now, because it is good, cheap, and here; do not wait, friend. " * 3


@pytest.mark.parametrize(
    "body",
    [
        f"{MENU}<article>{ARTICLE}</article><footer>&copy; us. All rights, reserved, here.</footer>",
        f'{MENU}<div class="ad">{LONG}</div><article>{ARTICLE}</article>',
        f"<header><h2>Site</h2></header>{MENU}<main>{ARTICLE}</main><aside>{LONG}</aside>",
        f'<div class="content has-sidebar">{ARTICLE}</div><div class="sidebar"><p>{LONG}</p></div>',
        f'<div id="cookie-notice"><p>{LONG}</p></div><div id="post">{ARTICLE}</div>',
        f'<article>{ARTICLE}<div class="share">Share this</div></article>'
        f'<section id="comments"><p>{LONG}</p><p>{LONG}</p></section>',
        f"<form><p>{LONG}</p><input><textarea>x</textarea></form><div>{ARTICLE}</div>{MENU}",
        f'<div role="navigation">{LONG}</div><section>{ARTICLE}</section>',
        f'<div class="top"><a href="/">Home</a> <a href="/b">Blog</a></div><div>{ARTICLE}</div>',
        f"{ARTICLE}",
    ],
)
def test_article_only(body):
    assert extraction.main_text(page(body)) == WANT


def test_markup_entities_and_space():
    body = (
        "<article><h1>A</h1><p><b>Bold start, here.<br><p>Next  \n one&nbsp;two &lt;x&gt; &#233;&#x4e2d; &amp"
        "<!-- no > way --><p>a<i>b</i>c, <a href='x>y'>link</a>.<ul><li>one, two<li>three</ul></article>"
    )
    assert extraction.main_text(page(body)).split("\n") == [
        "A", "Bold start, here.", "Next one two <x> é中 &", "abc, link.", "one, two", "three",
    ]


def test_broken_pages():
    whole = page(f"{MENU}<article>{ARTICLE}</article>")
    for cut in range(len(whole)):
        got = extraction.main_text(whole[:cut])
        assert "Item" not in got or cut < len(whole) and "Head" not in whole[:cut]
    assert extraction.main_text(whole[: whole.index("Short.") + 3]).endswith("Sho")
    for odd in (None, "", "  ", "<", "<p", "< p>x", "</p></div>", "<script>x", "&", "<!--", "<<p>>a, b."):
        assert isinstance(extraction.main_text(odd), str)


def expected(source):
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)
    if not body:
        return None
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<[^>]*\Z", "", body[1].replace("<br>", " ")))
    lines = (" ".join(html.unescape(p).split()) for p in parts)
    return "\n".join(x for x in lines if x)


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = extraction.extract(rows).join(rows, "page_id").collect()
    assert len(got) == rows.count()
    for r in got:
        assert r.text == expected(r.html) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", page(ARTICLE)), (2, "u", page(ARTICLE))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extraction.extract(df).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", ""), ("2", WANT), ("2", WANT), ("None", "")]
    assert extraction.extract(df.limit(0)).count() == 0


def scored(rows):
    """Scores by the text of a path, of (path, characters, punctuation)."""
    paths, number = extraction.Paths(), {}
    for text, _, _ in rows:
        at = 0
        for name in text.split("/")[1:]:
            at = paths.step(at, name)
        number[text] = at
    found = extraction.path_scores(paths, [(number[p], c, s) for p, c, s in rows])
    return {p: found[k] for p, k in number.items()}


def test_scores_follow_length_and_punctuation():
    scores = scored([("/a/p", 100, 8), ("/a/p", 60, 4), ("/b/li", 8, 0), ("/b/li", 6, 0)])
    assert scores["/a/p"] > 10 * scores["/b/li"]


def plain_scores(rows):
    """All pairs of paths: ratios smoothed by the share of the steps in common."""
    paths = sorted({p for p, _, _ in rows})
    ratio = {}
    for p in paths:
        own = [(c, s) for q, c, s in rows if q == p]
        ratio[p] = [sum(x[k] for x in own) / len(own) for k in (0, 1)]
    out = {}
    for a in paths:
        total, weight = [0.0, 0.0], 0.0
        steps = [*a.split("/")[1:], "end"]
        for b in paths:
            others, shared = [*b.split("/")[1:], "end"], 0
            while shared < min(len(steps), len(others)) and steps[shared] == others[shared]:
                shared += 1
            w = (shared / len(steps)) ** 4
            weight += w
            total = [t + w * r for t, r in zip(total, ratio[b], strict=True)]
        out[a] = total[0] / weight * (1 + total[1] / weight)
    return out


def test_scores_equal_all_pairs_of_paths():
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        depth = rng.randint(1, 6)
        path = "".join(f"/{rng.choice('abc')}" for _ in range(depth))
        rows.append((path, rng.randint(0, 300), rng.randint(0, 9)))
    got, want = scored(rows), plain_scores(rows)
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], rel=1e-9) for p in want)


@pytest.mark.parametrize(
    "body",
    [
        f'{MENU}<article class="share-box">{ARTICLE}</article>',
        f'{MENU}<div class="promo">{ARTICLE}</div>',
        f'<div class="top"><a href="/">Home</a></div><div id="widget"><div class="x">{ARTICLE}</div></div>',
        # No article element and no listed word: the paths decide.
        "<div class=k1>" + "".join(f"<span class=z><a href=/{i}>Go {i}</a></span><br>" for i in range(30)) + "</div>"
        f"<div class=k2>{ARTICLE}</div><div class=k3>" + "<div>tag</div>" * 20 + "</div>",
    ],
)
def test_hints_and_paths(body):
    assert extraction.main_text(page(body)) == WANT


@pytest.mark.parametrize(
    "source",
    [
        "x <y and " * 111_000, "<a" + " " * 1_000_000, "<script " * 125_000, "<a '" * 250_000, '<a b="' * 160_000,
        "".join(f"<p class=c{i}>Some words, here.</p>" for i in range(30_000)),
        "<div>words, here " * 100_000, "<ul><li>" * 50_000 + "a, b" + "</ul>" * 50_000,
        "<b>x<img>" * 100_000, "<p><i>" * 100_000 + "</p>" * 100_000, "</x>" * 250_000,
    ],
)
def test_long_and_odd_pages_in_proportion(source):
    begin = time.process_time()
    extraction.main_text(source)
    assert time.process_time() - begin < 5


def test_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "u", page(ARTICLE), 7, 8)], "page_id long, url string, html string, text int, n_chars int")
    assert [tuple(r) for r in extraction.extract(df).collect()] == [(1, "u", WANT, len(WANT))]
