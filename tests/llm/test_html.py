import os

import pyarrow.parquet as pq
import pytest

from lodestone.llm import html

PAGES = "/root/testdata/sf0.01"

LONG = "A paragraph of the article that is long enough to count as text, with some more words in it."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<nav>menu</nav>", ""),
        ("<article><h1>T</h1><p>a&amp;b&nbsp;c\n d<br>e</article><footer>f", "T\na&b c d e"),
        ("<div class='ad'>buy</div><main><p>x</p></main><aside>side</aside>", "x"),
        ("<article><p>x<script>var p='</p>'</script><style>p{}</style></p><!-- c > --><p>y</article>", "x\ny"),
        ("<body><header><p>head</p></header><article><header><h1>T</h1></header><p>x</p></article></body>", "T\nx"),
        ("<article><p>x</p><div class='comments'><p>" + LONG + "</p></div></article>", "x"),
        ("<article><p>x</p></article><section id='comments'><article><p>" + LONG * 5 + "</p></article></section>", "x"),
        ("<article><form><label>mail</label><input name=q></form><p>x</p><div role=dialog>d</div><p hidden>h</p></article>", "x"),
        ("<article><p title='a>b'>x</p><p data-x=\"it's > y\">z</p></article>", "x\nz"),
        ("<article><p>1 < 2 and <3</p></article>", "1 < 2 and <3"),
        ("<article><p>cut &am", "cut &am"), ("<article><p>cut <a href='x", "cut"), ("<article><p>x<!-- never closed", "x"),
        ("<div class='wrap has-sidebar'><article><p>x</p></article></div>", "x"),
        ("<article><h2>A</h2><ul><li>one</li><li>two <b>bold</b></li></ul><table><tr><td>c</td></tr></table></article>", "A\none\ntwo bold\nc"),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


def test_distribution_without_an_article():
    page = "<body><div><a href=1>home</a></div><div><a href=2>news</a></div><h1>Title</h1>" + f"<p>{LONG}</p>" * 4 + "<div>x</div>" + "".join(f"<div><a href={i}>link {i}</a></div>" for i in range(9)) + "</body>"
    got = html.main_text(page).split("\n")
    assert got[0] == "Title" and got[1:5] == [LONG] * 4 and not any("link" in x for x in got)


def paragraphs(n, text=LONG):
    return "".join(f"<p>{text} {i}</p>" for i in range(n))


def lines(a, b):
    return [f"{LONG} {i}" for i in range(a, b)]


def test_runs_surge_and_dive_as_defined():
    """Against sums of every window, taken one by one."""
    import random

    rng = random.Random(3)
    for _ in range(300):
        size = [rng.choice([0, 0, 0, 5, 30, 90]) for _ in range(rng.randrange(1, 25))]
        page = html.Page("")
        page.lines = [("x" * n, n, 0, False) for n in size]
        assert page.runs() == naive_runs(size)


def naive_runs(size):
    """Surge and dive, every window summed anew."""
    want, i = [], 0
    window = lambda a: sum(size[max(a, 0) : a + html.WINDOW])
    surge = max(1, min(html.SURGE, max([window(k) for k in range(len(size))], default=0)))
    while i < len(size):
        if size[i] and window(i) >= surge:
            j = i + 1
            while j < len(size) and window(j) and size[j] + sum(size[max(0, j - html.WINDOW + 1) : j + 1]):
                j += 1
            want.append((i, j))
            i = j
        else:
            i += 1
    return want


def naive_text(lines, top):
    """The text by its definition, line by line: a line is in if it lies between the ends, and each end is moved one line at a time."""
    size = [x[1] for x in lines]
    runs = naive_runs(size)
    if not runs:
        return ""
    core = sorted(runs, key=lambda r: (-sum(size[r[0] : r[1]]), r))[0]
    group = [core]
    for step in (-1, 1):
        k = runs.index(core)
        while 0 <= k + step < len(runs):
            a, b = sorted((runs[k], runs[k + step]))
            gap = lines[a[1] : b[0]]
            if len(gap) > html.GAP or any(not x[3] and x[1] >= html.SURGE // html.WINDOW for x in gap):
                break
            k += step
            group.append(runs[k])
    ends = [min(r[0] for r in group), max(r[1] for r in group) - 1]
    weights = {}
    for x in lines[core[0] : core[1]]:
        weights[top[x[2]]] = weights.get(top[x[2]], 0) + x[1]
    home = sorted(weights, key=lambda c: (weights[c], c))[-1]
    if not home:
        span = [i for i in range(ends[0], ends[1] + 1)]
        while lines[span[0]][2]:
            span.pop(0)
        while lines[span[-1]][2]:
            span.pop()
        while span[0] and lines[span[0] - 1][3] and not lines[span[0] - 1][2]:
            span.insert(0, span[0] - 1)
        return "\n".join(lines[i][0] for i in span)
    mine = [top[x[2]] == home for x in lines]
    span = [i for i in range(ends[0], ends[1] + 1) if mine[i]]
    span = list(range(span[0], span[-1] + 1))
    for step, at in ((-1, 0), (1, -1)):
        more = []
        i = span[at] + step
        while 0 <= i < len(lines) and mine[i] and not (len(more) >= html.GAP and not any(size[k] for k in more[-html.GAP :]) and not size[i]):
            more.append(i)
            i += step
        span = span + more if step > 0 else more[::-1] + span
    inner = {}
    for r in runs:
        for x in lines[r[0] : r[1]]:
            inner[x[2]] = inner.get(x[2], 0) + x[1]
    surge = max(1, min(html.SURGE, max(sum(size[k : k + html.WINDOW]) for k in range(len(size)))))
    return "\n".join(lines[i][0] for i in span if mine[i] and (lines[i][2] == home or inner.get(lines[i][2], 0) >= surge))


def test_text_is_what_lies_between_surge_and_dive():
    """Random lines in random elements, against the definition."""
    import random

    rng = random.Random(8)
    for _ in range(3000):
        page = html.Page("")
        page.kinds, page.top = ["", "article", "main", "article"], [0, 1, 2, 2]
        at, page.lines = 0, []
        for k in range(rng.randrange(1, 60)):
            at = rng.choice([at] * 6 + [0, 1, 2, 3])
            n = rng.choice([0, 0, 0, 5, 20, 60, 90])
            page.lines.append((f"{k}", n, at, n < 90 and rng.random() < 0.2))
        assert page.main_text() == naive_text(page.lines, page.top), page.lines


@pytest.mark.skipif(not os.path.isdir(PAGES), reason="no sample tables")
def test_given_pages_against_the_definition_and_without_windows(monkeypatch):
    sources = [h for h in pq.read_table(f"{PAGES}/pages.parquet")["html"].to_pylist() if h]
    pages = [html.Page(h) for h in sources]
    texts = [p.main_text() for p in pages]
    assert texts == [naive_text(p.lines, p.top) for p in pages] and all(texts)
    monkeypatch.setattr(html.Page, "runs", lambda self: [])
    assert all(html.main_text(h) != t for h, t in zip(sources, texts))


def test_windows_decide(monkeypatch):
    """An article of short lines against a body of long ones: the surge is in the body, whatever the article's total."""
    page = f"<body><article>{paragraphs(3, 'tiny ')}</article><div id='content'>{paragraphs(5)}</div></body>"
    assert html.main_text(page).split("\n") == lines(0, 5)
    monkeypatch.setattr(html.Page, "runs", lambda self: [(0, 3)])  # as if the text surged there
    assert html.main_text(page).split("\n") == ["tiny 0", "tiny 1", "tiny 2"]
    monkeypatch.setattr(html.Page, "runs", lambda self: [])
    assert html.main_text(page) == ""


def test_a_long_stretch_of_links_ends_the_text_in_its_element_too():
    def page(n):
        return f"<article>{paragraphs(2)}" + "".join(f"<p><a href={i}>l{i}</a></p>" for i in range(n)) + "<p>end</p></article>"

    assert html.main_text(page(html.GAP)).split("\n")[-1] == "end"
    assert html.main_text(page(html.GAP + 1)).split("\n") == [*lines(0, 2), *[f"l{i}" for i in range(html.GAP)]]


def test_a_very_long_page_is_whole():
    page = "<nav>" + "<a href=x>m</a>" * 9 + f"</nav><article>{paragraphs(20_000)}<h2>Head</h2><ul>{'<li>item of a list</li>' * 9}</ul>{paragraphs(3)}</article><footer>{paragraphs(9)}</footer>"
    got = html.main_text(page).split("\n")
    assert got == [*lines(0, 20_000), "Head", *["item of a list"] * 9, *lines(0, 3)]


def test_link_lists_inside_the_text_do_not_end_it():
    links = "<ul>" + "".join(f"<li><a href={i}>chapter {i}</a></li>" for i in range(6)) + "</ul>"
    page = f"<body><div class='entry-content has-sidebar'><h1 id='search-algorithms'>Title</h1>{paragraphs(2)}{links}{paragraphs(6)}</div></body>"
    assert html.main_text(page).split("\n") == ["Title", *lines(0, 2), *[f"chapter {i}" for i in range(6)], *lines(0, 6)]


def test_main_with_an_introduction_and_several_articles():
    page = f"<main><h1>T</h1><p>intro</p><article>{paragraphs(2)}</article><article>{paragraphs(3)}</article><article><p>see also</p></article></main>"
    assert html.main_text(page).split("\n") == ["T", "intro", *lines(0, 2), *lines(0, 3)]


def test_a_teaser_in_an_article_does_not_replace_the_text():
    page = f"<body><div>{paragraphs(9)}</div><article>{paragraphs(1)}</article></body>"
    assert set(lines(0, 9)) <= set(html.main_text(page).split("\n"))


def test_names_that_only_sound_like_boilerplate_stay():
    page = f"<article><h2 id='ad-hoc-networks'>A</h2><section id='discussion'>{paragraphs(2)}</section><section id='related-work'><p>r</p></section><div class='social-share'><p>share</p></div><div class='newsletter box'><p>join</p></div></article>"
    assert html.main_text(page).split("\n") == ["A", *lines(0, 2), "r"]


def test_article_is_whole_whatever_its_lines():
    parts = [LONG, "s", "t", "u", "v", "w", LONG, "end"]
    assert html.main_text("<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>").split("\n") == parts


def test_time_is_linear():
    import time

    for bad in ("<", "<a \"", "<a '", "<!--", "<p class=\"", "<div>", "&", "<script>", "<article>", "<p class=ad>"):
        began = time.time()
        html.main_text(bad * 50_000 + "</span>" * 50_000)
        assert time.time() - began < 5, bad


def test_table(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "u", "<article>é</article>"), (1, "u", "<article>é</article>"), (None, None, None)], "page_id long, url string, html string")
    got = html.extract(rows.select("*", F.lit(1).alias("text"), F.lit(2).alias("n_chars")))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(["(1, 'u', 'é', 1)", "(1, 'u', 'é', 1)", "(None, None, '', 0)"])
    assert html.extract(rows.limit(0)).count() == 0
