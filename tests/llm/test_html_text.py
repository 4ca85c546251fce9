"""Operator 12: the markup's rules, and the repeated runs against a count of every run."""

import html
import random
import re

import pytest

from lodestrata.llm import html_text, queries

SCHEMA = "page_id long, url string, html string, text string, host string, n_chars string"
MENU = "Home News Sport Weather Business Culture Travel About Contact Help"
LEGAL = "All rights reserved by the keepers of this site and its friends"


def frame(spark, pages):
    return spark.createDataFrame([(i, u, h, "clash", "clash", "clash") for i, (u, h) in enumerate(pages)], SCHEMA)


def text(page):
    return html_text.read_page(page)[0]


def test_query_keeps_whole_articles(spark, sf_dir):
    """The test pages' articles hold headings and paragraphs only."""
    def article(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner))
        return " ".join(filter(None, parts))

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r.page_id: r for r in queries.op12_html_text(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.page_id].text == article(r.html) and found[r.page_id].url == r.url
        assert found[r.page_id].n_chars == len(found[r.page_id].text)


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<article>a<b>b</b>c<br>d<p>e&nbsp;f &amp; g</p></article><footer>x</footer>", "abc d e f & g"),
        ("<article><header><h1>T</h1></header><p>it's 1 < 2 && 3 > 2 <a title=it's>q</a></article>", "T it's 1 < 2 && 3 > 2 q"),
        ("<header>site</header><main><nav>n</nav><h1>M</h1><div class=sidebar>s</div>t</main>", "M t"),
        ("<article>x<section id='comments'><article class=comment>no</article></section>y</article>", "x y"),
        ("<article>x<script>var t='</p><p>no'</script><style>p{}</style><!-- no -->y</article>", "xy"),
        ("<article>x<form><label>no</label><input value=no><button>no</button></form><aside>no</aside></article>", "x"),
        ("<aside><article>card</article></aside><article>real</article>", "real"),
        ("<div id=content>a<ul><li>b<li>c</ul><div role='complementary'>no</div></div><p>other", "a b c"),
        ("<article><p class='cookie-notice'>no<p>yes</article>", "yes"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
        ("<article><p>a<p>b<div>c<p>d</div>e", "a b c d e"),
        ("<article>a<script>never closed", "a"),
        ("<article>a<!-- never closed", "a"),
        ("<article>a<p title='>", "a"),
        ("<article>&am &amp &copy;&#x41;&#66;&unknown;</article>", "&am & ©AB&unknown;"),
        ("<nav>only a menu</nav>", ""),
        ("<article>" + "w " * 50000 + "</article>", " ".join(["w"] * 50000)),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(page, wanted):
    assert text(page) == wanted


def test_long_broken_markup_is_linear():
    for page in ("<a " * 200_000, "<" * 400_000, "<div>" * 100_000 + "x", '<a ="' * 100_000, "</p>" * 200_000):
        html_text.read_page(page)


def covered_words(streams):
    """Words covered by a run of 8 that stands in 3 different streams or more."""
    where = {}
    for i, s in enumerate(sorted(set(streams))):
        words = s.split(" ")
        for k in range(len(words) - 7):
            where.setdefault(tuple(words[k : k + 8]), set()).add(i)
    out = {}
    for s in set(streams):
        words = s.split(" ")
        marks = [False] * len(words)
        for k in range(len(words) - 7):
            if len(where[tuple(words[k : k + 8])]) >= 3:
                marks[k : k + 8] = [True] * 8
        out[s] = marks
    return out


@pytest.mark.parametrize("block_words", [1 << 20, 60])
def test_repeated_runs_equal_a_count_of_every_run(spark, monkeypatch, block_words):
    """Undecided pages on three hosts, one of them with most pages, whether a host is one block or many."""
    monkeypatch.setattr(html_text, "RUN", 8)
    rng = random.Random(4)
    runs = [" ".join(rng.choices("abcdefgh", k=rng.randint(6, 14))) for _ in range(6)]
    pages = []
    for i in range(90):
        own = [" ".join(rng.choices([f"w{j}" for j in range(400)], k=rng.randint(3, 20))) for _ in range(2)]
        parts = own + rng.sample(runs, rng.randint(0, 3))
        rng.shuffle(parts)
        pages.append((f"http://{rng.choice(['hot.org'] * 8 + ['b.org', 'c.org'])}/{i}", "".join(f"<div>{p}</div>" for p in parts)))
    pages += pages[:4]
    if block_words < 100:
        found = blocks_of(spark, frame(spark, pages), block_words)
    else:
        found = {r.page_id: r.text for r in html_text.extract(frame(spark, pages)).collect()}
    for i, (url, page) in enumerate(pages):
        streams = [" ".join(html_text.read_page(p)[1]) for u, p in pages if html_text.host_of(u) == html_text.host_of(url)]
        _, words, _ = html_text.read_page(page)
        marks = covered_words(streams)[" ".join(words)]
        wanted, at = [], 0
        for _, block in html_text.blocks(page):
            own = block.split(" ")
            mask = "".join("x" if c else "." for c in marks[at : at + len(own)])
            at += len(own)
            if "." in mask:
                mask = re.sub("x{8,}", lambda m: "-" * len(m[0]), mask)
                wanted += [w for w, c in zip(own, mask, strict=True) if c != "-"]
        assert found[i] == " ".join(wanted)


def blocks_of(spark, df, words):
    """The same extraction with tiny blocks: workers read the size from the shipped module, so it goes in by a closure."""
    run = html_text.host_blocks

    def small(batches):
        from lodestrata.llm import html_text as own

        own.BLOCK_WORDS, kept = words, own.BLOCK_WORDS
        try:
            yield from run(batches)
        finally:
            own.BLOCK_WORDS = kept

    before, html_text.host_blocks = html_text.host_blocks, small
    ranges, html_text.RANGE_BYTES = html_text.RANGE_BYTES, 2000
    try:
        return {r.page_id: r.text for r in html_text.extract(df).collect()}
    finally:
        html_text.host_blocks, html_text.RANGE_BYTES = before, ranges


def test_hosts_decide_where_markup_is_silent(spark):
    pages = [(f"http://h{i % 2}.org/{i}", f"<div>{MENU}</div><div>page {i} says {i * 7} and {i * 11}</div><div>{LEGAL} {i % 2}</div>") for i in range(12)]
    pages += [("http://h0.org/x", f"<article>{MENU} is quoted here</article><div>{MENU}</div>"), (None, f"<p>{MENU}"), ("http://few.org", f"<p>{MENU}")]
    found = {r.page_id: r.text for r in html_text.extract(frame(spark, pages)).collect()}
    assert [found[i] for i in range(12)] == [f"page {i} says {i * 7} and {i * 11}" for i in range(12)]
    assert found[12] == f"{MENU} is quoted here" and found[13] == MENU and found[14] == MENU


def test_awkward_tables(spark):
    assert html_text.extract(frame(spark, [])).count() == 0
    pages = [("u", None), ("u", ""), ("u", "<nav>n</nav>"), (None, "<article>x</article>"), ("u", "<article>x</article>")]
    df = frame(spark, pages)
    found = html_text.extract(df.union(df)).collect()
    assert sorted(r.text for r in found) == [""] * 6 + ["x"] * 4
    assert found[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_every_page_goes_through_the_array(spark, sf_dir):
    """Words of articles count too: n_repeated against a count of every run in the whole streams of the given pages, of which every fifth is there three times, with a line of its own."""
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    more = [given.where("page_id % 5 = 0").selectExpr(f"-page_id - {k}000000 AS page_id", "url", f"concat(html, '<p>copy {k}') AS html") for k in (1, 2)]
    df = given.union(more[0]).union(more[1])
    rows = df.collect()
    by_host = {}
    for r in rows:
        by_host.setdefault(html_text.host_of(r.url), []).append(" ".join(html_text.read_page(r.html)[1]))
    marks = {host: covered_words(streams) for host, streams in by_host.items()}
    found = {r.page_id: r.n_repeated for r in html_text.extract(df, repeats=True).collect()}
    assert "n_repeated" in queries.op12_html_text(spark, sf_dir).columns
    total = 0
    for r in rows:
        mask, at, wanted = marks[html_text.host_of(r.url)][" ".join(html_text.read_page(r.html)[1])], 0, 0
        for rank, block in html_text.blocks(r.html):
            n = len(block.split(" "))
            wanted += sum(mask[at : at + n]) if rank == html_text.ARTICLE else 0
            at += n
        assert found[r.page_id] == wanted
        total += wanted
    assert total > 0


@pytest.mark.parametrize("tag", ["article", "main", "div class=content"])
def test_repeated_runs_in_marked_content_are_counted_and_stay(spark, tag):
    """A passage that many pages share is text of each, and no run is lost for standing in an article."""
    close = tag.split()[0]
    pages = [("http://h.org", f"<{tag}><p>page {i} says {i * 7}</p><p>{MENU} {i}</p></{close}><nav>{LEGAL}</nav>") for i in range(5)]
    pages += [("http://h.org", f"<p>{MENU}</p><p>own words</p>"), ("http://other.org", f"<{tag}>{MENU}</{close}>")]
    found = {r.page_id: (r.text, r.n_repeated) for r in html_text.extract(frame(spark, pages), repeats=True).collect()}
    assert [found[i] for i in range(5)] == [(f"page {i} says {i * 7} {MENU} {i}", 10) for i in range(5)]
    assert found[5] == ("own words", 0) and found[6] == (MENU, 0)


def test_copies_in_many_blocks_count_once(spark, monkeypatch):
    """The same stream in many blocks is one stream; a third different one makes its runs repeated in all blocks."""
    def pages(kinds):
        return [("http://h.org", f"<nav>{'x' * (1 + i % kinds)}</nav><div>{MENU}</div>") for i in range(40)]

    for kinds in (2, 3):
        found = blocks_of(spark, frame(spark, pages(kinds)), 20)
        assert len(found) == 40 and set(found.values()) == {MENU if kinds == 2 else ""}


def test_packed_numbers_come_back():
    import numpy as np

    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 2**64, 1000, np.uint64)), np.array([0, 0, 2**64 - 1], np.uint64)):
        assert html_text.unpack(html_text.pack(values), len(values)).tolist() == values.tolist()
