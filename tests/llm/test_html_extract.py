import html
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import html_extract as x


def main(page):
    return "\n".join(x.main_blocks(page)[1])


def test_furniture_is_left_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a>Home</a></header>
    <div id="cookie-notice">We use cookies</div><div class=sidebar><ul><li>Links</ul></div><div class="ad">Buy</div>
    <article><header><h1>Title &amp; more</h1></header><p>One  two <b>bold</b>&nbsp;three<p>Next
    para<aside>Pull</aside><ul><li>a<li>b <ul><li>c</ul></ul><table><tr><td>x<td>y</table>line<br>break
    <section class="comments"><article class="comment">Bad</article></section><form>Mail <input></form><p hidden>no</p><p style="display: none">no</p>
    <div class="shareButtons">Share</div><nav>1 2 3</nav></article><footer>(c)</footer><script>if(a<b)"</p>"</script><!-- <p>x</p> -->tail</body>"""
    assert main(page).split("\n") == ["Title & more", "One two bold three", "Next para", "a", "b", "c", "x", "y", "line", "break"]


def test_pages_without_an_article():
    assert main("<body><nav>N</nav><main><p>A</p><div>B</div></main><p>C</p></body>") == "A\nB"
    assert main("<div role=main>A</div><div>C</div>") == "A"
    assert main("<p>A</p><div class='menu'>N</div>plain &lt;text&gt; <i>here</i>") == "A\nplain <text> here"
    assert main("<article>A</article><p>x</p><article>B</article>") == "A\nB"
    assert main("") == main("<p>") == main("<script>") == main("<!-- x") == ""
    assert main("<") == "<"
    assert main("<div class=page-header>x</div><article><div class='article-header'><h1>T</h1></div><p>A</article>") == "T\nA"
    assert main("a < b & c &amp d &copy; &#233; &bogus;") == "a < b & c & d © é &bogus;"
    assert main("<p title='a>b' data-x=\"<p>\">T<p") == "T"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<article>", "</article>", "<nav>", "</nav>", "<br>", "<!--", "-->", "<script>", "</script>", "<", ">", '"', "'", "&amp;", "&", "text", " ", "<p class='x", "\n"]), max_size=25).map("".join))
def test_any_markup_is_read(page):
    text = main(page)
    assert all(b == " ".join(b.split()) and b for b in text.split("\n") if text)


def brute_repeats(pages):
    streams = []
    for k, p in enumerate(pages):
        s, spans = [], []
        for b in p:
            spans.append((len(s), len(s) + len(b.split(" "))))
            s += [*b.split(" "), "\n"]
        s[-1] = ("end", k)
        streams.append((s, spans))
    depth = x.MIN_TOKENS
    where = {}
    for k, (s, _) in enumerate(streams):
        for i in range(len(s)):
            where.setdefault(tuple(s[i : i + depth]), set()).add(k)
    out = {}
    for k, (s, spans) in enumerate(streams):
        covered = set()
        for i in range(len(s)):
            if len(where[tuple(s[i : i + depth])]) > 1:
                covered |= set(range(i, i + depth))
        for h in {x.block_hash(b) for b, (i, j) in zip(pages[k], spans) if set(range(i, j)) <= covered}:
            out[h] = out.get(h, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays_match_brute_force(seed):
    rng = random.Random(seed)
    common = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 14))) for _ in range(5)]
    pages = []
    for _ in range(rng.randrange(2, 9)):
        pages.append([rng.choice(common) if rng.random() < 0.5 else " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))])
    assert x.repeated_blocks(pages) == brute_repeats(pages)
    assert x.repeated_blocks([]) == x.repeated_blocks([["a b c"]]) == {}


BANNER = "Read all of the news that matters to you here every day"
STORY = "The river rose again on day {0} and the people of the town {0} moved to higher ground {0}."


@pytest.mark.parametrize("shard_pages", [128, 10])
def test_repeated_boilerplate_goes_and_copies_stay(spark, monkeypatch, shard_pages):
    monkeypatch.setattr(x, "SHARD_PAGES", shard_pages)
    rows = []
    for i in range(60):
        rows.append((i, f"http://open.com/{i}", f"<div>{BANNER}</div><div>{STORY.format(i)}</div>"))
        rows.append((100 + i, f"http://marked.com/{i}", f"<article><p>{STORY.format(i)}<p>{BANNER}</article>"))
        rows.append((200 + i, f"http://copies.com/{i}", f"<article><p>{STORY.format(i % 3)}<p>{STORY.format(i)}</article>"))
        rows.append((300 + i, f"http://small{i // 5}.com/{i}", "<article><p>" + STORY.format(7) + "</article>"))
    rows += [(500, None, None), (501, "", ""), (502, "http://open.com/x", f"<div>{BANNER}</div>"), (503, "http://a.com/", "<p>" + "long words " * 50000), (503, "http://a.com/", "<p>" + "long words " * 50000), (None, "http://b.com/", "<p>no id</p>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int").repartition(5)
    got = x.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    for i in range(60):
        assert text[i] == STORY.format(i) and text[100 + i] == STORY.format(i)
        assert text[200 + i] == STORY.format(i % 3) + "\n" + STORY.format(i) and text[300 + i] == STORY.format(7)
    assert text[500] == text[501] == "" and text[502] == BANNER and text[None] == "no id" and text[503] == ("long words " * 50000).strip()
    assert x.extract(df.limit(0)).collect() == []


def test_near_copies_count_as_one_page(spark):
    words = lambda seed, n: " ".join(random.Random(seed).choices("river stone bread cloud paper light train house water music green apple".split(), k=n))
    shared = [words(k, 40) for k in range(5)]
    rows = [(i, f"http://{kind}{size}.com/{i}", open_ + "".join(f"<p>{b}</p>" for b in ([*shared, f"{words((kind, i, size).__repr__(), 9)}"] if i < 0.7 * size else [words((i, size).__repr__(), 120)])) + close)
            for kind, open_, close in (("marked", "<article>", "</article>"), ("open", "", "")) for size in (10, 30) for i in range(size)]
    # An unclassed notice in the articles of a small host.
    rows += [(900 + i, f"http://notice.com/{i}", f"<article><p>{words(2000 + i, 60)}</p><p>{BANNER}</p></article>") for i in range(6)]
    got = x.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert all(r.n_removed == (1 if "notice" in r.url else 0) and (BANNER in r.text) == False for r in got)  # noqa: E712


def test_tables_pages_give_their_articles(spark, sf_dir):
    pages = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inside))
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in x.extract(pages).collect()} == want


def test_an_article_keeps_what_its_names_say_of_itself():
    assert main('<article><p class="legal">One<p class="share notice">Two<div class="related">Three</div><div class="ad">x</div><ul class="menu"><li>Four</ul></article>') == "One\nTwo\nThree\nFour"
    assert main('<div class="Header-content"><p>All there is</p></div><nav>n</nav>') == "All there is"
    assert main('<div class="page-header">x</div><p>y') == "y" and main('<div class="page-header">x</div><article></article>') == ""


def test_parsing_is_linear_in_tags():
    import time

    took = []
    for n in (4000, 16000):
        page = "<i>" * n + "</b>" * n + "<div><b>" * n + "</u></p>" * n + "text"
        began = time.process_time()
        assert main(page) == "text"
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.2


@pytest.mark.parametrize("host_pages", [40, 300])
def test_parts_of_any_size_remove_the_same(spark, monkeypatch, host_pages):
    """Brute force over text without any markup of an article: a block goes where a fifth of the pages, three at least, have it."""
    rng = random.Random(host_pages)
    words = "river stone bread cloud paper light train house water music green apple".split()
    line = lambda n: " ".join(rng.choices(words, k=n)) + f" {rng.random()}"
    often, seldom = [line(9) for _ in range(3)], [line(9) for _ in range(40)]
    pages = {}
    for i in range(host_pages):
        pages[i] = [*(b for k, b in enumerate(often) if rng.random() < 0.3 + 0.2 * k), *rng.sample(seldom, 2), *(line(rng.randrange(12, 40)) for _ in range(3))]
        rng.shuffle(pages[i])
    n = {b: sum(b in p for p in pages.values()) for b in often + seldom}
    want = {i: "\n".join(b for b in p if n.get(b, 0) < max(3, 0.2 * host_pages)) for i, p in pages.items()}
    df = spark.createDataFrame([(i, f"http://one.com/{i}", "".join(f"<p>{b}</p>" for b in p)) for i, p in pages.items()], "page_id long, url string, html string")
    for part in (10**6, 128, 50):
        monkeypatch.setattr(x, "SHARD_PAGES", part)
        got = x.extract(df).collect()
        assert {r.page_id: r.text for r in got} == want and sum(r.n_removed for r in got) > host_pages
