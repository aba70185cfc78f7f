import itertools
import random

from tidewatch.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better for you and for others, please agree to this notice.</p></div>
<!-- ad --><div class="ad">Buy this now, it is the best thing that you can buy at this price.</div>
<article><h1>Title &amp; more</h1><p><b>First   part<br>goes&nbsp;on.<p>Second &lt;tag&gt; part</p><div class="adBanner"><p>Another offer that nobody needs.</p></div>
<ul><li>Item one</li><li>Item two</li></ul><p>End.</p>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I think this is a very good article, thank you for the writing.</p></div></section></article>
<aside><p>Read also this long and interesting story about something else entirely.</p></aside>
<form><p>Sign up for our letters with your address here.</p><input><button>Go</button></form>
<footer>&copy; site &middot; all rights</footer></body></html>"""


def cost(scores, edges, labels):
    return sum(abs(s) for s, l in zip(scores, labels) if (s > 0) != l and s) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_article_only():
    assert H.main_text(PAGE) == "Title & more\nFirst part goes on.\nSecond <tag> part\nItem one\nItem two\nEnd."


def test_page_without_article():
    html = ('<body><div class="top-menu"><a href=x>A</a> <a href=y>B</a></div><div id="content"><h2>Head</h2><p>Some plain text in a paragraph.'
            '</p><p>More.</p></div><div class="sidebar"><p>Something on the side that is long enough to look like text.</p></div>')  # fmt: skip
    assert H.main_text(html) == "Head\nSome plain text in a paragraph.\nMore."


def test_odd_pages():
    assert [H.main_text(x) for x in (None, "", "<", "<p", "   ", "<script>x", "</p></div>")].count("") >= 5
    assert H.main_text(None) == H.main_text("") == H.main_text("<script>alert(1)") == ""
    assert H.main_text("<article><p>cut in the mid") == "cut in the mid"
    assert H.main_text("<article>" + "<div>" * 3000 + "deep text") == "deep text"
    long = "<article>" + "<p>one more paragraph</p>" * 5000
    assert H.main_text(long).count("\n") == 4999


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 9)
        scores = [rng.choice([rng.uniform(-3, 3), 0.0, 1.0, -1.0]) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        best = min(cost(scores, edges, x) for x in itertools.product((False, True), repeat=n))
        assert abs(cost(scores, edges, H.minimum_cut(scores, edges)) - best) < 1e-9


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "", "<article>é😀</article>")]
    pages = spark.createDataFrame([(*r, 5, "z") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in H.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", 73), (1, "u", 73), (None, None, 0), (2, "", 2)], key=str)
    assert H.extract_text(pages.limit(0)).count() == 0


def test_articles_in_named_wrappers():
    words = " ".join(f"word{k}" for k in range(100))
    side = "<div class='sidebar'><p>Something on the side that nobody needs.</p></div>"
    page = lambda start, end: f"<body>{start}<article><p>{words}</p></article>{side}{end}</body>"
    for start, end in (("<div class='layout has-sidebar'>", "</div>"), ("<div id='page-with-search'>", "</div>"), ("<form>", "</form>"),
                       ("<div class='overlay'>", "</div>"), ("<div class='noticeNav'><div class='widget'>", "</div></div>")):
        assert H.main_text(page(start, end)) == words, start
    assert H.main_text(f"<html class='cookie-notice'>{page('', '')}</html>") == words
    after = f"<div class='comments'><div class='body'><p>{words} {words}</p></div></div>"
    assert H.main_text(f"<article><p>{words}</p></article>{after}") == words


def test_unclosed_dropped_elements_end_with_their_parents():
    for left_open in ("<label>Name", "<button>Go", "<div hidden>secret", "<p hidden>secret", "<p><span hidden>secret"):
        assert H.main_text(f"<article><div>{left_open}</div><p>All of the text.</p></article>") == "All of the text.", left_open
    assert H.main_text("<article><p hidden>secret<p>All of the text.</article>") == "All of the text."


WORDS = " ".join(f"word{k}" for k in range(80))


def test_names_of_headings_and_topics_inside_articles():
    for mark in ("id=search", "id=discussion", "class=comments-policy", "id=social", "class='widget'"):
        assert H.main_text(f"<article><h2>First</h2><p>{WORDS}</p><h2 {mark}>Second</h2><p>{WORDS}</p></article>") == f"First\n{WORDS}\nSecond\n{WORDS}", mark
    page = f"<article><p>{WORDS}</p><section class=discussion><h2>What it means</h2><p>{WORDS}</p><ul><li>one</li><li>two</li></ul><p>{WORDS}</p></section></article>"
    assert H.main_text(page) == f"{WORDS}\nWhat it means\n{WORDS}\none\ntwo\n{WORDS}"
    # Outside an article, and for names that are never topics, the mark holds.
    assert H.main_text(f"<article><p>{WORDS}</p></article><div class=discussion><p>{WORDS} again</p></div>") == WORDS
    for name in ("comments", "sponsored", "sidebar", "cookie-notice", "newsletter"):
        assert H.main_text(f"<article><p>{WORDS}</p><div class={name}><h3>Title</h3><p>{WORDS} more</p></div></article>") == WORDS, name


def test_the_cut_turns_labels():
    kept, n, turned = H.content_blocks(f"<article><p>{WORDS}</p><section class=discussion><ul><li>one<li>two</ul><p>{WORDS}</p></section></article>")
    assert (len(kept), n, turned) == (4, 4, 2)  # the items alone would go
    kept, n, turned = H.content_blocks(f"<div><p>{WORDS}</p><div>Kept</div><p>{WORDS}</p></div>")
    assert (len(kept), n, turned) == (3, 3, 1)


def test_formulas_and_text_for_readers_without_scripts():
    assert H.main_text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math>, stop.</p></article>") == "If x=1, stop."
    assert H.main_text(f"<article><p>{WORDS}</p><noscript><p>A table instead of the chart.</p></noscript></article>") == f"{WORDS}\nA table instead of the chart."
    assert H.main_text(f"<noscript>This site needs scripts, please switch them on now.</noscript><article><p>{WORDS}</p></article>") == WORDS


def test_deep_pages_take_memory_by_their_length():
    import time
    import tracemalloc

    start = time.time()
    assert len(H.main_text("<article>" + "<div>some text of it " * 100_000 + "</div>" * 100_000).split("\n")) == 100_000
    assert len(H.main_text("<article>" + "<section><b class=x>text" * 50_000 + "</span></i></section>" * 50_000).split("\n")) == 50_000
    assert H.main_text("<svg>" + "<g>" * 100_000 + "</b></g>" * 100_000 + "</svg><article>text of it</article>") == "text of it"
    assert time.time() - start < 60
    tracemalloc.start()
    H.read_page("<article>" + "<div>x" * 8000)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_generated_pages_give_their_articles():
    rng = random.Random(5)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    for _ in range(60):
        want, body = [], []
        for _ in range(rng.randrange(1, 8)):
            kind, text = rng.choice(["h2", "p", "p", "ul", "blockquote", "ad"]), sentence(rng.randrange(8, 60))
            if kind == "ad":
                body.append(f"<div class='ad-box'><p>{text}</p></div>")
            elif kind == "ul":
                items = [sentence(rng.randrange(1, 5)) for _ in range(3)]
                body.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
                want += items
            else:
                body.append(f"<{kind}>{text}</{kind}>")
                want.append(text)
        links = "".join(f"<li><a href=#>{sentence(2)}</a></li>" for _ in range(5))
        page = (f"<html><head><title>{sentence(4)}</title></head><body><header><p>{sentence(6)}</p></header><nav><ul>{links}</ul></nav>"
                f"<div class=sidebar><p>{sentence(30)}</p></div><article><h1>{(title := sentence(5))}</h1>{''.join(body)}</article>"
                f"<div id=comments><p>{sentence(40)}</p></div><footer><p>{sentence(20)}</p></footer></body></html>")  # fmt: skip
        assert H.main_text(page) == "\n".join([title, *want])
