import itertools
import random

from worksight.llm import html_text as ht


def test_minimum_cut_is_the_cheapest_labelling():
    choose = random.Random(8)
    for _ in range(60):
        n = choose.randint(1, 8)
        scores = [choose.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, choose.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if choose.random() < 0.5]

        def cost(labels, scores=scores, edges=edges):
            single = sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, labels, strict=True))
            return single + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(ht.minimum_cut(scores, edges)) - best) < 1e-6


PAGE = """<!DOCTYPE html><html lang=en class="page-with-ads"><head><title>Site</title><style>p{}</style>
<script>var t="</p><p>not text</p>";</script></head><body class="has-sidebar">
<header class="site"><a href="/">Home</a><p>A slogan that is long enough to look like a sentence.</p></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="wrapper main-menu-layout"><div id=cookie-notice><p>We use cookies. Accept all of them, please, now.</p></div>
<article><header><h1>The &eacute;vent &amp; more</h1></header>
<p>First paragraph,   with <b>bold</b><br>and <a href=x>a link</a>&nbsp;inside&hellip;
<p>Yes.<!-- no > comment --><div class=advert>Buy this product today, it is the best one there is.</div>
<p>Last &#8220;paragraph&#x201D; of a < b.</p><script>more()</script>
<form><p>Enter your address here to get our news.</p><input><button>Go</button></form>
<section id="comments"><h2>Comments</h2><div class="comment-body"><p>I liked this very much, thank you for it all.</p></div></section>
</article><aside><p>Related stories you may like to read later on today.</p></aside></div>
<footer>&copy; Someone, all rights reserved.</footer></body></html>"""


def test_article_only():
    assert ht.main_text(PAGE).split("\n\n") == [
        "The évent & more",
        "First paragraph, with bold and a link inside…",
        "Yes.",
        "Last “paragraph” of a < b.",
    ]


def test_pages_without_semantic_elements():
    long = "This paragraph has a good number of words, and it ends like a sentence does."
    links = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8))
    page = f"""<body><div class=top><ul>{links}</ul></div><div class=box><h2>Title of the text</h2>
    <p>{long}</p><p>Short one.</p><p>{long}</p></div><div class=sidebar><p>{long}</p></div>
    <div><ul>{links}</ul></div><div class=footer>{long}</div>"""
    assert ht.main_text(page).split("\n\n") == ["Title of the text", long, "Short one.", long]


LONG = "This paragraph has a good number of words, it says something, and it ends like a sentence does."


def test_links_around_blocks():
    """A teaser is linked whether its link stands inside the block or around it."""
    cards = [f"Another story number {i} with a title that is long enough" for i in range(4)]
    for card in ("<div><a href=x>{}</a></div>", "<a href=x><div>{}</div></a>", "<a href=x><div><p>{}</p></div></a>"):
        teasers = "".join(card.format(text) for text in cards)
        page = f"<body><div><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></div><div>{teasers}</div></body>"
        assert ht.main_text(page).split("\n\n") == ["A title", LONG, LONG]
    # a link that is never closed ends with the block around it
    page = f"<article><p><a href=x>Go</p><p>{LONG}</p></article>"
    assert LONG in ht.main_text(page)


def test_names_that_may_mean_either():
    page = f"""<article><h1>A title</h1><p>{LONG}</p><div class="related-work"><p>{LONG}</p></div>
    <div class="share-price-widget"><p>{LONG}</p></div><p>{LONG}</p>
    <div class="share"><a href=x>Send</a> <a href=y>Post</a></div>
    <div class="related"><a href=x>More on this</a></div></article>
    <div class="related"><p>{LONG}</p></div>"""
    assert ht.main_text(page).split("\n\n") == ["A title", LONG, LONG, LONG, LONG]


def test_references_end_at_tags():
    assert ht.main_text("<article><p>Fish &am<b>p;</b> chips &amp; more.</p></article>") == (
        "Fish &amp; chips & more."
    )


def test_odd_pages():
    for page in ("", "   ", "<", "<p", "<!-- open", "<script>x", "<p a='x>b", "</p></div>", "<a><b><i>", "&am", "<>"):
        assert isinstance(ht.main_text(page), str)
    assert ht.main_text("<article><p>Cut off &am") == "Cut off &am"
    deep = "<div>" * 3000 + "<article><p>Deep inside there is a sentence.</p></article>"
    assert ht.main_text(deep) == "Deep inside there is a sentence."
    many = "<article>" + "<p>One more sentence of this very long page.</p>" * 3000
    assert ht.main_text(many).count("\n\n") == 2999


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(ht.extract_main_text(pages).collect(), key=str)
    assert [(r.page_id, r.url, r.n_chars) for r in got if not r.text] == [(2, None, 0), (None, "v", 0)]
    assert [r.n_chars for r in got if r.page_id == 1] == [len(ht.main_text(PAGE))] * 2
    assert ht.extract_main_text(pages.limit(0)).count() == 0
