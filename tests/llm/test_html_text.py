"""Main text of pages: holders, block rules, inheritance, odd markup and nulls."""

from encore.llm.html_text import extract_text, main_text

LONG = "The singer of the band was on the road with it for a year, and this is what they have to say about the songs that were in the set. " * 2


def test_article_without_frame():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><p>{LONG}</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">{LONG}</div>
    <article><header><h1>A &amp; B</h1></header><p><b>First  line<br>goes\n on &lt;here&gt;.<p>Short.</p><div class="comments"><p>{LONG}</p></div>
    <p>Last &#233;&nbsp;one.</p></article><aside>{LONG}</aside><form>{LONG}<button>Go</button></form><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == "A & B\n\nFirst line goes on <here>.\n\nShort.\n\nLast é one."


def test_block_rules_without_holders():
    links = '<p><a href="/a">Charts</a> <a href="/b">Tours and tickets</a></p>'
    page = f"<div>{links}<h2>Tour</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><p>Hm.</p>{links}<p>Tail.</p></div>"
    clean = " ".join(LONG.split())
    assert main_text(page) == f"Tour\n\n{clean}\n\nYes.\n\n{clean}\n\nHm."


def test_unknown_language_uses_length_alone():
    text = "lorvik tamsel kuvren " * 20
    assert main_text(f"<p>{text}</p><p>tamsel</p>") == " ".join(text.split()) + "\n\ntamsel"


def test_holders_by_name():
    side = ["post-comments", "cookieNotice", "article-sidebar", "AdBox", "site-footer", "main-menu", "related_posts", "reader-comments"]
    for name in side:
        assert main_text(f'<article>a<div class="{name}">{LONG}</div><p id="{name}">{LONG}</p>b</article>') == "a\n\nb", name
    assert main_text(f'<div class="content has-sidebar"><div class="entry-content"><h1>T</h1><p>word</p></div><div id="sidebar">{LONG}</div></div>') == "T\n\nword"
    assert main_text(f'<header class="masthead"><h1>Site</h1></header><main><header><h1>T</h1></header>x<footer>{LONG}</footer></main>') == "T\n\nx"
    assert main_text(f'<main>x<div hidden>{LONG}</div><div style="display: none">{LONG}</div></main>') == "x"


def test_names_that_are_topics_as_well():
    clean = " ".join(LONG.split())
    assert main_text(f'<article class="legal-news"><p>{LONG}</p><p>Short.</p></article>') == f"{clean}\n\nShort."
    assert main_text(f'<article><h2>Search</h2><div class="search-tips"><p>{LONG}</p></div></article>') == f"Search\n\n{clean}"
    assert main_text(f'<article>a<div class="feedback-analysis">{LONG}</div>b</article>') == f"a\n\n{clean}\n\nb"
    assert main_text(f'<div class="content-header"><h1>T</h1></div><p>{LONG}</p>') == f"T\n\n{clean}"
    frame = f'<div class="search">Find a song</div><div class="legal"><a href="/l">{LONG}</a></div>'
    assert main_text(f"<article>{frame}<p>{LONG}</p>{frame}</article>") == clean
    assert main_text(f'<nav><div class="search-tips">{LONG}</div></nav><main>x</main>') == "x"


def test_odd_markup():
    assert main_text("") == ""
    assert main_text("<article>a<p>b</article><p>") == "a\n\nb"
    assert main_text("<article>open <script>never closed <p>x") == "open"
    assert main_text("<article>1 < 2 and a<b</article>") != ""
    assert main_text("<article><p class=ad>buy<p>text</article>") == "text"
    assert main_text('<div class="ad">x<article>y</article>') == "y"
    assert main_text("<article>a &am b &amp c</article>") == "a &am b & c"
    assert main_text("<article>" + "<p>x</p>" * 20_000 + "</article>").count("x") == 20_000
    assert main_text("<" * 50_000) != "never ends"


def test_operator(spark, rows):
    schema = "page_id long, url string, html string, text string, id string"
    data = [(1, "u", "<article>é<p>b</article>", "x", "y"), (None, None, None, None, None), (2, "u", "", "", ""), (2, "u", "", "", "")]
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_text(rows(data, schema)).collect()), key=str)
    assert got == [(0, None, "", 0), (1, "u", "é\n\nb", 4), (2, "u", "", 0), (2, "u", "", 0)]
    assert extract_text(rows([], schema)).count() == 0


def test_hidden_is_an_attribute_a_class_or_a_style():
    shown = [
        'style="overflow:hidden"', "style='overflow: hidden; color: red'", 'title="The hidden valley"', 'data-state="hidden"', "data-state=hidden", 'class="overflow-hidden"',
        'style="--display:none"', 'data-style="display:none"', 'aria-hidden="false"', 'alt="a = hidden"',
    ]
    for attributes in shown:
        assert main_text(f"<article {attributes}>{LONG}</article>") == " ".join(LONG.split()), attributes
        for name in ("div", "p"):
            assert main_text(f"<article>a<{name} {attributes}>word</{name}>b</article>") == "a\n\nword\n\nb", attributes
    gone = [
        "hidden", "HIDDEN", 'hidden=""', 'id=x hidden', 'hidden="until-found"', 'class="card hidden"', "class=hidden", 'aria-hidden="true"', "aria-hidden=true",
        'style="display:none"', 'style="color:red; display : none !important"', 'style="visibility: hidden"', 'style="/* off */ display:none"',
    ]
    for attributes in gone:
        for name in ("div", "p"):
            assert main_text(f"<article>a<{name} {attributes}>{LONG}</{name}>b</article>") == "a\n\nb", attributes
