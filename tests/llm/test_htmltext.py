import pytest

from radiolake.llm import htmltext
from radiolake.llm.htmltext import main_text

LONG = "This is a long paragraph, with many words in it, and it goes on for a while. It even has a second sentence."
FRAME = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p><p>no";</script></head>
<body><header class="site">Site name</header><nav><ul><li><a href=/a>Home, sweet home.</a></li></ul></nav>
<div class="cookie-notice">We use cookies, as everybody does. Do you mind?</div>
{body}
<aside><p>{aside}</p></aside><section id="comments"><p>First! {aside}</p></section>
<form><p>Your name</p><input></form><footer>&copy; us</footer></body></html>"""


def page(body):
    return FRAME.format(body=body, aside=LONG)


@pytest.mark.parametrize("holder", ["article", "main", 'div class="content"', "section"])
def test_article_only(holder):
    body = f"<{holder}><h1>A title</h1><p>{LONG}</p><div class=ad>Buy, buy, buy.</div><p>Short.</p><ul><li>One<li>Two</ul></{holder.split()[0]}>"
    assert main_text(page(body)) == f"A title\n\n{LONG}\n\nShort.\n\nOne\n\nTwo"


def test_broken_markup_references_and_white_space():
    body = f"<article><p><b>Bold  start<br>\n next<p>{LONG} &amp; &eacute;&#x41;&nbsp;&lt;b&gt;</p></i>tail<!-- no --></article>"
    assert main_text(page(body)) == f"Bold start next\n\n{LONG} & éA <b>\n\ntail"


def test_inline_elements_do_not_break_words():
    assert main_text("<article><p>a<b>b</b>c <a href='x>y'>d</a>e</p></article>") == "abc de"


def test_header_inside_the_article_stays_and_comments_go():
    body = f"<article><header><h1>Title</h1></header><p>{LONG}</p><div class='comment-list'><p>{LONG}</p></div></article>"
    assert main_text(page(body)) == f"Title\n\n{LONG}"


@pytest.mark.parametrize("source", [None, "", "   ", "<html></html>", "<script>x", "<p>", "<!-- x", "<", "<nav>menu</nav>"])
def test_pages_without_content(source):
    assert main_text(source) in ("", "<")


def test_plain_text_and_deep_nesting():
    assert main_text("just words") == "just words"
    assert main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"


def test_ratios_choose_the_long_paths():
    links = [htmltext.Block(("b", f"div.{i}"), "link", True) for i in range(9)]
    chosen = htmltext.content_paths([htmltext.Block(("b", "p"), LONG, True)] * 4 + links)
    assert ("b", "p") in chosen and ("b", "div.5") not in chosen
    assert htmltext.content_paths([]) == set()


def test_table(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "x"), (2, None, None, "y"), (2, None, None, "y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in htmltext.extract(df).collect())
    assert got == [(1, LONG), (2, ""), (2, "")]
    assert htmltext.extract(df).columns == ["page_id", "url", "text"]
    assert htmltext.extract(df.where("page_id > 5")).count() == 0


@pytest.mark.parametrize("name", ["overflow-hidden", "site-content has-sidebar", "sidebar", "menu", "modal"])
def test_names_round_the_article_do_not_empty_the_page(name):
    for holder in ("article", "div"):
        body = f'<div class="{name}"><{holder}><h1>A title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></{holder}></div>'
        assert main_text(page(body)) == "\n\n".join(["A title", LONG, LONG, LONG])


def test_parts_of_an_article_stay_whatever_their_names():
    body = f"""<article data-title="The hidden cost of x"><h2 id="related-work">Related work</h2><p>{LONG}</p>
    <p class="share-price">It fell.</p><section id="discussion"><p>{LONG}</p></section>
    <figure><img src=x><figcaption>A caption.</figcaption></figure><p data-style="display:none">Seen.</p>
    <p hidden>Gone.</p><div style="color:red; DISPLAY : none">Gone.</div><div aria-hidden=true>Gone.</div></article>"""
    assert main_text(page(body)) == f"Related work\n\n{LONG}\n\nIt fell.\n\n{LONG}\n\nA caption.\n\nSeen."


def test_comments_longer_than_the_article_go():
    many = f"<div id='comments'>{f'<article class=comment-body><p>{LONG}</p></article>' * 5}</div>"
    for holder in ("article", "div"):
        assert main_text(page(f"<{holder} class='post'><p>{LONG}</p></{holder}>{many}")) == LONG


def test_a_page_in_a_form_and_shorter_parts_of_an_article():
    assert main_text(f"<form><div><p>{LONG}</p></div></form>") == LONG
    body = f"<div class='one'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='two'><p>{LONG}</p></div>"
    assert main_text(page(body)) == "\n\n".join([LONG] * 4)


def test_an_advert_longer_than_the_article_beside_it_goes():
    assert main_text(f"<div class='ad'>{LONG}</div><article><h1>A title</h1><p>Short.</p></article>") == "A title\n\nShort."
