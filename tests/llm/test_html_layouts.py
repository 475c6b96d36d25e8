"""Pages written by hand, in layouts that the labeller wasn't trained on."""

import pytest

from chronolith.llm import html_model
from chronolith.llm.html_blocks import blocks

MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li><li><a href="/c">Contact</a></li></ul>'
TEXT = [
    "The old harbour bridge",
    "The bridge over the harbour was built in 1887, and it has carried trams, carts and cars ever since.",
    "Its twelve arches stand on piles of oak. When the water is low, one can see where the masons cut their marks.",
    "In the winter of 1929 the ice broke two of the piers; they were rebuilt within a year, at twice the cost.",
    "Today the bridge is a monument, and only pedestrians may cross it.",
]
ARTICLE = f"<h1>{TEXT[0]}</h1>" + "".join(f"<p>{t}</p>" for t in TEXT[1:])
WRAPPERS = [
    "<article>", "<main>", '<div class="css-1x2y">', '<div class="field-item">', '<div class="text">', '<div class="mw-body" role="main">', '<div class="content">', '<div id="main-content">', '<div class="post">',
    '<div class="entry">', '<div class="article__body">', '<div class="story">', '<div class="sc-abc123 kQwErT">', '<div class="col-md-8">', '<section>', '<div>', '<div id="a17">', '<div class="richtext">',
]
NOISE = {"Home", "News", "About us", "Contact"}


@pytest.fixture(scope="module")
def labeller():
    return html_model.trained()


def kept(labeller, html):
    page = blocks(html)
    return [b.text for b, yes in zip(page, labeller.labels([html_model.vectors(page)])[0], strict=True) if yes]


def close(opening):
    return f"</{opening.strip('<>').split()[0]}>"


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_plain_article_in_any_wrapper(labeller, wrapper):
    html = f"<html><body><nav>{MENU}</nav>{wrapper}{ARTICLE}{close(wrapper)}<footer><p>© 2021 Harbour News. All rights reserved.</p></footer></body></html>"
    assert kept(labeller, html) == TEXT


def test_a_page_of_an_encyclopedia(labeller):
    html = f"""<body class="mediawiki"><div id="mw-page-base"></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading">{TEXT[0]}</h1><div id="bodyContent"><div id="mw-content-text"><div class="mw-parser-output">
      <p>{TEXT[1]}</p><div id="toc" class="toc"><ul><li><a href="#a">1 History</a></li><li><a href="#b">2 Today</a></li></ul></div><h2><span class="mw-headline">History</span></h2><p>{TEXT[2]}</p><p>{TEXT[3]}</p></div></div></div></div>
      <div id="mw-navigation"><div id="p-navigation" role="navigation">{MENU}</div></div><footer id="footer"><ul id="footer-info"><li>This page was last edited on 3 May 2021.</li></ul></footer></body>"""
    got = kept(labeller, html)
    assert all(t in got for t in TEXT[:4]) and "1 History" not in got and not NOISE & set(got) and not any("last edited" in t for t in got)


def test_generated_class_names(labeller):
    html = f"""<body><div id="root"><div class="css-9f2a"><header class="css-77ab">{MENU}</header><div class="css-1abc"><h1 class="css-5tt0">{TEXT[0]}</h1><p class="css-0p">By Jane Doe</p>
      <p class="css-0p">{TEXT[1]}</p><p class="css-0p">{TEXT[2]}</p></div><footer class="css-zz1"><p>© 2023 Site</p></footer></div></div></body>"""
    got = kept(labeller, html)
    assert got[0] == TEXT[0] and TEXT[1] in got and TEXT[2] in got and "© 2023 Site" not in got and not NOISE & set(got)


def test_an_old_page_of_tables(labeller):
    html = f"""<body bgcolor=white><table width=100%><tr><td valign=top width=120><a href=1.htm>Home</a><br><a href=2.htm>Photos</a><br><a href=3.htm>Links</a></td><td><font size=5>{TEXT[0]}</font><p>{TEXT[1]}<p>{TEXT[2]}<p>{TEXT[3]}</td></tr></table>
      <hr><center>Copyright 1999 Joe's Page. Best viewed in 800x600.</center></body>"""
    got = kept(labeller, html)
    assert all(t in got for t in TEXT[1:4]) and not any("Copyright" in t for t in got) and not any("Photos" in t for t in got)


def test_notices_and_readers_comments_go(labeller):
    html = f"""<body><div class="cookie-banner"><p>We use cookies to improve your visit. Please accept them.</p><button>Accept</button></div><header><a href="/">Harbour News</a></header><main>{ARTICLE}</main>
      <section class="comments"><h3>3 comments</h3><div class="comment"><p>I walked over it as a child, and it was lovely.</p></div><div class="comment"><p>Great piece, thank you for writing it.</p></div></section>
      <div class="newsletter"><p>Subscribe to our letter and never miss a story.</p></div><footer>© 2020</footer></body>"""
    assert kept(labeller, html) == TEXT


def test_a_thread_of_a_forum_keeps_its_first_post(labeller):
    html = f"""<body><div class="navbar">{MENU}</div><div class="thread"><div class="post-body"><h2>{TEXT[0]}</h2><p>{TEXT[1]}</p><p>{TEXT[2]}</p></div><div class="replies"><div class="comment"><p>Nice find, where is it?</p></div></div></div><div class="footer">© forum</div></body>"""
    assert kept(labeller, html) == TEXT[:3]


def test_share_of_main_blocks_kept(labeller):
    """At least 0.95 of the blocks of main text over all wrappers, with generated names around the noise too."""
    kept_blocks = total = wrong = 0
    for wrapper in WRAPPERS:
        for name in ("", ' class="x9k2"', ' class="top"'):
            html = f"<body><div{name}>{MENU}</div><div{name}>{wrapper}{ARTICLE}{close(wrapper)}</div><footer{name}><p>© 2021 Harbour News.</p></footer></body>"
            got = kept(labeller, html)
            kept_blocks, total, wrong = kept_blocks + len(set(got) & set(TEXT)), total + len(TEXT), wrong + len(set(got) & NOISE)
    assert kept_blocks >= 0.95 * total and wrong <= 0.05 * len(WRAPPERS) * 3 * len(NOISE)
