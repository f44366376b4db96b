"""Shapes of pages beside those of the given table: what is main text in each, and what isn't."""

import pytest

from tidecurve.llm import html_text

P = "The long river ran through the valley and the people of the town kept their boats on its eastern bank, where the water was slow and the ground was firm. "
LONG = P * 3
MENU = '<div class="nav"><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">About us</a></div>'
FOOT = "<div>© 2024 The Valley Post. All rights reserved.</div>"


def page(body):
    return f"<html><head><title>T</title></head><body>{MENU}{body}{FOOT}</body></html>"


def clean(*texts):
    return "\n".join(" ".join(t.split()) for t in texts)


KEEPS = {
    "article": (f"<article><h1>Title</h1><p>{LONG}</p><p>{P}</p></article>", ("Title", LONG, P)),
    "form around the page": (f'<form id="aspnetForm"><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></form>', ("Title", LONG, LONG)),
    "fieldset around the page": (f"<fieldset><div><h1>Title</h1><p>{LONG}</p><p>{P}</p></div></fieldset>", ("Title", LONG, P)),
    "shown by scripts later": (f'<div style="display: none"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>', ("Title", LONG, LONG)),
    "hidden attribute": (f"<div hidden><p>{LONG}</p><p>{P}</p></div>", (LONG, P)),
    "lead, rich text and end": (f"<div id=c><h1>TITLE</h1><div class=lead><p>Lead of a few words.</p></div><div class=rich><p>{LONG}</p><p>{LONG}</p><p>{P}</p></div><div class=end><p>End of it.</p></div></div>", ("TITLE", "Lead of a few words.", LONG, LONG, P, "End of it.")),
    "title outside of the block": (f"<h1>TITLE</h1><div><p>{LONG}</p><p>{LONG}</p></div>", ("TITLE", LONG, LONG)),
    "three sections": (f"<section><p>{LONG}</p></section><section><p>{LONG}</p></section><section><p>{P}</p></section>", (LONG, LONG, P)),
    "nested blocks": (f"<div><div><div><p>{LONG}</p><p>{LONG}</p></div></div><div><p>{P}</p></div><div><div><p>{P}</p></div></div></div>", (LONG, LONG, P, P)),
    "two articles": (f"<article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}</p><p>{P}</p></article>", ("One", LONG, "Two", LONG, P)),
    "list in an article": (f"<article><p>{LONG}</p><ul><li>first point</li><li>second point</li></ul><p>{P}</p></article>", (LONG, "first point", "second point", P)),
    "wrapper with a sidebar's name": (f'<div class="has-sidebar"><div class="content"><p>{LONG}</p><p>{P}</p></div></div>', (LONG, P)),
    "related work of a paper": (f'<article><p>{LONG}</p><section class="related-work"><h2>Related work</h2><p>{P}</p></section></article>', (LONG, "Related work", P)),
    "table": (f"<article><p>{LONG}</p><table><tr><td>a</td><td>b</td></tr></table></article>", (LONG, "a", "b")),
    "main with sections": (f"<main><h1>T</h1><section><p>{LONG}</p></section><section><p>{P}</p></section></main>", ("T", LONG, P)),
    "references": (f"<article><p>{LONG}&amp; &#233;&#x20AC;&lt;b&gt; caf&eacute;</p></article>", (LONG + "& é€<b> café",)),
    "breaks": (f"<article><p>one<br>two</p><p>{LONG}</p></article>", ("one two", LONG)),
    "header of an article": (f"<article><header><h1>T</h1><p>By a person</p></header><p>{LONG}</p></article>", ("T", "By a person", LONG)),
    "quotation": (f"<article><p>{LONG}</p><blockquote>{P}</blockquote></article>", (LONG, P)),
    "preformatted": (f"<div><p>{LONG}</p><pre>x = 1\ny = 2</pre><p>{LONG}</p></div>", (LONG, "x = 1 y = 2", LONG)),
}

DROPS = {
    name: f'<article><p>{LONG}</p><div {what}><p>Buy the new boat today, it is cheap and very fast.</p></div><p>{P}</p></article>'
    for name, what in {
        "prefixed ad": 'class="td-ad"', "vendor's ad": 'class="googlead"', "numbered promo": 'class="promo-x2"', "component": 'class="c-newsletter-signup__x"', "plain ad": 'class="ad"', "camel": 'class="sidebarBox"',
        "id": 'id="comments"', "share": 'class="social-share"', "role": 'role="complementary"', "related": 'class="related-posts"', "hidden": 'style="visibility:hidden"', "aria": 'aria-hidden="true"', "slot": 'class="ad-slot-3"', "cookie": 'class="cookie-notice"',
    }.items()
}
DROPS |= {
    "form in an article": f"<article><p>{LONG}</p><form><p>Your name and your address, please.</p><input></form><p>{P}</p></article>",
    "aside": f"<article><p>{LONG}</p><aside><p>Buy the new boat today.</p></aside><p>{P}</p></article>",
    "script": f"<article><p>{LONG}</p><script>if (a < b) document.write('<p>no</p>')</script><p>{P}</p></article>",
    "comment articles": f'<article><p>{LONG}</p><p>{P}</p></article><div class="comments"><article><p>{P}</p></article><article><p>{P}</p></article></div>',
    "teasers": f'<article><p>{LONG}</p><p>{P}</p></article><article><a href="/x">Another story of the day</a></article><article><h3><a href="/y">And one more</a></h3></article>',
    "link list": f'<div><p>{LONG}</p><p>{P}</p></div><ul><li><a href="/x">Another story of the day</a></li><li><a href="/y">And one more of them</a></li></ul>',
}


@pytest.mark.parametrize("name", KEEPS)
def test_main_text_is_whole(name):
    body, want = KEEPS[name]
    assert html_text.main_text(page(body)) == clean(*want)


@pytest.mark.parametrize("name", DROPS)
def test_furniture_goes(name):
    assert html_text.main_text(page(DROPS[name])) == clean(LONG, P)


@pytest.mark.parametrize("reference", ["&#" + "9" * 5000 + ";", "&#x" + "f" * 5000 + ";", "&#" + "9" * 5000, "&#0;", "&#1114112;", "&#xD800;", "&nosuch;", "&#;", "&"])
def test_references_of_any_length(reference):
    assert html_text.main_text(f"<p>hello {reference} {P}</p>").startswith("hello ")


def test_deep_and_broken_pages_end():
    for bad in ("<div>" * 30_000 + P, "<p>" * 30_000 + P, "<b><i>" * 20_000 + P + "</b></i>", "<a href='" + "x" * 100_000, "<table><tr><td>" * 5000 + P):
        html_text.main_text(bad)
