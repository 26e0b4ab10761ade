"""Main text of hand-made pages, by the contract: exact texts, odd markup, hostile pages."""

import random
import time

import pytest

from facetmill.llm import html_text

LONG = "A sentence of the article that is long enough to be read as its main text, with a clause and an end."
BODY = f"<p>{LONG}</p><p>And a second one. {LONG}</p>"
TEXT = f"{LONG} And a second one. {LONG}"
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Related story {i}</a></li>" for i in range(4)) + "</ul>"

PAGES = {
    # Inside a marked article or main: compound names of what is not main text.
    "advert": (f"<main>{BODY}<div class='ad-slot'>Buy now</div></main>", TEXT),
    "advert between": (f"<article><p>{LONG}</p><div class=adSlot-2><p>Buy</p></div><p>And a second one. {LONG}</p></article>", TEXT),
    "comments": (f"<main>{BODY}<div class=comment-list><p>First!</p><div class=comment-body>Second</div></div></main>", TEXT),
    "comment articles": (f"<article>{BODY}</article><article class=comment><p>First!</p></article><article class='post-comment'>x</article>", TEXT),
    "nested comment": (f"<article>{BODY}<article class='comment depth-1'>{BODY}</article></article>", TEXT),
    "share buttons": (f"<main>{BODY}<div class='share-buttons'>Tweet this</div></main>", TEXT),
    "footer by name": (f"<main>{BODY}<div class='site-footer'>All rights</div><div id=pageFooter>Imprint</div></main>", TEXT),
    "main that is an advert": (f"<main class='ad-slot'>Buy</main><main>{BODY}</main>", TEXT),
    "related links": (f"<article><p>{LONG}</p>{LINKS}<p>And a second one. {LONG}</p></article>", TEXT),
    "cookie notice": (f"<article><div class='cookie-banner'>We use cookies</div><div id=newsletter-signup>Mail</div>{BODY}</article>", TEXT),
    "form": (f"<article>{BODY}<form>Name <select><option>x</select></form><nav>Menu</nav><aside>Side</aside></article>", TEXT),
    "main around an article": (f"<main><p>Latest news</p><article>{BODY}</article><div>More</div></main>", TEXT),
    # Names that only look like it.
    "look-alikes": ("<article class='post has-comments category-ads'><div class=no-sidebar><p class=side-effects>One.</p><section id=comments-on-the-treaty>Two.</section><h2 id=comments>Three.</h2><p class='market-share'>Four.</p><p data-id=ad>Five.</p></div></article>", "One. Two. Three. Four. Five."),
    "one link is text": ("<article><p>See</p><p><a href=x>the full report</a></p><p>for more.</p></article>", "See the full report for more."),
    # Odd markup.
    "quote in a value": ("<article><p class=it's>Hello</p><p>World</p><p>It's fine</p></article>", "Hello World It's fine"),
    "quote in a name": ("<article><p '>Hello</p><p \">World</p></article>", "Hello World"),
    "unclosed quote": ("<article><p title=\"x>Hello</p><p>World</p></article>", "Hello World"),
    "end sign in a value": ("<article><p title='a > b' alt=\"</p>\">Hello</p><img alt='x>y'>World</article>", "Hello World"),
    "no end": ("<article><p>Hello<p>World</article><p", "Hello World"),
    "comments in markup": ("<article><!-- <p>no</p> --><p>Hello<!-->World</p><!-- a > b --></article><!-- never closed", "HelloWorld"),
    "raw": ("<article><style>p > a</style><script>if (a < b) '</p>'</script><textarea>no</textarea><p>Hello</p><svg><text>no</text></svg><p>World</p></article>", "Hello World"),
    "references": ("<article><p>a&amp;b &lt;c&gt; &#65;&#x42; &copy 2 &nosuch; &#0000000000067; &#99999999999999; &</p></article>", "a&b <c> AB © 2 &nosuch; C � &"),
    "less than": ("<article><p>1 < 2 and 3 <4 <</p></article>", "1 < 2 and 3 <4 <"),
    "upper case": (f"<MAIN>{BODY.upper().replace('P>', 'p>')}<DIV CLASS='Ad'>x</DIV></MAIN>", TEXT.upper()),
    # No article is marked.
    "terms and copyright": (f"<div><p>By reading this page you accept the terms of use and the privacy rules of this site and more.</p></div><ul><li><a href=a>a</a><li><a href=b>b</a><li><a href=c>c</a><li><a href=d>d</a></ul>{BODY * 4}<ul><li><a href=a>a</a><li><a href=b>b</a><li><a href=c>c</a></ul><p>© 2024 The company of the site and its partners, all rights in texts and images reserved, see the imprint.</p>", " ".join([TEXT] * 4)),
    "regions": (f"<div>{BODY}</div>{LINKS}<p>short</p>{LINKS}<div>{BODY}</div>", f"{TEXT} short {TEXT}"),
    "nothing but short lines": ("<p>One</p><p>two</p>", "One two"),
    "no-sidebar wrapper": (f"<div class='page no-sidebar'><div id=content>{BODY}</div><div class=sidebar>Side</div></div>", TEXT),
    "white space": ("<article><p> a\n\tb </p>\r\n<p>\xa0</p></article>", "a b \xa0"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("part", ["<a '", '<a "', "<a x='", "<a =\">", "<p ", "</", "<!", "<!--", "<script>", "<svg", "&#1", "<a href='x", "<p class=\"a>", "<<<a b='", "<title>", "x" * 50 + "<b/", "<p =''", "=\"'"])
@pytest.mark.parametrize("end", ["", ">", "'>", "\">x</p>"])
def test_hostile_pages_take_linear_time(part, end):
    began = time.perf_counter()
    html_text.main_text(part * (1_000_000 // len(part)) + end)
    assert time.perf_counter() - began < 6


def test_any_markup_is_read():
    """No page of random parts breaks, loses words that stand outside of tags, or depends on what follows its end."""
    parts = ["<p>", "</p>", "<div class=x>", "</div>", "<b>", "<a href='q'>", "</a>", "<i t=\"", "<i t='", "'", '"', ">", "<", "=", " word ", "<br/>", "</", "<!x>"]
    for seed in range(400):
        rng = random.Random(seed)
        page = "<article>" + "".join(rng.choice(parts) for _ in range(30)) + "<p>last words</p></article>"
        assert html_text.main_text(page).isprintable()
        scan, read = html_text.Scanner(page), []
        while True:
            text, _, tag, _ = scan.next()
            read.append(text)
            if not tag:
                break
        assert len("".join(read)) <= len(page) and scan.at == len(page)
