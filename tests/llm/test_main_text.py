"""Main text: elements that are no text, marked articles, plain pages, and pages of many blocks."""

import time

import pytest

from omenflow.llm.html_main import main_text

LONG = "This is a sentence that is long enough to be taken for the text of an article, with a comma and a stop."


@pytest.mark.parametrize("html, text", [
    (f"<article><p>{LONG}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given. {LONG}</p></article>", f"{LONG} Let x=1 be given. {LONG}"),
    (f"<article><p>{LONG}</p><math><mi>y</mi><p>{LONG}</p></article>", f"{LONG} y {LONG}"),
    (f"<article><p>{LONG}</p><button>Share<p>{LONG}</p><p>{LONG}</p></article>", None),
    (f"<article><p>{LONG}</p><button class=x>Share</button><p>{LONG}</p><select><option>a<option>b</select></article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><noscript><p>Please enable scripts.</p></noscript><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><svg><title>icon</title><path/></svg><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f'<article class="post search-result"><p>{LONG}</p></article>', LONG),
    (f'<article id="comment-policy"><p>{LONG}</p></article>', LONG),
    (f'<article><p>{LONG}</p></article><article class="comment-body"><p>{LONG}</p></article>', LONG),
    ("<html><body>three plain words</body></html>", "three plain words"),
    ("<body><nav>three menu words</nav></body>", ""),
    ("<body><div class='cookie-notice'>we use cookies</div></body>", ""),
])
def test_cases(html, text):
    got = main_text(html)
    if text is None:  # the words of the button may stay, the paragraphs have to
        assert got.count(LONG) == 3
    else:
        assert got == text


def test_time_grows_with_the_page():
    page = lambda n: "<body>" + f"<p>{LONG}</p><ul class='menu'><li><a href='/x'>Home</a></li></ul>" * n + "</body>"
    main_text(page(10))
    began = time.time()
    assert main_text(page(8000)).count(LONG) == 8000
    assert time.time() - began < 20  # seconds on a busy machine; under two on an idle one
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000
    assert main_text(deep) == LONG
