"""Inline elements that tell against content end where their end tag stands."""

import pytest

from omenflow.llm import html_main

LONG = "This is a whole sentence of the article, long enough to count as text of its own; it goes on for a while. "


@pytest.mark.parametrize("mark", ['<span class="notice">x</span>', '<i class="icon-search"></i>', "<span hidden>x <span>y</span> z</span>", '<b class="share"><em>x</em></b>'])
def test_text_after_a_marked_inline_element_stays(mark):
    paragraph = f"<p>First words, {LONG}{mark} last words. {LONG}</p>"
    for page in (f"<body>{paragraph}</body>", f"<body>{mark}{paragraph}</body>", f"<article>{mark}{paragraph}<p>Second. {LONG}</p></article>"):
        text = html_main.main_text(page)
        assert "First words" in text and "last words" in text and ("Second" in text) == ("Second" in page)
        assert not {"x", "y", "z"} & set(text.split())


@pytest.mark.parametrize("attributes", ['data-hidden="false"', 'title="what is hidden here"', "title='class=share'", 'data-class="share"'])
def test_only_own_attributes_tell(attributes):
    assert html_main._evidence("div", attributes) == 0
    assert LONG.strip() in html_main.main_text(f"<body><div {attributes}><p>{LONG}</p></div></body>")


def test_own_attributes_still_tell():
    for attributes in ("hidden", 'data-x="1" hidden', 'class="share"', "class=share", "title='a b' id='cookie-bar'", 'style="display: none"', "aria-hidden=true"):
        assert html_main._evidence("div", attributes) < 0
