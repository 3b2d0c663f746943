"""Content that several elements hold."""

import time

from tidemark.llm import html_extraction
from tidemark.llm.html_extraction import main_text


def article(name, sentences):
    return "<article>" + "".join(f"<p>{name} sentence {i} of this part goes on for quite some words, and ends with a full stop.</p>" for i in range(sentences)) + "</article>"


def test_all_sibling_articles_that_pass_stay():
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(8))
    for wrap in ("{}", "<div>{}</div>", "<main>{}</main>"):
        page = f"<html><body><ul>{links}</ul>{wrap.format(article('First', 6) + article('Second', 4) + article('Third', 5))}<p><a href='/x'>More</a></p></body></html>"
        text = main_text(page)
        assert [text.count(f"{name} sentence") for name in ("First", "Second", "Third")] == [6, 4, 5]
        assert "Link" not in text


def test_names_do_not_mark_headings_and_paragraphs_of_an_article():
    story = "<p>The story goes on for quite some words, with a full stop at its end.</p>" * 5
    named = '<h2 id="related-work">Earlier studies</h2><p class="share-price">The price of one share rose again today.</p>'
    text = main_text(f'<html><body><article>{named}{story}<div class="share">Tell friends</div></article></body></html>')
    assert "Earlier studies" in text and "The price of one share" in text and "Tell friends" not in text


def test_tag_soup_takes_linear_time():
    for soup in ("<b>word " * 40_000, "<i>word </b>" * 30_000, "<div><p>" + "<b>" * 15_000 + "<li>word " * 15_000):
        start = time.process_time()
        assert html_extraction.main_text(soup).startswith("word")
        assert time.process_time() - start < 2


def test_unclosed_elements_close_as_in_browsers():
    page = "<body><article><p>one <b>two<p>three</b><ul><li>four<li><i>five<li>six</ul><table><tr><td>a<td>b<tr><td>c</table></article>"
    assert html_extraction.main_text(page).split("\n\n") == ["one two", "three", "four", "five", "six", "a", "b", "c"]
