import re
import time

import brute
import pytest

from verdictlake.llm import html as module
from verdictlake.llm.html import extract_text, main_text, nodes_of, smooth

LONG = "This is a sentence of the article, with commas, and it goes on for a while. "


def test_article_without_what_stands_around_it():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div><div class="ad">Buy this, now.</div>
    <article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>Two  words.</p><form><input value="x">Send</form><div class="comments"><p>{LONG}</p></div></article>
    <aside>{LONG}</aside><footer>&copy; me &middot; now.</footer></body></html>"""
    assert main_text(page) == f"Title & more\n\n{LONG.strip()}\n\nTwo words."


def test_pages_without_an_article_element():
    body = "".join(f"<p>{LONG * 3}</p>" for _ in range(6))
    page = f"<html><body><div id='menu'><a>One</a> <a>Two</a></div><div class='story'><h2>Head</h2>{body}</div><ul><li><a>x</a></li><li><a>y</a></li></ul></body></html>"
    text = main_text(page)
    assert text.count("This is") == 18 and "One" not in text and text.startswith("Head")


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == main_text("<!-- only") == ""
    assert main_text("plain text only, no markup.") == "plain text only, no markup."
    assert main_text("<article><p>cut of&am") == "cut of&am"
    assert main_text("<article><p>a < b &lt; c &#233;&eacute; <i") == "a < b < c éé"
    assert main_text("<p>x" * 3000).count("x") == 3000
    assert main_text("<div>" * 5000 + "deep text, here.").endswith("deep text, here.")


def test_inline_markup_and_white_space():
    assert main_text("<article><p>a<b>b</b>\n <i>c</i><br>d</p><p> \n </p><ul><li>one<li>two</ul></article>") == "ab c d\n\none\n\ntwo"


def test_paths_follow_the_rules_of_html():
    found = [n.place for n in nodes_of("<div><p>a<p>b</div>c") if n.text.strip()]
    assert [str(p) for p in found] == ["div/p", "div/p", ""] and found[0].path == found[1].path != found[2].path


def test_smoothing_keeps_a_constant():
    assert all(abs(v - 3) < 1e-9 for v in smooth([3.0] * 7))


def test_operator_keeps_rows_and_replaces_clashing_columns(spark):
    rows = [(1, "u", "<p>Hello there, you.</p>", 9), (1, "u", "<p>Hello there, you.</p>", 9), (2, None, None, None)]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == [(1, "Hello there, you.", 17)] * 2 + [(2, "", 0)]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_layout_names_around_an_article_do_no_harm():
    page = f"<body><div class='page with-sidebar'><article><h1>T</h1><p>{LONG}</p></article><div class='sidebar'>{LONG}</div><div id='comments'><article><p>{LONG}</p></article></div></div></body>"
    assert main_text(page) == f"T\n\n{LONG.strip()}"


def test_one_long_paragraph_is_not_the_whole_article():
    long = (LONG * 20).strip()
    page = f"<html><body><div id='menu'><a>One</a></div><div class='story'><h2>Head</h2><p>Lead, it is.</p><p>{long}</p><p>The end, now.</p></div></body></html>"
    assert main_text(page) == f"Head\n\nLead, it is.\n\n{long}\n\nThe end, now."


def test_sections_beside_a_long_body_are_kept():
    body = "".join(f"<p>{LONG * 6}</p>" for _ in range(6))
    page = f"<html><body><div><div class='lead'><p>{LONG}</p></div><div class='story'>{body}</div><div class='end'><h3>Last</h3><p>{LONG}</p></div></div><div class='sidebar'><p>{LONG}</p></div></body></html>"
    text = main_text(page)
    assert text.count("This is") == 38 and "Last" in text


def test_pages_equal_a_plain_version_and_ratios_decide(spark, data, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    found = [main_text(p) for p in pages]
    assert found == [brute.main_text(p) for p in pages] and all(found)
    with monkeypatch.context() as m:  # without ratios, menus and footers stay
        m.setattr(module, "path_ratios", lambda nodes: {x.place.path: 1.0 for x in nodes})
        assert sum(main_text(p) != f for p, f in zip(pages, found, strict=True)) > 0.9 * len(pages)
    with monkeypatch.context() as m:  # class names are a hint only
        for words in ("AROUND_WORDS", "NEVER_WORDS", "HEAD_WORDS"):
            m.setattr(module, words, re.compile("(?!)"))
        assert 0.9 < sum(len(main_text(p)) for p in pages) / sum(map(len, found)) < 1.1


@pytest.mark.parametrize("name", ["related", "promo", "teaser", "consent", "newsletter", "sidebar"])
def test_a_marked_article_is_still_found(name):
    page = f"<body><nav><a>Home</a></nav><div class='{name}'><h1>Title</h1>" + f"<p>{LONG * 3}</p>" * 4 + "</div><footer>Imprint</footer></body>"
    assert main_text(page).count("This is") == 12 and "Imprint" not in main_text(page)


def test_tables_lists_and_formulas_of_an_article_stay():
    page = f"<body><article><p>{LONG * 3}</p><table><tr><td>a<td>12</table><ul><li>one</ul><p>{LONG} <math><mi>x</mi></math></p><ul><li><a>Next</a><li><a>More</a></ul></article></body>"
    text = main_text(page)
    assert "a\n\n12\n\none" in text and text.endswith("x")


def test_long_comments_do_not_replace_a_short_article():
    page = f"<body><article><h1>Title</h1><p>{LONG}</p></article><div class='comments'>" + f"<p>{LONG * 4}</p>" * 5 + "</div></body>"
    assert main_text(page) == f"Title\n\n{LONG.strip()}"


@pytest.mark.parametrize("page", ["<a " * 350_000 + '"', "<a<a" * 250_000 + ' "', '<a "x" ' * 150_000 + '"', "<b>x" * 250_000, "<b>" * 200_000 + "<li>x</li>" * 50_000, "<div>x<p>" * 110_000, "</b" * 300_000, "<!--" * 250_000, "<![CDATA[" * 100_000, "<script>" * 120_000, "<p class='" * 100_000, "<ul><li>x" * 100_000])
def test_pages_of_a_megabyte_end(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 12  # a second or two; squares would take minutes


def test_an_open_quote_is_text_and_what_follows_is_found():
    assert main_text(f"<article><p>{LONG}</p><p>a <b class=\"x>b, c.</p></article>") == f"{LONG.strip()}\n\na <b class=\"x>b, c."
