"""Pages whose main text isn't all in one inner element."""

import time

import pytest

from loomgraph.llm import html


def said(name, n):
    return [f"The {name} paragraph number {i}, with a clause, says something of its own; and then it ends." for i in range(n)]


def ps(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


@pytest.mark.parametrize("tag", ["blockquote", "div", "section"])
def test_text_around_an_inner_container_stays(tag):
    outer, inner = said("outer", 3), said("inner", 9)
    page = f"<html><body><nav><a href=/>Home</a></nav><div>{ps(outer[:2])}<{tag}>{ps(inner)}</{tag}>{ps(outer[2:])}</div><footer>x</footer></body></html>"
    assert html.extract(page).split("\n") == [*outer[:2], *inner, outer[2]]


def test_text_outside_a_small_article_stays():
    own, rest = said("article", 4), said("outside", 6)
    page = f"<html><body><article>{ps(own)}</article><div>{ps(rest)}</div><nav>Home, away.</nav></body></html>"
    assert html.extract(page).split("\n") == own + rest


def test_all_of_an_article_stays():
    own = said("article", 6)
    page = f"<html><body><article><h1>Title</h1><div>{ps(own)}</div></article><footer>x</footer></body></html>"
    assert html.extract(page).split("\n") == ["Title", *own]


def test_a_sidebar_with_the_articles_path_is_left_out():
    own = said("article", 4)
    page = f"<div><div>{ps(own)}</div><div><p>Popular now<p>Most read</div></div>"
    assert html.extract(page).split("\n") == own


def test_stray_parts_inside_an_article_are_left_out():
    own = said("article", 4)
    page = f"<article><h1>Title</h1><div>Share</div>{ps(own[:2])}<ul><li>Home<li>About</ul><div><h3>More</h3><a href=x>One story, told.</a> <a href=y>Another story, told again.</a></div>{ps(own[2:])}<ul><li>one item, of two.<li>another item, the last.</ul></article>"
    assert html.extract(page).split("\n") == ["Title", *own, "one item, of two.", "another item, the last."]


def test_short_paragraphs_and_tables_stay():
    own = said("article", 5)
    page = f"<body><div>{ps([*own[:3], 'Yes', *own[3:]])}<table><tr><td>1</td><td>2</td></tr></table></div></body>"
    assert html.extract(page).split("\n") == [*own[:3], "Yes", *own[3:], "1", "2"]


@pytest.mark.parametrize("piece", ['<a "', "<a '", '<a "> " ', "<div>x", "<b>", "</div>", "<!--", "<p", "&amp;<", "<a href='>x</a>"])
def test_broken_markup_takes_linear_time(piece):
    def seconds(n):
        page = piece * n
        began = time.process_time()
        html.extract(page)
        return time.process_time() - began

    assert seconds(20_000) < 30 * seconds(2000) + 2


def test_pages_from_an_empty_table_and_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>One, two.</p>", "t", 3), (2, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract_pages(pages, keep=["page_id", "url"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "u", "One, two.", 9), (2, None, "", 0)]
    assert html.extract_pages(pages.limit(0), keep=["page_id", "url"]).count() == 0
