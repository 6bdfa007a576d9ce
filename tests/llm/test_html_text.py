import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskloom.llm.common import pages
from deskloom.llm.html_text import _inherited, extract, main_text

LONG = "The story of the town is that it was built by the river and that the people of the valley came to live in it."


def page(inner, head="<title>Site</title>"):
    return (
        f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style><script>if (a < b) document.write('<p>no</p>')</script></head><body class='has-sidebar'>"
        f"<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>{inner}"
        f"<footer>&copy; 2024 All rights reserved</footer></body></html>"
    )


def test_article_without_its_surroundings():
    text = main_text(page(
        f"<div id=cookieNotice>We use cookies</div><aside>{LONG}</aside><div class='sidebar'><p>{LONG}</p></div>"
        f"<article><header><h1>Title &amp; more</h1></header><p>{LONG}</p><!-- <p>hidden</p> --><div class=ad><p>{LONG}</p></div>"
        f"<p>Short\n  one&nbsp;here<br>same block<p>x &lt; y &eacute; &#39;q&#39;<ul><li>item one<li>item two</ul>"
        f"<ul><li><a href=/1>Another story</a><li><a href=/2>One more story to read</a></ul>"
        f"<form><p>{LONG}</p><input><button>Go</button></form><div style='display: none'>gone</div></article>"
        f"<section class='comments'><article class=comment><p>{LONG}</p></article></section><div class='newsletter-box'>Join us</div>"
    ))
    assert text == f"Title & more\n{LONG}\nShort one here same block\nx < y é 'q'\nitem one\nitem two"


def test_pages_without_an_article_use_neighbours():
    text = main_text(page(
        f"<div><p><a href=/x>Link one</a> <a href=/y>link two</a></p><p>After links</p></div>"
        f"<div><h2>Heading</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>Also short.</p></div><p>(c) 2024 someone</p><p>the end</p>"
    ))
    assert text == f"Heading\n{LONG}\nShort.\n{LONG}\nAlso short."


def test_inheritance_equals_brute_force():
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from([True, False, None]), max_size=12))
    def run(labels):
        want = []
        for i, own in enumerate(labels):
            known = [(abs(i - j), v) for j, v in enumerate(labels) if v is not None]
            near = [v for d, v in known if d == min(known)[0]]
            want.append(own if own is not None else any(near) if near else True)
        assert _inherited(labels) == want

    run()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("<>/\"'=!- apdivrtcl&;x\n")), max_size=80))
def test_any_markup_gives_clean_lines(markup):
    for line in main_text(markup).split("\n"):
        assert line == " ".join(line.split())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    for r in extract(pages(spark, f"/root/testdata/{sf}")).join(pages(spark, f"/root/testdata/{sf}"), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(p for p in parts if p)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_odd_rows(spark):
    rows = [(1, "u", page(f"<p>{LONG}"), 5), (1, "u", page(f"<p>{LONG}"), 5), (None, None, None, None), (3, None, "", 1), (4, "v", "<" * 50000 + "<p>" + LONG * 2000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    out = extract(df).collect()
    assert [r["text"] for r in out[:4]] == [LONG, LONG, "", ""]
    assert out[4]["text"].endswith(LONG) and out[4]["n_chars"] == len(out[4]["text"])
    assert extract(df.where("false")).collect() == []


@pytest.mark.parametrize("name", [
    "has-sidebar", "no-sidebar", "with-sidebar", "two-columns-no-sidebar", "comments-open", "has-related-posts", "share-enabled", "hidden-print",
    "hidden-xs", "overflow-hidden", "ad-free", "nav-open", "modalOpen",
])
def test_states_of_a_page_do_not_cut_it(name):
    for tag in ("div", "main", "article", "section"):
        for kind in ("class", "id"):
            assert main_text(page(f"<{tag} {kind}='{name} x'><h1>Title</h1><p>{LONG}</p></{tag}>")) == f"Title\n{LONG}"


def test_regions_by_name_unless_they_hold_an_article():
    for name in ("sidebar", "left-sidebar", "site-footer", "postComments", "visually-hidden", "is-hidden", "ad has-image", "comment-body"):
        assert main_text(page(f"<div><p>{LONG}</p></div><div class='{name}'><p>{LONG}</p></div>")) == LONG
    for mark in ("article", "main", "main class='widgets'"):
        assert main_text(page(f"<div class='sidebar-right'><div class=widget><{mark}><p>{LONG}</p></{mark.split()[0]}></div></div>")) == LONG
    assert main_text(page(f"<article><p>{LONG} Also <span class=share>Share this</span> here.</p></article>")) == f"{LONG} Also here."


def test_teaser_articles_are_not_the_story():
    teasers = "".join(f"<article class=card><h3><a href=/{i}>Another story {i}</a></h3><p>By Ann</p></article>" for i in range(6))
    story = f"<div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
    for inner in (story + teasers, teasers + story):
        assert main_text(page(inner)) == f"Title\n{LONG}\nShort.\n{LONG}"
    foreign = "Wieczorem mieszkańcy zebrali się nad rzeką, aby wspólnie świętować jubileusz założenia miasteczka."
    assert main_text(page(f"<div><h1>Tytuł</h1><p>{foreign}</p></div>{teasers}")) == f"Tytuł\n{foreign}"


def test_text_outside_a_wrong_mark():
    assert main_text(page(f"<article><p>{LONG}</p></article><div><p>{LONG} {LONG}</p><p>Short.</p></div>")) == f"{LONG}\n{LONG} {LONG}\nShort."
    much = f"<p>{LONG} {LONG}</p>" * 9
    text = main_text(page(f"<article>{much}</article><p>We use cookies.</p><p>{LONG}</p><p>{LONG} {LONG}</p>"))
    assert text == "\n".join([f"{LONG} {LONG}"] * 10)
    articles = main_text(page(f"<article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}</p></article>"))
    assert articles == f"One\n{LONG}\nTwo\n{LONG}"


def test_unmarked_boilerplate_in_an_article():
    advert = "<p>Big summer sale! Running shoes, jackets, tents: save 50%! <a href=/s>Shop outdoor gear now</a></p>"
    links = "<p><a href=/1>Another story</a></p>"
    text = main_text(page(
        f"<article><h1>Title</h1><p>{LONG}</p>{advert}<p>Short.</p><p>{LONG}</p>{links}<p>More from us</p>{links}<p>Copyright 2024 The Paper</p></article>"
    ))
    assert text == f"Title\n{LONG}\nShort.\n{LONG}"


def test_much_text_outweighs_the_name_of_its_region():
    story = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    want = f"Title\n{LONG}\nShort.\n{LONG}"
    for inner in (
        f"<form id=aspnetForm><div>{story}</div><div class=comments><p>{LONG}</p></div></form>",
        f"<form><article>{story}</article></form>",
        f"<div class='elementor-widget elementor-widget-text-editor'><div class=widget-container>{story}</div></div>",
        f"<div id='social-post'>{story}</div>",
        "".join(f"<div class='block-widget'>{part}</div>" for part in re.findall(r"<(?:p|h1)>.*?</(?:p|h1)>", story)),
        f"<aside><main>{story}</main></aside>",
        f"<div role=form>{story}<div class=ad><p>{LONG}</p></div></div>",
    ):
        assert main_text(page(inner)) == want
        assert main_text(inner) == want
    assert main_text(page(f"<div class=comments>{story}</div>")) == ""
    assert main_text(page(f"<p>{LONG}</p><div class=comments>{story * 9}</div><aside><article>{story}</article></aside>")) == LONG


def test_elements_that_are_never_closed():
    story = f"<h1>Title</h1><p>{LONG}</p>"
    for tag in ("nav", "button", "menu", "header", "select", "form", "aside"):
        for body in (f"<div>{story}</div>", f"<article>{story}</article>", f"<nav><a href=/>x</a></nav><section>{story}</section>"):
            assert main_text(f"<html><body><{tag}><a href=/a>A</a> <a href=/b>B</a>{body}</body></html>") == f"Title\n{LONG}"


def test_readers_comments_and_labelled_adverts_in_an_article():
    advert = f"<p>Advertisement: {LONG}</p>"
    for heading in ("<h3>12 Comments</h3>", "<p>Comments (3)</p>", "<h2>Leave a reply</h2>", "<h4>Kommentare</h4>"):
        text = main_text(page(f"<article><h1>Title</h1><p>{LONG}</p>{advert}<p>Sponsored</p><p>No comments so far.</p><p>{LONG}</p>{heading}<p>{LONG}</p></article>"))
        assert text == f"Title\n{LONG}\nNo comments so far.\n{LONG}"


def test_deep_nesting_takes_linear_time():
    from time import process_time

    def seconds(n):
        begun = process_time()
        for open_tags, stray in (("<div>", "</span>"), ("<div class=widget>", "</b>"), ("<form><div class=sidebar><article>", "</p>"), ("<nav>", "</i>")):
            assert main_text(open_tags * n + f"<p>{LONG}</p>" + stray * n) == LONG
        return process_time() - begun

    seconds(1000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.05)
