"""Main text of pages of which the tree once lost article text or kept furniture."""

import itertools

import numpy as np
import pytest

from gridloom.llm import html

LONG = "The river rose again in the night and by the morning the lower fields were under water, so that the farmers had to bring their cattle up to the road before the bridge was closed to all but the engineers and the crews of the two boats that went out at noon."
OTHER = LONG.replace("river", "lake").replace("farmers", "keepers")
LINKS = '<li><a href="/1">First other story</a></li><li><a href="/2">Second other story</a></li>'


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{LONG}</p><p>{OTHER}</p></article><nav><ul>{LINKS}</ul></nav>", [LONG, OTHER]),
        (f'<main><p>{LONG}</p><p>So it was.</p></main><footer><a href="/">Home of the site</a></footer>', [LONG, "So it was."]),
        (f'<article><p>{LONG}</p><div class="related"><ul>{LINKS}</ul></div><p>{OTHER}</p></article>', [LONG, OTHER]),
        (f"<article><p>{LONG}</p><ul>{LINKS}</ul><p>{OTHER}</p></article>", [LONG, OTHER]),
        (f'<nav>Menu <a href="/">Home</a></nav><article><p>{LONG}</p></article>', [LONG]),
        (f'<div class="cookie">We use cookies, please accept.</div><article><p>{LONG}</p></article>', [LONG]),
        (f'<div class="ad">Buy two, pay one.</div><p>{LONG}</p>', [LONG]),
        (f"<form><label>Name</label><p>Tell us who you are.</p></form><article><p>{LONG}</p></article>", [LONG]),
        (f'<article><p>{LONG}</p></article><div id="comments"><p>I was there and saw it.</p><p>{OTHER}</p><p>Me too.</p><p>{OTHER}</p></div>', [LONG]),
        (f'<div><a href="/">Home</a></div><h1>The flood</h1><p>{LONG}</p><p>No one slept.</p><p>{OTHER}</p><div>Imprint</div>', ["The flood", LONG, "No one slept.", OTHER]),
    ],
)
def test_main_text_beside_links_furniture_and_long_blocks(page, want):
    assert html.main_text(page).split("\n") == want


def test_place_and_own_links_decide():
    """Whatever stands beside it: furniture is never text, unlinked text of an article always is."""
    beside = list(itertools.product((0, 1, 5, 14, 43, 200), (0, 1, 5, 14, 43, 200), (0.0, 0.4, 1.0), (0.0, 0.4, 1.0), (0, 1)))
    for place in html.PLACES:
        for own, links in itertools.product((1, 5, 14, 43, 200), (0.0, 0.2)):
            x = np.array([[pw, own, nw, pl, links, nl, *(float(place == p) for p in html.PLACES), heading] for pw, nw, pl, nl, heading in beside])
            if place != "plain":
                assert (html.classify(x) == (place == "main")).all(), (place, own, links)


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<article class="post category-reviews"><p>{LONG}</p><p>Short.</p></article>', [LONG, "Short."]),
        (f'<article><h2>Methods</h2><p>{LONG}</p><section id="discussion"><h2 id="discussion">Discussion</h2><p>{OTHER}</p><p>Short.</p></section></article>', ["Methods", LONG, "Discussion", OTHER, "Short."]),
        (f'<form id="aspnetForm"><nav><a href="/">Home</a></nav><article><p>{LONG}</p><p>Short.</p></article></form>', [LONG, "Short."]),
        (f'<form id="aspnetForm"><div><p>{LONG}</p><p>Short.</p><p>{OTHER}</p></div></form>', [LONG, "Short.", OTHER]),
        (f'<article title="a hidden valley"><p>{LONG}</p><p class="x hidden lg:block">Short.</p></article>', [LONG, "Short."]),
        (f'<div class="site has-comments"><article><p>{LONG}</p><p>Short.</p></article></div>', [LONG, "Short."]),
        (f'<article><p>{LONG}</p><p hidden>Not seen.</p><p HIDDEN="">Nor this.</p><p style="color:red; display: none">Nor that.</p><p aria-hidden="true">Nor these.</p></article>', [LONG]),
        (f'<article><p>Short.</p></article><section id="comments"><p>{LONG}</p><p>{OTHER}</p></section>', ["Short."]),
        (f'<article><p>{LONG}</p></article><section id="discussion"><p>I was there.</p><p>{OTHER}</p></section>', [LONG]),
        (f'<article><p>{LONG}</p></article><article class="comment" id="comment-7"><p>{OTHER}</p></article>', [LONG]),
        (f'<h1>The flood</h1><p>{LONG}</p><div id="comments"><p>{OTHER}</p><p>{OTHER}</p></div>', ["The flood", LONG]),
        (f'<form class="login"><p>{LONG}</p></form><main><p>Short.</p></main>', ["Short."]),
    ],
)
def test_names_and_wrappers_do_not_take_articles(page, want):
    assert html.main_text(page).split("\n") == want


SIXTY = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<article><div title="a hidden gem"><p>{SIXTY}</p></div></article>', SIXTY),
        (f'<article><div class="md hidden lg:block"><p>{SIXTY}</p></div></article>', SIXTY),
        (f'<article><div data-id="sidebar" data-hidden="no"><p>{SIXTY}</p></div></article>', SIXTY),
        (f'<article class="discussion"><p>{SIXTY}</p></article>', SIXTY),
        (f'<article><p title="x>{SIXTY}</p></article>', SIXTY),
        (f"<article><p title='x>{SIXTY}</p></article>", SIXTY),
        (f'<div class="popular science"><p>{SIXTY}</p><p>{SIXTY}</p></div><footer>(c) us</footer>', f"{SIXTY}\n{SIXTY}"),
        (f'<div id="contact"><p>{SIXTY}</p><div class="ad"><p>{SIXTY}</p></div><p>{SIXTY}</p><p>{SIXTY}</p></div>', f"{SIXTY}\n{SIXTY}\n{SIXTY}"),
        (f'<div class="notice"><p>{SIXTY}</p><p>{SIXTY}</p></div><article><p>{SIXTY}</p></article>', SIXTY),
        (f'<div class="cookie-notice"><p>{SIXTY}</p></div>', ""),
        (f'<div class="content"><p>A short post.</p></div><div class="sidebar"><p>{SIXTY}</p><p>{SIXTY}</p></div>', "A short post."),
        (f'<div><p>The shop is closed until the end of the month.</p></div><div class="promo"><p>{SIXTY}</p><p>{SIXTY}</p></div>', None),
        (f"<aside><p>{SIXTY}</p><p>{SIXTY}</p></aside>", ""),
    ],
)
def test_attributes_and_names_round_all_of_a_text(page, want):
    got = html.main_text(f"<html><body>{page}</body></html>")
    assert got == want if want is not None else SIXTY not in got


HARMLESS = ["", ' title="a hidden gem"', ' class="md hidden lg:block"', ' data-id="sidebar"', ' data-role="nav" data-class="ad"', ' lang="en" id=x1', " title='say \"comments\" > here'", ' class="related-work-of-art"', ' style="color:red"', ' aria-label="menu"']
ROUND = [
    '<nav{a}><a href="/{n}">Link {n}</a> <a href="/x">Other</a></nav>', '<div class="ad"{a}>Buy this thing number {n}, it is the best of all things that you can buy today.</div>',
    '<aside{a}><p>Something else to read, number {n}, by the same person, who wrote a lot.</p></aside>', '<div class="cookie-notice">We use cookies, {n} of them, and you have to accept all of them now.</div>',
    '<section id="comments"{a}><h3>Comments</h3><p>I read all {n} of these lines and I agree with most of what they say about it.</p></section>', '<form{a}><label>Name {n}</label><input><button>Send</button></form>',
    '<script{a}>var t = "<p>{n}</p>";</script>', '<style>p > b {{ margin: {n} }}</style>', '<!-- <p>{n}</p> -->', '<ul class="menu"{a}><li>Home {n}</li><li><a href="/">Away</a></li></ul>',
]


def test_generated_pages(spark):
    """Articles between random furniture, their elements with attributes that say nothing about them."""
    import random

    rng = random.Random(8)
    words = "the river runs past a mill and further on under two bridges to some harbour where ships wait".split()
    rows, want = [], {}
    for page in range(300):
        furniture = lambda: "".join(rng.choice(ROUND).format(n=rng.randrange(100), a=rng.choice(HARMLESS[:1] + HARMLESS[3:5])) for _ in range(rng.randrange(4)))
        said = [" ".join(rng.choices(words, k=rng.choice([3, 8, 25, 60, 300]))) for _ in range(rng.randrange(1, 6))]
        inner = "".join(f"<p{rng.choice([a for a in HARMLESS if 'related' not in a])}>{t}</p>" for t in said)
        if rng.random() < 0.5:
            inner = f"<div{rng.choice(HARMLESS[:7])}>{inner}</div>"
        rows.append((page, "u", f"<html><body>{furniture()}<article{rng.choice(HARMLESS)}>{inner}</article>{furniture()}</body></html>"))
        want[page] = "\n".join(said)
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [(rows[k][2][:400], want[k][:100], got[k][:100]) for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), wrong[0])
