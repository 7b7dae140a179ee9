"""Line-block distribution against a plain walk over windows, and pages whose tags or class names mislead."""

import random

import numpy as np
import pytest

from prismtally.llm import htmltext

STORY = "Long story text of the page that goes on for a while. " * 3


def paragraph(word="story"):
    return f"<p>{STORY.replace('story', word)}</p>"


def count(page, word="Long story"):
    return htmltext.main_text(page).count(word)


def plain_surging(weights, window=htmltext.WINDOW):
    """The same rule line by line: grow a stretch while any of the last lines weighs something."""
    stretches, current = [], None
    for i in range(len(weights)):
        recent = weights[max(0, i - window + 1) : i + 1]
        if sum(recent) > 0:
            if current is None:
                current = {"first": i, "peak": 0}
            current["peak"] = max(current["peak"], sum(recent))
            if weights[i]:
                current["end"] = i + 1
        elif current is not None:
            stretches.append(current)
            current = None
    if current is not None:
        stretches.append(current)
    top = max((s["peak"] for s in stretches), default=0)
    kept = [(s["first"], s["end"]) for s in stretches if s["peak"] >= htmltext.SURGE and s["peak"] >= htmltext.SURGE_SHARE * top]
    return kept or [(s["first"], s["end"]) for s in stretches if s["peak"] == top][:1]


def test_windows_match_a_plain_walk():
    rng = random.Random(3)
    for _ in range(3000):
        weights = [rng.choice([0, 0, 0, rng.randint(1, 30), rng.randint(1, 300)]) for _ in range(rng.randint(0, 40))]
        found = htmltext.surging(htmltext.stretches(np.array(weights, np.int64)))
        assert found == plain_surging(weights), weights


@pytest.mark.parametrize(
    "open_, close",
    [
        ('<article class="post category-social">', "</article>"),
        ('<main class="tag-advertising">', "</main>"),
        ('<div class="content has-sidebar">', "</div>"),
        ('<div class="page-header"><h1>Title of it</h1>', "</div>"),
        ('<section id="newsletter-archive">', "</section>"),
    ],
)
def test_names_of_classes_do_not_lose_the_story(open_, close):
    assert count(f"<body><nav><a href=x>Home</a></nav>{open_}{paragraph() * 2}{close}<footer>Imprint</footer></body>") == 6


@pytest.mark.parametrize("tag", ["aside", "form", "nav"])
def test_side_elements_inside_the_story(tag):
    side = f"<{tag}><a href=y>more things to read</a> and some words</{tag}>"
    for wrap in ("{}", "<article>{}</article>", "<div class=story>{}</div>"):
        page = "<body><ul class=menu><li><a href=x>Home</a></ul>" + wrap.format(paragraph() + side + paragraph() * 2) + "<footer>Imprint 2020</footer></body>"
        text = htmltext.main_text(page)
        assert text.count("Long story") == 9 and "more things" not in text and "Imprint" not in text and "Home" not in text


def test_marked_paragraphs_and_links_stay():
    assert count(f'<article>{paragraph()}<p class="comment-worthy">Long story mark</p></article>') == 4
    assert "a link paragraph" in htmltext.main_text(f"<body>{paragraph()}<p><a href=x>a link paragraph</a></p>{paragraph()}</body>")


def test_what_is_beside_the_story_goes():
    page = (
        "<body><header><h1>Site</h1></header><div class='cookie-banner'>We use cookies to make this site work for you and all others.</div>"
        f"<div>{paragraph() * 3}</div><div class=sidebar><p>Short words beside</p></div><section class='comments'><p>{'Nice story, thanks a lot. ' * 4}</p></section>"
        "<div><p>Tiny.</p></div></body>"
    )
    text = htmltext.main_text(page)
    assert text.count("Long story") == 9 and not any(w in text for w in ("Site", "cookies", "beside", "Nice"))


def test_dense_areas_far_apart_are_all_kept():
    page = "<body>" + "<nav><a href=x>Home</a></nav>".join([paragraph("one"), paragraph("two") * 2, paragraph("three")]) + "</body>"
    text = htmltext.main_text(page)
    assert [text.count(f"Long {w}") for w in ("one", "two", "three")] == [3, 6, 3]


def test_pages_without_a_surge_or_without_text():
    assert htmltext.main_text("<body><p>Short.</p></body>") == "Short."
    for page in (None, "", "<body></body>", "<script>var x = 1</script>", "<nav><a href=x>Home</a></nav>"):
        assert htmltext.main_text(page) == ""
