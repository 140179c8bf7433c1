import math
import random
import time

import numpy as np
import pytest

from wardspark.llm import tag_paths
from wardspark.llm.tag_paths import main_text, names_outside, nodes, select

PARAGRAPH = "<p>" + "Words of a long paragraph, with marks; " * 10 + "</p>"
ASIDE = "<div class=sidebar><p>Other things, said beside it.</p></div>"


@pytest.mark.parametrize("wrap, also", [
    ('<div class="post no-sidebar">{}</div>', ""), ('<div id="main" class="content with-ads">{}</div>', ""), ('<div class="social-science-article">{}</div>', ""), ("<form action=x>{}</form>", ""),
    ('<article><div id="search-algorithms"><h2>Search algorithms</h2>{}</div></article>', "Search algorithms"), ('<article>{}<section class="related-work"><p>Related work</p></section></article>', "Related work"),
    ('<article>{}<table id="share-prices"><tr><td>4 euro</td></tr></table></article>', "4 euro"), ('<article><p class="byline">By A. Writer</p>{}</article>', "By A. Writer"),
    ('<article>{}<ul aria-label="tags"><li>one</li></ul></article>', "one"), ('<main><section class="comments">{}</section></main>', ""), ('<div class="widget">{}</div>', ""),
])
def test_names_take_no_article_away(wrap, also):
    text = main_text(f"<html><body><nav>Menu</nav>{wrap.format(PARAGRAPH * 4)}{'' if 'widget' in wrap or 'form' in wrap or 'comments' in wrap else ASIDE}<footer>Foot</footer></body></html>")
    assert text.count("Words of") == 40 and also in text and "beside it" not in text and "Menu" not in text and "Foot" not in text


@pytest.mark.parametrize("name", ["ad", "sidebar-left", "cookie-notice", "site_footer", "main-nav", "comments", "comment-list", "reader-comments", "x sidebar", "AD-slot", "share-buttons", "related-links", "newsletter-signup", "widget2"])
def test_names_of_other_containers(name):
    assert names_outside(name)
    page = f"<body><div>{PARAGRAPH * 3}<div class='{name}'><p>Not of the article, though it has marks, and words.</p></div></div></body>"
    assert "Not of" not in main_text(page) and main_text(page).count("Words of") == 30


@pytest.mark.parametrize("name", ["no-sidebar", "with-ads", "has-comments", "search", "tags", "share", "related", "alert", "skip", "byline", "content", "main", "box", "advent", "", "42", "loading", "menu-engineering"])
def test_names_that_say_nothing(name):
    assert not names_outside(name)


def ratios(blocks, share=0.1):
    """Which blocks are chosen by their own path's ratio, by plain sums."""
    place = [(b.outside, b.marked, b.path) for b in blocks]
    mean = lambda key, values: sum(v for p, v in zip(place, values) if p == key) / place.count(key)
    punctuation = [sum(c in ".,;:!?…。，、；：！？؟،।" for c in b.text) for b in blocks]
    lengths = [0.0 if b.outside else mean(p, [len(x.text) for x in blocks]) for b, p in zip(blocks, place)]
    marks = [0.0 if b.outside else mean(p, punctuation) for b, p in zip(blocks, place)]
    kernel = [math.exp(-d * d / 2) for d in range(-2, 3)]
    smooth = lambda v: [sum(k * v[min(max(i + d, 0), len(v) - 1)] for d, k in zip(range(-2, 3), kernel)) / sum(kernel) for i in range(len(v))]
    fused = [0.0 if b.outside else x * (1 + y) * (tag_paths.MARKED_SHARE if b.marked else 1) for b, x, y in zip(blocks, smooth(lengths), smooth(marks))]
    per_path = [mean(p, fused) for p in place]
    deviation = math.sqrt(sum((f - sum(fused) / len(fused)) ** 2 for f in fused) / len(fused))
    bound = min(deviation, share * max(per_path))
    return [not b.outside and r > 0 and r >= bound * (1 - 1e-12) for b, r in zip(blocks, per_path)], per_path, bound


def inherited(blocks, chosen):
    """Those, and what stands in their containers or nested in them."""
    kept = [b.block for b, c in zip(blocks, chosen) if c]
    framed = sum(len(b.text) * (1 if b.block.frame else -1) for b, c in zip(blocks, chosen) if c)

    def inside(block):
        while block is not None:
            if any(block is k for k in kept) and (framed > 0 or not block.frame):
                return True
            block = block.around
        return False

    return [not b.outside and (any(b.block is k for k in kept) or inside(b.block)) for b in blocks]


@pytest.mark.parametrize("seed", range(60))
def test_second_implementation_of_the_ratios(seed):
    draw = random.Random(seed)
    tags = ["div", "p", "section", "ul", "li", "h2", "td", "table", "article", "nav", "div class=ad", "div class=post", "b", "form", "footer"]

    def element(depth):
        tag = draw.choice(tags)
        inner = "".join(element(depth + 1) if depth < 5 and draw.random() < 0.5 else "Some words" + draw.choice([", ", " ", ". "]) * draw.randrange(1, 9) + "x" * draw.randrange(80) for _ in range(draw.randrange(1, 5)))
        return f"<{tag}>{inner}" + (f"</{tag.split()[0]}>" if draw.random() < 0.9 else "")

    blocks = nodes("<body>" + "".join(element(0) for _ in range(6)) + "</body>")
    chosen, per_path, bound = ratios(blocks)
    if min((abs(r - bound) for r in per_path), default=1) > 1e-9 * max(per_path, default=1):  # no tie that rounding decides
        assert select(blocks) == inherited(blocks, chosen)


def test_paths_are_told_apart_by_their_tags():
    blocks = nodes("<div><p>a</p><ul><li>b</ul></div><div><p>c</p></div><section><p>d</p></section>")
    assert blocks[0].path == blocks[2].path and len({b.path for b in blocks}) == 3


def test_time_grows_with_the_page():
    start = time.process_time()
    assert len(main_text("<div>x" * 50_000)) == 99_999
    assert main_text("<b><i>" * 20_000 + "<p>deep, text.") == "deep, text."
    assert main_text("</section>" * 50_000 + "<p>text, here.") == "text, here."
    assert time.process_time() - start < 20


def test_smoothing_keeps_sums():
    assert np.allclose(tag_paths._smooth(np.ones(7)), 1)
