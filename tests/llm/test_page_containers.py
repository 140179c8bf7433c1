import pytest

from wardspark.llm.tag_paths import main_text

LONG = "".join(f"<p>{'Words of a long paragraph, with marks; ' * 10}number {i}.</p>" for i in range(24))
CELLS = "".join(f"<tr><td>{i} a cell</td><td>{i} b cell</td></tr>" for i in range(10))
NESTED = f"<table>{CELLS}</table><div>Short one.<div>Deeper</div></div><section><p>Brief</p></section><p>End</p>"
SHORT = [f"{i} {c} cell" for i in range(10) for c in "ab"] + ["Short one.", "Deeper", "Brief", "End"]
MENU = "<div><a href='/'>Start</a></div>"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div><div>{}</div></div>", "{}"])
def test_short_text_nested_in_a_long_article(wrap):
    page = f"<html><body>{wrap.format(LONG + NESTED + '<div class=comments><p>no remark</p></div>')}<footer>no footer</footer></body></html>"
    text = main_text(page)
    assert text.count("number") == 24 and " ".join(SHORT) in text and "no " not in text


def test_what_stands_beside_the_article_is_left():
    page = f"<html><body>{MENU}<article>{LONG}{NESTED}</article>{MENU}{'A stray remark of the page, as it happens; long. ' * 3}{MENU}</body></html>"
    text = main_text(page)
    assert " ".join(SHORT) in text and "Start" not in text


def test_deep_nesting():
    assert main_text("<article>" + LONG + "<div>x" * 3000 + "</article>").count("x") == 3000
