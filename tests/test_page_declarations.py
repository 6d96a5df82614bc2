"""Pages with declarations that html.parser rejects keep what stands around them."""

import pytest

from botqa.sources.pages import extract_page


@pytest.mark.parametrize("bad", ["<![ endif]>", "<![foo]>", "<![]>", "<![if IE>", "<![endif]>", "<![if !IE]>", "<!-- [if IE]> x <![endif] -->"])
def test_body_around_a_declaration_survives(bad):
    page = f"<html><head><title>T</title></head><body><p>before</p>{bad}<p>after</p><![endif]><p>end</p></body></html>"
    assert extract_page(page) == ("before\nafter\nend", "T")


def test_declaration_at_the_end():
    assert extract_page("<title>T</title><body><p>whole body</p><![foo")[0].startswith("whole body")
