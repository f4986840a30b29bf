"""Pages without end tags of heads are read like those with them."""

import pytest

from pulseframe.llm import extraction

STORY = "<article><header><h1>The title</h1></header><p>One paragraph, long enough.</p></article>"


def read(html):
    return [(b.text, b.features) for b in extraction.blocks(html)]


@pytest.mark.parametrize(
    "head",
    [
        "<head><title>T</title><meta charset=utf-8>",
        "<head><title>T</title><script>var a = \"<body><p>no</p></head>\";</script>",
        "<HEAD><TITLE>T</TITLE><style>p {}</style><!-- <p> -->",
        "<head><title>T",
    ],
)
def test_head_without_end(head):
    """The head ends where it ends, not at a header."""
    for body in ("<body>", "</head><body>") if head.endswith("T") else ("", "<body>", "</head>", "</head ><body>"):
        page = "<html>" + head + body + STORY + "<p>Late.</p><header>Bar</header>"
        plain = "<html>" + ("<body>" if "body" in body else "") + STORY + "<p>Late.</p><header>Bar</header>"
        assert read(page) == read(plain)
        assert [b[0] for b in read(page)] == ["The title", "One paragraph, long enough.", "Late.", "Bar"]
        assert "t:article" in read(page)[0][1]


def test_unread_elements_end_at_their_own_name():
    assert [b.text for b in extraction.blocks("<svg><title>a</title></svgs>x</svg><p>y")] == ["y"]
    assert [b.text for b in extraction.blocks("<head><script>a<body><p>y")] == ["y"]
    assert extraction.blocks("<script><body>" * 20_000) == []
