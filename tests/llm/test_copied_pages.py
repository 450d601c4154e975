"""Copies of one page are no template."""

from dwellrank.llm import wrappers

PAGE = "<body><div class=content><h1>Title {k}</h1><p>Body {k}</div><div class=text>Always the same line.</div></body>"


def read(pages):
    w = wrappers.Wrapper()
    for page in pages:
        w.align(page)
    root, template = wrappers.Wrapper.loads(w.dumps()).plan()
    return [wrappers.main_text(page, root, frozenset(template)) for page in pages]


def test_copies_keep_their_text():
    assert read([PAGE.format(k=1)] * 5) == ["Title 1\nBody 1\nAlways the same line."] * 5


def test_copies_among_other_pages():
    texts = read([PAGE.format(k=k) for k in (1, 1, 1, 2, 3, 4)])
    assert texts == [f"Title {k}\nBody {k}" for k in (1, 1, 1, 2, 3, 4)]


def test_headline_on_copies_only():
    """A path that only the copies have."""
    copy = "<body><div class=content><h2>Only here</h2><p>Copied</div><div class=text>Always the same line.</div></body>"
    texts = read([copy] * 4 + [PAGE.format(k=k) for k in range(4)])
    assert texts[0] == "Only here\nCopied" and texts[4] == "Title 0\nBody 0"
