"""Pages are read along the wrapper of their host, marked ones too."""

import json

from dwellrank.llm import wrappers

MARKED = "<body><div>Menu {k}</div><article><h1>Head {k}</h1><p>One {k}</p></article><div>Below {k}</div></body>"


def wrapper(pages):
    w = wrappers.Wrapper()
    for page in pages:
        w.align(page)
    return w


def test_order_makes_optional_and_repeated_groups():
    shown = wrapper(["<body><h1>a</h1><p>b<p>c</body>", "<body><h1>d</h1><p>e</p><ul></ul></body>"]).expression()
    assert shown == "<body><h1>#TEXT(<p>#TEXT)+(<ul>)?"
    shown = wrapper(["<body><h2>a</h2><p>b</p><h2>c</h2><p>d</p><hr><div>x</div></body>"]).expression()
    assert shown == "<body>((<h2>#TEXT)?(<p>#TEXT)?)+<div>#SAME"
    # what comes in either order on different pages is repeated as well
    assert wrapper(["<body><h1>a</h1><p>b</p></body>", "<body><p>b</p><h1>c</h1></body>"]).expression() == "<body>((<h1>#TEXT)?(<p>#SAME)?)+"


def test_reading_follows_the_expression():
    expression, _ = wrapper(["<body><h1>a</h1><p>b</p><ul></ul></body>"]).plan()
    assert [s is None for s, _ in wrappers.read("<body><h1>x</h1><p>y</p></body>", expression)] == [False, False]
    assert [s is None for s, _ in wrappers.read("<body><p>y</p><h1>x</h1></body>", expression)] == [False, True]  # the other order
    assert [s is None for s, _ in wrappers.read("<body><p>y</p><p>z</p></body>", expression)] == [False, True]  # no repetition
    assert wrappers.main_text("<body><p>y</p><h1>x</h1></body>", expression) == "y\nx"


def test_marked_pages_get_their_text_from_the_wrapper():
    pages = [MARKED.format(k=k) for k in range(4)]
    expression, template = wrapper(pages).plan()
    assert wrappers.main_text(pages[1], expression, frozenset(template)) == "Head 1\nOne 1"
    nodes, place = json.loads(expression)
    headline = next(slot for slot, text in wrappers.read(pages[1], expression) if text == "Head 1")
    other = json.dumps([nodes, place[:headline] + "3" + place[headline + 1 :]])
    assert wrappers.main_text(pages[1], other, frozenset(template)) == "One 1"  # not read from the tags
