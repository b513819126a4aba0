"""Pages without article and main, with menus, comments, adverts and forms, against what an author wrote: density has to find the article."""

import pytest

from molspark.llm.html import main_text

PROSE = [
    "The old lighthouse stood at the very end of the cape, and every evening its keeper climbed the two hundred steps to light the lamp, whatever the weather was like.",
    "Ships from the north passed so close to the rocks that a single dark night would have been enough to lose one, and nobody in the village had forgotten the winter of the great storm.",
    "When the harbour was rebuilt, engineers measured the currents for a whole year before a single stone was laid, which the town council thought far too long and far too expensive.",
    "In the end the new pier was longer than planned by forty metres, and it has stood without repair ever since, as the annual reports of the port authority show in some detail.",
    "Visitors may walk out to the lamp in summer, but the gate is closed when the wind rises, because waves reach the path long before they look dangerous from the shore.",
]
SECOND = [
    "Bread dough that rests overnight in a cool kitchen needs far less yeast than recipes usually say, and the slow rise gives it a flavour that no shortcut can imitate.",
    "Weigh the flour and the water, since cups are never twice the same, and write down what you used, so that a good loaf can be repeated and a bad one understood.",
    "Fold the dough four times in the first two hours; it will turn from a wet heap into something smooth that holds its shape when it is tipped onto the table.",
    "Bake it dark. The crust carries most of the taste, and a pale loaf, however pretty, is soft again before the evening and stale on the following morning.",
]
MENU = '<ul>' + "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in "home news sport weather travel contact about".split()) + "</ul>"
COMMENTS = "".join(f"<div><b>reader{i}</b><p>I {w} this, thanks for writing.</p><a href='#r'>Reply</a> <a href='#f'>Flag</a></div>" for i, w in enumerate(("liked", "hated", "read", "shared", "printed")))
LINKS = "".join(f'<li><a href="/x/{i}">Ten things about topic number {i} that you should read today</a></li>' for i in range(8))
FOOT = '<p><a href="/terms">Terms</a> <a href="/privacy">Privacy</a> Copyright 2020</p>'
FORM = '<form action="/s"><label>Your mail</label><input name="m"><button>Send</button></form>'


def article(title, prose, heading):
    half = len(prose) // 2
    return f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in prose[:half]) + f'<h2 id="{heading.lower().replace(" ", "-")}">{heading}</h2>' + "".join(f"<p>{p}</p>" for p in prose[half:])


LAYOUTS = {
    "divs": lambda a: f'<body><div id="nav">{MENU}</div><div class="post-content">{a}</div><div id="comments">{COMMENTS}</div><div id="footer">{FOOT}</div></body>',
    "two columns": lambda a: f'<body><nav>{MENU}</nav><div class="row"><div class="col">{a}</div><div class="sidebar"><ul>{LINKS}</ul></div></div><footer>{FOOT}</footer></body>',
    "table": lambda a: f'<body><table><tr><td class="menu">{MENU}</td><td>{a}</td></tr></table>{FORM}<div class="footer">{FOOT}</div></body>',
    "advert inside": lambda a: f'<body><header>{MENU}</header><div><div>{a.replace("</p>", "</p><div class=ad>Buy one, get one free!</div>", 1)}</div></div><div class="comment-list">{COMMENTS}</div></body>',
    "deep": lambda a: f'<body><div><div><div class="menubar">{MENU}</div><div><div><section>{a}</section></div></div><aside><ul>{LINKS}</ul></aside></div></div><div class="newsletter-signup">{FORM}</div></body>',
    "comments after": lambda a: f'<body><div class="page"><div class="text">{a}</div><div class="user-comments">{COMMENTS}</div><div class="related-posts"><ul>{LINKS}</ul></div></div></body>',
}
ARTICLES = {
    "plain": ("The lighthouse", PROSE, "How it was built"), "cookies": ("On baking", SECOND, "Session cookies"),
    "comments": ("Style of code", PROSE[1:], "Comments in C"), "toolbar": ("A review", SECOND + PROSE[:1], "Navigation and the toolbar"),
}


@pytest.mark.parametrize("words", sorted(ARTICLES))
@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_article_without_landmarks(layout, words):
    title, prose, heading = ARTICLES[words]
    half = len(prose) // 2
    page = f"<!DOCTYPE html><html><head><title>{title} | Site</title></head>{LAYOUTS[layout](article(title, prose, heading))}</html>"
    assert main_text(page) == " ".join([title, *prose[:half], heading, *prose[half:]])


def test_names_delete_nothing_of_an_article():
    page = ('<article><h1>T</h1><p>P1</p><h2 id="session-cookies">Session cookies</h2><p>P2</p><section id="comments-in-c"><h2>Comments in C</h2><p>P3</p></section>'
            '<div class="widget"><p>P4</p></div><table class="widget"><tr><td>P5</td></tr></table><div id="sidebar-layouts-in-css"><p>P6</p></div></article>')
    assert main_text(page) == "T P1 Session cookies P2 Comments in C P3 P4 P5 P6"


@pytest.mark.parametrize("blanks", [0, 5, 65, 5000])
def test_blanks_around_attributes(blanks):
    b = " " * blanks
    assert main_text(f'<p>before <a title{b}={b}"x>y">text</a> after</p>') == "before text after"
