"""Main text of hand-written page layouts, none of them that of the given pages or of the teacher."""

import random
import re

import pytest

from sparktide.llm import html_text

TITLE = "How the old bridge was rebuilt"
FIRST = "The bridge over the river had been closed for two years, and nobody in the town believed that it would open again before winter."
SECOND = "Work began in spring. Stones from the first pier were numbered, cleaned and laid back in the order in which they had been found."
THIRD = "Since then, carts have crossed it every day."
BODY = f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p>"
WANT = "\n\n".join((TITLE, FIRST, SECOND, THIRD))
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul>'
SIDE = "<h3>Most read</h3><ul><li><a href=/1>Ten walks near the coast</a></li><li><a href=/2>What the mayor said</a></li></ul>"

LAYOUTS = {
    "blog theme": f'<body class="post-template single single-post comments-open"><header id="masthead" class="site-header"><p class="site-title">Town paper</p></header><nav class="main-navigation">{MENU}</nav><div id="content" class="site-content"><main><article class="post hentry">{BODY}</article></main><aside id="secondary" class="widget-area">{SIDE}</aside></div><footer id="colophon"><p>Proudly printed in town.</p></footer></body>',
    "wrapper with a misleading name": f'<body><div class="has-sidebar page"><nav>{MENU}</nav><article>{BODY}</article><div class="sidebar">{SIDE}</div></div></body>',
    "article with a misleading id": f'<body><header>Town paper</header><article id="form-guide">{BODY}</article><footer>All rights reserved.</footer></body>',
    "share prices": f'<body><nav>{MENU}</nav><article class="share-prices">{BODY}</article></body>',
    "title in the article's header": f"<body><nav>{MENU}</nav><article><header><h1>{TITLE}</h1></header><p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p></article></body>",
    "site name in a plain div": f"<body><div>Town paper</div><article>{BODY}</article></body>",
    "div of content": f'<body><div id="topbar">{MENU}</div><div class="entry-content">{BODY}</div><div id="footer">Printed in town.</div></body>',
    "main only": f"<body><nav>{MENU}</nav><main>{BODY}</main><footer>Printed in town.</footer></body>",
    "roles": f'<body><div role="navigation">{MENU}</div><div role="main">{BODY}</div><div role="contentinfo">Printed in town.</div></body>',
    "cookie bar first": f'<body><div id="cookie-consent"><p>We use cookies to make this site better. By reading on, you agree to that.</p><button>Yes</button></div><article>{BODY}</article></body>',
    "advert between paragraphs": f'<body><article><h1>{TITLE}</h1><p>{FIRST}</p><div class="advert"><p>Buy two umbrellas and pay for one, this week only.</p></div><p>{SECOND}</p><p>{THIRD}</p></article></body>',
    "newsletter form inside": f'<body><article><h1>{TITLE}</h1><p>{FIRST}</p><form class="newsletter"><p>Get our letter every week.</p><input name=mail></form><p>{SECOND}</p><p>{THIRD}</p></article></body>',
    "reader comments": f'<body><article>{BODY}</article><section id="comments"><h2>Two replies</h2><ol><li class="comment"><p>I crossed it yesterday and it is wonderful, thank you for the story.</p></li><li class="comment"><p>My grandfather laid those stones.</p></li></ol></section></body>',
    "comments inside": f'<body><article>{BODY}<div class="comments"><div class="comment-body"><p>I crossed it yesterday and it is wonderful, thank you for the story.</p></div></div></article></body>',
    "related below": f'<body><article>{BODY}</article><div class="related"><a href=/1>Ten walks near the coast</a> <a href=/2>What the mayor said</a></div></body>',
    "share buttons": f'<body><article><h1>{TITLE}</h1><div class="social-share"><a href=#>Send</a> <a href=#>Post</a></div><p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p></article></body>',
    "breadcrumbs": f'<body><div class="breadcrumb"><a href=/>Home</a> &gt; <a href=/town>Town</a></div><main><article>{BODY}</article></main></body>',
    "page in a form": f'<body><form id="aspnetForm" action="x"><div id="nav">{MENU}</div><div id="main-content">{BODY}</div><div id="footer">Printed in town.</div></form></body>',
    "deep wrappers": f'<body class="menu-closed"><div id="page"><div class="outer"><div class="inner"><div class="col-8"><article class="node">{BODY}</article></div><div class="col-4 sidebar">{SIDE}</div></div></div></div></body>',
    "unclosed paragraphs": f"<body><nav>{MENU}</nav><article><h1>{TITLE}</h1><p>{FIRST}<p>{SECOND}<p>{THIRD}</article><footer>Printed in town.</footer></body>",
    "microdata": f'<body><header>Town paper</header><div itemprop="articleBody">{BODY}</div><footer>Printed in town.</footer></body>',
    "login overlay": f'<body><article>{BODY}</article><div class="modal login"><form><p>Log in to go on.</p><input><input></form></div></body>',
    "hidden parts": f'<body><article><h1>{TITLE}</h1><p>{FIRST}</p><p style="display: none">Never seen.</p><p>{SECOND}</p><script>var p = "<p>no</p>";</script><p>{THIRD}</p></article></body>',
    "navigation drawer": f'<body class="nav-open"><div class="drawer navigation">{MENU}</div><main class="story"><article>{BODY}</article></main></body>',
    "aside within": f'<body><article><h1>{TITLE}</h1><p>{FIRST}</p><aside class="promo"><h3>Our shop</h3><p>Mugs with the bridge on them.</p></aside><p>{SECOND}</p><p>{THIRD}</p></article><nav>{MENU}</nav></body>',
    "nothing but paragraphs": f"<html><body>{BODY}</body></html>",
}


@pytest.fixture(scope="module")
def forest():
    return html_text.fit()


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(forest, name):
    assert html_text.main_texts([LAYOUTS[name]], forest) == [WANT]


def test_unseen_taught_pages(forest):
    """On generated pages of another seed, few characters of content are lost and little furniture stays."""
    teacher, lost, kept, content, furniture = html_text.Teacher(4321), 0, 0, 0, 0
    for _ in range(200):
        nodes = html_text._nodes(html_text.parse(teacher.page()))
        html_text._measure(nodes)
        _, text = html_text.decide(nodes, forest.score(html_text.features(nodes)))
        marks = [False] * len(nodes)
        for node in nodes:
            marks[node.index] = node.mark if node.mark is not None else bool(node.parent and marks[node.parent.index])
            own = html_text._own_text(node)
            if marks[node.index]:
                content, lost = content + own, lost + own * (not text[node.index])
            else:
                furniture, kept = furniture + own, kept + own * bool(text[node.index])
    assert lost <= 0.03 * content and kept <= 0.06 * furniture


def test_ends_without_beginnings_and_deep_nests(forest):
    pages = ["<div>" + "</b>" * 30_000 + "x", "<li>" + "<div><li>" * 3000 + "x", "<b>" * 3000 + "<p>x" * 3000]
    assert len(html_text.main_texts(pages, forest)) == 3


def prose(rng, least, most):
    words = ["".join(rng.choices("aeinrstlou", k=rng.randint(2, 9))) for _ in range(rng.randint(least, most))]
    return " ".join(words).capitalize() + "."


def test_no_paragraph_of_plain_pages_is_lost(forest):
    """600 pages of one to eight paragraphs of any length in five frames: every paragraph stays."""
    rng, pages, wants = random.Random(5), [], []
    frames = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>"), ('<div id="content">', "</div>"), ("<div>", "</div>"))
    for _ in range(600):
        a, b = rng.choice(frames)
        parts = [prose(rng, 3, 60) for _ in range(rng.randint(1, 8))]
        pages.append("<html><body>" + a + "".join(f"<p>{p}</p>" for p in parts) + b + "</body></html>")
        wants.append("\n\n".join(parts))
    assert [(g, w) for g, w in zip(html_text.main_texts(pages, forest), wants) if g != w] == []


def test_bodies_of_all_kinds_in_all_layouts(forest):
    """520 bodies over the layouts: title, three paragraphs of random length, of which some hold links."""
    rng, wrong = random.Random(6), []
    for name, layout in LAYOUTS.items():
        for _ in range(20):
            new = {TITLE: prose(rng, 2, 9).rstrip("."), FIRST: prose(rng, 8, 60), SECOND: prose(rng, 4, 60), THIRD: prose(rng, 4, 40)}
            page, want = layout, []
            for old, text in new.items():
                linked = rng.random() < 0.2 and old != TITLE
                page = page.replace(old, text + (' <a href="/x">seen here</a>' if linked else ""))
                want.append(text + (" seen here" if linked else ""))
            if html_text.main_texts([page], forest) != ["\n\n".join(want)]:
                wrong.append((name, [len(w) for w in want]))
    assert len(wrong) <= 5, wrong


@pytest.mark.parametrize("frame", ["<main><h1>Reading list</h1><p>{}</p></main>", "<article><p>{}</p></article>"])
def test_articles_of_links_are_kept(forest, frame):
    rng = random.Random(7)
    text = " ".join(f'{prose(rng, 4, 9)} <a href="/x">{prose(rng, 1, 3)}</a>' for _ in range(10))
    (got,) = html_text.main_texts([frame.format(text)], forest)
    assert got.endswith(html_text._SPACE.sub(" ", re.sub("<[^>]*>", "", text)))


def test_a_short_title_in_the_header_of_an_article(forest):
    page = f'<body><div class="has-sidebar page"><nav>{MENU}</nav><article><header><h1>Bridge</h1></header><p>{FIRST}</p><p>{SECOND}</p></article><div class="sidebar">{SIDE}</div></div></body>'
    assert html_text.main_texts([page], forest) == ["\n\n".join(("Bridge", FIRST, SECOND))]
