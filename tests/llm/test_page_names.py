"""What class and id names take out of an article, and what they must leave."""

import pytest

from runlens.llm import pages

LONG = "<p>" + "A sentence of the article itself, long enough to matter. " * 6 + "</p>"
KEPT = [
    f"<section id='discussion'><h2>Discussion</h2>{LONG}</section>", "<h2 id='related-work'>Related work</h2>", "<h2 class='section-header'>Methods</h2>",
    f"<div class='elementor-widget'>{LONG}</div>", "<p id='notice-period'>The notice period is three months.</p>", "<li class='menu-item'>Soup of the day</li>",
    f"<div class='widget'>{LONG}{LONG}</div>", "<h3 class='promo'>A heading</h3>", "<section id='responses'><p>How the agencies responded to it.</p></section>",
    f"<div class='has-sidebar nav-closed'>{LONG}</div>", "<td class='header'>Year</td>", f"<article>{LONG}{LONG}{LONG}{LONG}</article>",
]
GONE = [
    "<div class='ad'>Buy</div>", "<p class='advertisement'>Buy</p>", "<div class='comments-area'><p>first!</p></div>", "<ol id='comments'><li>first!</li></ol>",
    f"<article class='comment'>{LONG}</article>", "<article><p>nice read</p></article>", "<div class='share-buttons'>Share</div>", "<div class='notice'>Paid post</div>",
    "<div class='related-posts'><a href=x>Ten other things to read</a> <a href=y>More</a></div>", "<div id='related'><a href=x>Ten other things to read</a></div>",
    "<div role='navigation'>Home</div>", "<div hidden>secret</div>", "<div class='site-footer'>Imprint</div>", "<div id='newsletter-signup'>Mail us</div>",
]


def text_of(body):
    return pages.blocks(pages.main_parts(*pages.parsed(f"<html><body class='has-sidebar'><header>Shop</header><article class='post comment-open'>{body}</article></body></html>")))


@pytest.mark.parametrize("part", KEPT)
def test_kept(part):
    alone, beside = text_of(part), text_of(f"{LONG}{part}<p>End.</p>")
    if not part.startswith("<article>"):
        assert alone == pages.blocks([pages.parsed(f"<div>{pages.re.sub(' (class|id)=.[^>]*', '', part)}</div>")[0]])
    assert beside[-1] == "End." and len(beside) > 2


@pytest.mark.parametrize("part", GONE)
def test_gone(part):
    assert text_of(f"{LONG}{part}<p>End.</p>") == text_of(f"{LONG}<p>End.</p>")


def test_a_page_made_of_widgets():
    body = "".join(f"<div class='elementor-widget'>{LONG}</div>" for _ in range(8))
    page = f"<body><nav>Menu</nav>{body}<div class='footer-widget'>Imprint</div></body>"
    assert len(pages.blocks(pages.main_parts(*pages.parsed(page)))) == 8


def test_comments_as_articles_beside_the_article():
    page = f"<body><article>{LONG}</article><section id='comments'><article>{LONG}</article></section><article class='comment'>{LONG}</article></body>"
    assert len(pages.blocks(pages.main_parts(*pages.parsed(page)))) == 1
