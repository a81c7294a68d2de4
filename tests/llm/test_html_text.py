"""Pages that hide their article in what looks like boilerplate, deep ones, and a labelled set."""

import random
import time

from fluxgrid.llm.html_text import extract

BODY = "".join(f"<p>Sentence number {k} of the article has a few words.</p>" for k in range(6))
TEXT = "\n".join(f"Sentence number {k} of the article has a few words." for k in range(6))


def test_article_in_what_looks_like_noise():
    assert extract(f'<body><div class="post share-enabled">{BODY}</div><div class="share-buttons"><p>Tweet this</p></div></body>') == TEXT
    assert extract(f'<body><form action="/">{BODY}</form><nav>menu</nav></body>') == TEXT
    assert extract(f'<body><div class="promo">{BODY}<div class="comments"><p>rude words here</p></div></div><p>x</p></body>') == TEXT
    assert extract(f'<body><div class="content">{BODY}</div><form><p>Your mail address please, and your name</p></form></body>') == TEXT


def test_comments_stay_out_however_long():
    rude = "<p>A reader says something quite long about all of this.</p>" * 60
    assert extract(f'<body><div class="content"><p>One short article.</p></div><div class="comments">{rude}</div></body>') == "One short article."


def test_depth_and_many_tags_take_linear_time():
    start = time.perf_counter()
    assert extract("<div>x " * 20_000).startswith("x") and extract("<div></div>" * 40_000 + "<p>end") == "end"
    assert extract("<ul><li>" * 5_000 + "deep") == "deep" and extract("<p>" * 40_000 + "y") == "y"
    assert time.perf_counter() - start < 8


def test_labelled_pages():
    """Token recall and precision on generated pages whose article is known."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shells = ['<div class="content">{}</div>', "<article>{}</article>", '<div id="main"><div class="entry-content">{}</div></div>', "<main><section>{}</section></main>"]
    noise = ['<nav><a href="/">{}</a></nav>', '<div class="sidebar"><p>{}</p></div>', '<div class="cookie-notice"><p>{}</p></div>', '<footer><p>{}</p></footer>', '<div class="comments"><p>{}</p></div>', '<div class="ad-slot">{}</div>', "<script>{}</script>", "<form><label>{}</label></form>"]
    hit = got = want = 0
    for _ in range(200):
        article = [line(draw.randint(15, 60)) for _ in range(draw.randint(2, 8))]
        before, after = ("".join(draw.choice(noise).format(line(draw.randint(3, 25))) for _ in range(draw.randint(0, 4))) for _ in range(2))
        page = f"<html><head><title>{line(4)}</title></head><body>{before}{draw.choice(shells).format(''.join(f'<p>{p}</p>' for p in article))}{after}</body></html>"
        found, true = extract(page).split("\n"), set(article)
        hit, got, want = hit + len(true & set(found)), got + len(found), want + len(true)
    assert hit / want >= 0.9 and hit / got >= 0.9


def test_pages_without_an_article_are_empty():
    rude = "".join(f"<p>A reader says something quite long about number {k}.</p>" for k in range(9))
    for page in (
        f'<div class="comments">{rude}</div>', '<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div>', '<div class="sidebar"><p>Read our other pages.</p></div>',
        '<form action="/"><label>Your mail address</label><p>We never share it.</p></form>', '<nav><a href="/">Home</a></nav>', '<div class="promo"><p>Buy now!</p></div>', "",
    ):
        assert extract(f"<html><body>{page}</body></html>") == "", page


def test_a_short_article_is_not_lost_to_adverts():
    advert = "".join(f"<p>Buy number {k} of our many wonderful things today, at half the usual price.</p>" for k in range(3))
    assert extract(f'<body><div class="text"><p>The town has a new bridge since Monday.</p></div><div class="promo">{advert}</div></body>') == "The town has a new bridge since Monday."


def test_unclosed_quotes_take_linear_time():
    start = time.perf_counter()
    for piece in ("<a b='\"<p c=\"'", '<a b="', "<script ", "<!x ", "<a b='", "</a ", '<p c="<<<<<<<<<'):
        extract(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 7
    assert extract('<div class="a"><p title="1 < 2 and <b>">One is less than two.</p></div>') == "One is less than two."


def test_noise_by_other_names():
    """The same article among noise that is told by its links and place alone, or by other words."""
    article = "".join(f"<p>Paragraph {k} tells in a sentence what has happened in the town.</p>" for k in range(5))
    links = "".join(f'<li><a href="/{k}">Another page of this site</a></li>' for k in range(12))
    text = "\n".join(f"Paragraph {k} tells in a sentence what has happened in the town." for k in range(5))
    for before, after in ((f'<ul class="top">{links}</ul>', f'<div class="more"><ul>{links}</ul></div>'), (f'<div class="bar"><ul>{links}</ul></div>', '<div role="contentinfo"><p>All rights are ours.</p></div>'), ('<div style="display: none"><p>Hidden words stand here.</p></div>', "<aside><p>See also our shop.</p></aside>")):
        assert extract(f'<body>{before}<div class="mid"><div class="inner">{article}</div></div>{after}</body>') == text
