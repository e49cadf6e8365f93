import html as entities
import random

import pytest

from lagweave.llm import html

ARTICLE = ["A title &amp; more", "First paragraph &lt;here&gt; with   some\n white space&nbsp;and text.", "Short.", "The last one, é &#233; &eacute; &copy;."]
PLAIN = [" ".join(entities.unescape(x).split()) for x in ARTICLE]
BODY = f"<h1>{ARTICLE[0]}</h1><p><b>{ARTICLE[1]}<br><p>{ARTICLE[2]}</p><div class='ad'>buy <p>this</p></div><p>{ARTICLE[3]}"
NOISE = "<nav><ul><li><a href=/a>Home</a></li><li>More</li></ul></nav><!-- <p>gone</p> --><div class='ad'>An advert of many words that goes on and on.</div>"


def page(body, noise=NOISE):
    return f"<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{noise}{body}<footer>&copy; foot</footer></body></html>"


def test_article_element():
    assert html.main_text(page(f"<article>{BODY}</article>")) == "\n".join(PLAIN)


def test_div_page_by_line_blocks():
    apart = "<div id='sidebar'>links and <p>links</p></div><form>Name <input> <button>Go</button></form><section class='comments'><p>A reader says much about this and that.</p></section><div role='dialog' class='cookieNotice'>We use cookies</div>"
    assert html.main_text(page(f"<div class='post'>{BODY}</div>{apart}")) == "\n".join(PLAIN)


def test_long_div_page_keeps_short_parts_between_elements_apart():
    long = ["word " * 99 + "end." for _ in range(4)]
    body = "<h1>A heading of thirty characters</h1><div class='share'>Share this</div>" + "".join(f"<p>{x}</p>" for x in long) + "<div class='ad'>buy</div><p>" + "Closing words. " * 20 + "</p>"
    assert html.main_text(page(f"<div class='post'>{body}</div>")) == "\n".join(["A heading of thirty characters", *long, ("Closing words. " * 20).strip()])


def test_teaser_in_an_article_element_does_not_replace_the_main_text():
    long = "word " * 99 + "end."
    assert html.main_text(page(f"<div><p>{long}</p><p>{long}</p></div><article>Read this too</article>")) == "\n".join([long, long, "Read this too"])


def test_broken_and_empty_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<html><body></body>") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain text &am") == "plain text &am"
    assert html.main_text("<article><p>cut off in a <b>tag <a href='x") == "cut off in a tag"
    assert html.main_text("<article><p>a</p><script>never closed <p>b</p>") == "a"
    assert html.main_text("a < b and 1<2") == "a < b and 1<2"
    assert html.main_text("<p>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_long_texts_are_whole():
    many = [f"Paragraph {i} " + "word " * (i % 7) for i in range(5000)]
    got = html.main_text(page("<article>" + "".join(f"<p>{x}</p>" for x in many) + "</article>"))
    assert got == "\n".join(" ".join(x.split()) for x in many)


def slow_regions(found, window):
    """Surge and dive by plain sums, line by line."""
    plain = sum(x.plain for x in found)
    mean_weight = sum(x.plain * x.weight for x in found) / max(plain, 1)
    mass = [x.plain * x.weight / min(mean_weight, 1) if mean_weight else 0 for x in found]
    around = lambda i: range(max(0, i - (window - 1) // 2), min(len(mass), i + window // 2 + 1))
    sums = [sum(mass[j] for j in around(i)) for i in range(len(mass))]
    if not any(mass):
        return []
    surge = min(html.SURGE * max(sum(mass) / plain, 1) ** 0.5, html.SHARE * sum(s * s for s in sums) / sum(sums))
    low = [s <= html.DIVE * surge or i - window + 2 >= 0 and not any(x.text for x in found[i - max(window - 1, 1) + 1 : i + 1]) for i, s in enumerate(sums)]
    kept = []
    for i in range(len(found)):
        a = b = i
        while a > 0 and not low[a - 1]:
            a -= 1
        while b < len(found) and not low[b]:
            b += 1
        if not low[i] and max(sums[a:b]) >= surge:
            kept.append(i)
    return kept


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_regions_match_plain_sums(window):
    rng = random.Random(window)
    for _ in range(300):
        found = [html.Line("", 0, 0.0) if rng.random() < 0.4 else html.Line("x", rng.choice([0, 3, 20, 60, 300]), rng.choice([1.0, 1.0, 0.002, 100.0])) for _ in range(rng.randint(0, 25))]
        assert [i for a, b in html.regions(found, window) for i in range(a, b)] == slow_regions(found, window)


LONG = "Words of the text that go on and on and come to an end. " * 6


def test_the_window_decides():
    body = f"<div class='x1'><p>{LONG}</p><p>Hm.</p><p>{LONG}</p></div>"
    assert html.main_text(body) == "\n".join([LONG.strip(), "Hm.", LONG.strip()])
    assert html.main_text(body, 1) == "\n".join([LONG.strip()] * 2)


def test_neutral_names():
    # nothing but lengths, links and the places of containers tells the article from menu, advert and footer
    menu = "<div class='x1'><ul>" + "".join(f"<li>{x}</li>" for x in ("Home", "News", "About")) + "</ul></div>"
    linked = "<div class='x2'><ul>" + "".join(f"<li><a href=/{i}>A rather long headline of another page, number {i}</a></li>" for i in range(20)) + "</ul></div>"
    article = f"<div class='x3'><h2>Of words</h2><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two</li></ul><p>{LONG}</p></div>"
    foot = "<div class='x4'><div>Made by us.</div><div>No. 7</div></div>"
    assert html.main_text(f"<body>{menu}{linked}{article}{foot}</body>") == "\n".join(["Of words", LONG.strip(), "Short.", "one", "two", LONG.strip()])
    # a second part of the article after a menu stays
    assert html.main_text(f"<body>{article}{menu}<div class='x5'><p>{LONG[:160]}</p></div></body>").endswith(LONG[:160].strip())


def test_hints_do_not_decide_alone():
    whole = "\n".join(PLAIN)
    body = BODY.replace("<div class='ad'>buy <p>this</p></div>", "")
    assert html.main_text(page(f"<form><article>{body}</article></form>")) == whole
    assert html.main_text(f"<form>{body}</form>") == whole
    assert html.main_text(page(f"<div class='page with-sidebar'>{body}</div>", "")) == whole
    quoted = f"<article><div class='post-header'><h1>Title</h1></div><p>{LONG}</p><p class='share-quote'>So it is.</p><div class='notice'>Mind the gap.</div><p>{LONG}</p></article>"
    assert html.main_text(page(quoted)) == "\n".join(["Title", LONG.strip(), "So it is.", "Mind the gap.", LONG.strip()])
    comments = "<section class='comments'>" + f"<p>{LONG}</p>" * 3 + "</section>"
    assert html.main_text(page(f"<article><p>{LONG}</p></article>{comments}")) == LONG.strip()
    assert html.main_text(page(f"<article><p>{LONG}</p>{comments}<p>End.</p></article>")) == f"{LONG.strip()}\nEnd."


def test_rows(spark):
    rows = [(1, "u", page(f"<article>{BODY}</article>"), "x"), (2, None, None, "x"), (2, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)  # "text" clashes with the result's
    got = sorted(tuple(r) for r in html.extract(df).collect() if r["page_id"] == 1)
    assert got == [(1, "u", "\n".join(PLAIN), len("\n".join(PLAIN)))]
    assert html.extract(df).where("page_id = 2 and text = '' and n_chars = 0 and url is null").count() == 2
    assert html.extract(df.limit(0)).count() == 0
