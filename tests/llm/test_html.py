import html
import random

from gristmill.llm.html import extract, main_text


def page(blocks, rnd, cut=False, marked=True):
    """A page around known blocks, as sites have it."""
    esc = html.escape
    body = "".join(f"<p><b>{esc(b)}<br>" if rnd.random() < 0.3 else f"<p class='x>y'>{esc(b)}</p>\n" for b in blocks[1:])
    inner = f"<h1>{esc(blocks[0])}</h1>{body}"
    inner = f"<article>{inner}</article>" if marked else f'<div class="post">{inner}</div>'
    return (
        '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
        "<nav><ul>" + "<li><a href=/x>Menu entry</a></li>" * 6 + "</ul></nav><!-- ad <p>no</p> --><div class=ad>Buy this long advert text which goes on and on and on.</div>"
        f'{inner}<section id="comments"><p>First! {"so good " * 30}</p><article class="comment">me too</article></section>'
        '<aside>Side</aside><form><p>Your name</p></form><div class="cookie-notice">We use cookies</div><footer>&copy; us</footer>' + ("" if cut else "</body></html>")
    )


def test_articles_come_out_whole():
    rnd = random.Random(1)
    for n in range(300):
        blocks = [" ".join(rnd.choice(["some", "w&rds", "<b>", "é", "x."]) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 12))]
        assert main_text(page(blocks, rnd, cut=n % 3 == 0)) == "\n".join(blocks)


def test_without_article_marks():
    rnd = random.Random(2)
    blocks = ["Heading of the text", *(" ".join(["plain"] * 30) for _ in range(5)), "End."]
    assert main_text(page(blocks, rnd, marked=False)) == "\n".join(blocks)


def test_surroundings_inside_an_article_do_not_split_it():
    long = "plain " * 30
    assert main_text(f"<article><h1>Title</h1><div class=ad>Buy</div><p>{long}</p><aside>Side</aside><p>Short end.</p></article>") == f"Title\n{long.strip()}\nShort end."
    assert main_text(f"<article><h1>Title</h1><nav>Menu</nav><p>{long}</p><form>Name</form><p>One.</p><footer>Us</footer><p>Two.</p></article><p>{long}</p>") == f"Title\n{long.strip()}\nOne.\nTwo."


def test_names_of_surroundings_are_whole_names():
    long = ("plain " * 30).strip()
    inner, want = f"<h1>Title</h1><p>{long}</p>", f"Title\n{long}"
    for page in (
        f"<article class='post comments-open'>{inner}</article>",
        f"<article class='widget'>{inner}</article>",
        f"<main class='has-sidebar'>{inner}</main>",
        f"<main id=sidebar>{inner}</main>",
        f"<div class='layout with-sidebar'>{inner}</div>",
        f"<article><div class='entry-header'><h1>Title</h1></div><p>{long}</p></article>",
        f"<div class='post-header'><h1>Title</h1></div><p>{long}</p>",
        f"<div class='sidebar widget'><div class=widget>{inner}</div><div class=widget>Side</div></div>",
        f"<div id=comments>{inner}</div>",
        f"<div class=post>{inner}</div><div id=comments class='comments-area'><p>{long * 3}</p></div>",
        f"<article>{inner}<div class='share-bar'>Share</div><div class=cookieNotice>We</div><article class=comment-body>me too</article></article>",
        f"<div class='site-header'><p>{long}</p></div><div class='sidebar'><p>{long}</p></div>{inner}<div class='ad-728x90'>{long}</div>",
    ):
        assert main_text(page) == want, page


def test_long_attribute_values():
    for quote in "'\"":
        value = "<p>no</p> " * 20_000
        assert main_text(f"<div data-x={quote}{value}{quote} class=x>yes</div><p title={quote}>open</p>") == "yes\nopen"


def test_white_space_references_and_odd_markup():
    assert main_text("<p>a\n  b&nbsp;&amp;&lt;c&gt; 1 < 2<br>d <i>e</i>f</p>") == "a b &<c> 1 < 2 d ef"
    assert main_text("<p>open <a href='") == "open"
    assert main_text("no markup at all") == "no markup at all"
    assert main_text("<!-- never closed <p>x</p>") == "x"
    assert main_text("<script>never closed") == main_text("") == main_text(None) == ""
    assert main_text("<" * 50_000 + "p>x") .endswith("x")


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (None, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (3, "v", "<p>" + "long text " * 50_000, "t")], "page_id long, url string, html string, text string")
    rows = sorted(((r.page_id or 0, r.text[:5], r.n_chars) for r in extract(pages).collect()))
    assert rows == [(0, "", 0), (1, "a", 1), (2, "", 0), (2, "", 0), (3, "long ", 499_999)]
    assert extract(pages.limit(0)).count() == 0
