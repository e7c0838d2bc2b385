import random
import time

from textweft.llm.html_text import extract, main_text, path_ratios

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body class="has-sidebar">
<header><h2>Site</h2><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do, and ask for your consent.</p></div>
<div id="content"><h1>A &amp; B</h1><p>First  paragraph,\n with <b>bold</b> text &eacute;.<p>Second one; it is longer than the first, and has a <a href=x>link</a>.
<table><tr><td>c1<td>c2<tr><td>c3</table><blockquote>Quoted words here.</blockquote><div class="ad">Buy now!</div><!-- <p>gone</p> -->
<form><label>Name</label><input><button>Go</button></form><p>Last.</p></div>
<aside><p>Elsewhere, other things happened, and more.</p></aside><div class="comments"><p>A reader said that this is, well, wrong.</p></div>
<footer>&copy; me</footer></body></html>"""


def test_article_of_a_page_without_article_element():
    assert main_text(PAGE) == "A & B\nFirst paragraph, with bold text é.\nSecond one; it is longer than the first, and has a link.\nc1 c2\nc3\nQuoted words here.\nLast."


def test_article_element_is_taken_whole():
    page = "<body><nav>menu</nav><div class=ad>" + "advert words, " * 30 + "</div><article><h1>Short</h1><p>x</p>tail<br>end<article class=comment>no</article></article></body>"
    assert main_text(page) == "Short\nx\ntail end"


def test_no_part_of_an_article_in_several_containers_is_left_out():
    long = "".join(f"<p>Paragraph {i} of the text, which is long, and has its commas.</p>" for i in range(30))
    lines = "".join(f"\nParagraph {i} of the text, which is long, and has its commas." for i in range(30))
    for before, after in (("An opening of its own, in a container.", ""), ("", "A closing, which ends the text, of its own.")):
        page = "<body><nav>menu</nav>" + (before and f"<div><p>{before}</p></div>") + f"<div>{long}</div>" + (after and f"<div><p>{after}</p></div>") + "<footer>x</footer></body>"
        assert main_text(page) == (before + lines + "\n" + after).strip()
    assert main_text(f"<body><nav>menu</nav><article>{long}</article><article><p>The second.</p></article></body>") == lines[1:] + "\nThe second."
    linked = "<article><p>The second.</p><ul><li><a href=x>a</a></ul></article>"
    assert main_text(f"<body><nav>menu</nav><article>{long}</article>{linked}</body>") == lines[1:] + "\nThe second.\na"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x</script>") == ""
    assert main_text("bare &lt;text&gt;") == "bare <text>"
    assert main_text("<p>cut <b>off &am") == "cut off &am"
    assert main_text('<p title="a>b">x</p') == "x"
    assert main_text("<p>" + "<div>" * 3000 + "deep") == "deep"
    assert len(main_text("<article>" + "<p>word </p>" * 20_000 + "</article>").split("\n")) == 20_000


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "<p>é</p>", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {(r.page_id, r.url, r.n_chars) for r in got} >= {(2, None, 0), (None, "v", 1)}
    assert extract(pages.limit(0)).count() == 0


PROSE = "".join(f"<p>Sentence {i} of the text, which is long, has commas, and ends in a full stop. A second one follows, as it should.</p>" for i in range(8))


def lines(text):
    return text.split("\n")


def test_path_ratios_choose_the_content_without_any_names():
    page = f"<body><div><span>Home</span> <span>News</span> <span>Shop</span></div><div>Short words here</div><section><h1>Title</h1>{PROSE}<p>End.</p></section><div>Elsewhere now</div></body>"
    got = lines(main_text(page))
    assert got[0] == "Title" and got[-1] == "End." and len(got) == 10
    assert lines(main_text(page, share=0.0))[:2] == ["Home News Shop", "Short words here"] and lines(main_text(page, share=0.0))[-1] == "Elsewhere now"
    # a path with a prior is content from its ratio on
    marked = f'<body><article><h1>Title</h1>{PROSE}<div class="related">{PROSE}</div><div class="related"><i>More</i></div></article></body>'
    assert len(lines(main_text(marked))) == 17 and len(lines(main_text(marked, share=0.0))) == 18 and len(lines(main_text(marked, share=0.9))) == 9


def test_ratios_are_those_of_the_definition():
    rng = random.Random(1)
    for _ in range(20):
        paths = [rng.randrange(4) for _ in range(rng.randrange(1, 15))]
        texts = [" ".join("ab,." [rng.randrange(4)] * rng.randrange(1, 6) for _ in range(3)) + "x" for _ in paths]
        length, marks = [], []
        for p in paths:
            own = [t for q, t in zip(paths, texts, strict=True) if q == p]
            length.append(sum(len(t.strip()) for t in own) / len(own))
            marks.append(sum(t.count(",") + t.count(".") for t in own) / len(own))
        smooth = lambda x: [0.25 * x[max(i - 1, 0)] + 0.5 * x[i] + 0.25 * x[min(i + 1, len(x) - 1)] for i in range(len(x))]
        fused = [a * (1 + b) for a, b in zip(smooth(length), smooth(marks), strict=True)]
        want = {p: sum(f for q, f in zip(paths, fused, strict=True) if q == p) / paths.count(p) / (sum(fused) / len(fused)) for p in paths}
        got = path_ratios(paths, texts)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_a_form_around_the_page_is_no_form():
    controls = '<label>Name</label><input name="x"><button>Go</button>'
    page = f'<body><form action="/"><nav>menu</nav><h1>Title</h1>{PROSE}{controls}</form></body>'
    assert len(lines(main_text(page))) == 9 and "Go" not in main_text(page)
    page = f'<body><article><h1>Title</h1>{PROSE}<form><p>Your mail address, please.</p>{controls}</form></article></body>'
    assert len(lines(main_text(page))) == 9 and "mail" not in main_text(page)


def test_unlucky_names_within_an_article():
    page = f'<body><article><h1>Title</h1>{PROSE}<section class="related-work">{PROSE}</section><div class="search-results">{PROSE}</div><div class="comments">{PROSE}</div></article></body>'
    assert len(lines(main_text(page))) == 25


def test_time_is_linear_in_unclosed_tags():
    began = time.perf_counter()
    assert main_text("<b>" * 30_000 + "x" + "</i>" * 30_000) == "x"
    main_text("<li><ul>" + "<b>" * 20_000 + "<li>y</li>" * 10_000)
    assert time.perf_counter() - began < 2
