import time

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.line_blocks import extract_pages, main_text, stretches

P1, P2, P3 = ("First paragraph &amp; its many words, long enough to be text, going on for quite a while yet.",
              "Second one with <b>bold</b> and <a href='x'>a link</a>, also long enough to be the text of a page.", "Short.")
PLAIN = ("First paragraph & its many words, long enough to be text, going on for quite a while yet. "
         "Second one with bold and a link, also long enough to be the text of a page. Short.")
NOISE = ("<nav><ul><li><a href='/a'>Home</a></li><li><a>News</a></li></ul></nav><div class='ad banner'>Buy now, this is an advert "
         "with a good many words in it, nearly like a paragraph.</div>")
TAIL = ("<aside>Sidebar text that is long enough to look like a paragraph of the article itself.</aside>"
        "<section id='comments'><p>A reader writes a comment that is also long enough to look like text.</p></section>"
        "<form><label>Mail</label><input></form><footer>&copy; all rights</footer>")


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


def test_article_element():
    body = f"<article><h1>Title</h1><p>{P1}<p>{P2}</p><p>{P3}<script>x()</script></article>"
    assert main_text(page(NOISE + body + TAIL)) == "Title " + PLAIN
    assert main_text(page(NOISE + body + TAIL)[:-20]) == "Title " + PLAIN


def test_without_an_article_element_the_distribution_decides():
    assert main_text(page(NOISE + f"<div><p>{P1}</p><p>{P2}</p><p>{P3}</p></div>" + TAIL)) == PLAIN


def test_references_white_space_and_inline_elements():
    text = main_text("<article><p>a&nbsp;&lt;b&gt;  \n c<i>d</i>e &#x41;&bogus; <br>f<!-- <p>no --></p> g</article>")
    assert text == "a <b> cde A&bogus; f g"


def test_menus_inside_the_article_are_left_out():
    assert main_text(f"<main><nav>Menu</nav><p>{P3}</p><div class='share-buttons share'>Share</div>"
                     "<div class='advert'>Ad</div></main>") == "Short."


def test_defined_results():
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<p>") == ""
    assert main_text(page(NOISE)) == ""


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>/\"'=!-&;pab \n"), max_size=80))
def test_any_markup_is_read(html):
    main_text(html)
    main_text("<article>" + html)


def test_broken_quotes_are_read_in_linear_time():
    assert main_text("<p a=\"" * 20_000) is not None


def test_stretches():
    import numpy as np
    assert stretches(np.array([0, 0, 9, 0, 9, 0, 0, 0, 0, 3, 0]), 10, 3) == [(0, 5)]
    assert stretches(np.array([], int), 1) == []


def test_query_columns(spark):
    schema = "page_id long, url string, html string, text string, id int"
    rows = [(1, "u", f"<article><p>{P1}</p></article>", "t", 4), (None, None, None, None, None), (1, "u", "", "", 0), (2, "v", "x", "", 0)]
    got = extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert all(r["n_chars"] == len(r["text"]) for r in got) and max(r["n_chars"] for r in got) > 50
    assert extract_pages(spark.createDataFrame([], schema)).collect() == []


def test_text_outside_of_marked_teasers_is_kept():
    teasers = "<article><h3>Other news</h3><p>Read on.</p></article>" * 2
    assert main_text(page(f"<div><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><nav>x</nav><ul><li><a>y</a></li></ul>"
                          "<nav>x</nav><nav>z</nav>" + teasers)).startswith(PLAIN)


def test_text_beside_a_dominant_article_surges_by_itself():
    rest = "<nav>x</nav>" * 4
    body = f"<article><p>{P1}</p><p>{P2}</p></article>{rest}<div><p>{P1}</p></div>{rest}<p>Tiny.</p>"
    got = main_text(page(body))
    assert got.count("First paragraph") == 2 and "Tiny" not in got


def test_a_shorter_stretch_is_kept_beside_a_long_one():
    menu = "<ul>" + "<li><a href='/a'>Home</a></li>" * 5 + "</ul>"
    assert main_text(page(f"<div>{f'<p>{P1}</p>' * 9}</div>{menu}<div><p>{P1} End.</p></div>")).endswith("End.")


def test_raw_elements_end_with_their_own_name():
    body = "<article><p>The story.</p>{}<p>Its end.</p></article>"
    for raw in ("<svg><title>Icon</title><text>X</text></svg>", "<noscript><iframe></iframe>X</noscript>", "<script>a</style>X</script>",
                "<template><script>1</script>X</template>"):
        assert main_text(body.format(raw)) == "The story. Its end."


def test_title_in_a_named_header_of_the_article():
    page = '<div class="header">Site</div><article><div class="entry-header"><h1>Title</h1></div><p>Text.</p><div class="entry-footer">f</div></article>'
    assert main_text(page) == "Title Text."


def test_short_page_without_marks():
    assert main_text("<body><nav>Home</nav><div>Only this.</div></body>") == "Only this."


def test_many_open_elements_cost_little():
    start = time.perf_counter()
    assert main_text("<div>" * 60_000 + "text" + "</p>" * 60_000) == "text"
    assert time.perf_counter() - start < 10
