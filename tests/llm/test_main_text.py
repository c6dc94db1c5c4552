import pytest

from loamwork.llm.main_text import extract_main_text, main_text

P1 = "The river of the valley is a place that was known to all of the people in the old town, and it has been so for a long time."
P2 = "In the winter, the ice on the water was so thick that they would walk from the mill to the church and back by the same way."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
    <article><h1>Title  &amp;\n here</h1><p><b>{P1}<br><p>{P2}</p><p>Enê èle.</p><div class="ad-slot">Buy that.</div>
    <form><label>Name</label><input></form><aside>More of it.</aside><p>Short &lt;end&gt;</p>
    <section id="comments"><p>{P1} I agree.</p></section></article>
    <div class="cookie-notice">We use cookies.</div><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == f"Title & here\n{P1}\n{P2}\nEnê èle.\nShort <end>"


def test_pages_without_article_tags():
    page = f"""<body><div id=top><a href=x>Home</a> | <a href=y>News</a></div><h2>A heading</h2><p>{P1} {P2}</p><p>Yes.</p><p>{P2} {P1}</p>
    <div><a href=1>one thing</a> <a href=2>other thing</a></div><p>Copyright © 2020 of the people in the town</p></body>"""
    assert main_text(page) == f"A heading\n{P1} {P2}\nYes.\n{P2} {P1}"


@pytest.mark.parametrize("page", [None, "", " ", "<p>", "<script>x", "<!-- open", "<nav><a>x</a>", "<article></article>", "</div></p>", "<article><nav>x</nav>"])
def test_nothing_to_extract(page):
    assert main_text(page) == ""


def test_odd_markup():
    assert main_text("<article><h1>One.</h1><p><b>One.<br></article><footer>x</footer>") == "One.\nOne."
    assert main_text("<ARTICLE><P>a < b &unknown; &#233;</ARTICLE>") == "a < b &unknown; é"
    assert main_text(f"<main><p hidden>{P1}</p><p>{P2}</p>") == P2
    assert main_text("<article>" + "<div>" * 3000 + P1) == P1


def test_column_form(spark):
    pages = [(1, "u", f"<article><p>{P1}</article>", "old"), (1, "u", f"<article><p>{P1}</article>", "old"), (None, None, None, None), (3, "v", "<article>" + f"<p>{P1}é</p>" * 3000, "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    for r in extract_main_text(frame).collect():
        assert r.text == main_text(r.html) and r.n_chars == len(r.text)
    assert extract_main_text(frame).columns == ["page_id", "url", "html", "text", "n_chars"]
    assert extract_main_text(frame.where("false")).collect() == []
