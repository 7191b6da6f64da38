"""Main text of pages and the site templates that go."""

from weftgraph.llm.html_text import host, main_text, read, templates, parse


def texts(page):
    return [t for t, _ in read(page)]


def test_blocks_entities_and_white_space():
    page = ("<body><nav><a>menu</a></nav><article><h1>T &amp; x</h1><p><b>one \n two<br>more"
            "<p>a&nbsp;b &#233;&copy</p></article><footer>f</footer>")
    assert texts(page) == ["T & x", "one two more", "a b é©"]


def test_never_main_text():
    page = ("<div>keep<form>f<input></form><aside>s</aside><div class='cookie-notice'>n</div>"
            "<div id=ad-top>a</div><section class='reader comments'><p>c</p></section>"
            "<p>in <button>no</button>line <script>var t='</p>'</script>end</p><style>x</style></div>")
    assert texts(page) == ["keep", "in line end"]


def test_broken_markup():
    assert texts(None) == texts("") == []
    assert texts("1 < 2 & 3 &am <b") == ["1 < 2 & 3 &am"]
    assert texts("<p>x<!-- never closed") == ["x"]
    assert texts("</div></p><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>t") == [
        "a", "b", "1", "2", "3", "t"]
    assert texts("<div>" * 3000 + "deep" + "</p>" * 3) == ["deep"]


def test_hosts():
    assert [host(u) for u in (None, "", "x", "https://u:p@A.b:8/c", "http://h.org?q")] == [
        "", "", "", "a.b", "h.org"]


def test_templates_go_and_articles_stay(spark):
    def page(i, body):
        return (i, f"http://site.org/{i}", body, "clash")

    rows = [page(i, f"<div><div><p>Buy now</p><p>all rights</p></div><p>story {i}</p>"
                    f"<p>shared {i % 8}</p></div>") for i in range(40)]
    # A copied article is no template, nor is a plain paragraph that a marked article repeats.
    rows += [page(100 + i, "<div><p>copied story</p></div>") for i in range(30)]
    rows += [page(200 + i, f"<article><p>same line</p><p>own {i}</p><div class='box'>try our app"
                           "</div></article>") for i in range(60)]
    rows += [(300, None, None, "clash"), (301, "http://site.org/e", "", "clash"),
             (None, "http://other.org/", "<div><p>Buy now</p></div>", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, signature string")
    got = {r["page_id"]: r for r in main_text(pages).collect()}
    assert len(got) == len(rows)
    assert got[3]["text"] == "story 3\nshared 3"
    assert got[105]["text"] == "copied story"
    assert got[207]["text"] == "same line\nown 7"
    assert got[300]["text"] == got[301]["text"] == "" and got[300]["url"] is None
    assert got[None]["text"] == "Buy now"  # another host
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    again = main_text(pages.union(pages))
    assert again.count() == 2 * len(rows)  # repeated rows give equal rows
    assert {r["text"] for r in again.where("page_id = 3").collect()} == {"story 3\nshared 3"}


def test_rare_subtrees_are_no_templates(spark):
    rows = [(i, "http://a.org/", f"<div><p>seen {i // 4}</p></div>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert templates(parse(pages)).count() == 0
    assert main_text(pages.where("false")).count() == 0
