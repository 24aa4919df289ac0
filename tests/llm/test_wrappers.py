"""Wrapper alignment, block texts against whole pages, odd markup and empty rows."""

from weftline.llm import wrappers

SCHEMA = "page_id long, url string, html string, text string"


def page(title, paragraphs, extra="", menu=("Home", "News"), wrap=("article", "article")):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p><p>x';</script></head><body><header><h1>Site</h1></header><nav><ul>"
        + "".join(f"<li><a href='/{m}'>{m}</a></li>" for m in menu)
        + f"</ul></nav><div class='ad'>Buy</div><{wrap[0]}><h1>{title}</h1>{body}{extra}</{wrap[1]}><aside>Side</aside><form><p>Mail</p><input></form><footer>&copy; me</footer></body></html>"
    )


def test_alignment():
    item = lambda key, kids=(), again=0, maybe=0: [key, list(kids), again, maybe]
    p = lambda again=0, maybe=0: item("p", [item("#")], again, maybe)
    assert wrappers.fold([["p", [["#", []]]], ["p", [["#", []]]], ["hr", []]]) == [p(1), item("hr")]
    one, two = [item("h1", [item("#")]), p(1)], [item("h1", [item("#")]), item("img"), p()]
    assert wrappers.align(one, two) == [item("h1", [item("#")]), item("img", maybe=1), p(1)]
    assert wrappers.align(one, one) == one
    assert set(wrappers.slots(wrappers.align(one, [p()]))) == {("h1", 0, 1), ("p", 1, 0)}


def test_extract(spark):
    comments = "<div id='comments'><p>First!</p></div><div class='share-buttons'>Share</div>"
    rows = [
        (1, "http://a.example/1", page("One &amp; only", ["x  y\n z", "a <b>b</b>c<br>d &lt;p&gt; &nbsp; e"])),
        (2, "http://a.example/2", page("Two", ["only"], comments, menu=())),
        (3, "http://a.example/3", page("Three", [])),
        (4, "http://b.example/1", page("Four", ["para"] * 3, wrap=("div class='text'", "div"))),
        (5, "http://b.example/2", page("Five", ["other"], wrap=("div class='text'", "div"))),
        (6, "http://b.example/3", page("Six", ["else", "more"], wrap=("div class='text'", "div"))),
        (7, None, None), (8, "", ""), (9, "http://c.example", "plain text only"), (10, "x", "<p><b>one<p>two<li>three <div"),
        (11, "http://c.example/x", "<!-- open comment <p>no</p>"), (12, "http://a.example/12", page("Long", ["w " * 30000])), (None, "http://a.example/1", page("One &amp; only", ["again"])),
        (13, "http://a.example/13", "<html><body><article><h1>T&am</h1><p>cut &amp"), (14, "http://d.example", "<article><p>a</p><ul><li>1<li>2</ul><table><tr><td>c<td>d</table></article>"),
    ]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    want = {
        1: "One & only\nx y z\na bc d <p> e", 2: "Two\nonly", 3: "Three", 4: "Four\npara\npara\npara", 5: "Five\nother", 6: "Six\nelse\nmore", 7: "", 8: "",
        9: "plain text only", 10: "one\ntwo\nthree", 11: "", 12: "Long\n" + " ".join(["w"] * 30000), None: "One & only\nagain", 13: "T&am\ncut &", 14: "a\n1\n2\nc\nd",
    }
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_empty_table(spark):
    assert wrappers.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", html, "x") for i, html in enumerate(pages)]
    return [r.text for r in wrappers.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]


def test_template_texts_beside_article_texts(spark):
    """Texts of one path are told apart by their slots and by what all pages have there."""
    ends = ["Subscribe to us today.", "Read more below.", "All rights reserved."]
    page = lambda *said: f"<body><div><p>{ends[0]}</p>{''.join(f'<p>{t}</p>' for t in said[:1])}<p>{ends[1]}</p>{''.join(f'<p>{t}</p>' for t in said[1:])}<hr><h2>x</h2><p>{ends[2]}</p></div></body>"
    said = [["a one"], ["b one", "b two", "b three"], ["c one", "c two"], ["d one", "d one"]]
    assert extracted(spark, [page(*s) for s in said]) == ["\n".join(s) for s in said]
    bare = "<body><div><p>only text here</p></div></body>"  # lacks the template
    assert extracted(spark, [page(*s).replace("<p>Subscribe to us today.</p>", "").replace("<p>Read more below.</p>", "") for s in said] + [bare]) == ["\n".join(s) for s in said] + ["only text here"]


def test_place():
    item = lambda key, kids=(), again=0, maybe=0: [key, list(kids), again, maybe]
    text = lambda tag, again=0, maybe=0: item(tag, [item("#")], again, maybe)
    wrapper = [text("p", 1), item("ul", [text("li", 1)], 0, 1), text("p", 0, 1), item("div", [text("h2")], 0, 1), item("section"), item("div", [text("p")])]
    assert [s[0] for s in wrappers.slots(wrapper)] == ["p", "ul/li", "p", "div/h2", "div/p"]
    numbered = wrappers._numbered(wrapper, iter(range(9)))
    slots = lambda html: wrappers.place(wrappers.blocks(html)[1], numbered, {}, [])
    assert slots("<p>a</p><p>b</p><ul><li>c<li>d</ul><p>e</p><section></section><div><p>f</p></div>") == [0, 0, 1, 1, 2, 4]
    assert slots("<p>a</p><div><p>f</p></div>") == [0, 4] and slots("<p>a</p><div><h2>f</h2></div><section></section><div><p>g</p></div>") == [0, 3, 4]
    assert slots("<table>x</table><div><p>f</p></div>") == [None, 4]


def test_copies_of_a_page_show_no_template(spark):
    page = lambda said, advert="": f"<body><div><p>{said}</p><p>Welcome.</p></div><div class='ad'>{advert}</div></body>"
    same = [page("the one text", advert=i) for i in range(4)]  # differ in dropped texts only
    assert extracted(spark, same) == ["the one text\nWelcome."] * 4
    assert extracted(spark, same[:2] + [page("two")]) == ["the one text\nWelcome."] * 2 + ["two\nWelcome."]
    assert extracted(spark, same + [page("two"), page("three")]) == ["the one text"] * 4 + ["two", "three"]
    quote = "<body><div><blockquote>said once</blockquote></div></body>"
    assert extracted(spark, [page("one"), page("two"), page("three")] + [quote] * 3) == ["one", "two", "three"] + ["said once"] * 3


def test_many_trees_merge_in_bounded_parts(spark, monkeypatch):
    """No task gets many more than TREES trees of a host; the wrapper holds every page."""
    page = lambda i: "<body>" + "".join(f"<div class='{'abcdefghij'[int(d)]}'><p>{d}</p></div>" for d in f"{i:03d}") + "</body>"
    rows = [(i, "http://h.example/", page(i), "x") for i in range(0, 900, 3)] + [(-1, "http://i.example/", page(1), "x")]
    monkeypatch.setattr(wrappers, "TREES", 20)

    merge = wrappers._merge_part

    def part(key, pdf):
        assert len(pdf) <= 60, len(pdf)
        return merge(key, pdf)

    monkeypatch.setattr(wrappers, "_merge_part", part)
    found = {r.host: r.wrapper for r in wrappers.wrapped(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(found) == {"h.example", "i.example"}
    items = wrappers._numbered(wrappers.json.loads(found["h.example"]), iter(range(10**6)))
    assert all(None not in wrappers.place(wrappers.blocks(r[2])[1], items, {}, []) for r in rows[:-1])


def test_odd_markup():
    texts = lambda html: [text for _, _, text, _, _ in wrappers.blocks(html)[0]]
    for html in ("<p title=it's>text</p>", '<p data-x=5">text</p>', '<p title="a>b">text</p>', "<p title='a>b' x>text", '<p title="open>text</p>', '<p =">text', '<p x = "\'>">text'):
        assert texts(html) == ["text"], html
    assert texts("x < y <b>c</b> <3") == ["x < y c <3"]
    assert texts("<!-->a<!-- b --!>c<!-- open <p>no</p> end") == ["ac"]
    assert texts("a<![CDATA[ open <p>no</p> end") == ["a"]
    assert texts("<script>if(a<b && c>\"<p '\")</script ><p>x</p><style>never closed <p>y</p>") == ["x"]


def test_deep_and_long_pages(spark):
    """Megabytes of open tags, quotes or nested elements cost linear time and lose no text."""
    n = 50_000
    deep = "<div>" * n + "core" + "</div>" * n + "<p>after</p>"
    hidden = "<div>" * 300 + "<div class=ad><div><p>Buy</p></div></div>kept" + "</div>" * 300
    odd = ["<a " * 350_000, "<a " * 350_000 + ">", '<a x="' * 170_000 + ">", "<!--" * 250_000, "<script>" * 130_000, "<li><div>" + "<blockquote>" * n + "<li></li>" * n]
    assert extracted(spark, [deep, hidden, *odd]) == ["core\nafter", "kept", *[""] * len(odd)]
    said = "".join(f"<div>{i}" for i in range(n))
    found, tree = wrappers.blocks(said + "end" + "</div>x" * 10 + said)
    assert len(found) == 2 * n + 10 and "".join(t for _, _, t, _, _ in found) == "".join(map(str, range(n))) + "end" + "x" * 10 + "".join(map(str, range(n)))
    items = wrappers._numbered(wrappers.fold(tree), iter(range(10**6)))
    assert len(wrappers.place(tree, items, {}, [])) == found[-1][4] + 1


def test_long_lists_align_by_next_matches(monkeypatch):
    """Beyond CELLS the wrapper may be looser; every page still has its place in it."""
    import random

    rng = random.Random(3)
    for cells in (0, 4_000_000):
        monkeypatch.setattr(wrappers, "CELLS", cells)
        for _ in range(50):
            pages = ["".join(f"<{t}>x</{t}>" for t in rng.choices(["p", "h2", "h3", "pre"], k=rng.randint(1, 12))) for _ in range(2)]
            trees = [wrappers.blocks(page)[1] for page in pages]
            items = wrappers._numbered(wrappers.align(*[wrappers.fold(tree) for tree in trees]), iter(range(10**6)))
            assert all(None not in wrappers.place(tree, items, {}, []) for tree in trees)


def test_size_of_lists_changes_no_result(monkeypatch):
    """Lists whose table is not held as a whole are aligned and fitted the same way."""
    import random

    rng = random.Random(4)
    page = lambda: "".join(f"<{t}>x{'<pre>y</pre><h4>z</h4>' * rng.randrange(2)}</{t}>" for t in rng.choices(["p", "h2", "h3", "div"], k=rng.randint(1, 30)))
    seen = {0: [], 4_000_000: []}
    pages = [[page() for _ in range(3)] for _ in range(120)]
    for cells, found in seen.items():
        monkeypatch.setattr(wrappers, "CELLS", cells)
        for group in pages:
            one, two, other = [wrappers.fold(wrappers.blocks(text)[1]) for text in group]
            merged = wrappers.align(one, two)
            found += [merged, wrappers._fitted(wrappers._shape(other), wrappers._numbered(merged, iter(range(10**6))), {})]
    assert seen[0] == seen[4_000_000]
