import pytest

from ledgerlark.llm import html_text as H


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>One  two\n three<p>Four", "One two three\n\nFour"),
        ("a<div>b</div>c", "a\nb\nc"),
        ("<b>a</b> <i>b</i>c", "a bc"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<ul><li>a<li>b<ol><li>c<li>d</ol><li>e</ul>f", "- a\n- b\n  1. c\n  2. d\n- e\n\nf"),
        ("<ol start=9><li>a</li><li>long</li></ol>", "9. a\n10. long"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("<p hidden>x</p><p style='display: none'>y</p><p>z</p>", "z"),
        ("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span></div>", "b"),
        ("<script>var a='</p>'</script><style>p{}</style><noscript>n</noscript>t<!-- c > -->u", "tu"),
        ("<details><summary>s</summary>hid</details><details open><summary>s</summary>seen</details>", "s\ns\nseen"),
        ("&lt;b&gt; &amp;amp; &eacute;", "<b> &amp; é"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>5<tr><td>Kiwi<td>12</table>", "Name   Qty\nApple  5\nKiwi   12"),
        ("<table><tr><td colspan=2>Wide heading<tr><td>a<td>b</table>", "Wide heading\na  b"),
        ("<table><tr><td rowspan=2>L<td>1<tr><td>2</table>after", "L  1\n   2\n\nafter"),
        ("<table><td>a<table><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
        ("<table><caption>Cap</caption><td>a</table>", "Cap\na"),
        ("text with < and <3 and <", "text with < and <3 and <"),
        ('<a href="x>y">link</a> <a href="open>rest</a>', "link rest"),
        ("</p></div>stray", "stray"),
        ("<p>a<table><td>b</table>c", "a\n\nb\n\nc"),
        ("<select><option>one<option>two</select>", "one\ntwo"),
        ("<table><tr><td>Total</td><td colspan=3>12</td></table>", "Total  12"),
        ("<table><tr><th colspan=2>Hi<th>x</table>", "Hi  x"),
        ("<table><tr><th colspan=2>Hi<th>x<tr><td colspan=2>Hello<td>y</table>", "Hi     x\nHello  y"),
        ("<table><tr><td>Total</td><td colspan=3>12</td><tr><td>Sum<td>1<td>2<td>3</table>", "Total  12\nSum    1  2  3"),
        ("<table><tr><td>" + "w" * 300 + "<td>x<tr><td>a<td>b</table>", "w" * 300 + "  x\na  b"),
        ("<dialog open>a</dialog><dialog>b</dialog>c", "a\nc"),
        ("<svg><title>t</title><desc>d</desc><text>seen</text></svg>", "seen"),
        ("", ""),
    ],
)
def test_rendering(html, want):
    assert H.extracted(html)[1] == want


def test_title_depth_and_long_input():
    assert H.extracted("<html><head><title> A &amp;\n b </title></head><body>x</body>") == ("A & b", "x")
    assert H.extracted("<div>" * 20_000 + "deep")[1] == "deep"
    assert H.extracted("<a \"" * 20_000 + ">x")[1] in ("x", '')
    assert H.extracted("<" * 50_000)[1] == "<" * 50_000
    assert H.extracted("<p>word " * 30_000)[1].count("word") == 30_000
    assert H.extracted("<table>" + "<tr><td colspan=99999>x<td>y" * 50 + "</table>")[1].count("x") == 50


@pytest.mark.parametrize("depth", [10, 300, 30_000])
def test_hidden_text_stays_hidden_at_any_depth(depth):
    assert H.extracted("<div>" * depth + "<div hidden>SECRET</div>seen<p style='display:none'>SECRET")[1] == "seen"
    assert H.extracted("<ul><li>" * depth + "<p hidden>SECRET</p>x")[1].split()[-1] == "x"
    assert H.extracted("<table><td><p>" + "<div>" * depth + "<span style='visibility:hidden'>SECRET</span>y")[1] == "y"


@pytest.mark.parametrize(
    "html",
    [
        "<table><tr><td>" + "a" * 200_000 + "<td>x" + "<tr><td>b<td>c" * 4000 + "</table>",
        "<table><tr>" + ("<td>" + "a" * 40) * 1000 + "<tr><td colspan=999><td>x" * 4000 + "</table>",
        ("<table><tr><td>" + "a" * 70 + "<td>") * 200 + "<br>x" * 4000,
        ("<table><tr><td>" + "a" * 70 + "<tr><td><td>") * 100 + "<br>x" * 4000,
        "<table>" + ("<tr><td colspan=7>" + "a" * 60 + "<td>z") * 300 + "</table>",
    ],
    ids=["long cell", "many columns", "nested beside", "nested below", "spans"],
)
def test_text_of_tables_grows_with_the_html(html):
    text = H.extracted(html)[1]
    assert len(text) <= 40 * len(html)
    assert text.count("a") == html.count("a") - html.count("table") - html.count("colspan")


def made(rng, depth=0):
    """(html, lines) of a random tree, its lines by another way: from the tree itself, without any parsing."""
    word = f"w{rng.randrange(1000)}"
    kind = rng.choice(("text", "p", "div", "list", "hidden", "table", "inline", "pre") if depth < 3 else ("text", "inline", "hidden"))
    if kind == "text":
        return word, [word]
    if kind == "inline":
        return f"<b>{word}</b> <i>x</i>", [f"{word} x"]
    if kind == "hidden":
        return rng.choice(("<div hidden>{}</div>", "<script>{}</script>", "<p style='display: none'>{}</p>", "<!-- {} -->")).format(word), []
    if kind == "pre":
        return f"<pre>{word}\n  z</pre>", ["", word, "  z", ""]
    if kind == "table":
        rows = [[f"c{rng.randrange(10 ** rng.randint(1, 5))}" for _ in range(3)] for _ in range(rng.randint(1, 4))]
        widths = [max(len(r[k]) for r in rows) for k in range(3)]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
        return html, ["", *("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows), ""]
    inner = [made(rng, depth + 1) for _ in range(rng.randint(1, 3))]
    if kind == "list":
        html, lines = "<ul>", []
        for _, (h, own) in enumerate(inner):
            h, own = (h, own) if len(own) == 1 and "<" not in h else ("k", ["k"])
            html += f"<li>{h}"
            lines += [f"- {own[0]}"]
        return html + "</ul>", ["", *lines, ""]
    html = "".join(f"<div>{h}</div>" for h, _ in inner)
    lines = [x for _, own in inner for x in own]
    return (f"<section>{html}</section>", ["", *lines, ""]) if kind == "p" else (f"<div>{html}</div>", lines)


def test_random_trees_against_another_rendering():
    import random

    rng = random.Random(9)
    for _ in range(400):
        html, lines = made(rng)
        want = []
        for x in lines:
            if x or (want and want[-1]):
                want.append(x)
        while want and not want[-1]:
            want.pop()
        assert H.extracted(html)[1] == "\n".join(want), html


def test_all_visible_words_come_out_in_order():
    import random

    rng = random.Random(5)
    for _ in range(200):
        parts, want, open_ = [], [], []
        for k in range(60):
            r = rng.random()
            if r < 0.3:
                tag = rng.choice(["div", "p", "b", "ul", "li", "section", "span", "h2", "blockquote"])
                parts.append(f"<{tag}>")
                open_.append(tag)
            elif r < 0.5 and open_:
                parts.append(f"</{open_.pop()}>")
            else:
                want.append(f"w{k}")
                parts.append(f" w{k} ")
        text = H.extracted("".join(parts))[1]
        assert [w for w in text.split() if w != "-"] == want


def test_frame(spark):
    rows = [(1, "u", "<p>a</p>", "x", 1), (None, None, None, None, None), (1, "u", "<p>a</p>", "x", 1), (2, "u", "", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.text, r.n_chars, r.n_lines) for r in H.extract_pages(pages).collect())
    assert got == [(0, "", 0, 0), (1, "a", 1, 1), (1, "a", 1, 1), (2, "", 0, 0)]
    assert H.extract_pages(pages.limit(0)).count() == 0
