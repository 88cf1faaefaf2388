import random
import time

from lumenreel.llm.html_text import WIDE, Spans, extract, html_text


def test_blocks_lists_and_tables():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head>
    <body><h1>Head &amp; tail</h1><p>One   two<b> three</b><p>Four<br>five
    <ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><div hidden>gone</div><div style="display:none">gone</div>
    <table><tr><th>Name<th>N<tr><td>long name<td>1</table>tail<pre>a  b
  c</pre><!-- no --></body></html>"""
    assert html_text(page) == (
        "Head & tail\n\nOne two three\n\nFour\nfive\n\n- a\n- b\n  3. x\n  4. y\n\n"
        "Name       N\nlong name  1\n\ntail\n\na  b\n  c"
    )


def test_broken_and_odd_pages():
    assert html_text(None) == html_text("") == ""
    assert html_text("plain < text & more") == "plain < text & more"
    assert html_text("<p>open <b>never</i> closed <a href='x") .startswith("open never closed")
    assert html_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text("<td>loose<td>cells") == "loose\ncells"
    assert html_text("<script>never ends") == ""
    assert html_text("&eacute;&#233;&nope;") == "éé&nope;"


def test_loose_content_among_rows_is_kept():
    assert html_text("<table><tr><form><td>a</td><td>b</td></form></tr><tr><td>c<td>d</table>") == "a  b\nc  d"
    assert html_text("<form>x<table><tr><form><td>a</td></form><td>b</td></tr><tr><td>c</td></tr></table>y</form>") == "x\n\na  b\nc\n\ny"
    assert html_text("x<table>one<tr>two<td>a</td>three</tr><tbody>four<b>five<tr><td>b</b></table>y") == "xonetwothreefourfive\n\na\nb\n\ny"
    assert html_text("<table><tr><div>loose<td>a</div><caption>cap</caption></table>") == "loose\n\na\ncap"
    assert html_text("<table><colgroup><col>text<tr><td>a</table>") == "text\n\na"
    assert html_text("<table><tr><td>a<table><tr>in<td>b</table>c</table>") == "ain\n\nb\n\nc"
    assert html_text("<table><tr><table><tr><td>b</table>c") == "b\n\nc"


def test_head_ends_where_content_begins():
    assert html_text("<head><title>T</title><p>Hello") == "Hello"
    assert html_text("<html><head><meta charset=x>\n<style>p{}</style> text <b>more</b>") == "text more"
    assert html_text("<head><noscript><p>no</noscript><link href=x></head><body>yes") == "yes"


def test_only_parsed_attributes_hide():
    for attrs in ('title="a hidden gem"', "alt='x hidden'", 'class="a hidden b"', 'data-style="display:none"', 'style="--display:none"', 'title="style=\'display:none\'"', 'type="hidden"', 'style="display:none;display:block"', "x=hidden", "class=hidden"):
        assert html_text(f"<div {attrs}>shown</div>") == "shown", attrs
    for attrs in ("hidden", "HIDDEN=''", "a=b hidden", "a='b'hidden", 'style="color:red; Display : NONE !important;display:block"', "style=display:none", "style='visibility:hidden'"):
        assert html_text(f"<div {attrs}>gone</div>") == "", attrs


def test_rows_are_kept(spark):
    rows = [(1, None, "t"), (1, None, "t"), (2, "", "t"), (3, "<p>x", None), (None, "<p>" + "word " * 200000, "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 0, 1, 999999]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_visibility_is_inherited_and_display_is_final():
    assert html_text('<div style="visibility:hidden">a<p style="visibility:visible">b<i>c</i></p>d</div>e') == "bc\n\ne"
    assert html_text('<div style="display:none">a<p style="visibility:visible;display:block">b</p></div>e') == "e"
    assert html_text('<table style="visibility:collapse"><tr><td>a<td style="visibility:visible">b</table>') == "b"


def test_cells_over_columns_and_rows():
    assert html_text("<table><tr><td colspan=2>both<td>c<tr><td>aa<td>bb<td>cc</table>") == "both    c\naa  bb  cc"
    assert html_text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert html_text("<table><tr><td colspan=1000>x<td>y<tr><td>z</table>") == "x  y\nz"
    wide = "w" * (WIDE + 1)
    assert html_text(f"<table><tr><td>{wide}<td>b<tr><td>a<td>c</table>") == f"{wide}  b\na  c"


def plain_columns(rows):
    """Each cell's column, from a grid of places."""
    taken, out = {}, []
    for r, row in enumerate(rows):
        column = 0
        for across, down in row:
            while (r, column) in taken:
                column += 1
            out.append(column)
            for y in range(r, r + (down or len(rows))):
                for x in range(column, column + across):
                    taken[y, x] = True
            column += across
    return out


def test_spans_equal_a_grid():
    rng = random.Random(4)
    for _ in range(400):
        rows = [[(rng.choice([1, 1, 2, 5]), rng.choice([1, 1, 2, 3, 0, 9])) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 12))]
        spans, found = Spans(), []
        for r, row in enumerate(rows):
            spans.reach(r)
            column = 0
            for across, down in row:
                column = spans.free(column)
                found.append(column)
                if down != 1:
                    spans.take(column, column + across, r + down - 1 if down else None)
                column += across
        assert found == plain_columns(rows)


def test_drawings_formulas_and_fields():
    assert html_text("a<svg width=9><title>t</title><style>x</style><defs><text>no</text></defs><g>bare<text x=1>SVG <tspan>visible</tspan></text><path d='M'/><text>two</text></g></svg>b") == "a\nSVG visible\ntwo\nb"
    assert html_text("<svg><foreignObject><p>in</p></foreignObject><circle/><text display=none>no</text><text visibility=hidden>no</text></svg>") == "in"
    assert html_text("<p>x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> z") == "x y=2 z"
    assert html_text("<svg><g><div>broken out</div>more") == "broken out\nmore"
    assert html_text("<math><mtext><b>inside</b></mtext></math><svg/>after") == "insideafter"
    assert html_text("<textarea>one\n two\n\nthree &amp;</textarea>") == "one\n two\n\nthree &"
    assert html_text("<form>Name <input type=text value=no><input type=Submit value='Send it'><input type=hidden value=no></form>") == "Name Send it"


def test_broken_pages_take_linear_time():
    many = 40_000
    for junk in ("<![CDATA[", '<a "', "<a '", "<a ", "</a ", "<!x ", "<!x \"", "<script>", "</script <script>", "<a \"\" ", "<", "<!--", "<textarea>", "<table><tr><td>", "<p>", "<ul><li>"):
        for end in ("", '"', ">", "'>"):
            start = time.time()
            html_text("<p>seen</p>" + junk * many + end)
            assert time.time() - start < 10, junk
    for cell in ("<tr><td rowspan=65534 colspan=1000>a", "<tr><td rowspan=65534>a", "<tr><td rowspan=5000 colspan=1000>a<td>b", "<tr><td><td rowspan=300>a", "<tr><td rowspan=9000 colspan=2>a<td>", "<td rowspan=7>a"):
        start = time.time()
        assert len(html_text("<table>" + cell * (1_000_000 // len(cell)))) < 200_000_000
        assert time.time() - start < 10, cell
    page = "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "</table>"
    assert len(html_text(page)) < 2 * len(page)


def plain_page(rng):
    """A page and its text, made side by side."""
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda: " ".join(word() for _ in range(rng.randint(1, 5)))
    junk = lambda: rng.choice(["", "", f"<!-- {word()} -->", f"<script>var {word()} = '<p>';</script>", f"<div hidden>{word()}</div>", f'<p style="display:none">{word()}</p>'])

    def inline(t):
        return " ".join(rng.choice(["{}", "<b>{}</b>", "<a href='x>y'>{}</a>", "<span class=hidden>{}</span>"]).format(w) for w in t.split())

    parts = []  # source, lines, whether blank lines part it from its neighbours
    for _ in range(rng.randint(0, 8)):
        kind, t = rng.choice(["p", "h2", "div", "ul", "ol", "table", "pre"]), text()
        if kind in ("p", "h2", "div"):
            parts.append((f"<{kind} title='a>b'>\n{inline(t)}{rng.choice(['', '</' + kind + '>'])}" if kind == "p" else f"<{kind}>{inline(t)}</{kind}>", [t], kind != "div"))
        elif kind == "pre":
            parts.append((f"<pre>{t}\n  {t}</pre>", [t, "  " + t], True))
        elif kind == "table":
            rows = [[text() if rng.random() < 0.8 else "" for _ in range(3)] for _ in range(rng.randint(1, 4))]
            wide = [max(len(r[i]) for r in rows) for i in range(3)]
            source = "<table>" + "".join("<tr>" + "".join(f"<td>{inline(c)}" for c in r) for r in rows) + "</table>"
            parts.append((source, ["  ".join(c.ljust(w) for c, w in zip(r, wide) if w).rstrip() for r in rows if any(r)], True))
        else:
            items = [text() for _ in range(rng.randint(1, 4))]
            inner = [text() for _ in range(rng.randint(0, 2))]
            marks = ["- "] * len(items) if kind == "ul" else [f"{i}. " for i in range(4, 4 + len(items))]
            source = f"<{kind}{' start=4' if kind == 'ol' else ''}>" + "".join(f"<li>{inline(i)}" for i in items)
            source += ("<ul>" + "".join(f"<li>{inline(i)}</li>" for i in inner) + "</ul>" if inner else "") + f"</{kind}>"
            parts.append((source, [m + i for m, i in zip(marks, items)] + [" " * len(marks[-1]) + "- " + i for i in inner], True))
    parts = [p for p in parts if any(p[1])]
    lines = []
    for i, (_, new, spaced) in enumerate(parts):
        lines += ([""] if i and (spaced or parts[i - 1][2]) else []) + new
    return "<!doctype html><head><title>no</title>" + junk() + "<body>" + "".join(junk() + p[0] for p in parts), "\n".join(lines)


def test_pages_equal_the_text_made_beside_them():
    rng = random.Random(9)
    for _ in range(400):
        source, want = plain_page(rng)
        assert html_text(source) == want, source


def test_columns_named_like_the_text(spark):
    got = extract(spark.createDataFrame([(1, "<p>x", "t")], "page_id long, html string, Text string"), keep=("page_id", "Text"))
    assert got.columns == ["page_id", "text"] and got.first().text == "x"
