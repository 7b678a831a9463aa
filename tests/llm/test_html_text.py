from curio.llm.html_text import extract, text_of
from curio.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_layout():
    html = ("<title>no</title><p>Hi<p>there <b>bold</b>&amp;<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>"
            "<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>s<td>22</table>end<br>x<script>no</script>"
            "<div style='display:none'>no</div><div hidden>no</div><!-- no --><pre>a\n  b</pre>")
    assert text_of(html) == "\n".join([
        "Hi", "", "there bold&", "", "- a", "- b", "  1. x", "  2. y", "- c", "", "Name       N", "long name  1", "s          22",
        "", "end", "x", "", "a", "  b"])


def test_broken_markup():
    for html in ["<", "</p>", "<div><span>x", "a < b > c", "<table><td>x<table><tr><td>y", "<p" * 50, "<b><i>x</b>y</i>", "&#xZZ;&bogus;&lt;"]:
        assert isinstance(text_of(html), str)
    assert text_of("<div>" * 5000 + "deep") == "deep"
    assert "deep" in text_of("<table><tr><td>" * 200 + "deep")
    assert text_of("plain   text\n here") == "plain text here"
    assert text_of(None) == "" == text_of("")
    assert text_of("<p>" + "word " * 100000).count("word") == 100000


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "old"), (1, "<p>a</p>", "old"), (None, None, None)], "page_id long, html string, TEXT string")
    out = extract(df)
    assert out.columns == ["page_id", "html", "text"] and sorted(r.text for r in out.collect()) == ["", "a", "a"]
    assert extract(df.limit(0)).count() == 0


def test_query_emits_all_visible_words(spark):
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as H
    for r in QUERIES["op4_html_text"](spark, SF).collect():
        seen = re.sub(r"(?is)<!--.*?-->|<(script|style|title)\b.*?</\1>|<[^>]*>", " ", pages[r.page_id])
        words = [w for w in H.unescape(seen).split()]
        mine = [w for w in r.text.split() if w != "-" and not re.fullmatch(r"\d+\.", w)]
        assert sorted("".join(mine)) == sorted("".join(w for w in words if w != "-" and not re.fullmatch(r"\d+\.", w)))


def test_no_word_is_lost_in_tables_heads_and_drawings():
    for html, words in [
            ("<table><tr><form><td>x</td><td>y</td></form></tr></table>after", "x y after"), ("<table><tbody><td>x</td><td>y</table>z", "x y z"),
            ("<table><td>x<tr><td>y</table>", "x y"), ("<table><tr>one<td>x</td></tr>two<tbody>three<tr><td>y</table>z", "one two three x y z"),
            ("a<table><tr><b>one<tr><td>x</b></table>b", "a one x b"), ("<table><tr><div>d<p>e</div><td>x</table>", "d e x"),
            ("<table><form><tr><td>x</form><tr><td>y</table>z", "x y z"), ("<table><tr><td>a<table>s<tr><td>b</table>c</table>d", "a s b c d"),
            ("<table>a<table><tr><td>b</table>c", "a b c"), ("<table><caption>c<tr><td>x</table>", "c x"),
            ("<table><tbody><tr><img alt=pic><select><option>o</select><td>x</table>", "pic o x"), ("<tr>a <td>b", "a b"),
            ("<head><title>t</title><span>x</span><p>y", "x y"), ("<head><b>x <i>y<p>z", "x y z"), ("<head><meta charset=u>x <a>y", "x y"),
            ("<head>x</head><body>y", "x y"), ("<svg><title>t</title><defs/><g><text>a</text><text>b</text></g></svg>c", "a b c"),
            ("<svg><defs><text>no</text></defs><text>a</text></svg>", "a"), ("<math><mi>x</mi><annotation>no</annotation></math> y", "x y"),
            ("<object data=f>held</object> y", "held y")]:
        assert sorted(text_of(html).split()) == sorted(words.split()), (html, text_of(html))
    assert text_of("<table><tr>" + "w <b>v</b> " * 3000 + "<td>x").split().count("w") == 3000
    assert text_of("<table><tr><td>a<td>b<tr><form><td>long<td>d</form></table>") == "a     b\nlong  d"


def test_end_tags_in_cells_end_nothing_outside():
    for tag in ("form", "section", "strong", "div", "span", "body"):
        html = f"<{tag}><table><tr><td>a</{tag}></td><td>b</td></tr><tr><td>long</td><td>d</td></tr></table></{tag}>z"
        assert text_of(html) == "a     b\nlong  d\n\nz", tag
    assert text_of("<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</table>") == "a b  c"
    assert text_of("<table><tr><td>x</tr><tr><td>y</table>") == "x\ny"


def test_options_lists_and_comments():
    assert text_of("x<select><option>a<option>b</select>y") == "x a b y"
    assert text_of("<ul><li><p>para</p></li><li><p>two</p>more</li></ul>") == "- para\n\n- two\n\n  more"
    assert text_of("<ul><li>a<br>b<ul><li>c</ul>d<li></ul>") == "- a\n  b\n  - c\n  d\n-"
    assert text_of("<ol start=5><li>a<li value=9>b<li>c<ol><li>d</ol></ol>") == "5. a\n9. b\n10. c\n  1. d"
    assert text_of("<ul><li><ul><li>x</ul></ul>") == "-\n  - x"
    assert text_of("a<!-- b <p>c") == "a" and text_of("a<!-- b -->c") == "ac"


def test_visibility_and_the_page_s_own_rules():
    assert text_of("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>") == "yes"
    assert text_of("<div style='display:none'>no<b style='display:block;visibility:visible'>no</b></div>a") == "a"
    page = "<style>/* .k{display:none} */ .h, p.x#y {color:red; display : none} @media print {.k{display:none}} .v{visibility:hidden}</style>"
    assert text_of(page + "<i class='q h'>no</i><p class=x id=y>no</p><p class=x>a</p><b class=k>b</b><i class=v>no</i>") == "a\n\nb"
    assert text_of("<style>.h{display:none} div.h{display:block}</style><div class=h>a</div><i class=h>no</i>") == "a"
    assert text_of("<style>.h{display:none!important}</style><i class=h style='display:inline'>no</i>b") == "b"
    assert text_of("<style>.h{display:none}</style><i class=h style='display:inline'>a</i>b") == "ab"
    assert text_of("<style media=print>p{display:none}</style><style>@import x; q{}</style><p>a") == "a"
    assert text_of("<style>" + "@{} {} ; a" * 100000 + "</style>x") == "x"
    assert text_of("<style>.h{display:none}</style><table><tr class=h><td>no<tr><td>a<td class=h>no<td>b</table>") == "a  b"


def plain_grid(rows):
    """Brute force: a grid of cell numbers for rows of (text, colspan, rowspan)."""
    grid = {}
    for r, row in enumerate(rows):
        c = 0
        for text, wide, tall in row:
            while (r, c) in grid:
                c += 1
            for i in range(tall):
                for j in range(wide):
                    grid.setdefault((r + i, c + j), (r, c, text))
            c += wide
    return grid


def test_spans_put_cells_under_their_columns():
    import random
    rng = random.Random(2)
    assert text_of("<table><tr><th colspan=2>Both<th>N<tr><td>a<td>b<td>1<tr><td rowspan=2>x<td>y<td>2<tr><td>z<td>3</table>") == \
        "Both  N\na  b  1\nx  y  2\n   z  3"
    for _ in range(200):
        # spans that overlap in one place are an error of the page and left out here
        width, rows, free = rng.randrange(1, 6), [], {}
        for r in range(rng.randrange(1, 6)):
            row, c = [], 0
            while c < width:
                if free.get(c, 0) > r:
                    c += 1
                    continue
                room = next((n for n in range(1, width - c) if free.get(c + n, 0) > r), width - c)
                wide, tall = rng.randint(1, room), rng.choice([1, 1, 2])
                for j in range(wide):
                    free[c + j] = r + tall
                row.append((f"r{r}c{c}" + "w" * rng.randrange(4), wide, tall))
                c += wide
            rows.append(row)
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={t}>{x}" for x, w, t in row) for row in rows) + "</table>"
        lines = [line for line in text_of(html).split("\n") if line]
        at = {}  # text -> place in its line
        for line in lines:
            for word in line.split():
                at[word] = line.index(word)
        grid = plain_grid(rows)
        column = {text: c for (r, c), (r0, c0, text) in grid.items() if (r, c) == (r0, c0)}
        assert set(at) == set(column)
        for a in column:
            for b in column:
                assert (at[a] < at[b]) == (column[a] < column[b]) and (at[a] == at[b]) == (column[a] == column[b]), (html, a, b)
