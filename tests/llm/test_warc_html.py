import random
import re
import time
from html.parser import HTMLParser

from compare import rows, tables
from pyspark.sql import functions as F

from corpusloom.llm import html_text, warc
from corpusloom.llm.queries import oracle_sql, queries
from corpusloom.llm.tables import read_table

FOLDER = "/root/testdata/sf0.01"


def test_same_as_sql(spark):
    for name in ("op4_exact_dedup", "op6_revisits"):
        theirs = tables(FOLDER).execute(oracle_sql()[name]).df()
        assert rows(queries()[name](spark, FOLDER).toPandas()) == rows(theirs)


RECORD = "record_id long, url string, ts long, kind string, http_status int, headers map<string,string>, body string, part string"


def resolve(records, merge_unchecked):
    """A plain scan for each revisit."""
    out = {}
    for rid, url, ts, kind, status, headers in records:
        if (kind, status) != ("revisit", 304):
            continue
        own = {k.lower(): v for k, v in (headers or {}).items()}
        found = None
        for o in records:
            if o[3:5] == ("response", 200) and None not in (url, ts, o[1], o[2]) and o[1] == url and (o[2], o[0]) < (ts, rid):
                found = max(found, o, key=lambda x: (x[2], x[0])) if found else o
        if not found:
            out[rid] = (None, "orphan", own)
            continue
        old = {k.lower(): v for k, v in (found[5] or {}).items()}
        same = None
        if "etag" in own and "etag" in old:
            same = own["etag"].removeprefix("W/") == old["etag"].removeprefix("W/")
        elif "last-modified" in own and "last-modified" in old:
            same = own["last-modified"] == old["last-modified"]
        merged = old | {k: v for k, v in own.items() if k not in warc.NOT_MERGED}
        out[rid] = (found[0], {True: "resolved", None: "unchecked", False: "mismatch"}[same], merged if same or same is None and merge_unchecked else own)
    return out


def test_revisits_are_a_plain_scan(spark):
    random.seed(15)
    records = []
    for rid in range(600):
        kind, status = random.choice([("response", 200), ("response", 404), ("revisit", 304), ("revisit", 304), ("revisit", 200)])
        names = {"ETag": random.choice(['"a"', 'W/"a"', '"b"']), "Last-Modified": random.choice("xy"), "Content-Length": "1", "X": str(rid)}
        headers = {k: v for k, v in names.items() if random.random() < 0.6}
        url = random.choice(["hot.org/x"] * 4 + ["a.org/x", "b.org/y", None])
        records.append((rid, url, random.choice([*range(40), None]), kind, status, random.choice([headers, headers, None])))
    spelled = [(i, u and random.choice(["http://", "https://WWW."]) + u + random.choice(["", "/", "#f", "?utm_source=z"]), *r, "body", "p") for i, u, *r in records]
    for merge in (False, True):
        got = warc.resolve_revisits(spark.createDataFrame(spelled, RECORD), merge_unchecked=merge).collect()
        assert {r.record_id: (r.refers_to, r.status, r.headers) for r in got} == resolve(records, merge)
    assert warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_canonical_url(spark):
    urls = {"HTTP://WWW.Ex.org:80/A/?utm_a=1&b=2&utm_c=3#x": "ex.org/A/?b=2", "https://ex.org/": "ex.org", "//m.ex.org:443/p?": "m.ex.org/p", None: None}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == urls


LAID_OUT = {
    "<p>a<p>b<ul><li>x<li>y<ul><li>z</ul><li>w</ul><ol start=3><li>q<li>r</ol>t": "a\n\nb\n\n- x\n- y\n  - z\n- w\n\n3. q\n4. r\n\nt",
    "<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<br>c<td>22</table>after": "Name   N\nalpha  1\nb      22\nc\n\nafter",
    "<pre>a\n  b</pre><div hidden>no</div><i style='color:red; DISPLAY : none'>no</i> ok &amp; <b>bo</b>ld<script>'</p>'</script>": "a\n  b\n\nok & bold",
    "<title>T</title>x<!-- <p>no -->y<textarea>keep</textarea>": "xykeep",
    "</p>a</div></td>b<br>c": "ab\nc",
    "": "",
    "a < b <3 <": "a < b <3 <",
    "x<a href='>'>y</a><p unclosed": "xy",
}


def test_layout():
    for page, text in LAID_OUT.items():
        assert html_text.page_text(page)[1] == text, page
    assert html_text.page_text("<head><title> a\n b </title></head>c") == ("a b", "c")
    assert html_text.page_text(None) == (None, "")
    assert html_text.page_text("<div>" * 20000 + "deep")[1] == "deep"
    assert html_text.page_text("<ul><li>" * 200 + "x")[1].endswith("- x")


DRAWN = {
    "see <svg><title>t</title><desc/><defs><text>no</text></defs>no<g><circle r='1'/><text>A<tspan>b</tspan></text><text>C</text></g></svg>end": "see Ab C end",
    "<svg><style/><text><![CDATA[1 < 2]]></text><text display=none>no</text></svg>": "1 < 2",
    "<svg><switch><foreignObject><p>x<p>y</foreignObject><text>old</text></switch></svg>z": "x\n\ny\n\nz",
    "<p>a<svg><path d='M0'><p>b": "a\n\nb",
    "if <math><mi>x</mi> <mo>=</mo> <mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> then": "if x=1 2 then",
    "<math><semantics><mrow><mi>y<mo>&lt;</mo></mi></mrow><annotation-xml encoding='text/html'><p>no</annotation-xml></semantics></math>z": "y<z",
    "Size<select><option>S<option selected>M<option>L</select>now": "Size M now",
    "<select><option disabled>pick</option><optgroup label=g><option>S<option>L</optgroup></select>": "S",
    "<select><option hidden selected label='Choose'>c<option>d</select>": "Choose",
    "<select multiple><option>S<option>L</select>x": "S\nL\nx",
    "<select><option>S<textarea>t</textarea>u<select hidden><option>v</select>": "S tu",
    "<svg>" + "<g>" * 20000 + "<text>deep": "deep",
}


def test_drawings_formulas_and_choices():
    for page, text in DRAWN.items():
        assert html_text.page_text(page)[1] == text, page[:200]
    assert html_text.page_text("<svg><title>s</title></svg><p>x") == (None, "x")


class Words(HTMLParser):
    """Words outside elements that are never shown, by another parser."""

    def __init__(self):
        super().__init__()
        self.words, self.unseen = [], 0

    def handle_starttag(self, tag, attrs):
        self.unseen += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.unseen -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.unseen:
            self.words += data.split()


def test_all_words_of_pages_stay_in_order(spark):
    pages = read_table(spark, FOLDER, "pages")
    for r in html_text.extract(pages).collect():
        words = Words()
        words.feed(r.html)
        words.close()
        shown = [re.sub(r"^-$", "", w) for w in r.page.text.split()]
        assert "".join(w for w in shown if w) == "".join(w for w in words.words if w != "-")
    assert html_text.extract(pages.limit(0)).count() == 0


def plain_table(rows):
    """Where each cell's text begins, by column, with every column as wide as its widest cell of one column."""
    grid, taken = [], {}
    for r, row in enumerate(rows):
        at = 0
        for text, columns, down in row:
            while (r, at) in taken:
                at += 1
            grid.append((r, at, text))
            for y in range(r, r + down):
                for x in range(at, at + columns):
                    taken[y, x] = text
            at += columns
    wide = {}
    for r, row in enumerate(rows):
        for text, columns, _ in row:
            c = next(c for q, c, t in grid if q == r and t == text)
            wide[c] = max(wide.get(c, 0), len(text) if columns == 1 else 0)
    return {text: (r, sum(wide.get(x, 0) + 2 for x in range(c) if wide.get(x, 0))) for r, c, text in grid}


def test_tables_are_laid_out_as_by_a_plain_renderer():
    rows = [[("Wide head", 2, 1), ("c0", 1, 1)], [("a1", 1, 2), ("bee1", 1, 1), ("c1", 1, 1)], [("b2", 1, 1), ("c2", 1, 1)], [("a3", 1, 1), ("b3", 1, 1), ("c3", 1, 1)]]
    cell = lambda c: f"<td colspan={c[1]} rowspan={c[2]}>{c[0]}</td>"
    html = "<table>" + "".join(f"<tr>{''.join(map(cell, row))}</tr>" for row in rows) + "</table>"
    lines = html_text.page_text(html)[1].split("\n")
    for text, (r, column) in plain_table(rows).items():
        if text == "c0":  # its column begins within the wide head's text, so it stands two spaces after it
            assert lines[r] == "Wide head  c0"
        else:
            assert lines[r][column : column + len(text)] == text, (lines, text)


def test_long_cells_are_not_padded_to():
    html = "<table><tr><td>" + "x" * 20000 + "</td><td>" + "<br>".join(["short"] * 2000) + "</td></tr></table>"
    assert len(html_text.page_text(html)[1]) < 4 * len(html)
    wide = "<table>" + "<tr><td colspan=1000>a</td><td rowspan=99999999>b</td><td colspan=x>c</td></tr>" * 50 + "</table>"
    assert len(html_text.page_text(wide)[1]) < 2 * len(wide)


def test_visibility_is_inherited():
    shown = lambda html: html_text.page_text(html)[1]
    assert shown("a<div style='visibility:hidden'>b<span style='visibility:visible'>c</span>d</div>e") == "a\nc\ne"
    assert shown("<p style='visibility:hidden'>b<b style='display:none'>x<i style='visibility:visible'>y</i></b></p>z") == "z"
    assert shown("<p style='visibility:hidden;visibility:visible'>b</p>") == "b"
    assert shown("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>") == "- b"
    assert shown("a<button>got</button><textarea>it</textarea>") == "a got it"


def test_clashing_page_column(spark):
    frame = spark.createDataFrame([("<p>a", 1, "t"), (None, 2, "u"), ("<p>a", 1, "t")], "html string, page int, text string")
    got = html_text.extract(frame)
    assert got.columns == ["html", "page", "text"] and sorted(r.page.text for r in got.collect()) == ["", "a", "a"]
    assert html_text.extract(frame.limit(0)).count() == 0


SPACED, INLINE = {"p", "ul", "ol", "blockquote", "h2"}, {"b", "i", "span", "a"}


def random_tree(rng, depth=0, within=None):
    """(tag, children) of a well-formed page without tables; a string is text."""
    children = []
    for _ in range(rng.randint(0, 5)):
        kind = rng.random()
        if within in ("ul", "ol"):
            children.append(("li", random_tree(rng, depth + 1, "li")))
        elif kind < 0.45 or depth > 5:
            children.append(rng.choice(["one", " two ", "three\n\tfour", " ", "&amp;", "é "]))
        elif kind < 0.55:
            children.append(("br", []))
        elif kind < 0.75 or within in INLINE | {"p", "h2"}:
            tag = rng.choice(sorted(INLINE))
            children.append((tag, random_tree(rng, depth + 1, tag)))
        else:
            tag = rng.choice(["div", "p", "ul", "ol", "blockquote", "h2", "section"])
            children.append((tag, random_tree(rng, depth + 1, tag)))
    return children


def as_html(children):
    return "".join(c if isinstance(c, str) else f"<{c[0]}>" if c[0] == "br" else f"<{c[0]}>{as_html(c[1])}</{c[0]}>" for c in children)


def plain_text(children):
    """The page as events (text, line break, block edge), then as lines: nothing of a layout is held but the line."""
    events = []

    def walk(children, lists, indent):
        for c in children:
            if isinstance(c, str):
                events.append(("text", c.replace("&amp;", "&"), indent))
                continue
            tag, inner = c
            if tag == "br":
                events.append(("break", "", indent))
            elif tag in INLINE:
                walk(inner, lists, indent)
            elif tag in ("ul", "ol"):
                events.append(("edge", "" if lists else "gap", indent))
                for n, (_, item) in enumerate(inner, 1):
                    deeper = indent + (len(lists) > 0)
                    events.append(("edge", "", indent))
                    events.append(("item", f"{n}. " if tag == "ol" else "- ", deeper))
                    walk(item, [*lists, tag], deeper)
                    events.append(("edge", "", indent))
                    events.append(("item", "", indent))
                events.append(("edge", "" if lists else "gap", indent))
            else:
                events.append(("edge", "gap" if tag in SPACED else "", indent))
                walk(inner, lists, indent + (tag == "blockquote"))
                events.append(("edge", "gap" if tag in SPACED else "", indent))

    walk(children, [], 0)
    lines, line, space, gap, mark = [], "", False, False, ""
    for kind, value, indent in [*events, ("edge", "", 0)]:
        if kind == "text":
            for i, word in enumerate(re.split(r"[ \t\n]+", value)):
                space = space or i > 0
                if word:
                    if not line:
                        lines += [""] if gap and lines else []
                        line, gap, mark = "  " * indent + mark, False, ""
                    elif space:
                        line += " "
                    line, space = line + word, False
        elif kind == "item":
            mark = value
        else:
            if line or kind == "break":
                lines.append(line)
            gap = gap or value == "gap"
            line, space = "", False
    return "\n".join(lines).strip("\n")


def test_pages_without_tables_are_those_of_a_plain_renderer():
    rng = random.Random(41)
    shown = 0
    for _ in range(1500):
        tree = random_tree(rng)
        assert html_text.page_text(as_html(tree))[1] == plain_text(tree), as_html(tree)
        shown += "<ol>" in as_html(tree) and "<blockquote>" in as_html(tree)
    assert shown > 50


CROWDED = {
    "lists": "<ul><li>x" * 3000,
    "tables": "<table><tr><td>x" * 4000,
    "spans": "<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 150,
    "many spans": "<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 900,
    "wide row": "<table><tr>" + "".join(f"<td>{'w' * 8000}{i}" for i in range(100)) + "".join("<tr><td colspan=99><td>x" for _ in range(300)),
    "columns": "<table><tr>" + "".join(f"<td>{'w' * 40}{i}" for i in range(300)) + "".join("<tr><td colspan=299><td>x" for _ in range(300)),
    "lines": "<table><tr><td>" + "w" * 48 + "<td>" + "x<br>" * 5000 + "<td>y" * 2000,
    "end tags": "<i><table><td>" + "<div>" * 10000 + "</i>" * 10000,
    "foreign end tags": "<svg><g><foreignobject>" + "<div>" * 10000 + "</g>" * 10000,
    "quotes": "<blockquote>x" * 5000,
}


def test_time_and_text_stay_within_a_multiple_of_the_page():
    for name, page in CROWDED.items():
        began = time.process_time()
        text = html_text.page_text(page)[1]
        assert time.process_time() - began < 2 and len(text) < 4 * len(page), name
        assert sorted(re.findall('[xy]', text)) == sorted(re.findall('[xy]', re.sub('<[^>]*>', '', page))), name


def test_columns_that_earlier_rows_fill_are_passed_over():
    rng = random.Random(42)
    for _ in range(200):
        rows = [[(f"r{r}c{c}", rng.randint(1, 3), rng.randint(1, 3)) for c in range(rng.randint(0, 4))] for r in range(rng.randint(1, 6))]
        taken, want = set(), []
        for r, row in enumerate(rows):
            at = 0
            for text, columns, down in row:
                while (r, at) in taken:
                    at += 1
                want.append((r, at, text))
                taken |= {(y, x) for y in range(r + 1, r + down) for x in range(at, at + columns)}
                at += columns
        cells = [[html_text.Cell([t], len(t), c, d) for t, c, d in row] for row in rows]
        got = [(r, at, cell.lines[0]) for r, line in enumerate(html_text.places(cells)) for at, cell in line]
        assert got == want


def test_end_tags_end_the_innermost_element_in_reach():
    shown = lambda html: html_text.page_text(html)[1]
    assert shown("<p>a<b>b</p>c") == "ab\n\nc"
    assert shown("<table><tr><td><p>a</table></p>b") == "a\n\nb"
    assert shown("<i>a<table><tr><td>b</i>c</table>d") == "a\n\nbc\n\nd"
    assert shown("<svg><g><text>a</g><text>b</svg>c") == "a b c"
    assert shown("<svg><g><foreignobject><div>a</g>b</div></foreignobject></g></svg>") == "ab"
    assert shown("<li>a<div><li>b") == "- a\n- b"
