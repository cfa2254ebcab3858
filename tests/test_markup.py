"""Detail text against a document tree built with Python's HTML parser."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lodgetrail.functions import fees, markup, text
from lodgetrail.sources import details


class Tree(HTMLParser):
    """A small document tree: nodes are [name, children]; texts are strings."""

    def __init__(self, page):
        super().__init__()
        self.root = ["root", []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def _end_paragraph(self):
        names = [n[0] for n in self.open]
        if "p" in names:
            del self.open[len(names) - 1 - names[::-1].index("p") :]

    def handle_starttag(self, tag, attrs):
        if tag == "p" or tag in markup.BLOCK:
            self._end_paragraph()
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in markup.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        names = [n[0] for n in self.open]
        if tag in names[1:]:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        children = self.open[-1][1]
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def texts(node):
    if isinstance(node, str):
        return [node.strip()] if node.strip() else []
    return [] if node[0] in ("script", "style") else [t for c in node[1] for t in texts(c)]


def find(node, test, parent=None):
    if isinstance(node, str):
        return None
    if test(node):
        return node, parent
    return next((hit for c in node[1] if (hit := find(c, test, node))), None)


def leading(node):
    return node[1][0] if node[1] and isinstance(node[1][0], str) else ""


def description(page):
    hit = find(Tree(page).root, lambda n: n[0] == "h2" and "Detail" in leading(n))
    out = []
    if hit:
        h2, parent = hit
        for c in parent[1][next(i for i, c in enumerate(parent[1]) if c is h2) + 1 :]:
            if isinstance(c, str):
                continue
            if c[0] in ("h2", "h3"):
                break
            out += texts(c)
    return "\n".join(out) or None


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


PAGES = [
    '<div><h2 title="a>b">Detail <b>of it</b></h2><div>one<div>two</div></div><!-- <h2>no</h2> --><p>three<h3>end</h3><p>four</div><p>out</p>',
    '<section><h2>Detail</h2>loose<p data-x="1 > 0">kept &amp; read<br>next</p></section><div>other</div>',
    "<h2>Detail</h2><ul><li>a<li>b<h3>inner</h3></ul><h2>more</h2><p>x</p>",
    "<h2>Detail</h2><script>if (a < b) { '</div>' }</script><style>.x{}</style><div>3 < 4 and <i>5</i></div>",
    "<div><h2>Detail</h2></div><p>not beside it</p>",
    "<h2>Other</h2><p>x</p><h2>Detail</h2><p>a<p>b<div>c</div>d",
    "<h2>Detail</h2><img src='x>y'><p>after an image</p><table><tr><td>cell<td>cell2</table>",
]


def test_descriptions_equal_the_tree(spark):
    assert values(spark, PAGES, text.description_section(F.col("v"))) == [description(p) for p in PAGES]


def test_random_pages_equal_the_tree(spark):
    rng = random.Random(12)

    def part(depth):
        kind = rng.choice(["text", "div", "p", "span", "ul", "void", "h3", "comment"] if depth < 4 else ["text", "void"])
        if kind == "text":
            return rng.choice(["word", " two words ", "1 < 2", "a&amp;b", "  "])
        if kind == "void":
            return rng.choice(["<br>", '<img alt="x > y">', "<hr/>"])
        if kind == "comment":
            return "<!-- <div> > -->"
        inner = "".join(part(depth + 1) for _ in range(rng.randrange(4)))
        if kind == "p":
            inner = "".join(rng.choice(["x", "<b>y</b>", " z "]) for _ in range(3))
            return f"<p>{inner}" + rng.choice(["</p>", "</p>", ""])
        if kind == "ul":
            return f'<ul class="a>b">' + "".join(f"<li>{part(depth + 1)}" + rng.choice(["</li>", ""]) for _ in range(2)) + "</ul>"
        return f"<{kind} data-a='>'>{inner}</{kind}>"

    pages = []
    for _ in range(150):
        body = "".join(part(0) for _ in range(rng.randrange(1, 7)))
        pages.append(f"<body><div>{part(1)}<h2>Detail</h2>{body}</div>{part(0)}</body>")
    got = values(spark, pages, markup.siblings_text(text.first_match(markup.visible(F.col("v")), text._DETAIL), ("h2", "h3")))
    want = [description(p) for p in pages]
    assert [(p, g) for p, g, w in zip(pages, got, want) if g != w] == []


@pytest.mark.parametrize("page,value", [
    ("<div><span>Water price</span><span>18 <b>THB</b>/unit</span></div>", "18 THB/unit"),
    ('<div><span>Water  price</span><!-- x --><div title="a>b"><div>20</div><div>THB</div></div><p>no</p></div>', "20THB"),
    ("<div><b>Water price</b> 8 THB/unit</div><p>other</p>", "8 THB/unit"),
    ("<div><b>Water price</b><i> </i>\n9 THB\nmore</div>", "9 THB"),
    ("<div><b>Water price</b></div><div>7</div>", None), ("<p>Water price</p> <p> 5 <b>THB</b></p>", "5 THB"),
    ("<p><b>Water price</b> 6 THB</p><p>other</p>", "6 THB"), ("<p>Water price</p>", None),
    ("<p>nothing</p>", None), (None, None),
])
def test_labels(spark, page, value):
    assert values(spark, [page], fees.labelled_text(markup.visible(F.col("v")), r"Water\s+price")) == [value]


def test_the_grid_is_its_element(spark):
    row = lambda cls, label: f'<div class="css-{cls}"><span class="css-l">{label}</span></div>'
    style = '<style data-emotion="css off">.css-off{text-decoration-line:line-through;}</style>'
    page = (f'<div><h2 id="x>y">Amenities <i>all</i></h2><p>intro</p><div class="css-box">{style}{row("on", "Pool")}{row("off", "Gym")}</div>'
            f'<div class="css-on"><span class="css-l">Not of the grid</span></div></div>')
    assert values(spark, [page, "<h2>Amenities</h2>", None], F.array_join(details.icon_amenities(details.amenity_section(F.col("v"))), "|")) == ["Pool", None, None]


def test_long_pages_are_read_whole(spark):
    page = "<h2>Detail</h2>" + "".join(f'<p class="{"x" * 50}">part {i}</p>' for i in range(3000)) + "<h2>end</h2>" + '<a title="' + "q>" * 20_000 + '">z</a>'
    got = values(spark, [page], text.description_section(F.col("v")))[0]
    assert got.split("\n") == [f"part {i}" for i in range(3000)]


def test_a_tags_name_is_read_once():
    """Lambdas don't share repeated parts: read in place, the name was cut out of every tag for each use."""
    assert str(markup.tokens(F.col("v"))).count("regexp_extract(") == 1
