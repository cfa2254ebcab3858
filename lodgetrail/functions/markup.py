"""HTML read as elements: a page is cut into tags and texts, and folds over them keep the depth.

Quoted attributes may hold ``>``, comments and scripts are no text, a paragraph ends where a block begins, and a section
ends with the element it stands in. Everything is a ``Column``; no page leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: elements without a closing tag, elements whose closing tag may be left out (they only stand inside
# others, so the depth does without them), and elements that end an open paragraph
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
LOOSE = ("dd", "dt", "li", "option", "tbody", "td", "tfoot", "th", "thead", "tr")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "details", "div", "dl", "fieldset", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "main", "nav", "ol", "pre", "section", "table", "ul",
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))

#: Attributes up to the end of a tag; quoted values are taken whole.
ATTRIBUTES = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
#: A tag; where its quotes don't match, up to the next ``>``.
TAG = rf"</?[a-zA-Z]{ATTRIBUTES}>|</?[a-zA-Z][^>]*+>|<![^>]*+>"
HIDDEN = rf"(?is)<(script|style)\b{ATTRIBUTES}>.*?</\1\s*>|<!--.*?-->"
_TOKEN = rf"(?s){TAG}|(?:[^<]++|<(?![a-zA-Z/!]))++"
_OPEN, _CLOSE, _TEXT, _P_OPEN, _P_CLOSE, _NONE = 1, -1, 0, 3, -3, 9


def visible(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, HIDDEN, "")


def plain(text: Column) -> Column:
    """A text with its entities read."""
    for entity, shown in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(shown))
    return text


def tokens(html: Column) -> Column:
    """Tags and texts of a visible page, in order, as structs of ``kind``, ``name``, ``block`` and ``raw``."""
    def name_of(raw: Column) -> Column:
        tag = F.when(F.startswith(raw, F.lit("<")), F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)))
        return F.struct(F.coalesce(tag, F.lit("")).alias("name"), raw.alias("raw"))

    def mark(named: Column) -> Column:
        name, raw = named["name"], named["raw"]
        closes = F.startswith(raw, F.lit("</"))
        kind = (
            F.when(F.startswith(raw, F.lit("<!")), _NONE).when(name == "", _TEXT)
            .when(name.isin(*VOID, *LOOSE) | F.endswith(raw, F.lit("/>")), _NONE)
            .when(name == "p", F.when(closes, _P_CLOSE).otherwise(_P_OPEN))
            .otherwise(F.when(closes, _CLOSE).otherwise(_OPEN)))
        return F.struct(kind.alias("kind"), name.alias("name"), name.isin(*BLOCK).alias("block"), raw.alias("raw"))

    # A lambda's repeated parts are not shared, so names are read in a step of their own.
    return F.transform(F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), name_of), mark)


def _moved(depth: Column, paragraph: Column, token: Column, within: bool = False) -> tuple[Column, Column]:
    """Depth and open paragraph (its depth, 0 for none) after a token; ``within``: a paragraph may have been open before the first."""
    kind = token["kind"]
    # A block ends an open paragraph, and so does the closing tag of what it stands in.
    ends = (paragraph > 0) & (token["block"] | ((kind == _CLOSE) & (paragraph == depth)))
    base = F.when(ends, paragraph - 1).otherwise(depth)
    new_depth = (
        F.when(kind.isin(_OPEN, _CLOSE), base + kind)
        .when(kind == _P_OPEN, F.when(paragraph > 0, paragraph).otherwise(depth + 1))
        .when((kind == _P_CLOSE) & (paragraph > 0), paragraph - 1)
        .when((kind == _P_CLOSE) & F.lit(within), depth - 1).otherwise(depth))
    new_paragraph = (
        F.when(kind.isin(_OPEN, _CLOSE), F.when(ends, 0).otherwise(paragraph))
        .when(kind == _P_OPEN, F.when(paragraph > 0, paragraph).otherwise(depth + 1))
        .when(kind == _P_CLOSE, 0).otherwise(paragraph))
    return new_depth, new_paragraph


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``; a lambda's repeated parts are not shared, so the value is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _after(acc: Column, token: Column, then: Callable[[Column, Column], Column], within: bool = False) -> Column:
    """``then`` of the depth and the open paragraph after a token, worked out once."""
    depth, paragraph = _moved(acc["depth"], acc["paragraph"], token, within)
    both = F.struct(depth.cast("int").alias("depth"), paragraph.cast("int").alias("paragraph"))
    return _once(both, lambda m: then(m["depth"], m["paragraph"]))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _appended(text: Column, more: Column, separator: str) -> Column:
    """``text`` with another stripped text behind it, if that is not blank."""
    return _once(_stripped(plain(more)), lambda own: F.when(own == "", text).when(text == "", own).otherwise(F.concat(text, F.lit(separator), own)))


def siblings_text(after: Column, stop: tuple[str, ...], separator: str = "\n") -> Column:
    """Texts of the elements that follow in the same parent, up to one named in ``stop``; text between elements isn't theirs.

    ``after`` is what follows an element's closing tag, without scripts, styles and comments.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("paragraph"), F.lit(False).alias("over"), F.lit("").alias("text"))

    def step(acc: Column, token: Column) -> Column:
        return F.when(acc["over"], acc).otherwise(_after(acc, token, lambda depth, paragraph: moved(acc, token, depth, paragraph)))

    def moved(acc: Column, token: Column, depth: Column, paragraph: Column) -> Column:
        top = F.when(token["block"] & (acc["paragraph"] > 0), acc["paragraph"] - 1).otherwise(acc["depth"])
        over = (depth < 0) | ((token["kind"] == _OPEN) & (top == 0) & token["name"].isin(*stop))
        text = F.when((token["kind"] == _TEXT) & (acc["depth"] > 0), _appended(acc["text"], token["raw"], separator)).otherwise(acc["text"])
        return F.struct(depth.alias("depth"), paragraph.alias("paragraph"), over.alias("over"), text.alias("text"))

    return F.aggregate(tokens(after), start, step, lambda acc: F.nullif(acc["text"], F.lit("")))


def next_text(inside: Column) -> Column:
    """The text of the element after the one that ``inside`` begins in; without one, the next line of their parent.

    ``inside`` is what follows a label's text, without scripts, styles and comments.
    """
    names = ("depth", "paragraph", "phase", "text", "line")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("paragraph"), F.lit(0).alias("phase"), F.lit("").alias("text"), F.lit("").alias("line"))

    def step(acc: Column, token: Column) -> Column:
        return F.when(acc["phase"] >= 4, acc).otherwise(
            _after(acc, token, lambda depth, paragraph: moved(acc, token, depth, paragraph), within=True))

    def moved(acc: Column, token: Column, depth: Column, paragraph: Column) -> Column:
        # Phases: 0 in the label's element, 1 behind it, 2 in the next element, 3 behind that, 4 out of the parent.
        opens, is_text = token["kind"].isin(_OPEN, _P_OPEN), token["kind"] == _TEXT
        phase = (
            F.when(depth < 0, 4)
            .when((acc["phase"] == 0) & (depth == 0), 1)
            .when((acc["phase"] == 1) & opens, 2)
            .when((acc["phase"] == 2) & (depth == 0), 3).otherwise(acc["phase"]))
        text = F.when(is_text & (acc["phase"] == 2), F.concat(acc["text"], plain(token["raw"]))).otherwise(acc["text"])
        own = F.regexp_extract(plain(token["raw"]), r"([^\s][^\n]*?)\s*(?:\n|$)", 1)
        line = F.when(is_text & (acc["line"] == ""), own).otherwise(acc["line"])
        return F.struct(*[v.alias(n) for v, n in zip((depth, paragraph, phase.cast("int"), text, line), names)])

    return F.aggregate(tokens(inside), start, step, lambda acc: F.coalesce(
        F.nullif(_stripped(acc["text"]), F.lit("")), F.nullif(acc["line"], F.lit(""))))


def next_element(after: Column, name: str) -> Column:
    """The first element called ``name`` among those that follow in the same parent, with its tags; null without one.

    ``after`` is what follows an element's closing tag, without comments.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("paragraph"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, token: Column) -> Column:
        return F.when(acc["last"] >= 0, acc).otherwise(_after(acc, token, lambda depth, paragraph: moved(acc, token, depth, paragraph)))

    def moved(acc: Column, token: Column, depth: Column, paragraph: Column) -> Column:
        top = F.when(token["block"] & (acc["paragraph"] > 0), acc["paragraph"] - 1).otherwise(acc["depth"])
        first = F.when((acc["first"] < 0) & (token["kind"] == _OPEN) & (top == 0) & (token["name"] == name), token["i"]).otherwise(acc["first"])
        last = F.when((depth < 0) | ((acc["first"] >= 0) & (depth == 0)), token["i"]).otherwise(acc["last"])
        return F.struct(depth.alias("depth"), paragraph.alias("paragraph"), first.alias("first"), last.alias("last"))

    def find(parts: Column) -> Column:
        numbered = F.transform(parts, lambda t, i: F.struct(t["kind"].alias("kind"), t["name"].alias("name"), t["block"].alias("block"), i.alias("i")))
        # Texts and tags without a depth move nothing.
        moving = F.filter(numbered, lambda t: ~t["kind"].isin(_TEXT, _NONE))
        return _once(F.aggregate(moving, start, step), lambda found: cut(parts, found))

    def cut(parts: Column, found: Column) -> Column:
        length = F.when(found["last"] >= 0, found["last"] - found["first"] + 1).otherwise(2**31 - 1)
        return F.when(found["first"] >= 0, F.array_join(F.transform(F.slice(parts, found["first"] + 1, length), lambda t: t["raw"]), ""))

    return _once(tokens(after), find)
