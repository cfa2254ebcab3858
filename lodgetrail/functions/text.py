"""Text, contact and link rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgetrail import dims
from lodgetrail.functions import markup

# Blanks a Unicode-aware strip removes; Spark's trim() alone takes only U+0020.
_BLANKS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]))
# Word edges that agree with Unicode-aware engines, combining marks excluded.
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used.

    Filters and pushed-down expressions are not freed of repeated parts by the
    optimiser; a one-element transform names the part instead.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank_or_dash(c: Column) -> Column:
    return strip(c).isin("", "-")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract with NULL, not '', when nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def text_key(c: Column) -> Column:
    """Trimmed, lower-cased; NULL becomes ''."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def place_key(subdistrict: Column, district: Column, province: Column) -> Column:
    return F.concat_ws("|", text_key(subdistrict), text_key(district), text_key(province))


def contains_key(haystack: Column, needle: Column) -> Column:
    """Case-insensitive containment on keys; an empty needle is in everything."""
    return F.contains(text_key(haystack), text_key(needle))


def equals_ignoring_case(c: Column, value: str) -> Column:
    """Exact match without case; '%', '_' and '\\' have no special meaning."""
    return F.lower(c) == F.lower(F.lit(value))


def address_text(*parts: Column) -> Column:
    """Non-blank parts, stripped, joined by one space; NULL if none is left."""
    kept = F.filter(F.array(*[strip(p) for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def prefixed(prefix: str, c: Column) -> Column:
    """prefix + value; NULL and '' stay NULL."""
    return F.concat(F.lit(prefix), F.nullif(c, F.lit("")))


def clean_line_id(value: Column) -> Column:
    """A LINE handle, or NULL for placeholders, labels and bare phone numbers."""
    decoded = let(value, lambda v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v))
    unlabelled = strip(F.regexp_replace(strip(decoded), dims.LINE_ID_LABEL, ""))

    def usable(handle: Column) -> Column:
        known = ~F.lower(handle).isin("", *dims.LINE_ID_PLACEHOLDERS)
        return F.when(known & handle.rlike(r"\p{L}"), handle)

    return let(unlabelled, usable)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def has_real_phone(c: Column) -> Column:
    """At least five digits; NULL counts as no."""
    return F.coalesce(F.length(digits(c)) >= 5, F.lit(False))


def format_phone(c: Column) -> Column:
    """'(+66) 81 806 3131'; other lengths are grouped by three."""
    d = digits(F.coalesce(c, F.lit("")))
    rest = F.substr(d, F.lit(3))
    grouped = F.when(
        F.length(rest) == 9, F.regexp_replace(rest, r"^(..)(...)(....)$", "$1 $2 $3")
    ).otherwise(F.regexp_replace(rest, r"(.{3})(?=.)", "$1 "))
    return F.concat(F.lit("(+"), F.substring(d, 1, 2), F.lit(") "), grouped)


def safe_link(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^\s*https?://"), c)


def admitted_url(url: Column, hosts) -> Column:
    """http(s) and a host of the allow-list; malformed addresses are refused."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(scheme.isin("http", "https") & host.isin(*hosts), F.lit(False))


def email_key(c: Column) -> Column:
    return F.lower(strip(c))


def token_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def client_key(forwarded_for: Column, socket_address: Column, trusted_hops: int) -> Column:
    """Entry written by the outermost trusted proxy, else the socket address."""
    fallback = F.coalesce(socket_address, F.lit("unknown"))
    if trusted_hops <= 0:
        return fallback
    hops = F.filter(F.transform(F.split(forwarded_for, ","), strip), lambda p: p != "")
    return F.when(F.size(hops) >= trusted_hops, F.element_at(hops, -trusted_hops)).otherwise(fallback)


def encode_component(c: Column) -> Column:
    """Percent-encoding with the marks a browser leaves bare."""
    out = F.url_encode(c)
    for encoded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def strip_tags(html: Column, separator: str = "\n") -> Column:
    """Visible text of a fragment: scripts, styles, comments and tags removed."""
    return markup.plain(F.regexp_replace(markup.visible(html), f"(?s){markup.TAG}", separator))


def text_lines(text: Column) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def clean_description(text: Column) -> Column:
    """Drops leaked scoped style rules and characters broken by bad decoding."""
    out = F.regexp_replace(text, r"\.css-[\w-]+\s*\{[^}]*\}", "")
    out = F.replace(out, F.lit("\ufffd"), F.lit(""))
    out = F.regexp_replace(out, r"[\x{D800}-\x{DFFF}]", "")
    return blank_to_null(out)


_DETAIL = rf"(?is)<h2\b{markup.ATTRIBUTES}>[^<]*(?:Detail|Information about).*?</h2\s*>(.*)$"
_PARAGRAPH = rf"(?is)<p\b{markup.ATTRIBUTES}>(.*?)(?:</p>|<p\b|$)"


def description_section(html: Column) -> Column:
    """Text of the elements after the detail heading, up to the next one beside it; else the first paragraph over 50 characters."""
    shown = markup.visible(html)
    section = markup.siblings_text(first_match(shown, _DETAIL), ("h2", "h3"))
    paragraphs = F.transform(
        F.regexp_extract_all(shown, F.lit(_PARAGRAPH), F.lit(1)),
        lambda p: strip(F.regexp_replace(strip_tags(p, " "), r"\s+", " ")),
    )
    fallback = F.get(F.filter(paragraphs, lambda p: F.length(p) > 50), F.lit(0))
    return clean_description(F.coalesce(section, fallback))


def listing_number(visible: Column) -> Column:
    return first_match(visible, r"Listing\s+no\s*:\s*(\d+)")


def contact_description(deposit: Column, electric: Column, amenities: Column) -> Column:
    """Two or three lines: deposit, electricity unless on request, air conditioning."""
    deposit_line = F.when(
        F.coalesce(deposit, F.lit("")) != "", F.concat(F.lit("Deposit: "), deposit)
    ).otherwise(F.lit("Deposit:"))
    electric_line = F.when(
        ~F.coalesce(electric, F.lit("")).isin("", "Please contact"),
        F.concat(F.lit("Electric price: "), electric),
    )
    has_ac = F.coalesce(F.array_contains(amenities, "Air Conditioner"), F.lit(False))
    ac_line = F.concat(F.lit("Air Conditioner : "), F.when(has_ac, "YES").otherwise("NO"))
    return F.concat_ws("\n", deposit_line, electric_line, ac_line)


def is_verified_text(text: Column) -> Column:
    """Only a positive marker counts; 'not verified' and its forms never do."""
    negative = text.rlike(rf"(?i){NOT_AFTER_WORD}(?:not|non|un)[\s-]*verified{NOT_BEFORE_WORD}")
    positive = text.rlike(rf"(?i){NOT_AFTER_WORD}verified{NOT_BEFORE_WORD}")
    return positive & ~negative


def json_list(c: Column) -> Column:
    """Stored JSON text to an array of strings; NULL reads as an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def list_json(c: Column) -> Column:
    """An array to stored JSON text; an empty list is stored as NULL."""
    return F.when(F.size(c) > 0, F.to_json(c))
