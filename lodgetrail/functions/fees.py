"""Fee and deposit objects of a detail page, as readable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgetrail.functions import markup
from lodgetrail.functions.text import first_match

_NUMERIC_KINDS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def variant_text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def variant_kind(v: Column, path: str) -> Column:
    """Upper-case type name at a path; '' when absent, 'VOID' when null."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))


def format_fee(fee: Column, unit_suffix: str = "", meter_label: str | None = None) -> Column:
    kind = variant_text(fee, "$.type")
    month = variant_text(fee, "$.month")
    amount = F.coalesce(variant_text(fee, "$.unitPrice"), variant_text(fee, "$.amount"))
    text = (
        F.when(kind == "CALL", F.lit("Please contact"))
        .when(kind == "INCLUDED", F.lit("Included"))
        .when(kind == "MONTH", F.concat(month, F.when(month == "1", " month").otherwise(" months")))
        .when(kind == "AMOUNT", F.concat(amount, F.lit(f" THB{unit_suffix}")))
        .when(kind == "PER_PERSON", F.concat(variant_text(fee, "$.perPersonPrice"), F.lit(" THB/person")))
        .when(kind == "RANGE", F.nullif(variant_text(fee, "$.range"), F.lit("")))
    )
    if meter_label:
        text = text.when(F.endswith(kind, F.lit("_METER")), F.lit(meter_label))
    return text


def format_deposit(fee: Column) -> Column:
    kind = variant_text(fee, "$.type")
    low, high = variant_text(fee, "$.range.min"), variant_text(fee, "$.range.max")
    range_number = F.when(
        variant_kind(fee, "$.range").rlike(_NUMERIC_KINDS), variant_text(fee, "$.range")
    )
    baht = F.coalesce(variant_text(fee, "$.amount"), range_number, F.concat_ws("-", low, high))
    return (
        F.when(kind == "CALL", F.lit("Please contact"))
        .when(kind == "NO_DEPOSIT_PAYMENT", F.lit("No deposit"))
        .when(kind == "MONTH", F.concat(variant_text(fee, "$.month"), F.lit(" month")))
        .when(kind.isin("AMOUNT", "RANGE") & (baht != ""), F.concat(baht, F.lit(" Baht")))
    )


def labelled_text(shown: Column, label: str) -> Column:
    """The text of the element after the one that holds a label, else the line after the label; ``shown`` is the visible page."""
    return markup.next_text(first_match(shown, rf"(?is)>[^<]*{label}[^<]*(<.*)$"))


def fees(listing: Column, html: Column) -> dict[str, Column]:
    """Five fees: the page's JSON first, then the labels (never for the deposit)."""

    shown = markup.visible(html)

    def part(name: str) -> Column:
        return F.try_variant_get(listing, f"$.fee.{name}", "variant")

    return {
        "deposit": format_deposit(part("deposit")),
        "advance_payment": F.coalesce(
            format_fee(part("advancePayment")), labelled_text(shown, r"Advance\s+payment")),
        "electric_price": F.coalesce(
            format_fee(part("electric"), "/unit", "as charged by Electricity Authority"),
            labelled_text(shown, r"Electric\s+price")),
        "water_price": F.coalesce(
            format_fee(part("water"), "/unit", "as charged by Waterworks Authority"),
            labelled_text(shown, r"Water\s+price")),
        "service_fee": F.coalesce(
            format_fee(part("service")), labelled_text(shown, r"Service\s+fee")),
    }
