"""Price and contract rules; amounts are whole THB unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgetrail import dims
from lodgetrail.functions.text import is_blank_or_dash, let

_THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"


def _numbers(raw: Column) -> Column:
    """All comma-grouped whole numbers of a text, in order."""
    ascii_raw = F.translate(raw, _THAI_DIGITS, "0123456789")
    tokens = F.transform(
        F.regexp_extract_all(ascii_raw, F.lit("([0-9,]+)"), F.lit(1)),
        lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("bigint"),
    )
    return F.filter(tokens, lambda n: n.isNotNull())


def parse_price_range(raw: Column) -> Column:
    """struct(min, max) of the first two numbers; one number fills both."""
    def pick(n: Column) -> Column:
        low = F.get(n, F.lit(0))
        return F.struct(low.alias("min"), F.coalesce(F.get(n, F.lit(1)), low).alias("max"))

    nothing = F.array().cast("array<bigint>")
    return let(F.coalesce(_numbers(raw), nothing), pick)


def format_price(low: Column, high: Column, suffix: str) -> Column:
    """'14,000 - 36,000 THB/month'; NULL without a usable minimum."""
    unusable = low.isNull() | ((low == 0) & (F.coalesce(high, F.lit(0)) == 0))
    single = high.isNull() | (low == high)
    low_text = F.format_number(low, 0)
    return (
        F.when(unusable, F.lit(None).cast("string"))
        .when(single, F.concat(low_text, F.lit(f" {suffix}")))
        .otherwise(F.concat(low_text, F.lit(" - "), F.format_number(high, 0), F.lit(f" {suffix}")))
    )


def contract_number(raw: Column) -> Column:
    """A believable contract price: the low end, or the high end if the low is not."""
    def pick(n: Column) -> Column:
        low, high = F.get(n, F.lit(0)), F.try_element_at(n, F.lit(-1))
        return F.when(low >= dims.MIN_VALID_PRICE, low).when(high >= dims.MIN_VALID_PRICE, high)

    return let(F.filter(_numbers(raw), lambda x: x > 0), pick)


def to_eur(amount: Column, rate: float = dims.EUR_RATE) -> Column:
    return F.round(amount / F.lit(rate)).cast("bigint")


def from_eur(amount: float, rate: float = dims.EUR_RATE) -> int:
    """Typed EUR bound to THB, rounded half up."""
    return int(amount * rate + 0.5)


def price_value() -> Column:
    """1-month minimum, else header minimum; zero is no price."""
    p = F.coalesce(F.col("contract_monthly_min"), F.col("price_monthly_min"))
    return F.when(p > 0, p)


def has_raw(raw: Column) -> Column:
    return F.coalesce(~is_blank_or_dash(raw), F.lit(False))


def _leading_number(raw: Column) -> Column:
    run = F.regexp_extract(raw, r"([0-9,\s\p{Z}]+)", 1)
    return F.when(has_raw(raw), F.regexp_replace(run, r"[\s\p{Z},]", "").try_cast("bigint"))


def price_of(duration_field: str | None) -> Column:
    """Price for a chosen contract length, falling back to the header price."""
    header = [
        F.nullif(F.col("price_monthly_min"), F.lit(0)),
        _leading_number(F.col("contract_monthly_raw")),
    ]
    chosen = []
    if duration_field:
        chosen = [
            F.nullif(F.col(f"{duration_field}_min"), F.lit(0)),
            _leading_number(F.col(f"{duration_field}_raw")),
        ]
    return F.coalesce(*chosen, *header)


def savings(local: Column, multiplier: float = dims.OTA_MULTIPLIER) -> dict[str, Column]:
    """Comparison with short-stay platforms, as named columns."""
    price = F.when(local != 0, local)
    ota = F.round(price * F.lit(multiplier)).cast("bigint")
    return {
        "ota_price": ota,
        "ota_night": F.round(ota / dims.NIGHTS_PER_MONTH).cast("bigint"),
        "savings": (ota - price).cast("bigint"),
        "discount_pct": F.lit(int((1 - 1 / multiplier) * 100 + 0.5)).cast("bigint"),
    }


def contract_flag(raw: Column) -> Column:
    """'unknown' when absent, 'false' when blank or a dash, else 'true'."""
    return F.when(raw.isNull(), "unknown").when(is_blank_or_dash(raw), "false").otherwise("true")


def is_short_term() -> Column:
    """Offers a 1-, 3- or 6-month contract."""
    return (
        F.coalesce(F.col("has_monthly_contract") == "true", F.lit(False))
        | has_raw(F.col("contract_3_month_raw"))
        | has_raw(F.col("contract_6_month_raw"))
    )


def badges() -> dict[str, Column]:
    """Which contract lengths a card advertises."""
    one = contract_number(F.col("contract_monthly_raw")).isNotNull()
    return {
        "badge_1_month": F.coalesce(F.col("has_monthly_contract") == "true", F.lit(False)) & one,
        "badge_3_month": contract_number(F.col("contract_3_month_raw")).isNotNull(),
        "badge_6_month": contract_number(F.col("contract_6_month_raw")).isNotNull(),
    }
