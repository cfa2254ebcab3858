"""Room rows nested in a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contract_rooms(rooms: Column) -> Column:
    """Rooms with any contract price; only the available ones if there are any."""
    priced = F.filter(
        rooms,
        lambda r: F.coalesce(
            r["monthly_min_thb"], r["monthly_max_thb"], r["contract_1_month_thb"],
            r["contract_3_month_thb"], r["contract_6_month_thb"],
        ).isNotNull(),
    )
    available = F.filter(
        priced,
        lambda r: F.coalesce(r["status"], F.lit("")).eqNullSafe("")
        | (F.lower(F.trim(r["status"])) == "available"),
    )
    return F.when(F.size(available) > 0, available).otherwise(priced)


def humanise(code: Column) -> Column:
    """'STUDIO_ROOM' to 'Studio room'."""
    low = F.replace(F.lower(F.nullif(code, F.lit(""))), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))


def number_text(x: Column) -> Column:
    """A double without a trailing '.0'."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def room_label(room: Column) -> Column:
    """'Deluxe · Studio · 24 m²'; unknown parts are left out."""
    name, kind, size = room["name"], humanise(room["room_type"]), room["size_sqm"]
    return F.concat_ws(
        " · ",
        F.when((name != "") & (name != "Unknown"), name),
        F.when(kind.isNotNull() & ~kind.eqNullSafe(name), kind),
        F.when(size != 0, F.concat(number_text(size), F.lit(" m²"))),
    )


def section_title(rooms: Column) -> Column:
    """The label of the only contract room, else a generic title."""
    usable = contract_rooms(rooms)
    only = F.when(F.size(usable) == 1, F.nullif(room_label(F.get(usable, F.lit(0))), F.lit("")))
    return F.coalesce(only, F.lit("Room Type"))
