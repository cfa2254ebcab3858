"""Scalar rules on literal inputs."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from lodgetrail.functions import amenities, clock, fees, geo, price, rooms, text


def values(spark, rows, column, name="v", kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} {kind}")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_price_range(spark):
    rows = ["14,000 - 36,000 THB/month", "4,500 THB/month", "-", "", None, ",", "๑๔,๐๐๐ บาท", "1 - 2 - 3"]
    got = values(spark, rows, price.parse_price_range(F.col("v")))
    assert [tuple(g) if g else (None, None) for g in got] == [
        (14000, 36000), (4500, 4500), (None, None), (None, None), (None, None), (None, None), (14000, 14000), (1, 2)]


def test_contract_number_prefers_a_believable_end(spark):
    rows = ["85 - 5,200 THB/month", "4,500 THB/month", "10 - 20", "0 - 3000", "-", None, "2000 - 100"]
    assert values(spark, rows, price.contract_number(F.col("v"))) == [5200, 4500, None, 3000, None, None, 2000]


def test_format_price(spark):
    df = spark.createDataFrame([(None, 5), (0, 0), (0, None), (1000, None), (1000, 1000), (1000, 25000)], "a bigint, b bigint")
    got = [r[0] for r in df.select(price.format_price(F.col("a"), F.col("b"), "THB/day")).collect()]
    assert got == [None, None, None, "1,000 THB/day", "1,000 THB/day", "1,000 - 25,000 THB/day"]


def test_price_of_reads_the_leading_number(spark):
    df = spark.createDataFrame(
        [(0, "THB 5,000", None, "7000"), (None, "-", 0, "7 000 x"), (800, "x", None, None), (None, "a b 9", 300, None)],
        "contract_3_month_min bigint, contract_3_month_raw string, price_monthly_min bigint, contract_monthly_raw string")
    assert [r[0] for r in df.select(price.price_of("contract_3_month")).collect()] == [5000, 7000, 800, 300]


def test_line_id_rules(spark):
    rows = ["Unavailable", "-", "   ", None, "%40acme_asset", "@tower61", "0613963159", "081-234-5678", "~0620477711",
            "Line ID : 0890215335", "Phone0971538717", "secretplace", "25house", "50%off", "a+b", "line: x", "LINE ID：kate"]
    assert values(spark, rows, text.clean_line_id(F.col("v"))) == [
        None, None, None, None, "@acme_asset", "@tower61", None, None, None, None, None, "secretplace", "25house",
        "50%off", "a+b", None, "kate"]


def test_amenities_in_thai_and_english(spark):
    rows = ["ห้อง มีแอร์ ,ทีวี, ตู้เย็น", "เครื่องปรับอากาศพร้อม", "ห้องนี้ไม่มีแอร์ มีพัดลม", "FAN and Sofa", "fantastic sofas",
            "Wi-Fi, no smoking", None, "unfurnished", "A/C room", "ที่fan"]
    got = values(spark, rows, amenities.derive_amenities(F.col("v")))
    assert got == [["Air Conditioner"], ["Air Conditioner"], [], ["Fan", "Sofa"], [], ["In-room WIFI"], [], [], ["Air Conditioner"], ["Fan"]]


def test_contact_description(spark):
    df = spark.createDataFrame(
        [("7500 Baht", "9 THB/unit", ["Air Conditioner"]), (None, "8 THB/unit", []), ("Please contact", "Please contact", None)],
        "d string, e string, a array<string>")
    got = [r[0] for r in df.select(text.contact_description(F.col("d"), F.col("e"), F.col("a"))).collect()]
    assert got == [
        "Deposit: 7500 Baht\nElectric price: 9 THB/unit\nAir Conditioner : YES",
        "Deposit:\nElectric price: 8 THB/unit\nAir Conditioner : NO",
        "Deposit: Please contact\nAir Conditioner : NO",
    ]


def test_fee_texts(spark):
    rows = ['{"type":"CALL"}', '{"type":"MONTH","month":1}', '{"type":"MONTH","month":3}', '{"type":"AMOUNT","unitPrice":7}',
            '{"type":"AMOUNT","amount":7.5}', '{"type":"PER_PERSON","perPersonPrice":90}', '{"type":"RANGE","range":"5-7"}',
            '{"type":"STATE_METER"}', '{"type":"INCLUDED"}', '{}', '{"type":"MONTH"}', None]
    got = values(spark, rows, fees.format_fee(F.try_parse_json("v"), "/unit", "metered"))
    assert got == ["Please contact", "1 month", "3 months", "7 THB/unit", "7.5 THB/unit", "90 THB/person", "5-7", "metered",
                   "Included", None, None, None]
    rows = ['{"type":"MONTH","month":2}', '{"type":"NO_DEPOSIT_PAYMENT"}', '{"type":"AMOUNT","amount":5000}',
            '{"type":"RANGE","range":{"min":1,"max":2}}', '{"type":"RANGE","range":{"max":2}}', '{"type":"RANGE","range":900}',
            '{"type":"RANGE","range":"text"}', '{"type":"OTHER","amount":1}']
    assert values(spark, rows, fees.format_deposit(F.try_parse_json("v"))) == [
        "2 month", "No deposit", "5000 Baht", "1-2 Baht", "2 Baht", "900 Baht", None, None]


def test_times(spark):
    rows = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+07:00", "2024-01-02T03:04:05", "2024-01-02", "soon", "", None]
    got = values(spark, rows, F.date_format(clock.parse_iso(F.col("v")), "MM-dd HH:mm"))
    assert got == ["01-02 03:04", "01-01 20:04", "01-02 03:04", "01-02 00:00", None, None, None]
    got = values(spark, ["x 03/02/2024 7:05 y", "99/99/2024 1:00"], F.date_format(clock.parse_local(F.col("v")), "MM-dd HH:mm"))
    assert got == ["02-03 00:05", None]


def test_geo_fuzz_equals_an_hmac(spark):
    df = spark.createDataFrame([(7, 13.7, 100.5)], "id bigint, lat double, lon double")
    p = df.select(geo.approximate_position(F.col("id"), F.col("lat"), F.col("lon"), "k" * 70)).first()[0]
    digest = hmac.new(b"k" * 70, b"geo:7", hashlib.sha256).digest()
    angle = int.from_bytes(digest[:4], "big") / 2**32 * 2 * math.pi
    dist = 100 + int.from_bytes(digest[4:8], "big") / 2**32 * 200
    assert p.lat == pytest.approx(13.7 + dist * math.cos(angle) / 111320, abs=1e-5)
    assert p.lon == pytest.approx(100.5 + dist * math.sin(angle) / (111320 * math.cos(math.radians(13.7))), abs=1e-5)


def test_province_is_whole_word_and_longest(spark):
    rows = ["Nan Road, NAKHON SRI THAMMARAT", "Nana Taksin", "5 Soi, Tha Sala Mueang Chiang Mai 50000", None]
    got = values(spark, rows, geo.location_parts(F.col("v")))
    assert [g.province if g else None for g in got] == ["Nakhon Sri Thammarat", None, "Chiang Mai", None]
    assert (got[2].district, got[2].subdistrict) == ("Mueang", "5 Soi, Tha Sala")


def test_phones_links_and_clients(spark):
    assert values(spark, ["66818063131", "66", "+1 (555) 12345", None], text.format_phone(F.col("v"))) == [
        "(+66) 81 806 3131", "(+66) ", "(+15) 551 234 5", "(+) "]
    assert values(spark, ["https://a", "HTTP://b", "javascript:x", None], text.safe_link(F.col("v"))) == ["https://a", "HTTP://b", None, None]
    assert values(spark, ["1.1.1.1, 2.2.2.2", "2.2.2.2", "", None], text.client_key(F.col("v"), F.lit("sock"), 1)) == [
        "2.2.2.2", "2.2.2.2", "sock", "sock"]
    assert values(spark, ["http://x.example/a", "ftp://x.example", "ht tp", "https://y.example", None],
                  text.admitted_url(F.col("v"), ("x.example",))) == [True, False, False, False, False]


def test_description_section(spark):
    rows = [
        "<h2>Detail</h2><p>.css-a1{x:y}Good&amp;calm</p><script>no</script><p>flat</p><h3>Next</h3><p>other</p>",
        "<p>short</p><p>" + "long words " * 6 + "</p>", "<div>nothing</div>", None,
    ]
    assert values(spark, rows, text.description_section(F.col("v"))) == [
        "Good&calm\nflat", ("long words " * 6).strip(), None, None]


def test_rooms(spark):
    kind = "array<struct<name:string,room_type:string,size_sqm:double,monthly_min_thb:bigint,monthly_max_thb:bigint,contract_1_month_thb:bigint,contract_3_month_thb:bigint,contract_6_month_thb:bigint,daily_thb:bigint,status:string>>"

    def room(name, low=None, status=None, size=None, room_type=None):
        return (name, room_type, size, low, None, None, None, None, None, status)

    lists = [[room("A", 1, "Available", 24.0, "STUDIO"), room("B", 2, "Not Available")], [room("B", 2, "Not Available")], [room("C")], []]
    assert values(spark, lists, F.transform(rooms.contract_rooms(F.col("v")), lambda r: r["name"]), kind=kind) == [["A"], ["B"], [], []]
    assert values(spark, lists, rooms.section_title(F.col("v")), kind=kind) == ["A · Studio · 24 m²", "B", "Room Type", "Room Type"]
