"""Landed pages: cards, details, caches."""

import json

from pyspark.sql import functions as F

from lodgetrail.sources import details, pages, tables

BASE, CDN = "https://listings.example", "https://cdn.example"


def script(payload) -> str:
    body = payload if isinstance(payload, str) else json.dumps(payload)
    return f'<html><script id="__NEXT_DATA__" type="application/json">{body}</script></html>'


def landing(spark, *htmls):
    return spark.createDataFrame([(i, f"p{i}", h) for i, h in enumerate(htmls)], "page_no int, page_url string, html string")


def card(slug, **extra):
    return {"slug": slug, "name": slug.upper(), **extra}


def test_only_good_cards_survive(spark):
    listings = [
        card("a", price={"monthly": {"type": "AMOUNT", "minPrice": 5000, "maxPrice": 9000}}),
        card("b", price={"monthly": {"type": "CALL", "minPrice": "x"}}, updatedAt="2024-01-02T00:00:00Z"),
        card("c", price="5000"), "text", card("d", district=["x"]), {"slug": "e"}, card("f", price={"monthly": {"type": "AMOUNT", "minPrice": "12"}}),
    ]
    page = landing(spark, script({"props": {"pageProps": {"listings": listings}}}), script("{broken"), "<html></html>",
                   script({"props": {"pageProps": {"listings": {"no": "list"}}}}))
    rows = {r.slug: r for r in pages.read_cards(page, BASE, CDN).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].price_monthly_raw == "5,000 - 9,000 THB/month" and rows["b"].price_monthly_min is None
    assert rows["a"].url == f"{BASE}/en/a" and rows["a"].has_monthly_contract == "unknown" and not rows["a"].from_structured_list
    assert pages.quarantined_cards(page).count() == 5


def test_contract_terms_and_flags(spark):
    one = card("a", price={"shortTerm": {"oneMonth": {"shortContract": True, "minPrice": 4000, "maxPrice": 4000},
                                         "threeMonth": {"shortContract": False, "minPrice": 1}}},
               promotion={"type": "SALE"}, addressDocument={"reviewStatus": "VERIFIED"}, coverPicture="/c.jpg", street=" 5 Soi ", province="Nan")
    two = card("b", price={"shortTerm": {"oneMonth": None}}, promotion=None)
    rows = {r.slug: r for r in pages.read_cards(landing(spark, script({"props": {"pageProps": {"listings": [one, two]}}})), BASE, CDN).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.contract_monthly_raw, a.contract_3_month_raw, a.has_monthly_contract) == ("4,000 THB/month", None, "true")
    assert a.is_verified and a.has_promotion and a.thumbnail_url == f"{CDN}/c.jpg" and a.address == "5 Soi Nan"
    assert b.from_structured_list and b.has_monthly_contract == "false" and not b.has_promotion


def test_page_counts(spark):
    def total(v):
        return script({"props": {"pageProps": {"pagination": {"totalPages": v}}}})

    htmls = [total(3), total("3"), total("trois"), total(None), total(0), total(True), script({}), total(-1)]
    got = [r[0] for r in landing(spark, *htmls).orderBy("page_no").select(pages.page_count(pages.embedded_json(F.col("html")))).collect()]
    assert got == [3, 3, None, None, None, None, None, None]
    html = '<a href="/list/bangkok/4">4</a><a class="x" href="/list/bangkok/12">12</a><a href="/list/bangkok/600-1200">f</a>'
    assert landing(spark, html, "<p></p>").orderBy("page_no").select(pages.last_page(F.col("html"), "list/bangkok")).collect()[0][0] == 12


def test_text_card(spark):
    text = "Calm House\n4,500 - 6,000\nTHB/month\n5 Soi Nana Road Mueang Chiang Mai\nContract monthly\n5,400 - 6,900\nTHB/month\nContract 3 month\n-\nUpdated 03/02/2024 7:05\nThis is not verified listing"
    row = pages.read_text_cards(spark.createDataFrame([("Calm House", text)], "name string, card_text string")).first()
    assert row.contract_monthly_raw == "5,400 - 6,900 THB/month" and row.contract_3_month_raw == "-"
    assert row.contract_6_month_raw is None and row.has_monthly_contract == "true"
    assert row.province == "Chiang Mai" and row.district == "Mueang" and not row.is_verified
    assert str(row.source_updated_at) == "2024-02-03 00:05:00"


def detail(spark, *htmls):
    df = spark.createDataFrame([(f"u{i}", h) for i, h in enumerate(htmls)], "url string, html string")
    return {r.url: r for r in details.read_details(df, "cdn.example/pic").collect()}


def test_detail_page_states(spark):
    listing = {"contactInformation": [{"phone": [{"phoneNumber": "0812345678"}], "lineId": "%40host", "whatsApp": "66812345678", "email": ""}],
               "location": {"lat": "13,75", "lng": 100.5}, "fee": {"deposit": {"type": "MONTH", "month": 2}},
               "rooms": [{"roomName": "", "minSize": 20, "maxSize": 30, "availability": False}, "x"]}
    ok = script({"props": {"pageProps": {"listing": listing}}})
    rows = detail(
        spark, ok, ok + '<a href="https://wa.me/66812345678">w</a>', script({"props": {"pageProps": {"listings": []}}}),
        '<p>Line ID : @abc</p><a href="mailto:a@b.c?x=1">m</a><a href="https://wa.me/6612345">w</a>', script("{bad"))
    assert (rows["u0"].phone, rows["u0"].line_id, rows["u0"].whatsapp, rows["u0"].email) == ("0812345678", "@host", None, None)
    assert rows["u1"].whatsapp == "66812345678" and rows["u1"].deposit == "2 month"
    assert (rows["u0"].latitude, rows["u0"].longitude) == (13.75, 100.5)
    assert [(r.name, r.size_sqm, r.status) for r in rows["u0"].room_types] == [("Unknown", 25.0, "Not Available")]
    assert rows["u2"].page_gone and not rows["u2"].has_structured_data and rows["u2"].source_id is None
    assert (rows["u3"].phone, rows["u3"].line_id, rows["u3"].whatsapp, rows["u3"].email) == (None, "@abc", "6612345", "a@b.c")
    assert not rows["u4"].page_gone and not rows["u4"].has_structured_data


def test_amenity_grid(spark):
    grid = ('<h2>Amenities</h2><div class="css-box"><style data-emotion="css off">.css-off{text-decoration-line:line-through;}</style>'
            '<style data-emotion="css on">.css-on{color:#000;}</style>'
            '<div class="css-off"><span class="css-t">Air Conditioner</span></div><div class="css-on"><span class="css-t">Fan</span></div>'
            '<div class="css-odd wide"><span class="css-t">Desk</span></div></div>')
    rows = detail(spark, grid, "<h2>Detail</h2><p>has a fan</p>", "<h2>Amenities</h2><p>none</p>")
    assert rows["u0"].amenities == ["Fan", "Desk"]
    assert rows["u1"].amenities == ["Fan"] and rows["u2"].amenities == []


def test_images_and_nested_coordinates(spark):
    ld = '<script type="application/ld+json">[{"a":{"latitude":1,"longitude":2}},{"b":[{"geo":{"latitude":"7,9","longitude":"98.3"}}]}]</script>'
    imgs = '<img src="https://cdn.example/pic/2.jpg?class=t"><img alt="" data-src="https://cdn.example/pic/1.jpg"><img src="https://cdn.example/pic/2.jpg"><img src="/x.png">'
    row = detail(spark, ld + imgs)["u0"]
    assert (row.latitude, row.longitude) == (7.9, 98.3)
    assert row.images == ["https://cdn.example/pic/2.jpg", "https://cdn.example/pic/1.jpg"]


def test_point_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a|b|c": {"lat": 1.5, "lon": 2.0}, "x": {"lat": 3, "lon": 4}}')
    got = tables.read_point_cache(spark, str(tmp_path / "c.json")).orderBy("place_key").collect()
    assert [tuple(r) for r in got] == [("a|b|c", 1.5, 2.0), ("x", 3.0, 4.0)]


def test_pages_without_json_are_read_from_visible_cards(spark):
    card = '<li><a href="/en/packages">Buy</a><a href=\'/en/calm\'>Calm &amp; House</a><img src="https://cdn.example/c/1.jpg?w=2"><p>14,000 - 36,000 THB/month</p><div>Contract monthly</div><div>15,000 THB/month</div></li>'
    other = '<li><a href="/en/contact">THB</a></li><li>THB 3</li><li><a href="/en/deep/er">x</a>THB</li><li class="a"><a href="/en/day"> </a><h3>By day</h3>900 THB/day</li>'
    rows = [(1, "u1", f"<ul>{card}{other}</ul>"), (2, "u2", script("{broken") + card), (3, "u3", script({"props": {"pageProps": {"listings": []}}}) + card), (4, "u4", None)]
    df = spark.createDataFrame(rows, "page_no bigint, page_url string, html string")
    got = {(r.page_no, r.slug): r for r in pages.read_html_cards(df, BASE, CDN).collect()}
    assert set(got) == {(1, "calm"), (1, "day"), (2, "calm")}
    calm = got[1, "calm"]
    assert (calm.name, calm.url, calm.price_monthly_min, calm.price_monthly_max) == ("Calm & House", f"{BASE}/en/calm", 14000, 36000)
    assert (calm.contract_monthly_min, calm.has_monthly_contract, calm.from_structured_list, calm.thumbnail_url) == (15000, "true", True, f"{CDN}/c/1.jpg")
    assert (got[1, "day"].name, got[1, "day"].daily_price_min, got[1, "day"].from_structured_list) == ("By day", 900, False)
