"""Keyed and ordered operators against brute force, hot keys included."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodgetrail.operators import accounts, collect, contacts, images, limits, location, ordered
from lodgetrail.operators.limits import Admission

START = datetime(2024, 1, 1)


def hits(seed, n=1500, span=20_000):
    """Requests where one client makes a third of all."""
    rng = random.Random(seed)
    return [
        (1 if rng.random() < 0.34 else rng.randint(2, 30), i, START + timedelta(microseconds=rng.randint(0, span * 1_000_000)))
        for i in range(n)
    ]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"client bigint, request_id bigint, ts timestamp{extra}").repartition(5)


def test_running_values_over_chunks(spark):
    rows = hits(1)
    df = frame(spark, rows).withColumn("mark", F.when(F.col("request_id") % 7 == 0, F.col("request_id")))
    got = ordered.running(
        df, ["client"], ["ts", "request_id"], F.date_trunc("hour", "ts"),
        sums={"total": F.col("request_id")}, lasts={"last_mark": F.col("mark")})
    want, state = {}, defaultdict(lambda: [0, None])
    for c, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        s = state[c]
        s[0] += i
        s[1] = i if i % 7 == 0 else s[1]
        want[i] = tuple(s)
    assert {r.request_id: (r.total, r.last_mark) for r in got.collect()} == want


def test_sliding_count(spark):
    rows = hits(2)
    got = ordered.sliding_count(frame(spark, rows), ["client"], "ts", 60)
    for r in got.collect():
        assert r.recent_count == sum(1 for c, _, t in rows if c == r.client and r.ts - timedelta(seconds=60) <= t <= r.ts)


@pytest.mark.parametrize("limit,window,seed", [(3, 60, 3), (8, 300, 4), (1, 60, 5), (40, 2000, 6)])
def test_admission_equals_one_request_at_a_time(spark, limit, window, seed):
    rows = hits(seed)
    want, gates = {}, {}
    for c, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        us = int((t - START) / timedelta(microseconds=1))
        want[i] = gates.setdefault(c, Admission(limit, window * 1_000_000)).offer(us)
    got = {r.request_id: (r.admitted, r.retry_after) for r in limits.admit_requests(frame(spark, rows), limit, window).collect()}
    assert got == {i: (w is None, w) for i, w in want.items()}
    assert any(w is not None for w in want.values())


def test_denied_requests_leave_no_trace():
    gate = Admission(2, 60_000_000)
    assert [gate.offer(s * 1_000_000) for s in (0, 10, 20, 59, 60, 61)] == [None, None, 41, 2, 1, None]


def test_failure_window_resets_on_success(spark):
    rows = [(1, i, START + timedelta(minutes=m), k) for i, (m, k) in enumerate(
        [(0, "bad"), (1, "bad"), (2, "ok"), (3, "bad"), (10, "bad"), (17, "bad"), (40, "bad")])]
    out = limits.failure_window(frame(spark, rows, ", kind string"), F.col("kind") == "bad", F.col("kind") == "ok", 900, 3)
    assert [r.recent_failures for r in out.orderBy("request_id").collect()] == [1, 2, 0, 1, 2, 3, 1]
    assert [r.rate_limited for r in out.orderBy("request_id").collect()] == [False] * 5 + [True, False]


def test_first_cards_and_pages(spark):
    cards = spark.createDataFrame(
        [("a", 5000, "p1", 1), ("b", 6000, "p1", 2), ("a", 9999, "p2", 3), ("c", 7000, "p2", 4), ("a", 1, "p3", 5)],
        "slug string, price bigint, page string, n int").withColumn("scan", F.lit(1))
    kept = {r.slug: r.price for r in collect.first_occurrence(cards, ["slug"], ["n"]).collect()}
    assert kept == {"a": 5000, "b": 6000, "c": 7000}
    assert tuple(collect.pages_with_first_cards(cards, "scan", "slug", "page", ["n"]).first())[1:] == (2, 3)
    assert {r.slug: r.ignored_duplicates for r in collect.occurrence_counts(cards, ["slug"]).collect()}["a"] == 2


def near(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1") <= 6


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_watermark_clusters_equal_brute_force(spark, agree):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(260):
        h = rng.choice(seeds)
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            h ^= 1 << rng.randrange(64)
        rows.append((i, 1 if i % 3 else i % 5, "tl", h - 2**64 if h >> 63 else h))
    corners = spark.createDataFrame(rows, "image_id bigint, listing_id bigint, corner string, hash bigint")
    hashes = images.distinct_hashes(corners)
    got = {(r.listing_id, r.hash, r.near_hash) for r in images.near_links(hashes, agree=agree).collect()}
    own = {(r[1], r[3]) for r in rows}
    assert got == {(l, a, b) for l, a in own for m, b in own if l == m and a != b and near(a, b)}


def greedy(rows):
    """Images flagged by the pass, one after the other: rows of (image, listing, {corner: hash})."""
    flagged = set()
    for corner in images.CORNERS:
        for i, l, own in rows:
            if (l, i) in flagged or corner not in own:
                continue
            cluster = {(l, j) for j, m, other in rows if m == l and corner in other and near(own[corner], other[corner])}
            if len(cluster) >= 3:
                flagged |= cluster
    return {i for _, i in flagged}


@pytest.mark.parametrize("seed", range(3))
def test_watermarks_equal_the_pass_image_by_image(spark, seed):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(9)]

    def drawn():
        h = rng.choice(seeds)
        for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 30])):
            h ^= 1 << rng.randrange(64)
        return h - 2**64 if h >> 63 else h

    rows = [(i, i % 3, {c: drawn() for c in images.CORNERS if rng.random() < 0.8}) for i in range(150)]
    rows += [(150 + i, 7, dict(rows[0][2])) for i in range(40)]  # copies
    flat = [(i, l, c, h) for i, l, own in rows for c, h in own.items()]
    corners = spark.createDataFrame(flat, "image_id bigint, listing_id bigint, corner string, hash bigint").repartition(3)
    got = [r.image_id for r in images.watermarked_images(corners).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)
    assert images.watermarked_images(corners.filter("image_id < 0")).count() == 0


def test_masks_cover_every_close_pair():
    for distance, agree in ((6, 2), (6, 4), (1, 2)):
        masks = images.agreement_masks(distance, agree)
        rng = random.Random(distance)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), distance))
            assert any(diff & (m % 2**64) == 0 for m in masks)


def test_gallery_numbers_a_hot_listing(spark):
    rows = [(1 if i % 3 else 2, i, f"u{i}", 9000 - i, i % 10 == 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "listing_id bigint, image_id bigint, image_url string, position bigint, excluded boolean").repartition(4)
    got = images.gallery(df)
    for listing in (1, 2):
        shown = sorted((p, i) for l, i, _, p, x in rows if l == listing and not x)
        numbered = {r.image_id: r.gallery_no for r in got.filter(F.col("listing_id") == listing).collect()}
        assert numbered == {i: n + 1 for n, (_, i) in enumerate(shown)}


def test_excluded_image_is_never_the_thumbnail(spark):
    df = spark.createDataFrame(
        [(1, 10, "bad", 0, True), (1, 11, "good", 0, None), (1, 12, "later", 0, False), (2, 13, "x", 0, True)],
        "listing_id bigint, image_id bigint, image_url string, position bigint, excluded boolean")
    assert [tuple(r) for r in images.thumbnails(df).collect()] == [(1, "good")]


def test_positions_continue_after_stored_images(spark):
    stored = spark.createDataFrame([("a", "u0", 0), ("a", "u1", 7)], "slug string, image_url string, position bigint")
    batch = spark.createDataFrame(
        [("a", ["u1", "u2", "u0", "u3", "u2"], "t", True), ("b", ["x", "y"], "t", False), ("c", [], "t", False), ("d", None, "t", True)],
        "slug string, images array<string>, thumbnail_url string, was_known boolean")
    got = {(r.slug, r.image_url): r.position for r in images.new_image_rows(batch, stored).collect()}
    assert got == {("a", "u2"): 8, ("a", "u3"): 9, ("b", "x"): 0, ("b", "y"): 1, ("c", "t"): 0}


def test_map_point_fallback_chain(spark):
    rows = [
        (1, 10.0, 100.0, "5 Soi", "s", "d", "p"), (2, None, None, " 5 SOI ", "s", "d", "p"), (3, None, None, "Soi", "S", " D", "p"),
        (4, None, None, None, "s", "d", "p"), (5, None, None, None, None, None, None), (6, None, None, "", "q", "d", "p"),
    ]
    df = spark.createDataFrame(rows, "id bigint, latitude double, longitude double, address string, subdistrict string, district string, province string")
    a = spark.createDataFrame([("5 soi", 1.0, 2.0)], "place_key string, lat double, lon double")
    p = spark.createDataFrame([("s|d|p", 3.0, 4.0)], "place_key string, lat double, lon double")
    got = {r.id: (r.map_lat, r.precise) for r in location.with_map_points(df, a, p).collect()}
    assert got == {1: (10.0, True), 2: (1.0, True), 3: (3.0, False), 4: (3.0, False), 5: (None, None), 6: (None, None)}


def test_verdicts_reach_every_listing_of_a_shared_contact(spark):
    rows = [(i, "active" if i % 4 else "removed", "agency" if i % 3 == 0 else f"h{i}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, status string, line_id string, line_verified boolean")
    verdicts = spark.createDataFrame([("agency", "valid"), ("h1", "unknown"), ("h2", "invalid")], "line_id string, verdict string")
    got = {r.id: r.line_verified for r in contacts.apply_line_verdicts(df, verdicts).collect()}
    assert len(got) == 60 and got[1] is None and got[2] is False
    assert all(got[i] == (True if i % 4 else None) for i in range(0, 60, 3))
    weights = {r.verdict: (r.listings, r.contacts) for r in contacts.verdict_weights(df, verdicts, "line_id").collect()}
    assert weights == {"valid": (15, 1), "unknown": (1, 1), "invalid": (1, 1)}


def billing(spark, rows):
    full = [(i, START + timedelta(minutes=m), k, c, s, u, st) for i, (m, k, c, s, u, st) in enumerate(rows)]
    return spark.createDataFrame(
        full, "event_id bigint, ts timestamp, event_type string, customer_id string, subscription_id string, user_id bigint, status string")


def test_subscription_life(spark):
    A = accounts
    rows = [
        (0, A.COMPLETED, "c1", "s1", 7, "active"), (5, A.UPDATED, "c1", "s1", None, "trialing"),
        (6, A.UPDATED, "c9", "ghost", None, "active"), (9, A.COMPLETED, "c2", "s2", None, "active"),
        (10, A.FAILED, "c1", None, None, None), (11, A.FAILED, "c8", None, None, None),
        (60 * 24 * 3, A.COMPLETED, "c1", "s3", 7, "active"), (60 * 24 * 5, A.REFUNDED, "c1", None, None, None),
        (60 * 24 * 6, A.DELETED, "c2", "s2", None, None), (60 * 24 * 7, A.UPDATED, "c1", "s1", None, "active"),
    ]
    events = billing(spark, rows)
    folded = A.fold_subscriptions(events.unionByName(events)).collect()
    assert {r.subscription_id: (r.status, r.user_id, r.is_premium) for r in folded} == {
        "s1": ("active", 7, True), "s2": ("canceled", None, False), "s3": ("canceled", 7, False)}
    owners = A.account_entitlements(A.fold_subscriptions(events)).collect()
    assert [(r.user_id, r.subscription_id, r.is_premium) for r in owners] == [(7, "s3", False)]


def test_first_claim_wins(spark):
    df = spark.createDataFrame(
        [(1, START + timedelta(seconds=5), "x"), (2, START, "x"), (3, START, "y"), (4, START, "x")], "event_id bigint, ts timestamp, session_id string")
    assert {r.event_id: r.granted for r in accounts.first_claims(df).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_backfill_equals_folding_one_scan_at_a_time(spark):
    """Classes and removals of the windowed form against a plain replay of the scans."""
    from lodgetrail.operators import observe

    rng = random.Random(11)
    seen = [(s, n, rng.choice([100, 100, 200])) for n in range(1, 21) for s in range(12) if rng.random() < (0.25 if s < 4 else 0.7)]
    obs = spark.createDataFrame(seen, "slug bigint, scan_no bigint, price bigint")
    classes, removed, state = {}, set(), {}
    by_scan = defaultdict(dict)
    for s, n, p in seen:
        by_scan[n][s] = p
    for n in range(1, 21):
        for s, p in by_scan[n].items():
            old = state.get(s)
            classes[s, n] = (
                "NEW" if old is None else "PRICE_CHANGED" if old["price"] != p
                else "REACTIVATED" if old["removed"] else "UNCHANGED")
            state[s] = {"price": p, "removed": False, "miss": 0}
        for s, v in state.items():
            if s not in by_scan[n] and not v["removed"]:
                v["miss"] += 1
                if v["miss"] >= 3:
                    v["removed"] = True
                    removed.add((s, n))
    steps = observe.classify_steps(observe.price_steps(obs)).collect()
    assert {(r.slug, r.scan_no): r.change_class for r in steps} == classes
    assert {(r.slug, r.scan_no) for r in observe.removals(obs, F.lit(20)).collect()} == removed and removed
