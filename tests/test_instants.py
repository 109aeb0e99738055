import random

import brute
from pyspark.sql import functions as F
from tables import FORMATS, frame, result, rows

from annalist.functions import timestamps as T
from annalist.functions import zones
from annalist.operators import instants

STAMPS = [
    "2024-03-31T02:30:00", "2024-10-27T02:30:00", "2024-10-27 02:30", "2024-02-30T10:00:00Z", "2024-13-05", "0000-00-00", "2024-02-29", "2023-02-29", "2024-07", "2024-07-01T12:00:00Z",
    "2024-07-01t12:00:00z", " 2024-07-01T12:00:00Z", "2024-07-01T12:00:00 Z", "2024-07-01T12:00:00.1234567Z", "2024-07-01T12:00:00,5Z", "2024-07-01T12:00:00+0530", "2024-07-01 12:00:00-04", "20240701T120000Z",
    "Mon, 01 Jul 2024 12:00:00 +0200", "Jul 1, 2024 12:05 AM", "Jul 1, 2024 12:05 PM", "07/08/2024 09:10", "13/08/2024 09:10", "08/13/2024 9:10 PM", "7.8.2024 09:10", "1720000000", "1720000000123", "2024-07-01T12:00:00[Asia/Kolkata]",
    "2024-07-01T12:00:00[Nowhere/Land]", "2024-07-01 12:00:00 EDT", "2024-07-01 12:00:00 XYZ", "2024-07-01T24:00:00Z", "2024-07-01T12:60:00Z", "Jul 1, 2024 13:05 PM", "n/a", "TBD", "", "   ", None, "last Tuesday", "-", "2024/07/01 10:20", "١٢٣٤",
    "x" * 5000, "9" * 400, "2024-07-01T12:00:00+99:00", "1969-12-31T23:59:59.9Z",
]


def test_every_spelling_against_plain_python(spark):
    given = [{"ts": s, "source": src, "id": f"evt-{i}"} for i, (s, src) in enumerate((s, src) for s in STAMPS for src in ("adr", "manual", "git", None, "other"))]
    skip = {"2024-07-01T12:00:00[Nowhere/Land]", "2024-07-01T12:00:00+99:00", "١٢٣٤"}
    d = instants.event_instants(frame(spark, "event_log", given, extra=False), frame(spark, "source_formats", FORMATS), ["row_id", "ts", "source"])
    zone = {r["source"]: (r["zone"], r["date_order"]) for r in FORMATS}
    for r in d.collect():
        want = None if r["ts"] in skip or (r["ts"] or "").isdigit() and len(r["ts"]) > 19 else brute.instant(r["ts"], *zone.get(r["source"], (None, None)))
        assert r["instant_us"] == want, (r["ts"], r["source"])


def test_result_does_not_depend_on_the_session_zone(spark):
    given = [{"ts": "2024-07-01 10:00", "source": "adr", "id": "evt-1"}]
    want = {("event_log", 1, "2024-07-01T08:00:00.000000Z")}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert result(instants.found(frame(spark, "event_log", given), frame(spark, "relations", []), frame(spark, "source_formats", FORMATS))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_relations_take_the_zone_of_their_provenance(spark):
    ev = [{"id": " EVT-a", "source": "manual"}, {"id": "evt-b", "source": None}, {"id": "evt-c", "source": "Adr "}]
    rel = [{"source": "svc-a", "target": "svc-b", "ts": "2024-07-01 10:00", "provenance": p} for p in ("evt-A ", "evt-b", "evt-c", None, "evt-missing")]
    got = result(instants.found(frame(spark, "event_log", ev, extra=True), frame(spark, "relations", rel, extra=True), frame(spark, "source_formats", FORMATS)))
    assert got == {("relations", i + 1, f"2024-07-01T{h}:00:00.000000Z") for i, h in enumerate(("14", "10", "08", "10", "10"))}


def test_empty_tables(spark):
    assert result(instants.found(frame(spark, "event_log", []), frame(spark, "relations", []), frame(spark, "source_formats", []))) == set()


ZONES = [
    "Europe/Berlin", "Europe/London", "Europe/Dublin", "Europe/Moscow", "Europe/Lisbon", "Europe/Paris", "Europe/Amsterdam", "Europe/Istanbul", "America/New_York", "America/Chicago",
    "America/Los_Angeles", "America/St_Johns", "America/Sao_Paulo", "America/Caracas", "America/Havana", "America/Santiago", "Asia/Kolkata", "Asia/Tokyo", "Asia/Shanghai", "Asia/Tehran",
    "Asia/Gaza", "Asia/Jerusalem", "Australia/Lord_Howe", "Australia/Sydney", "Pacific/Apia", "Pacific/Auckland", "Africa/Casablanca", "Africa/Cairo", "Africa/Monrovia", "Antarctica/Troll",
]


def test_zones_agree_with_the_zone_library_around_every_change(spark):
    import datetime as dt
    from zoneinfo import ZoneInfo

    epoch, rng = dt.datetime(1970, 1, 1), random.Random(1)
    given = []
    for z in ZONES:
        seconds, offsets, first = zones.transitions(z)
        before = [first, *offsets]
        for i, s in enumerate(seconds):
            for offset in (before[i], before[i + 1]):
                x = epoch + dt.timedelta(seconds=s + offset)
                if 1900 <= x.year <= 2100:
                    given += [(z, (x + dt.timedelta(seconds=k)).isoformat()) for k in (-1, 0, 1, -1800, 1800)]
        given += [(z, dt.datetime(y, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), 7).isoformat()) for y in range(1800, 2101)]
    bad = []
    for r in T.with_instant(spark.createDataFrame(given, "z string, ts string"), "ts", F.col("z")).collect():
        x = dt.datetime.fromisoformat(r["ts"])
        want = x - ZoneInfo(r["z"]).utcoffset(x)
        if r["instant_us"] != (want - epoch) // dt.timedelta(microseconds=1):
            bad.append((r["z"], r["ts"]))
    assert not bad, (len(bad), bad[:5])


def test_years_behind_the_zone_table_follow_the_rule(spark):
    import datetime as dt
    from zoneinfo import ZoneInfo

    rng = random.Random(2)
    local = [dt.datetime(y, m, d, rng.randint(0, 23), rng.randint(0, 59)) for y in (2037, 2038, 2040, 2065, 2066, 2100, 2101, 2399, 2400, 9000) for m in (1, 3, 4, 7, 10, 11) for d in (1, 15, 26, 30)]
    d = spark.createDataFrame([(z, x.isoformat()) for z in ("Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "America/Sao_Paulo") for x in local], "z string, ts string")
    for r in T.with_instant(d, "ts", F.col("z")).collect():
        x = dt.datetime.fromisoformat(r["ts"])
        want = x - ZoneInfo(r["z"]).utcoffset(x)
        assert r["instant_us"] == (want - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), (r["z"], r["ts"])


def test_masks_have_one_parser_each(spark):
    masks = T.parsers()["p_mask"].to_pylist()
    assert len(masks) == len(set(masks)) < 10_000
    d = spark.createDataFrame([("2024-7-1T12:00:00.123456+02:00[Europe/Berlin]",)], "s string")
    assert d.select(T.shape_mask(F.col("s"))).first()[0] == "9999-99-99a99:99:99.f+99:99[a]"


def test_brute_force_on_fixture(spark):
    ev = rows("event_log", [{"ts": s, "source": "adr", "id": f"evt-{i}"} for i, s in enumerate(STAMPS[:20])])
    got = result(instants.found(frame(spark, "event_log", ev), frame(spark, "relations", []), frame(spark, "source_formats", FORMATS)))
    assert got == brute.p7(ev, [], FORMATS)
