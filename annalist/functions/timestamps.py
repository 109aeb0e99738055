"""Timestamps in mixed spellings to one UTC instant.

Each string is tokenised into a character-class shape mask (digit runs, letter runs, separators).  A grammar of
date, time and zone forms is enumerated once into a table mask -> parser, where a parser says which digit or letter
token holds which component.  Rows meet their parser by an equi-join with that table (its size is fixed by the
grammar, not by the data); the components are then converted with integer arithmetic and, where a stamp names no
offset, with the transition table of its zone.  All of it runs inside the JVM.
"""

from __future__ import annotations

import functools
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import zones
from annalist.functions.ids import WHITE

# Offsets in minutes of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
# Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
DAY_US = 86_400_000_000


def shape_mask(c: Column) -> Column:
    """Mask of a trimmed string: letter runs ``a``, one- and two-digit runs ``99``, longer runs in their length,
    fractions of a second ``.f``, a bracketed zone ``[a]``."""
    m = F.regexp_replace(c, r"\[[^\]]+\]$", "[a]")
    m = F.translate(F.regexp_replace(m, "[A-Za-z]+", "a"), "012345678", "999999999")
    m = F.regexp_replace(m, r"(:99:99|a999999)[.,]9+", "$1.f")
    return F.regexp_replace(m, r"(?<!9)9(?!9)", "99")


@functools.lru_cache(maxsize=1)
def parsers() -> pa.Table:
    """Every mask of the grammar with its parser.

    Indices are 0-based token numbers, -1 where a component is absent: ``n_*`` among digit runs, ``w_*`` among letter
    runs.  ``form`` is civil, basic or epoch; ``xy`` marks dates with the year last whose order may be open.
    """
    dates: list[tuple[str, dict, int, int]] = []
    for sep in "-/.":
        dates.append((f"9999{sep}99{sep}99", {"n_year": 0, "n_month": 1, "n_day": 2}, 3, 0))
        dates.append((f"99{sep}99{sep}9999", {"n_month": 0, "n_day": 1, "n_year": 2, "xy": True}, 3, 0))
    for sep in "-/":
        dates.append((f"9999{sep}99", {"n_year": 0, "n_month": 1}, 2, 0))
    for mask, month in (("a 99, 9999", 0), ("a 99 9999", 0), ("a, a 99, 9999", 1)):
        dates.append((mask, {"w_month": month, "n_day": 0, "n_year": 1}, 2, month + 1))
    for mask, month in (("99 a 9999", 0), ("99-a-9999", 0), ("a, 99 a 9999", 1), ("a 99 a 9999", 1), ("99. a 9999", 0)):
        dates.append((mask, {"w_month": month, "n_day": 0, "n_year": 1}, 2, month + 1))
    clocks = [("99:99", {"n_hour": 0, "n_minute": 1}, 2), ("99:99:99", {"n_hour": 0, "n_minute": 1, "n_second": 2}, 3), ("99:99:99.f", {"n_hour": 0, "n_minute": 1, "n_second": 2, "n_fraction": 3}, 4)]
    tails: list[tuple[str, dict, int]] = [("", {}, 0), ("a", {"w_tail": 0}, 1), (" a", {"w_tail": 0}, 1), (" a a", {"w_tail": 0, "w_zone": 1}, 2), ("[a]", {"bracket": True}, 0), (" [a]", {"bracket": True}, 0)]
    for sign, s in (("+", 1), ("-", -1)):
        for gap, end in itertools.product(("", " "), ("", "[a]")):
            b = {"bracket": bool(end), "sign": s}
            tails += [(f"{gap}{sign}99:99{end}", b | {"n_off_h": 0, "n_off_m": 1}, 0), (f"{gap}{sign}9999{end}", b | {"n_off_hm": 0}, 0), (f"{gap}{sign}99{end}", b | {"n_off_h": 0}, 0)]
    found: dict[str, dict] = {}

    def put(mask: str, parser: dict) -> None:
        found.setdefault(mask, parser)

    for mask, date, digits, words in dates:
        put(mask, {"form": "civil"} | date)
        for (gap, skip), (clock, parts, used), (tail, rest, _) in itertools.product(((" ", 0), ("a", 1), (", ", 0), (" a ", 1)), clocks, tails):
            p = {"form": "civil"} | date | {k: v + digits for k, v in parts.items()}
            for k, v in rest.items():
                p[k] = v + digits + used if k.startswith("n_") else v + words + skip if k.startswith("w_") else v
            put(f"{mask}{gap}{clock}{tail}", p)
    for (clock, parts, used), (tail, rest, _) in itertools.product((("999999", {}, 2), ("999999.f", {"n_fraction": 2}, 3), ("9999", {}, 2)), tails):
        p = {"form": "basic"} | parts
        for k, v in rest.items():
            p[k] = v + used if k.startswith("n_") else v + 1 if k.startswith("w_") else v
        put(f"99999999a{clock}{tail}", p)
    for n in range(2, 20):
        put("9" * n, {"form": "epoch"})
    masks = sorted(found)
    ints = ("n_year", "n_month", "n_day", "n_hour", "n_minute", "n_second", "n_fraction", "n_off_h", "n_off_m", "n_off_hm", "w_month", "w_tail", "w_zone", "sign")
    cols: dict = {"p_mask": masks, "p_form": [found[m]["form"] for m in masks]}
    for k in ints:
        cols[f"p_{k}"] = pa.array([found[m].get(k, -1 if k != "sign" else 0) for m in masks], pa.int32())
    for k in ("xy", "bracket"):
        cols[f"p_{k}"] = pa.array([bool(found[m].get(k, False)) for m in masks], pa.bool_())
    return pa.table(cols)


def _case(word: str, values: dict[str, int]) -> str:
    return f"CASE {word} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _parsed(df: DataFrame, ts: str) -> DataFrame:
    """Adds ``t_*``: components of ``ts`` and, as far as the stamp itself says it, the instant.

    ``t_local`` is the local clock reading in microseconds (null where the stamp denotes nothing), ``t_offset`` the
    offset in seconds if the stamp names one, ``t_named`` the zone it names in brackets, ``t_open`` whether the day and
    month are told apart only by the order of the source.
    """
    spark = df.sparkSession
    # The parser table has a size fixed by the grammar (about 4,000 rows), so it may always be broadcast.
    table = getattr(spark, "_annalist_parsers", None)
    if table is None:
        table = spark._annalist_parsers = spark.createDataFrame(parsers())
    table = F.broadcast(table)
    d = df.withColumn("t_s", F.regexp_replace(F.btrim(F.col(ts), F.lit(WHITE)), r"\s+", " "))
    d = d.withColumn("p_mask", shape_mask(F.col("t_s"))).join(table, "p_mask", "left")
    d = d.withColumn("t_n", F.when(F.col("p_form").isNotNull(), F.regexp_extract_all(F.regexp_replace("t_s", r"\[[^\]]+\]$", ""), F.lit("([0-9]+)"), 1)))
    d = d.withColumn("t_w", F.when(F.col("p_form") != "epoch", F.regexp_extract_all(F.regexp_replace("t_s", r"\[[^\]]+\]$", ""), F.lit("([A-Za-z]+)"), 1)))
    num = lambda k: f"cast(get(t_n, p_n_{k}) AS bigint)"
    months = {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {m: i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9}
    steps = [
        {
            "t_named": "CASE WHEN p_bracket THEN lower(regexp_extract(t_s, '\\\\[([^\\\\]]+)\\\\]$', 1)) END",
            "t_tail": "upper(get(t_w, p_w_tail))",
            "t_zone2": "upper(get(t_w, p_w_zone))",
            "t_year": f"CASE p_form WHEN 'civil' THEN {num('year')} WHEN 'basic' THEN cast(substr(t_n[0],1,4) AS bigint) END",
            "t_a": f"CASE p_form WHEN 'civil' THEN coalesce({num('month')}, {_case('lower(get(t_w, p_w_month))', months)}) WHEN 'basic' THEN cast(substr(t_n[0],5,2) AS bigint) END",
            "t_b": f"CASE p_form WHEN 'civil' THEN CASE WHEN p_n_day < 0 THEN 1L ELSE {num('day')} END WHEN 'basic' THEN cast(substr(t_n[0],7,2) AS bigint) END",
            "t_hour": f"CASE WHEN p_form = 'basic' THEN cast(substr(t_n[1],1,2) AS bigint) WHEN p_n_hour < 0 THEN 0L ELSE {num('hour')} END",
            "t_minute": f"CASE WHEN p_form = 'basic' THEN cast(substr(t_n[1],3,2) AS bigint) WHEN p_n_minute < 0 THEN 0L ELSE {num('minute')} END",
            "t_second": f"CASE WHEN p_form = 'basic' THEN coalesce(try_cast(substr(t_n[1],5,2) AS bigint), 0L) WHEN p_n_second < 0 THEN 0L ELSE {num('second')} END",
            "t_fraction": "coalesce(cast(rpad(substr(get(t_n, p_n_fraction),1,6),6,'0') AS bigint), 0L)",
        },
        {
            "t_half": "CASE WHEN t_tail IN ('AM','PM') THEN t_tail END",
            "t_abbr": f"{_case('CASE WHEN t_tail IN (\'AM\',\'PM\') THEN t_zone2 ELSE t_tail END', {k: v * 60 for k, v in ABBREVIATIONS.items()})}",
            "t_abbr_given": "CASE WHEN t_tail IN ('AM','PM') THEN t_zone2 IS NOT NULL ELSE t_tail IS NOT NULL END",
            "t_off": f"CASE WHEN p_n_off_h >= 0 THEN {num('off_h')} * 60 + coalesce({num('off_m')}, 0L) WHEN p_n_off_hm >= 0 THEN ({num('off_hm')} div 100) * 60 + {num('off_hm')} % 100 END",
            "t_off_bad": f"coalesce({num('off_h')} > 18 OR {num('off_m')} > 59 OR {num('off_hm')} div 100 > 18 OR {num('off_hm')} % 100 > 59, false)",
            "t_open": "coalesce(p_xy AND t_a BETWEEN 1 AND 12 AND t_b BETWEEN 1 AND 12 AND t_a <> t_b, false)",
        },
    ]
    for step in steps:
        d = d.withColumns({k: F.expr(v) for k, v in step.items()})
    return d


def _local(d: DataFrame, order: Column) -> DataFrame:
    """Adds ``t_local``, ``t_offset`` and ``t_epoch`` from the components and the order of open dates."""
    d = d.withColumn("t_order", order)
    steps = [
        {
            # A day above 12 shows the order; else the source's order holds, and day first where that says nothing.
            "t_month": "CASE WHEN NOT p_xy THEN t_a WHEN t_a > 12 THEN t_b WHEN t_b > 12 THEN t_a WHEN t_order = 'mdy' THEN t_a ELSE t_b END",
            "t_day": "CASE WHEN NOT p_xy THEN t_b WHEN t_a > 12 THEN t_a WHEN t_b > 12 THEN t_b WHEN t_order = 'mdy' THEN t_b ELSE t_a END",
            "t_h24": "CASE WHEN t_half IS NULL THEN t_hour WHEN t_hour < 1 OR t_hour > 12 THEN NULL ELSE t_hour % 12 + CASE t_half WHEN 'PM' THEN 12 ELSE 0 END END",
        },
        {
            "t_last": "CASE WHEN t_month IN (4,6,9,11) THEN 30L WHEN t_month = 2 THEN CASE WHEN t_year % 4 = 0 AND (t_year % 100 <> 0 OR t_year % 400 = 0) THEN 29L ELSE 28L END ELSE 31L END",
            "t_y": "t_year - CASE WHEN t_month <= 2 THEN 1 ELSE 0 END",
        },
        {"t_ok": "t_year >= 1 AND t_month BETWEEN 1 AND 12 AND t_day BETWEEN 1 AND t_last AND t_h24 BETWEEN 0 AND 23 AND t_minute <= 59 AND t_second <= 59 AND NOT t_off_bad AND (NOT t_abbr_given OR t_abbr IS NOT NULL)"},
        {
            "t_days": "(t_y div 400) * 146097 + (t_y % 400) * 365 + (t_y % 400) div 4 - (t_y % 400) div 100 + (153 * (t_month + CASE WHEN t_month > 2 THEN -3 ELSE 9 END) + 2) div 5 + t_day - 1 - 719468",
            # Bare numbers: seconds, milliseconds, microseconds or nanoseconds by their size.
            "t_epoch": "CASE WHEN p_form = 'epoch' THEN CASE WHEN length(t_n[0]) <= 11 THEN cast(t_n[0] AS bigint) * 1000000 WHEN length(t_n[0]) <= 14 THEN cast(t_n[0] AS bigint) * 1000 WHEN length(t_n[0]) <= 17 THEN cast(t_n[0] AS bigint) ELSE try_cast(t_n[0] AS bigint) div 1000 END END",
        },
        {
            "t_local": f"CASE WHEN t_ok THEN t_days * {DAY_US} + ((t_h24 * 60 + t_minute) * 60 + t_second) * 1000000 + t_fraction END",
            "t_offset": "CASE WHEN t_off IS NOT NULL THEN t_off * 60 * p_sign ELSE t_abbr END",
        },
    ]
    for step in steps:
        d = d.withColumns({k: F.expr(v) for k, v in step.items()})
    return d


def _barrier(d: DataFrame, keep: list[str], out: dict[str, Column]) -> DataFrame:
    """``keep`` and ``out`` behind a one-row generator.

    A filter on a computed column is else pushed below the projections, where each step's expressions are inlined
    into the next until the generated code no longer compiles.
    """
    return d.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*[c.alias(k) for k, c in out.items()]))))


def with_instant(df: DataFrame, ts: str, zone: Column | None = None, order: Column | None = None, out: str = "instant_us") -> DataFrame:
    """Adds ``out``: microseconds since 1970 UTC that the string column ``ts`` denotes, null where it denotes nothing.

    ``zone`` and ``order`` give the zone of stamps that name none and the order of dates in digits that is not evident;
    null means UTC and day first.  Null, empty, unreadable and impossible stamps give null, as do zones that the zone
    table does not know.  Columns named ``p_*``, ``t_*`` and ``zone_*`` must not be in ``df``; all others are kept.
    """
    keep = df.columns
    d = _local(_parsed(df, ts), order if order is not None else F.lit(None).cast("string"))
    return _barrier(_resolve(d, zone), keep, {out: F.col("t_instant")})


def _resolve(d: DataFrame, zone: Column | None) -> DataFrame:
    own = F.lower(F.coalesce(F.col("t_named"), F.lower(zone) if zone is not None else F.lit(None)))
    d = d.withColumn("zone_key", F.when(F.col("t_offset").isNull() & (own != "utc"), own))
    # A year behind the table is read as the year of the same calendar among its last 28, moved by whole days.
    january = lambda y: f"(365 * ({y} - 1) + ({y} - 1) div 4 - ({y} - 1) div 100 + ({y} - 1) div 400)"

    def same(last: int) -> str:
        year = {zones.kind(y): y for y in range(last - 27, last + 1)}
        return f"array({', '.join(f'{year[k]}L' for k in range(14))})"

    like = f"element_at(CASE zone_last WHEN {zones.LAST_YEAR} THEN {same(zones.LAST_YEAR)} ELSE {same(zones.FAR_YEAR)} END, cast(7 * ({january('(t_year + 1)')} - {january('t_year')} - 365) + {january('t_year')} % 7 + 1 AS int))"
    names, changes, width = zones.zone_tables(d.sparkSession)
    # Both tables have a size fixed by the zone database: about 600 names and 60,000 rows of changes.
    d = d.join(F.broadcast(names), "zone_key", "left")
    d = d.withColumn("zone_year", F.when(F.col("zone_number").isNotNull(), F.expr(f"greatest(zone_since, CASE WHEN t_year > zone_last THEN {like} ELSE t_year END)")))
    d = d.withColumn("zone_moved", F.expr(f"CASE WHEN t_year > zone_last THEN {january('t_year')} - {january('zone_year')} ELSE 0L END"))
    d = d.withColumn("zone_slot", F.expr("zone_number * 10000 + zone_year")).join(F.broadcast(changes), "zone_slot", "left")
    local = "(t_local div 1000000 - CASE WHEN t_local % 1000000 < 0 THEN 1 ELSE 0 END - zone_moved * 86400)"
    found = "CASE " + " ".join(f"WHEN {local} >= zone_t{k} THEN zone_o{k}" for k in range(width, 0, -1)) + " ELSE zone_o0 END"
    d = d.withColumn("t_shift", F.expr(f"CASE WHEN t_offset IS NOT NULL THEN t_offset WHEN zone_key IS NULL THEN 0L ELSE {found} END"))
    return d.withColumn("t_instant", F.expr("coalesce(t_epoch, t_local - t_shift * 1000000)"))


def needs_source(df: DataFrame, ts: str) -> DataFrame:
    """Adds ``needs_source``: whether the instant of ``ts`` depends on the zone or date order of a source."""
    keep = df.columns
    d = _parsed(df, ts)
    free = F.col("p_form").isin("civil", "basic") & F.col("t_off").isNull() & F.col("t_abbr").isNull() & F.col("t_named").isNull()
    return _barrier(d, keep, {"needs_source": F.coalesce(free | F.col("t_open"), F.lit(False))})


def from_us(name: str) -> Column:
    """Timestamp without zone (UTC reading) of a column of microseconds since 1970, whatever the session zone is."""
    return F.expr(f"timestampadd(MICROSECOND, {name}, timestamp_ntz'1970-01-01 00:00:00')")


def to_us(name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, read as UTC when it has no zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} AS timestamp_ntz))")


def format_us(name: str) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` of a column of microseconds since 1970; null stays null."""
    return F.date_format(from_us(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
