"""Plain-Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import datetime as dt
import re
from collections import defaultdict
from zoneinfo import ZoneInfo

WHITE = " \t\n\r\f\x0b   ﻿"
PREFIX = re.compile(r"^(svc-|module-|adr-|inc-|feat-|env-|team-|ext-|person-|goal-|secret-)")
EPOCH = dt.datetime(1970, 1, 1)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ABBR = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CET": 60, "CEST": 120}


def cid(x):
    x = (x or "").strip(WHITE).lower()
    return x or None


def us(t):
    return None if t is None else (t - EPOCH) // dt.timedelta(microseconds=1)


def instant(s, zone=None, order=None):
    """Microseconds since 1970, or None."""
    if s is None:
        return None
    s = re.sub(r"\s+", " ", s.strip(WHITE))
    if re.fullmatch(r"\d+", s):
        n = len(s)
        return int(s) * 1_000_000 if n <= 11 else int(s) * 1000 if n <= 14 else int(s) if n <= 17 else int(s) // 1000
    clock = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
    tail = r"(?: ?(?P<ap>AM|PM|am|pm))?(?: ?(?P<z>[A-Za-z]{1,5}))?(?: ?(?P<sg>[+-])(?P<oh>\d{2}):?(?P<om>\d{2})?)?(?:\[(?P<zn>[^\]]+)\])?"
    forms = [
        rf"(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}})(?:[Tt ]{clock}{tail})?",
        r"(?P<y>\d{4})[-/](?P<m>\d{1,2})",
        rf"(?P<a>\d{{1,2}})[-/.](?P<b>\d{{1,2}})[-/.](?P<y>\d{{4}})(?: {clock}{tail})?",
        rf"(?P<mn>[A-Za-z]{{3}}) (?P<d>\d{{1,2}}), (?P<y>\d{{4}})(?: {clock}{tail})?",
        rf"[A-Za-z]{{3}}, (?P<d>\d{{1,2}}) (?P<mn>[A-Za-z]{{3}}) (?P<y>\d{{4}}) {clock}{tail}",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt](?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?{tail}",
    ]
    for f in forms:
        m = re.fullmatch(f, s)
        if m:
            break
    else:
        return None
    g = defaultdict(lambda: None, m.groupdict())
    if g["mn"]:
        if g["mn"].lower() not in MONTHS:
            return None
        month, day = MONTHS.index(g["mn"].lower()) + 1, int(g["d"])
    elif g["a"]:
        a, b = int(g["a"]), int(g["b"])
        day, month = (a, b) if a > 12 else (b, a) if b > 12 else (b, a) if order == "mdy" else (a, b)
    else:
        month, day = int(g["m"]), int(g["d"] or 1)
    hour = int(g["h"] or 0)
    if g["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"].lower() == "pm" else 0)
    try:
        local = dt.datetime(int(g["y"]), month, day, hour, int(g["mi"] or 0), int(g["s"] or 0), int((g["f"] or "0")[:6].ljust(6, "0")))
    except ValueError:
        return None
    if g["sg"]:
        off = int(g["oh"]) * 60 + int(g["om"] or 0)
        return us(local) - off * 60_000_000 * (1 if g["sg"] == "+" else -1)
    if g["z"]:
        if g["z"].upper() not in ABBR:
            return None
        return us(local) - ABBR[g["z"].upper()] * 60_000_000
    off = ZoneInfo(g["zn"] or zone or "UTC").utcoffset(local.replace(fold=0))
    return us(local) - off // dt.timedelta(microseconds=1)


def fmt(x):
    return (EPOCH + dt.timedelta(microseconds=x)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def formats(rows):
    return {r["source"]: (r["zone"], r["date_order"]) for r in rows}


def p7(events, relations, source_formats):
    f = formats(source_formats)
    out, src = set(), {}
    for e in events:
        if e["source"]:
            src.setdefault(cid(e["id"]), e["source"])
    for tbl, rows, of in (("event_log", events, lambda r: r["source"]), ("relations", relations, lambda r: src.get(cid(r["provenance"])))):
        for r in rows:
            x = instant(r["ts"], *f.get(of(r), (None, None)))
            if x is not None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r["ts"]):
                out.add((tbl, r["row_id"], fmt(x)))
    return out


def event_times(events, source_formats):
    f, at = formats(source_formats), {}
    for e in events:
        x = instant(e["ts"], *f.get(e["source"], (None, None)))
        if x is not None and cid(e["id"]):
            at[cid(e["id"])] = min(x, at.get(cid(e["id"]), x))
    return at


def p2(events, states, source_formats):
    at, known, out = event_times(events, source_formats), defaultdict(list), set()
    for s in states:
        if cid(s["id"]) and (s["status"] or "").strip() and s["valid_from"] and s["seen_at"]:
            known[cid(s["id"])].append((us(s["valid_from"]), us(s["seen_at"]), s["row_id"], s["status"].strip(), cid(s["superseded_by"]) or ""))
    for e in events:
        t = at.get(cid(e["id"]))
        if t is None:
            continue
        for r in e["refs"] or []:
            if r and cid(r["kind"]) == "entity" and cid(r["id"]):
                best = max((s for s in known[cid(r["id"])] if s[0] <= t and s[1] <= t), default=None)
                if best:
                    out.add((cid(e["id"]), cid(r["id"]), best[3], best[4]))
    return out


def p3(events, source_formats):
    f, said, out = formats(source_formats), defaultdict(dict), set()
    for e in events:
        x = instant(e["ts"], *f.get(e["source"], (None, None)))
        if x is None:
            continue
        first = next((cid(d["id"]) for d in (e["derived_entities"] or [])[:1] if d), None) or ""
        for i, st, by in [(cid(d["id"]), (d["status"] or "").strip(WHITE), "") for d in e["derived_entities"] or [] if d] + [(cid(s), "superseded", first) for s in e["supersedes"] or []]:
            if i and st:
                said[i][x] = max(said[i].get(x, ("",)), (cid(e["id"]), st, by))
    for i, by_time in said.items():
        versions = []
        for x in sorted(by_time):
            if not versions or versions[-1][1:] != by_time[x][1:]:
                versions.append((x, *by_time[x][1:]))
        for k, v in enumerate(versions):
            out.add((i, fmt(v[0]), fmt(versions[k + 1][0]) if k + 1 < len(versions) else "", v[1], v[2]))
    return out


def p5(entities, events):
    parent = {}
    for e in sorted(entities, key=lambda r: r["row_id"]):
        if cid(e["id"]) and cid(e["superseded_by"]):
            parent.setdefault(cid(e["id"]), cid(e["superseded_by"]))
    for e in sorted(events, key=lambda r: (r["seen_at"], r["row_id"])):
        for s in e["supersedes"] or []:
            p = cid(e["derived_entities"][0]["id"]) if e["derived_entities"] else None
            if cid(s) and p:
                parent.setdefault(cid(s), p)
    out = set()
    for n in set(parent) | set(parent.values()):
        path = [n]
        while path[0] in parent and parent[path[0]] not in path:
            path.insert(0, parent[path[0]])
        out.add((n, "", -1, "") if path[0] in parent else (n, path[0], len(path) - 1, ">".join(path)))
    return out


def p6(relations, events, entities, map_entities, documents, commits):
    parent: dict = defaultdict(dict)
    far = dt.datetime(9999, 1, 1)

    def add(space, i, seen, gone=None):
        if i:
            a, b = parent[space].get(i, (far, dt.datetime(1, 1, 1)))
            parent[space][i] = (min(a, seen), max(b, gone or far))

    for e in entities + map_entities:
        add("entity", cid(e["id"]), e["seen_at"], e["removed_at"])
    for e in events:
        add("event", cid(e["id"]), e["seen_at"])
    for x in documents:
        add("doc", cid(x["path"]), x["seen_at"])
    for c in commits:
        add("commit", cid(c["sha"]), c["seen_at"])
        add("commit", (cid(c["sha"]) or "")[:12], c["seen_at"])
    out = set()

    def ref(tbl, r, field, space, i):
        if not i or not space:
            return
        reason = None
        if i not in parent[space]:
            reason = "missing"
        elif field != "source_events" and parent[space][i][0] > r["seen_at"]:
            reason = "late"
        elif field != "source_events" and parent[space][i][1] <= r["seen_at"]:
            reason = "deleted"
        if reason:
            out.add((tbl, r["row_id"], field, i, reason, r["seen_at"].strftime("%Y-%m")))

    for r in relations:
        for field in ("source", "target"):
            i = cid(r[field])
            if i:
                ref("relations", r, field, "entity" if PREFIX.match(i) else "event" if i.startswith("evt-") else None, i)
    spaces = {"entity": "entity", "adr": "entity", "event": "event", "doc": "doc", "commit": "commit"}
    for e in events:
        for x in e["refs"] or []:
            if x:
                ref("event_log", e, "refs", spaces.get(cid(x["kind"])), cid(x["id"]))
    for e in entities:
        for x in e["source_events"] or []:
            ref("entities", e, "source_events", "event", cid(x))
    return out


def p1(entities, links):
    up: dict = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    pairs = [(cid(e["id"]), cid(a)) for e in entities for a in e["aliases"] or [] if cid(a) and PREFIX.match(cid(a))]
    pairs += [(cid(x["alias"]), cid(x["canonical"])) for x in links if x["is_match"]]
    for a, b in pairs:
        if a and b and a != b:
            up[top(a)] = top(b)
    groups = defaultdict(list)
    for x in up:
        groups[top(x)].append(x)
    return {(x, min(g)) for g in groups.values() if len(g) > 1 for x in g}
