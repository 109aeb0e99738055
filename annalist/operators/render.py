"""Answers as text, from rows whose number is bounded by the caps of each section.

Nothing is cut silently: a section that shows less than there is says how much more there is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Row

# Most rows of each section.
MAX_RELATIONS, MAX_EVENTS, MAX_REFS, MAX_FACTS = 12, 5, 3, 5
# References are shown in this order of their kinds, then as they stand.
REF_ORDER = ("commit", "pr", "file")
NOTHING = "(no knowledge found)"


def more(n: int, what: str, indent: str = "  ") -> list[str]:
    return [f"{indent}... +{n} more {what}"] if n > 0 else []


def entity_lines(e: Row) -> list[str]:
    """An entity with its mark when superseded, summary and first facts (``facts``)."""
    mark = f" [SUPERSEDED by {e['superseded_by']}]" if e["status"] == "superseded" else ""
    facts = [f"  fact: {f}" for f in (e["facts"] or [])[:MAX_FACTS]]
    return [f"- {e['id']} ({e['type']}){mark}: {e['description'] or e['name']}", *([f"  summary: {e['summary']}"] if e["summary"] else []), *facts]


def event_lines(v: Row) -> list[str]:
    """An event with its flags, summary and first references."""
    rank = {k: i for i, k in enumerate(REF_ORDER)}
    refs = sorted((r for r in v["refs"] or [] if r is not None), key=lambda r: rank.get(r["kind"], len(rank)))
    flags = (" [DISPUTED]" if v["disputed"] else "") + (" [trust=low]" if v["trust"] == "low" else "")
    head = f"- {v['id']} ({v['type']}, {v['ts'][:10]}, impact={v['impact']}){flags}: {v['title']}"
    return [head, *([f"  {v['summary']}"] if v["summary"] else []), *(f"  ref {r['kind']}: {r['id']}" for r in refs[:MAX_REFS]), *more(len(refs) - MAX_REFS, "refs")]


def title_line(v: Row) -> str:
    """An event found by its title; what it reverts is absent, which is said first (``undone``, ``citation``)."""
    if v["undone"] is not None:
        return f"- NOT PRESENT (reverted {v['ts'][:10]}): {v['title']}  [{v['citation']}]"
    return f"- {v['id']} ({v['type']}, {v['ts'][:10]}): {v['title']}"


def relation_line(r: Row) -> str:
    return f"({r['source']}) --[{r['predicate']}]--> ({r['target']})" + (f"  [{r['provenance']}]" if r["provenance"] else "")


def answer(entities: Sequence[Row], titles: Sequence[Row], relations: Sequence[Row], n_relations: int, held: int, events: Sequence[Row], n_events: int, hops: int = 2) -> str:
    """The sections of an answer: entities, events by title, relations, source events; ``n_*`` count what there is in all,
    ``held`` what only hubs lead to."""
    if not (entities or titles or relations or events):
        return NOTHING
    sections = [["## Matched entities", *(x for e in entities for x in entity_lines(e))]]
    if titles:
        sections.append(["## Events matched by title", *map(title_line, titles)])
    if relations:
        shown = sorted(relations, key=lambda r: (r["source"], r["predicate"], r["target"]))[:MAX_RELATIONS]
        behind = [f"  ... {held} further relations lie behind hubs"] if held > 0 else []
        sections.append([f"## Relations ({hops}-hop)", *map(relation_line, shown), *more(n_relations - len(shown), "relations"), *behind])
    if events:
        shown = sorted(events, key=lambda v: (v["ts"], v["id"]), reverse=True)[:MAX_EVENTS]
        sections.append(["## Source events", *(x for v in shown for x in event_lines(v)), *more(n_events - len(shown), "source events")])
    return "\n\n".join("\n".join(s) for s in sections)


def timeline(shown: Sequence[Row], omitted: int) -> str:
    """Rows of a history in order, columns aligned; where context was left out is said once, before the first row that is
    not older than it."""
    ordered = sorted(shown, key=lambda r: (r["ts"], r["id"]))
    wide = max((len(r["action"]) for r in ordered), default=0)
    long = max((len(r["detail"]) for r in ordered), default=0)
    lines = [f"  ... {omitted} earlier context events omitted (no recorded state change) ..."] if omitted > 0 else []
    return "\n".join([*lines, *(f"  {r['ts']}  {r['action']:<{wide}}  {r['detail']:<{long}}  {r['citation']}".rstrip() for r in ordered)]) or NOTHING
