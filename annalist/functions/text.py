"""Text rules as column expressions: tokens, slugs, redaction, lint, sizes, small parsers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from annalist.session import ship

# Words that carry no meaning in a query.
STOPWORDS = ("the", "a", "an", "is", "are", "was", "were", "why", "what", "when", "who", "how", "does", "do", "did", "in", "on", "at", "of", "for", "to", "it", "this", "that", "we", "our", "and", "or", "with")
# What is replaced before an event is stored, in this order.
REDACTIONS = (
    (r"\beyJ[A-Za-z0-9_-]{20,}\.eyJ[A-Za-z0-9_-]{20,}(?:\.[A-Za-z0-9_-]+)?", "[REDACTED:jwt]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED:aws-key]"),
    (r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC )?PRIVATE KEY-----", "[REDACTED:private-key]"),
    (r"(?i)\b(password|passwd|secret|api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret)\b(\s*[:=]\s*)(\"[^\"]{8,}\"|'[^']{8,}'|\S{8,})", "$1$2[REDACTED:credential]"),
)
# What the linter reports.
LINTS = {
    "assignment": r"(?i)(password|passwd|secret|api[_-]?key|token)\s*[:=]\s*\S{8,}",
    "aws-key": r"AKIA[0-9A-Z]{16}",
    "pem": r"-----BEGIN (RSA |EC )?PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{20,}\.eyJ[A-Za-z0-9_-]{20,}",
}
TOKEN_MARGIN = 1.2


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(c: Column) -> Column:
    """Tokens of three characters or more that are no stopwords."""
    return F.filter(tokens(c), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))


def query_tokens(text: str) -> list[str]:
    """Tokens of a query text on the driver, by the same rule."""
    out, run = [], ""
    for ch in (text or "").lower():
        if ch.isalnum():
            run += ch
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


def query_words(text: str) -> list[str]:
    return sorted({t for t in query_tokens(text) if len(t) >= 3 and t not in STOPWORDS})


def slugify(c: Column, width: int = 48) -> Column:
    """Lower case, other signs as single hyphens, at most ``width`` characters, no hyphen at the ends."""
    s = F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.regexp_replace(F.substring(s, 1, width), "-+$", "")


def redact(c: Column) -> Column:
    for pattern, marker in REDACTIONS:
        c = F.regexp_replace(c, pattern, marker)
    return c


def lint(c: Column) -> Column:
    """Names of the lint rules that a text breaks, in order."""
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in LINTS.items()]), lambda x: x.isNotNull())


def with_margin(n: Column) -> Column:
    """Size estimate of a text of so many ``token_runs``."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(TOKEN_MARGIN)).cast("bigint"))


def estimate_tokens(c: Column) -> Column:
    """Size estimate: a third of each run of letters or digits, rounded up, one per other sign, a fifth on top."""
    return with_margin(token_runs(c))


def token_runs(c: Column) -> Column:
    """The estimate without its margin, which adds up over the lines of a text."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z]+|[0-9]+|[^\sA-Za-z0-9])"), 1)
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + F.when(r.rlike("^[A-Za-z0-9]"), F.ceil(F.length(r) / 3)).otherwise(1).cast("bigint"))


def clip(c: Column, width: int = 62) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.btrim(x)), lambda x: x != "")


def parse_ref(c: Column) -> Column:
    """``kind:id``."""
    p = F.split(c, ":", 2)
    return F.struct(F.get(p, F.lit(0)).alias("kind"), F.get(p, F.lit(1)).alias("id"))


def parse_entity(c: Column) -> Column:
    """``id:type:name[:description]``."""
    p = F.split(c, ":", 4)
    return F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("id", "type", "name", "description"))])


def parse_relation(c: Column) -> Column:
    """``source:predicate:target``."""
    p = F.split(c, ":", 3)
    return F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("source", "predicate", "target"))])


def valid_sha(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]{7,40}$"), F.lit(False))


def valid_ref(c: Column) -> Column:
    """Branch and tag names that a version control tool cannot take for an option."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_][A-Za-z0-9._/+-]*$") & ~F.contains(c, F.lit("..")) & ~F.endswith(c, F.lit(".lock")), F.lit(False))


def calendar_date(c: Column) -> Column:
    """Whether a text is a day of the calendar written yyyy-MM-dd."""
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


_FENCE = re.compile(r"```(?:json)?\s*([\[{].*?[\]}])\s*```", re.DOTALL)


def json_in(text: str | None, opening: str = "[{") -> str | None:
    """The JSON value in a code fence, else the one that begins at the first opening bracket, as it stands; None if it
    does not parse.  What follows the value does not matter."""
    t = text or ""
    fenced = next((m[1] for m in _FENCE.finditer(t) if m[1][0] in opening), None)
    at = 0 if fenced is not None else min((i for b in opening if (i := t.find(b)) >= 0), default=-1)
    body = fenced if fenced is not None else t[at:] if at >= 0 else ""
    try:
        end = json.JSONDecoder().raw_decode(body)[1] if body else 0
    except (ValueError, RecursionError):
        return None
    return body[:end] if end and (fenced is None or not body[end:].strip()) else None


def extract_json(c: Column, opening: str = "[{") -> Column:
    """``json_in`` of a text column; ``opening="{"`` takes objects only.  Null texts give null."""

    ship(SparkSession.getActiveSession())

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([json_in(x, opening) for x in s], dtype=object)

    return run(c)
