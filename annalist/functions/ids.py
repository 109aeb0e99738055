"""Identifier rules shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that make a string an entity id.
ENTITY_PREFIXES = ("svc-", "module-", "adr-", "inc-", "feat-", "env-", "team-", "ext-", "person-", "goal-", "secret-")
WHITE = " \t\n\r\f\x0b   ﻿"


def clean_id(c: Column) -> Column:
    """Outer white space trimmed, lower case; empty becomes null."""
    return F.nullif(F.lower(F.btrim(c, F.lit(WHITE))), F.lit(""))


def clean_str(c: Column) -> Column:
    """Outer white space trimmed; empty becomes null."""
    return F.nullif(F.btrim(c, F.lit(WHITE)), F.lit(""))


def is_entity_id(c: Column) -> Column:
    return c.rlike("^(" + "|".join(ENTITY_PREFIXES) + ")")
