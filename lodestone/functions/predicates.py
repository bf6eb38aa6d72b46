"""Boolean columns on task cards. Missing text counts as blank and case does not matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TERMINAL = ("done", "completed", "archived", "cancelled", "canceled")
BACKSTAGE = ("record", "receipt", "log", "ledger", "pointer")
TRUE = ("1", "true", "yes", "on")


def plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def truthy(c: Column) -> Column:
    return plain(c).isin(*TRUE)


def is_backstage(doc_type: Column, scope: Column, audience: Column) -> Column:
    return plain(doc_type).isin(*BACKSTAGE) | (plain(scope) == "backstage") | (plain(audience) == "backstage")


def requires_role(status: Column, scope: Column, responsibility: Column, assignee: Column, human_gate: Column, backstage: Column, role: str = "owner") -> Column:
    """An active card that enters a human role's gate: by scope, by responsibility, or by a gate flag
    if it is assigned to the role or to no one."""
    gated = plain(scope).isin(role, "human", "pi") | plain(responsibility).isin(f"{role}-gated", "human-gated", "pi-gated") | (truthy(human_gate) & plain(assignee).isin("", role))
    return ~backstage & ~plain(status).isin(*TERMINAL) & gated


def owner_action_needed(status: Column, gate: Column, waiting: Column, record: Column) -> Column:
    """To do or in review, gated, and neither waiting nor a record."""
    return plain(status).isin("todo", "review") & gate & ~waiting & ~record


def mentions_any(people: list[str], *fields: Column) -> Column:
    """One of the people is named in one of the fields; no people, no filter."""
    hay = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(not people)
    for p in people:
        out = out | F.contains(hay, F.lit(p.lower()))
    return out


def haystack(needle: str, *fields: Column) -> Column:
    """All fields as one text contain the words; blank words match."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(needle.strip().lower()))


def since(ts: Column, start: str) -> Column:
    """Not before `start`: as times if both can be read as such, else as text."""
    at, base = F.try_to_timestamp(ts), F.try_to_timestamp(F.lit(start))
    return F.coalesce(at >= base, ts >= F.lit(start))


def recently_done(status: Column, age_days: Column, assignee: Column, agents: list[str], within: int = 3) -> Column:
    return (plain(status) == "done") & age_days.between(0, within) & plain(assignee).isin(*agents)


def is_stale(stamp: Column, now: Column, days: int) -> Column:
    """No stamp, or one older than so many days."""
    return stamp.isNull() | (F.datediff(now, stamp) > days)


def has_drifted(updated: Column, landing: Column) -> Column:
    """The day of the update is after that of the landing page, or there is no such page's day."""
    day = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(10))
    return day(updated) > day(landing)
