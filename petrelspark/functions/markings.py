"""Expressions on markings: an array of tokens by place, in place order.  A null element of an ω-marking is ω."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enabled(marking: Column, pre: Column, inhibitor: Column | None = None) -> Column:
    """Every place has the tokens that the input arcs take, and no inhibitor arc finds as many as its weight.

    ``inhibitor``: weights by place, 0 where there is no such arc."""
    ok = F.forall(F.zip_with(marking, pre, lambda m, w: m >= w), lambda x: x)
    if inhibitor is not None:
        ok = ok & F.forall(F.zip_with(marking, inhibitor, lambda m, w: (w == 0) | (m < w)), lambda x: x)
    return ok


def fire(marking: Column, pre: Column, post: Column, reset: Column | None = None) -> Column:
    """The marking after firing; places of reset arcs are empty then."""
    after = F.zip_with(F.zip_with(marking, pre, lambda m, w: m - w), post, lambda m, w: m + w)
    return after if reset is None else F.zip_with(after, reset, lambda m, r: F.when(r > 0, F.lit(0).cast("long")).otherwise(m))


def enabled_at(marking: Column, takes: Column, stops: Column) -> Column:
    """``enabled`` from arcs alone: ``takes`` and ``stops`` are (pos, weight) of the input and inhibitor arcs, null or empty where there are none."""
    has = F.forall(F.coalesce(takes, F.array()), lambda a: F.element_at(marking, a["pos"] + 1) >= a["weight"])
    return has & F.forall(F.coalesce(stops, F.array()), lambda a: F.element_at(marking, a["pos"] + 1) < a["weight"])


def fired(marking: Column, gains: Column, resets: Column) -> Column:
    """``fire`` from arcs alone: ``gains`` maps places to what they win or lose, ``resets`` are the places that are empty then; both may be null."""
    after = F.transform(marking, lambda m, i: m + F.coalesce(F.try_element_at(gains, i), F.lit(0).cast("long")))
    return F.when(resets.isNull(), after).otherwise(F.transform(after, lambda m, i: F.when(F.array_contains(resets, i), F.lit(0).cast("long")).otherwise(m)))


def within(marking: Column, capacity: Column) -> Column:
    """No place holds more than its capacity; a null capacity is none."""
    return F.forall(F.zip_with(marking, capacity, lambda m, c: c.isNull() | (m <= c)), lambda x: x)


def covers(a: Column, b: Column) -> Column:
    """``a`` has at least ``b``'s tokens in every place; ω is more than any number."""
    return F.forall(F.zip_with(a, b, lambda x, y: x.isNull() | (y.isNotNull() & (x >= y))), lambda x: x)


def strictly_covers(a: Column, b: Column) -> Column:
    """``a`` covers ``b`` and has more in some place."""
    return covers(a, b) & F.exists(F.zip_with(a, b, lambda x, y: (x.isNull() & y.isNotNull()) | (x > y)), lambda x: F.coalesce(x, F.lit(False)))


def accelerated(marking: Column, ancestor: Column) -> Column:
    """ω wherever ``marking`` has more than the ancestor that it covers."""
    return F.zip_with(marking, ancestor, lambda m, a: F.when(m.isNull() | a.isNull() | (m > a), F.lit(None).cast("long")).otherwise(m))


def changes(before: Column, after: Column) -> Column:
    """(place_id, before, after, delta) of the places whose tokens differ."""
    each = F.transform(F.arrays_zip(before.alias("before"), after.alias("after")), lambda x, i: F.struct(i.alias("place_id"), x["before"].alias("before"), x["after"].alias("after"), (x["after"] - x["before"]).alias("delta")))
    return F.filter(each, lambda x: x["delta"] != 0)


def touched(pre: Column, post: Column) -> Column:
    """The places that a transition takes from or gives to."""
    used = F.zip_with(pre, post, lambda a, b: (a > 0) | (b > 0))
    return F.filter(F.transform(used, lambda u, i: F.when(u, i)), lambda i: i.isNotNull())


def independent(touched_a: Column, touched_b: Column) -> Column:
    """Two transitions share no place."""
    return ~F.arrays_overlap(touched_a, touched_b)


def asleep_after(sleep: Column, awake: Column) -> Column:
    """Transitions (array) that still sleep once those that depend on the fired one are ``awake``."""
    return F.array_except(sleep, awake)


def asleep_in_both(a: Column, b: Column) -> Column:
    """What sleeps on two ways to one state; only that may be left out there."""
    return F.array_intersect(a, b)


def asleep_with(sleep: Column, fired: Column) -> Column:
    """The sleeping transitions with those that brothers have fired before."""
    return F.array_sort(F.array_union(sleep, fired))


def dot_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
