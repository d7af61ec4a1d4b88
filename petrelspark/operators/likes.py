"""Work that is done once for nets that are alike.

Nets of the same places, transitions and arcs have the same states, whatever their ids.  What a solver gives for the least net of each kind is dealt to all
others of its kind, so rounds follow the number of different nets and only the result follows the number of nets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.operators import detect
from petrelspark.operators.explore import StateGraph, explore
from petrelspark.operators.translate import alike
from petrelspark.plans.net import Net
from petrelspark.staging import counted, stage


@dataclass(frozen=True)
class Likes:
    """nets(net_id, like): every net with the least one of its kind; ``first``: the least ones."""

    nets: DataFrame
    first: Net

    def dealt(self, rows: DataFrame) -> DataFrame:
        """The rows (net_id, ...) of the least nets, for every net."""
        own = [F.col("to").alias("net_id") if c == "net_id" else F.col(c) for c in rows.columns]
        return self.nets.select(F.col("net_id").alias("to"), "like").join(rows, F.col("like") == F.col("net_id")).select(*own)


def likes(net: Net, places: Sequence[str] = (), transitions: Sequence[str] = ()) -> Likes:
    """The kinds of nets.  ``places``, ``transitions``: further SQL expressions in which nets of a kind agree, such as names, where a solver reads them."""
    facts = (
        net.places.selectExpr("net_id", "place_id", "tokens", "capacity", *places),
        net.transitions.selectExpr("net_id", "trans_id", *transitions),
        net.arcs.where("weight > 0").select("net_id", "place_id", "trans_id", "direction", "weight"),
    )
    nets = stage(alike(*facts), "likes")
    least = counted(nets.where("net_id = like").select("net_id"), "firsts")
    first = Net(*(counted(d.join(least, "net_id", "left_semi"), "first") for d in (net.places, net.transitions, net.arcs)), added=net.added)
    return Likes(nets, first)


def once(net: Net, solve: Callable[[Net], DataFrame], places: Sequence[str] = (), transitions: Sequence[str] = ()) -> DataFrame:
    """The rows (net_id, ...) that ``solve`` gives for nets, found once for each kind; ``places`` and ``transitions`` as in ``likes``."""
    of = likes(net, places, transitions)
    return of.dealt(counted(solve(of.first), "solved"))


def facts_once(tables: Sequence[DataFrame], solve: Callable[..., DataFrame]) -> DataFrame:
    """The rows (net_id, ...) that ``solve`` gives for programs, from tables (net_id, ...), found once for those with the same rows in all tables."""
    nets = stage(alike(*tables), "likes")
    least = counted(nets.where("net_id = like").select("net_id"), "firsts")
    rows = counted(solve(*(counted(d.join(least, "net_id", "left_semi"), "first") for d in tables)), "solved")
    to = nets.withColumnRenamed("net_id", "to").join(rows, F.col("like") == F.col("net_id"))
    return to.select(*[F.col("to").alias("net_id") if c == "net_id" else F.col(c) for c in rows.columns])


def explore_once(net: Net, limit: int | None = 50_000) -> StateGraph:
    """``explore``, in which nets of a kind are explored once."""
    of = likes(net)
    g = explore(of.first, limit)
    return StateGraph(net, of.dealt(g.states), of.dealt(g.edges), of.dealt(g.failures), of.dealt(g.truncated))


def some_of(net: Net, nets: DataFrame) -> Net:
    """The net's part of some nets (net_id)."""
    some = counted(nets.select("net_id").distinct(), "some")
    return Net(*(d.join(some, "net_id", "left_semi") for d in (net.places, net.transitions, net.arcs)), added=net.added)


_ATOMIC = "ttype in ('AtomicLoad', 'AtomicStore', 'AtomicCmpXchg')"
_STORE = "ttype in ('AtomicStore', 'AtomicCmpXchg')"
_EVENT = f"case when {_ATOMIC} then"


def atomicity_once(net: Net) -> DataFrame:
    """``detect.atomicity`` of the nets' state graphs.

    A violation needs a load and two stores of its variable, of compatible orderings, so nets without them have none and are not explored.  In all others a span is told
    by the least transition that has it, so nets that differ in spans alone are explored once."""
    atoms = counted(net.transitions.where(_ATOMIC).select("net_id", "trans_id", "ttype", "var", "ordering", "span"), "atoms")
    loads = atoms.where("ttype = 'AtomicLoad'").select("net_id", "var", F.col("span").alias("load"), F.col("ordering").alias("load_order"))
    met = loads.join(atoms.where(_STORE), ["net_id", "var"]).where(detect.compatible(F.col("load_order"), F.col("ordering")))
    part = some_of(net, met.groupBy("net_id", "var", "load").agg(F.countDistinct("span").alias("n")).where("n >= 2"))
    atoms = atoms.join(part.places.select("net_id").distinct(), "net_id", "left_semi")
    spans = counted(atoms.where("span is not null").groupBy("net_id", "span").agg(F.min("trans_id").cast("string").alias("twin")), "spans")
    twins = atoms.join(spans, ["net_id", "span"]).select("net_id", "trans_id", "twin")
    told = part.transitions.drop("span").join(twins, ["net_id", "trans_id"], "left").withColumnRenamed("twin", "span")
    told = Net(part.places, counted(told.select(*part.transitions.columns), "told"), part.arcs, added=part.added)
    reads = [f"case when {_ATOMIC} or ttype = 'Start' then ttype end as ttype", f"{_EVENT} var end as var", f"{_EVENT} ordering end as ordering", "span"]
    found = once(told, lambda n: detect.atomicity(explore(n)), transitions=reads)
    names = spans.groupBy("net_id").agg(F.map_from_entries(F.collect_list(F.struct("twin", "span"))).alias("names"))
    name = lambda x: F.try_element_at("names", x)
    return found.join(names, "net_id").select("net_id", "var", name(F.col("load")).alias("load"), F.array_sort(F.transform("stores", name)).alias("stores"))


def witnesses_once(net: Net) -> DataFrame:
    """``detect.net_witnesses`` of the nets' state graphs.

    Every pattern has a load by one thread and a store by another one of the same variable, so nets without them have none and are not explored."""
    atoms = counted(net.transitions.where(f"{_ATOMIC} and tid is not null and var is not null").select("net_id", "ttype", "var", "tid").distinct(), "atoms")
    loads, stores = atoms.where("ttype = 'AtomicLoad'"), atoms.where(_STORE).select("net_id", "var", F.col("tid").alias("other"))
    part = some_of(net, loads.join(stores, ["net_id", "var"]).where("tid != other"))
    reads = [f"case when ttype = 'AtomicLoad' then 'load' when {_STORE} then 'store' end as kind", f"{_EVENT} var end as v", f"{_EVENT} tid end as i"]
    return once(part, lambda n: detect.net_witnesses(explore(n)), transitions=reads)


def texts_once(texts: DataFrame, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows (path, ...) that ``solve`` gives for texts (path, text), found once for those that are equal, under their SHA-256."""
    key = F.sha2("text", 256)
    rows = counted(solve(stage(texts.select("text").distinct().select(key.alias("path"), "text"), "texts")), "solved")
    to = texts.select(F.col("path").alias("to"), key.alias("like"))
    return to.join(rows, F.col("like") == F.col("path")).select(*[F.col("to").alias("path") if c == "path" else F.col(c) for c in rows.columns])
