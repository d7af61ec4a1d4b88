"""Nets as tables.  Any number of nets share the tables; ``net_id`` tells them apart."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACES = "net_id string, place_id int, name string, tokens long, capacity long, place_type string, span string"
TRANSITIONS = "net_id string, trans_id int, name string, ttype string, res_place int, var string, ordering string, span string, tid int, basic_block int, data_type string"
ARCS = "net_id string, place_id int, trans_id int, direction string, weight long"
FUNCTIONS = "func string, instance_id int, crate string, has_body boolean, is_entry boolean, is_local boolean"
CALL_EDGES = "caller int, callee int, site_kind string, location string, dest_local int"
CONSTRAINTS = "func string, src string, dst string, kind string"
TRACE = "trace_id string, idx long, tid int, var string, kind string, ordering string, span string"
MIR_TEXT = "path string, text string"


@dataclass(frozen=True)
class Net:
    """places, transitions, arcs; see the schemas above.  A null capacity is unbounded.

    ``added``: arcs between the same ends are added up already, and none has weight 0."""

    places: DataFrame
    transitions: DataFrame
    arcs: DataFrame
    added: bool = False

    @staticmethod
    def empty(spark: SparkSession) -> Net:
        return Net(*(spark.createDataFrame([], s) for s in (PLACES, TRANSITIONS, ARCS)))

    def union(self, other: Net) -> Net:
        return Net(self.places.unionByName(other.places), self.transitions.unionByName(other.transitions), self.arcs.unionByName(other.arcs))

    def with_rows(self, spark: SparkSession, places: list = (), transitions: list = (), arcs: list = ()) -> Net:
        """This net and further rows."""
        return self.union(Net(spark.createDataFrame(list(places), PLACES), spark.createDataFrame(list(transitions), TRANSITIONS), spark.createDataFrame(list(arcs), ARCS)))

    def set_arcs(self, spark: SparkSession, arcs: list) -> Net:
        """Arcs that take the place of those between the same place and transition in the same direction."""
        new = spark.createDataFrame(arcs, ARCS)
        return replace(self, added=False, arcs=self.arcs.join(new.select("net_id", "place_id", "trans_id", "direction"), ["net_id", "place_id", "trans_id", "direction"], "left_anti").unionByName(new))

    def weights(self) -> DataFrame:
        """Arcs with those between the same ends added up; weight 0 is no arc."""
        if self.added:
            return self.arcs
        return self.arcs.where("weight > 0").groupBy("net_id", "place_id", "trans_id", "direction").agg(F.sum("weight").alias("weight"))

    def incidence(self) -> DataFrame:
        """(net_id, place_id, trans_id, change): what firing adds to the place, where it is not 0."""
        w = F.when(F.col("direction") == "out", F.col("weight")).when(F.col("direction") == "in", -F.col("weight")).otherwise(0)
        return self.arcs.groupBy("net_id", "place_id", "trans_id").agg(F.sum(w).alias("change")).where("change != 0")

    def shapes(self) -> DataFrame:
        """(net_id, shape): the ids of a net's places and transitions and the cells of its incidence matrix, in order; nets with the same ones are solved alike."""
        number, whole = F.lit(None).cast("int"), F.lit(None).cast("long")
        p = self.places.select("net_id", "place_id", number.alias("trans_id"), whole.alias("change"))
        t = self.transitions.select("net_id", number, "trans_id", whole)
        c = self.arcs.where("direction in ('in', 'out')").select("net_id", "place_id", "trans_id", F.when(F.col("direction") == "out", F.col("weight")).otherwise(-F.col("weight")))
        of = lambda when, what: F.array_sort(F.collect_list(F.when(when, what)))
        g = p.union(t).union(c).groupBy("net_id").agg(
            of(F.col("trans_id").isNull(), F.col("place_id")).alias("places"), of(F.col("place_id").isNull(), F.col("trans_id")).alias("transitions"),
            of(F.col("place_id").isNotNull() & F.col("trans_id").isNotNull(), F.struct("place_id", "trans_id", "change")).alias("cells"))
        return g.select("net_id", F.struct("places", "transitions", "cells").alias("shape"))

    def initial(self) -> DataFrame:
        """(net_id, marking, capacity): arrays in place order."""
        rows = F.array_sort(F.collect_list(F.struct("place_id", "tokens", "capacity")))
        return self.places.groupBy("net_id").agg(rows.alias("p")).select("net_id", F.transform("p", lambda x: x["tokens"]).alias("marking"), F.transform("p", lambda x: x["capacity"]).alias("capacity"))

    def firing(self) -> DataFrame:
        """(net_id, trans_id, pre, post, inhibitor, reset): weights by place, in place order.

        Only arcs are joined; the zeros between them are filled in by each row itself."""
        ids = self.places.groupBy("net_id").agg(F.array_sort(F.collect_list("place_id")).alias("ids"))
        at = ids.select("net_id", F.posexplode("ids").alias("pos", "place_id"))
        names = {"in": "pre", "out": "post", "inhibitor": "inhibitor", "reset": "reset"}
        own = [F.map_from_entries(F.collect_list(F.when(F.col("direction") == d, F.struct("pos", "weight")))).alias(n) for d, n in names.items()]
        arcs = self.weights().join(at, ["net_id", "place_id"]).groupBy("net_id", "trans_id").agg(*own)
        full = self.transitions.select("net_id", "trans_id").join(ids, "net_id").join(arcs, ["net_id", "trans_id"], "left")
        dense = lambda n: F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.coalesce(F.try_element_at(n, i), F.lit(0).cast("long"))).alias(n)
        return full.select("net_id", "trans_id", *[dense(n) for n in names.values()])

    def moves(self) -> DataFrame:
        """(net_id, trans_id, takes, stops, gains, resets): what each transition needs and does, by the positions of its places; see ``markings``.

        A row has as many entries as the transition has arcs, however many places the net has."""
        at = self.places.select("net_id", "place_id", (F.row_number().over(Window.partitionBy("net_id").orderBy("place_id")) - 1).alias("pos"))
        arcs = self.weights().join(at, ["net_id", "place_id"])
        of = lambda d: F.collect_list(F.when(F.col("direction") == d, F.struct("pos", "weight")))
        by_arc = arcs.groupBy("net_id", "trans_id").agg(of("in").alias("takes"), of("inhibitor").alias("stops"), F.collect_list(F.when(F.col("direction") == "reset", F.col("pos"))).alias("resets"))
        change = F.sum(F.when(F.col("direction") == "out", F.col("weight")).otherwise(-F.col("weight")))
        gains = arcs.where("direction in ('in', 'out')").groupBy("net_id", "trans_id", "pos").agg(change.alias("change")).where("change != 0")
        gains = gains.groupBy("net_id", "trans_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "change"))).alias("gains"))
        every = self.transitions.select("net_id", "trans_id").join(by_arc, ["net_id", "trans_id"], "left").join(gains, ["net_id", "trans_id"], "left")
        return every.select("net_id", "trans_id", "takes", "stops", "gains", F.when(F.size("resets") > 0, F.col("resets")).alias("resets"))

    def diagnosis(self) -> DataFrame:
        """Places and transitions that stand alone or lack inputs or outputs: (net_id, kind, id, name, issue).

        A place's input is an arc from a transition to it."""
        way = lambda d: (F.col("direction") == d).cast("int")
        ends = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit(None).cast("struct<name:string,tokens:bigint>").alias("own"), way("in").alias("takes"), way("out").alias("gives")) for kind, key in (("place", "place_id"), ("transition", "trans_id"))]))
        none = F.lit(0).alias("takes"), F.lit(0).alias("gives")
        p = self.places.select("net_id", F.lit("place").alias("kind"), F.col("place_id").alias("id"), F.struct("name", F.col("tokens").cast("long").alias("tokens")).alias("own"), *none)
        t = self.transitions.select("net_id", F.lit("transition").alias("kind"), F.col("trans_id").alias("id"), F.struct("name", F.lit(None).cast("long").alias("tokens")).alias("own"), *none)
        met = p.union(t).union(self.arcs.where("weight > 0").select("net_id", ends)).groupBy("net_id", "kind", "id").agg(F.collect_list("own").alias("own"), F.max("takes").alias("takes"), F.max("gives").alias("gives"))
        each = met.select("net_id", "kind", "id", F.inline("own"), "takes", "gives")
        of_place = F.when((F.col("takes") == 0) & (F.col("gives") == 0), "isolated").when((F.col("gives") == 0) & (F.col("tokens") == 0), "never marked").when(F.col("takes") == 0, "sink")
        of_trans = F.when((F.col("takes") == 0) & (F.col("gives") == 0), "isolated").when(F.col("takes") == 0, "source").when(F.col("gives") == 0, "sink")
        issue = F.when(F.col("kind") == "place", of_place).otherwise(of_trans)
        return each.select("net_id", "kind", "id", "name", issue.alias("issue")).where("issue is not null")
