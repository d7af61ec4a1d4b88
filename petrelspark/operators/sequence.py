"""Three-event patterns in interleavings: a start and an end by one thread, and another thread's event on the same variable between.

For an end event the start is the last one of its thread before it, and the other thread's event is its last one after both
the start and the thread's previous end.  Windows within bins of the trace find start and previous end; the rest is an equi-join on the variable
with a range condition.  A hot variable is a join key that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrelspark.staging import counted, stage

#: Rule -> kinds of start, middle and end.
RULES = {1: ("load", "store", "store"), 2: ("store", "store", "load"), 3: ("load", "store", "load")}


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RULES.items()], "rule int, start_kind string, mid_kind string, end_kind string")


def event_kind(ttype: Column) -> Column:
    """load or store of a transition's label; a compare-and-exchange stores."""
    return F.when(ttype == "AtomicLoad", "load").when(ttype.isin("AtomicStore", "AtomicCmpXchg"), "store")


def _ends(t: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, rule, var, tid_i, m, start_idx, after, end_idx) of the events that end a rule's pattern for their thread.

    What a thread last did to a variable before an event is found in bins of ``width`` indices, and else carried over from the bins before, of
    which there is one row for each; so no window holds all events of a hot variable."""
    at = F.floor(F.col("idx") / width)
    lasts = lambda w: [F.max(F.when(F.col("kind") == k, F.col("idx"))).over(w).alias(f"own_{k}") for k in ("load", "store")]
    own = Window.partitionBy(*keys, "var", "tid", "bin").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    inside = t.withColumn("bin", at).select("*", *lasts(own))
    bins = t.groupBy(*keys, "var", "tid", at.alias("bin")).agg(*[F.max(F.when(F.col("kind") == k, F.col("idx"))).alias(k) for k in ("load", "store")])
    past = Window.partitionBy(*keys, "var", "tid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(*keys, "var", "tid", "bin", *[F.max(k).over(past).alias(f"past_{k}") for k in ("load", "store")])
    last = inside.join(carried, [*keys, "var", "tid", "bin"])
    of = {k: F.coalesce(f"own_{k}", f"past_{k}") for k in ("load", "store")}
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(m).alias("m"), F.lit(e).alias("e"), of[s].alias("start"), of[e].alias("prev")) for rule, (s, m, e) in RULES.items()])
    ruled = last.select(*keys, "var", "tid", "idx", F.explode(F.filter(each, lambda r: (r["e"] == F.col("kind")) & r["start"].isNotNull())).alias("r"))
    return ruled.select(*keys, "r.rule", "var", F.col("tid").alias("tid_i"), "r.m", F.col("r.start").alias("start_idx"), F.greatest("r.start", "r.prev").alias("after"), F.col("idx").alias("end_idx"))


def witnesses(trace: DataFrame, keys: list[str] | None = None, width: int = 65_536) -> DataFrame:
    """(rule, var, tid_i, tid_j, start_idx, mid_idx, end_idx) of a trace (idx, tid, var, kind).

    ``keys``: columns of the interleaving, such as trace_id.  Events with a null variable, thread, kind or index are left out."""
    keys = keys or []
    t = trace.select(*keys, "idx", "tid", "var", "kind").where("idx is not null and tid is not null and var is not null and kind is not null")
    ends = _ends(t, keys, width)
    mids = t.select(*keys, "var", F.col("tid").alias("tid_j"), F.col("kind").alias("m"), F.col("idx").alias("mid"))
    # the open interval from the later of start and previous end to the end
    joined = ends.join(mids, [*keys, "var", "m"]).where("tid_i != tid_j and mid > after and mid < end_idx")
    return joined.groupBy(*keys, "rule", "var", "tid_i", "tid_j", "start_idx", "end_idx").agg(F.max("mid").alias("mid_idx"))


def binned_witnesses(trace: DataFrame, width: int = 4096) -> DataFrame:
    """``witnesses`` of one interleaving, with the range condition turned into an equi-join on bins of ``width`` indices, so that a hot
    variable's events meet only those near by.  An interval of many bins needs only its last events: each thread's
    last event of a kind in a bin stands for the bin."""
    t = counted(trace.select("idx", "tid", "var", "kind").where("idx is not null and tid is not null and var is not null and kind is not null"), "trace")
    ends = _ends(t, [], 16 * width)
    bin_of = lambda c: F.floor(c / width)
    spread = ends.withColumn("bin", F.explode(F.sequence(bin_of(F.col("after")), bin_of(F.col("end_idx")))))
    edge = (F.col("bin") == bin_of(F.col("after"))) | (F.col("bin") == bin_of(F.col("end_idx")))
    mids = t.select("var", F.col("tid").alias("tid_j"), F.col("kind").alias("m"), F.col("idx").alias("mid")).withColumn("bin", bin_of(F.col("mid")))
    last = mids.groupBy("var", "tid_j", "m", "bin").agg(F.max("mid").alias("mid"))
    inside = spread.where(~edge).join(last, ["var", "m", "bin"])
    near = spread.where(edge).join(mids, ["var", "m", "bin"]).where("mid > after and mid < end_idx")
    both = near.unionByName(inside).where("tid_i != tid_j")
    return both.groupBy("rule", "var", "tid_i", "tid_j", "start_idx", "end_idx").agg(F.max("mid").alias("mid_idx"))


def slices(trace: DataFrame, found: DataFrame, width: int = 4096) -> DataFrame:
    """``found`` with ``slice``, the index, thread and kind of each of its variable's events from start to end, in order.

    Events come as one row for each variable and bin of ``width`` indices, of which a slice is cut: within one bin nothing but ``found`` itself is dealt, and
    only slices over several bins are put together from a piece of each.  Every row of ``found`` gives one row, repeated ones too."""
    of = lambda c: F.floor(F.col(c) / width)
    every = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), F.concat_ws(":", F.col("idx").cast("string"), F.col("tid").cast("string"), "kind").alias("what"))))
    bins = trace.where("idx is not null").groupBy(F.col("var").alias("v"), of("idx").alias("b")).agg(every.alias("e")).select("v", "b", F.col("e.at").alias("ats"), F.col("e.what").alias("whats"))
    rows = stage(found, "found")
    # where the slice begins and how far it goes in a bin; its ends are events as a rule, and else lie between two
    place = F.array_position("ats", F.col("start_idx"))
    first = F.when(of("start_idx") < F.col("b"), 1).when(place > 0, place).otherwise(F.size(F.filter("ats", lambda x: x < F.col("start_idx"))) + 1)
    place = F.array_position("ats", F.col("end_idx"))
    last = F.when(of("end_idx") > F.col("b"), F.size("ats")).when(place > 0, place).otherwise(F.size(F.filter("ats", lambda x: x <= F.col("end_idx"))))
    piece = F.slice("whats", first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
    here = lambda d, *more: d.join(bins, (F.col("var") == F.col("v")) & (F.col("_bin") == F.col("b"))).select(*found.columns, *more, piece.alias("slice")).where("size(slice) > 0")
    one = here(rows.where(of("start_idx") == of("end_idx")).withColumn("_bin", of("start_idx")))
    over = rows.where(of("start_idx") < of("end_idx")).withColumn("_row", F.monotonically_increasing_id())
    over = here(over.withColumn("_bin", F.explode(F.sequence(of("start_idx"), of("end_idx")))), "_row", "b")
    over = over.groupBy(*found.columns, "_row").agg(F.array_sort(F.collect_list(F.struct("b", "slice"))).alias("s")).withColumn("slice", F.flatten(F.col("s.slice"))).drop("s", "_row")
    return one.unionByName(over)


def fingerprint(found: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """One row for each group with a hash of its sorted distinct parts."""
    return found.groupBy(*by).agg(F.xxhash64(F.to_json(F.array_sort(F.collect_set(F.struct(*parts))))).alias("fingerprint"))
