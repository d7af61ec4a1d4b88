"""Command line: nets from IR text or from a written net, analysed, with reports as files.

    python -m petrelspark PATH --out FOLDER [--mode deadlock|datarace|atomic|all] [--settings FILE] [--until STAGE] [--net] [--compat]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrelspark.plans.analysis import analyse
from petrelspark.plans.net import Net
from petrelspark.plans.settings import MODES, STAGES, Settings
from petrelspark.sources import mir, mir_program, sinks
from petrelspark.staging import scope, stage


def net_of(rows: dict[str, DataFrame]) -> Net:
    """IR-text rows (``mir.net_rows``), which have text ids, as a net."""
    from petrelspark.operators.translate import as_net

    text = lambda d, kind, ident, **more: d.select(F.col("path").alias("net_id"), F.lit(kind).alias("kind"), ident.alias("id"), *[more.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("other", "string"), ("tokens", "long"), ("capacity", "long"), ("ptype", "string"), ("ttype", "string"), ("res", "string"), ("var", "string"), ("ordering", "string"), ("span", "string"), ("tid", "int"))])
    named = lambda c: F.regexp_replace(c, "_exit$", "_end")
    end = F.when(F.col("id").endswith("_exit"), "FunctionEnd").when(F.col("kind").startswith("mutex"), "Resources").otherwise("BasicBlock")
    places = text(rows["places"], "place", named("id"), tokens=F.col("init_tokens"), capacity=F.lit(1), ptype=end)
    label = F.when(F.col("kind") == "lock", "Lock").when(F.col("kind") == "unlock", "Unlock").otherwise("Goto")
    trans = text(rows["transitions"], "transition", F.col("id"), ttype=label, res=F.when(F.col("op").isNotNull(), F.concat(F.lit("p_mutex_"), "op", F.lit("_free"))))
    arcs = text(rows["arcs"], "arc", named("source"), other=named("target"), tokens=F.col("weight"))
    return as_net(places.union(trans).union(arcs))


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="petrelspark", description="Analyse programs as nets.")
    p.add_argument("path")
    p.add_argument("--out", required=True)
    p.add_argument("--mode", choices=MODES, default="deadlock")
    p.add_argument("--settings", default="petrelspark.toml")
    p.add_argument("--until", choices=STAGES)
    p.add_argument("--net", action="store_true", help="the path is a net that sinks.write_net wrote")
    p.add_argument("--compat", action="store_true")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("petrelspark").getOrCreate()
    semantics = "compat" if a.compat else "strict"
    with scope(spark):
        if a.net:
            net = sinks.read_net(spark, a.path)
        else:
            texts = mir.read(spark, a.path)
            # compat: locks within functions; else all functions with spawns, calls, locks, channels and atomic variables
            net = net_of(mir.net_rows(texts, semantics=semantics)) if a.compat else mir_program.program_net(texts, semantics=semantics)
            net = Net(stage(net.places, "places"), stage(net.transitions, "transitions"), stage(net.arcs, "arcs"))
            sinks.write_report(mir.unknown_heads(texts, semantics), f"{a.out}/warnings")
        for name, report in analyse(net, a.mode, Settings.load(a.settings), a.until, semantics).items():
            sinks.write_report(report, f"{a.out}/{name}")
        sinks.write_net(net, f"{a.out}/net")


if __name__ == "__main__":
    main()
