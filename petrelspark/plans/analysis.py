"""The whole analysis of nets: reduce, explore, detect."""

from __future__ import annotations

from pyspark.sql import DataFrame

from petrelspark.operators import detect, explore, reduce
from petrelspark.plans.net import Net
from petrelspark.plans.settings import MODES, Settings, goes_past


def analyse(net: Net, mode: str = "deadlock", settings: Settings | None = None, until: str | None = None, semantics: str = "strict", entry: str = "main") -> dict[str, DataFrame]:
    """Results by name: stats, and of the mode deadlocks, blocked_cycles (of nets without a deadlock), races, violations, witnesses."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    settings = settings or Settings()
    out: dict[str, DataFrame] = {"diagnosis": net.diagnosis()}
    if not goes_past(until, "net"):
        return out
    if settings.reduce_net:
        net = reduce.reduced(net)["result"]
    if not goes_past(until, "reduce"):
        return out
    graph = (explore.explore_reduced if settings.por else explore.explore)(net, settings.limit)
    out["stats"] = graph.stats()
    if not goes_past(until, "stategraph"):
        return out
    if mode in ("deadlock", "all"):
        out["deadlocks"] = detect.deadlock_report(graph, semantics, entry)
        out["blocked_cycles"] = detect.blocked_cycles(detect.of_nets(graph, out["deadlocks"], but=True))
    if mode in ("datarace", "all"):
        out["races"] = detect.merged_races(detect.race_pairs(detect.accesses(graph), ["net_id"]), ["net_id"])
    if mode == "atomic":
        out["violations"], out["witnesses"] = detect.atomicity(graph), detect.net_witnesses(graph, settings.search_states, settings.search_depth)
    return out
