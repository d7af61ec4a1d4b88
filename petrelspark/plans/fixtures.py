"""Literal nets for queries and tests, each a few places and transitions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from petrelspark.plans.net import ARCS, PLACES, TRANSITIONS, Net

#: net -> (places "name:tokens/capacity[!type]", transitions "name[!label]: inputs -> outputs"); "-" is unbounded, "2*p" a weight.
_LOCKS = ["main_start:1/1!FunctionStart", "main_end:0/1!FunctionEnd", "Mutex_0:1/1!Resources", "Mutex_1:1/1!Resources", "main_wait:0/1"] + [f"{t}{k}:0/1" for t in "ab" for k in range(4)]
_SPAWN = ["spawn: main_start -> a0 + b0 + main_wait", "a_lock0!Lock@2: a0 + Mutex_0 -> a1", "a_lock1!Lock@3: a1 + Mutex_1 -> a2", "a_unlock: a2 -> a3 + Mutex_0 + Mutex_1"]
_JOIN = ["b_unlock: b2 -> b3 + Mutex_0 + Mutex_1", "join: main_wait + a3 + b3 -> main_end"]
_WRITER = ["main_start:1/1!FunctionStart", "main_end:0/1!FunctionEnd", "RwLock_0:10/10!Resources", "w1:0/1"]
NETS: dict[str, tuple[list[str], list[str]]] = {
    "N1": (["p0:1/1", "p1:0/1"], ["t0: p0 -> p1"]),
    "N2": (["p0:1/10", "p1:0/10"], ["t0: p0 -> p1", "t1: p1 -> p0"]),
    "N4": (["start:1/1", "progress:0/1", "blocked:0/1"], ["loop: start + progress -> progress", "block: start -> blocked"]),
    "N5": (["shared:1/1!Resources"], ["unsafe_read!UnsafeRead@0: shared -> shared", "unsafe_write!UnsafeWrite@0: shared -> shared"]),
    "N6": (["shared_atomic:1/1!Resources"], ["store_a!AtomicStore@0/Release/1/10:5: shared_atomic -> shared_atomic", "store_b!AtomicStore@0/SeqCst/2/12:5: shared_atomic -> shared_atomic", "load!AtomicLoad@0/Relaxed/1/14:5: shared_atomic -> shared_atomic"]),
    "N7": (_LOCKS, [*_SPAWN, "b_lock1!Lock@3: b0 + Mutex_1 -> b1", "b_lock0!Lock@2: b1 + Mutex_0 -> b2", *_JOIN]),
    "N8": (_LOCKS, [*_SPAWN, "b_lock0!Lock@2: b0 + Mutex_0 -> b1", "b_lock1!Lock@3: b1 + Mutex_1 -> b2", *_JOIN]),
    "N9": (_WRITER, ["wlock: main_start + RwLock_0 -> w1", "wunlock: w1 -> 10*RwLock_0 + main_end"]),
    "N10": (_WRITER, ["wlock: main_start + 10*RwLock_0 -> w1", "wunlock: w1 -> 10*RwLock_0 + main_end"]),
    "N11": (["p0:1/1", "p1:0/1", "q0:1/1", "q1:0/1"], ["a: p0 -> p1", "b: q0 -> q1"]),
}
#: A net without a bound, for the coverability tree alone.
GENERATOR = {"N3": (["p0:1/-", "p1:0/-"], ["t0: p0 -> p0 + p1"])}
#: Nets that the reduction rules shrink.
REDUCIBLE = {
    "chain": (["p0:1/1", "p1:0/1", "p2:0/1", "p3:0/1"], ["t0: p0 -> p1", "t1: p1 -> p2", "t2: p2 -> p3"]),
    "idle_cycle": (["p0:0/1", "p1:0/1"], ["t0: p0 -> p1", "t1: p1 -> p0"]),
    "live_cycle": (["p0:1/10", "p1:0/10"], ["t0: p0 -> p1", "t1: p1 -> p0"]),
    "resource_chain": (["p0:1/1", "p1:0/1!Resources", "p2:0/1", "p3:0/1"], ["t0: p0 -> p1", "t1: p1 -> p2", "t2: p2 -> p3"]),
    "locks": NETS["N7"],
}
#: A thread spins while the owner of a lock waits for one that nobody gives back, and the same with a lock that comes back.
SPINNING = {
    "spin": (["s0:1/1", "s1:0/1", "A:0/1!Resources", "B:1/1!Resources", "w:1/1"], ["go: s0 -> s1", "back: s1 -> s0", "lockA!Lock@2: w + A -> w + A", "lockB!Lock@3: s1 + B -> s1 + B"]),
    "two_sets": (["s:1/1", "x0:0/1", "x1:0/1", "y:0/1", "A:0/1!Resources", "B:1/1!Resources"], ["left: s -> x0", "right: s -> y", "go: x0 -> x1", "back!Lock@5: x1 + B -> x0 + B", "stay!Lock@5: y + B -> y + B", "never!Lock@4: x0 + A -> x1 + A"]),
    "freed": (["s0:1/1", "s1:0/1", "A:1/1!Resources", "B:1/1!Resources"], ["a!Lock@2: s0 + A -> s1 + A", "b!Lock@3: s1 + B -> s0 + B"]),
}
#: Nets with inhibitor ("~p") and reset ("^p") arcs.
SPECIAL = {
    "inhibited": (["p:1/-", "q:1/-", "r:0/-"], ["t0: p + ~q -> r", "t1: q -> r", "t2: p + ~r -> q"]),
    "resetting": (["p:1/-", "q:5/-", "r:0/-"], ["t0: p + ^q -> r", "t1: 2*q -> r"]),
}


def rows(nets: dict[str, tuple[list[str], list[str]]]) -> tuple[list, list, list]:
    """Rows of the three tables."""
    places, transitions, arcs = [], [], []
    for net, (ps, ts) in nets.items():
        number = {}
        for k, p in enumerate(ps):
            name, _, rest = p.partition(":")
            counts, _, kind = rest.partition("!")
            tokens, _, most = counts.partition("/")
            number[name] = k
            places.append((net, k, name, int(tokens), None if most == "-" else int(most), kind or "BasicBlock", ""))
        for k, t in enumerate(ts):
            head, _, rule = t.partition(": ")
            name, _, label = head.partition("!")
            kind, _, more = label.partition("@")
            about = more.split("/") if more else []
            atomic = len(about) > 1
            transitions.append((net, k, name, kind or "Normal", int(about[0]) if about else None, about[0] if about else None, about[1] if atomic else None, about[3] if atomic else f"{k}:1", int(about[2]) if atomic else None, 0, "i32" if about else None))
            for side, way in zip(rule.split(" -> "), ("in", "out"), strict=True):
                for part in side.split(" + "):
                    weight, _, place = part.rpartition("*")
                    special = {"~": "inhibitor", "^": "reset"}.get(place[0])
                    arcs.append((net, number[place.lstrip("~^")], k, special or way, int(weight or 1)))
    return places, transitions, arcs


def net(spark: SparkSession, nets: dict[str, tuple[list[str], list[str]]] = NETS) -> Net:
    p, t, a = rows(nets)
    return Net(spark.createDataFrame(p, PLACES).coalesce(1), spark.createDataFrame(t, TRANSITIONS).coalesce(1), spark.createDataFrame(a, ARCS).coalesce(1))


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


#: The dense forms of places, transitions and weights.
DENSE = """initial AS (SELECT net_id, list(CAST(tokens AS BIGINT) ORDER BY place_id) AS m, list(CAST(capacity AS BIGINT) ORDER BY place_id) AS cap FROM places GROUP BY net_id),
firing AS (
  SELECT p.net_id, t.trans_id, list(coalesce(i.weight, 0) ORDER BY p.place_id) AS pre, list(coalesce(o.weight, 0) ORDER BY p.place_id) AS post,
    list(coalesce(h.weight, 0) ORDER BY p.place_id) AS inh, list(coalesce(z.weight, 0) ORDER BY p.place_id) AS rst
  FROM places p JOIN transitions t ON p.net_id = t.net_id
    LEFT JOIN weights i ON i.net_id = p.net_id AND i.place_id = p.place_id AND i.trans_id = t.trans_id AND i.direction = 'in'
    LEFT JOIN weights o ON o.net_id = p.net_id AND o.place_id = p.place_id AND o.trans_id = t.trans_id AND o.direction = 'out'
    LEFT JOIN weights h ON h.net_id = p.net_id AND h.place_id = p.place_id AND h.trans_id = t.trans_id AND h.direction = 'inhibitor'
    LEFT JOIN weights z ON z.net_id = p.net_id AND z.place_id = p.place_id AND z.trans_id = t.trans_id AND z.direction = 'reset'
  GROUP BY p.net_id, t.trans_id)"""


def sql_tables(nets: dict[str, tuple[list[str], list[str]]] = NETS) -> str:
    """Common table expressions of the same rows: places, transitions, arcs, and the dense forms initial and firing."""
    p, t, a = rows(nets)
    values = lambda some: ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in some)
    return f"""places(net_id, place_id, name, tokens, capacity, place_type, span) AS (VALUES {values(p)}),
transitions(net_id, trans_id, name, ttype, res_place, var, ordering, span, tid, basic_block, data_type) AS (VALUES {values(t)}),
arcs(net_id, place_id, trans_id, direction, weight) AS (VALUES {values(a)}),
weights AS (SELECT net_id, place_id, trans_id, direction, CAST(sum(weight) AS BIGINT) AS weight FROM arcs WHERE weight > 0 GROUP BY ALL),
{DENSE}"""
