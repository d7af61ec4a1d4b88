"""Small literal programs as facts for ``operators.translate``, with the same facts as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = "net_id string, func string, is_entry boolean"
BLOCKS = "net_id string, func string, bb int, is_cleanup boolean, is_empty_unreachable boolean, term_kind string, span string, targets array<int>"
CALLS = "net_id string, func string, bb int, target int, action string, callee string, callees array<string>, res string, res2 string, ordering string, span string, tid int"
RESOURCES = "net_id string, res string, kind string"

_SWAP = ["spawn t1", "spawn t2", "join t1", "join t2", "return"]
_LOCKS = ["mutex_lock A", "mutex_lock B", "unlock_mutex B", "unlock_mutex A", "return"]
#: program -> (resources "name kind", functions with a step for each block).  A step is a terminator ("goto 2", "switch 1 3", "return", "unreachable", "assert 1", "drop 1") or a call
#: ("action argument", with several callees joined by "+", a lock after "/" and an ordering after "@"), which goes on to the next block; "!" before a step is a cleanup block.
PROGRAMS: dict[str, tuple[list[str], dict[str, list[str]]]] = {
    "abba": (["A mutex", "B mutex"], {"main": _SWAP, "t1": _LOCKS, "t2": ["mutex_lock B", "mutex_lock A", "unlock_mutex A", "unlock_mutex B", "return"]}),
    "ordered": (["A mutex", "B mutex"], {"main": _SWAP, "t1": _LOCKS, "t2": _LOCKS}),
    "readers": (["R rwlock"], {"main": _SWAP, "t1": ["read_lock R", "unlock_read R", "return"], "t2": ["write_lock R", "unlock_write R", "return"]}),
    "twice": (["A mutex"], {"main": ["mutex_lock A", "mutex_lock A", "unlock_mutex A", "return"]}),
    "branches": ([], {"main": ["switch 1 2 4", "goto 3", "assert 3", "return", "!resume"], "other": ["goto 0"]}),
    "helper": (["A mutex"], {"main": ["normal bump", "normal bump", "return"], "bump": ["mutex_lock A", "plain", "unlock_mutex A", "return"]}),
    "signal": (["A mutex", "C condvar"], {"main": ["spawn w", "mutex_lock A", "notify C", "unlock_mutex A", "join w", "return"], "w": ["mutex_lock A", "wait C/A", "unlock_mutex A", "return"]}),
    "mail": (["ch channel"], {"main": ["spawn w", "recv ch", "join w", "return"], "w": ["send ch", "return"]}),
    "unsent": (["ch channel"], {"main": ["recv ch", "return"]}),
    "fork": ([], {"main": ["rayon_join left+right", "return"], "left": ["return"], "right": ["plain", "return"]}),
    "race": (["cell unsafe"], {"main": ["spawn w", "unsafe_read cell", "join w", "return"], "w": ["unsafe_write cell", "return"]}),
    "flags": (["x atomic"], {"main": ["spawn w", "spawn u", "atomic_load x@Relaxed", "join w", "join u", "return"], "w": ["atomic_store x@Release", "return"], "u": ["atomic_cas x@SeqCst", "return"]}),
    "stuck": ([], {"main": ["unreachable"]}),
}
#: Terminators that a step may be, besides calls.
_ENDS = ("goto", "switch", "return", "unreachable", "resume", "assert", "drop")


def rows(programs: dict[str, tuple[list[str], dict[str, list[str]]]] = PROGRAMS) -> tuple[list, list, list, list]:
    """Rows of functions, blocks, calls and resources."""
    functions, blocks, calls, resources = [], [], [], []
    for net, (things, bodies) in programs.items():
        resources += [(net, *x.split(" ")) for x in things]
        for number, (func, steps) in enumerate(bodies.items()):
            functions.append((net, func, func == "main"))
            for bb, step in enumerate(steps):
                kind, _, rest = step.lstrip("!").partition(" ")
                at = f"{func}:{bb}"
                ends = kind in _ENDS
                blocks.append((net, func, bb, step.startswith("!"), False, kind if ends else "call", at, [int(x) for x in rest.split()] if ends else []))
                if not ends:
                    name, _, ordering = rest.partition("@")
                    name, _, lock = name.partition("/")
                    of_function = kind in ("normal", "spawn", "join", "rayon_join")
                    calls.append((net, func, bb, bb + 1, kind, name if of_function and "+" not in name else None, name.split("+") if "+" in name else None, None if of_function else name or None, lock or None, ordering or None, at, number))
    return functions, blocks, calls, resources


def facts(spark: SparkSession, programs: dict[str, tuple[list[str], dict[str, list[str]]]] = PROGRAMS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """functions, blocks, calls, resources."""
    return tuple(spark.createDataFrame(r, s).coalesce(1) for r, s in zip(rows(programs), (FUNCTIONS, BLOCKS, CALLS, RESOURCES), strict=True))


def _literal(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def sql_facts(programs: dict[str, tuple[list[str], dict[str, list[str]]]] = PROGRAMS, prefix: str = "") -> str:
    """Common table expressions of the same rows: functions, blocks, calls, resources, with a prefix before their names."""
    names = [[c.strip().split(" ")[0] for c in s.split(", ")] for s in (FUNCTIONS, BLOCKS, CALLS, RESOURCES)]
    values = lambda some: ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in some)
    return ",\n".join(f"{prefix}{t}({', '.join(n)}) AS (VALUES {values(r)})" for t, n, r in zip(("functions", "blocks", "calls", "resources"), names, rows(programs), strict=True))


#: The net of the facts, by text ids: what each kind of step takes and gives, as a table.
_STEPS = """steps(action, ttype, takes, gives, own) AS (VALUES
  ('plain', 'Goto', 0, 0, false), ('mutex_lock', 'Lock', 1, 0, false), ('read_lock', 'RwLockRead', 1, 0, false), ('write_lock', 'RwLockWrite', 10, 0, false),
  ('unlock_mutex', 'Unlock', 0, 1, false), ('unlock_read', 'Unlock', 0, 1, false), ('unlock_write', 'Unlock', 0, 10, false), ('notify', 'Notify', 0, 1, false),
  ('send', 'Function', 0, 1, false), ('recv', 'Function', 1, 0, false), ('atomic_load', 'AtomicLoad', 1, 1, true), ('atomic_store', 'AtomicStore', 1, 1, true),
  ('atomic_cas', 'AtomicCmpXchg', 1, 1, true), ('unsafe_read', 'UnsafeRead', 1, 1, true), ('unsafe_write', 'UnsafeWrite', 1, 1, true))"""
SQL = f"""{_STEPS},
live AS (SELECT net_id, func, bb, term_kind, targets, func || '_bb' || bb AS p FROM blocks WHERE NOT is_cleanup),
c AS (SELECT *, func || '_bb' || bb AS p, func || '_bb' || target AS q, func || '_bb' || bb || '_' || action AS t FROM calls),
way AS (SELECT l.net_id, l.term_kind, l.p, m.p AS q, l.p || '_to_bb' || m.bb AS t FROM (SELECT *, unnest(targets) AS go FROM live WHERE term_kind IN ('goto', 'switch', 'assert', 'drop')) l JOIN live m ON m.net_id = l.net_id AND m.func = l.func AND m.bb = l.go),
stops AS (SELECT net_id, term_kind, p, func || '_end' AS q, p || '_' || term_kind AS t FROM live WHERE term_kind IN ('return', 'unreachable', 'resume')),
named_places AS (
  SELECT net_id, func || '_start' AS name, CAST(is_entry AS INTEGER) AS tokens, 1 AS capacity, 'FunctionStart' AS place_type FROM functions
  UNION ALL SELECT net_id, func || '_end', 0, 1, 'FunctionEnd' FROM functions
  UNION ALL SELECT net_id, p, 0, 1, 'BasicBlock' FROM live
  UNION ALL SELECT net_id, p || '_waiting', 0, 1, 'BasicBlock' FROM c WHERE action IN ('normal', 'wait', 'rayon_join')
  UNION ALL SELECT net_id, res, CASE kind WHEN 'rwlock' THEN 10 WHEN 'condvar' THEN 0 WHEN 'channel' THEN 0 ELSE 1 END, CASE kind WHEN 'rwlock' THEN 10 WHEN 'channel' THEN 100 ELSE 1 END, 'Resources' FROM resources),
named_trans AS (
  SELECT net_id, func || '_enter' AS name, 'Start' AS ttype, func AS var, NULL AS ordering, NULL AS span FROM live WHERE bb = 0
  UNION ALL SELECT net_id, t, CASE term_kind WHEN 'switch' THEN 'Switch' WHEN 'assert' THEN 'Assert' WHEN 'drop' THEN 'Drop' ELSE 'Goto' END, NULL, NULL, NULL FROM way
  UNION ALL SELECT net_id, t, CASE term_kind WHEN 'return' THEN 'Return' ELSE 'Goto' END, NULL, NULL, NULL FROM stops
  UNION ALL SELECT c.net_id, c.t, s.ttype, CASE WHEN own THEN res END, c.ordering, c.span FROM c JOIN steps s USING (action)
  UNION ALL SELECT net_id, t, CASE action WHEN 'normal' THEN 'Function' WHEN 'wait' THEN 'Wait' WHEN 'spawn' THEN 'Spawn' WHEN 'join' THEN 'Join' WHEN 'rayon_join' THEN 'Spawn' END, CASE WHEN action IN ('spawn', 'join') THEN callee END, NULL, NULL FROM c WHERE action IN ('normal', 'wait', 'spawn', 'join', 'rayon_join')
  UNION ALL SELECT net_id, t || '_ret', CASE action WHEN 'normal' THEN 'Function' WHEN 'wait' THEN 'Wait' ELSE 'Join' END, NULL, NULL, NULL FROM c WHERE action IN ('normal', 'wait', 'rayon_join')),
named_arcs AS (
  SELECT net_id, func || '_start' AS place, func || '_enter' AS trans, 'in' AS direction, 1 AS weight FROM live WHERE bb = 0
  UNION ALL SELECT net_id, p, func || '_enter', 'out', 1 FROM live WHERE bb = 0
  UNION ALL SELECT net_id, p, t, 'in', 1 FROM way UNION ALL SELECT net_id, q, t, 'out', 1 FROM way
  UNION ALL SELECT net_id, p, t, 'in', 1 FROM stops UNION ALL SELECT net_id, q, t, 'out', 1 FROM stops
  UNION ALL SELECT net_id, p, t, 'in', 1 FROM c
  UNION ALL SELECT net_id, q, CASE WHEN action IN ('normal', 'wait', 'rayon_join') THEN t || '_ret' ELSE t END, 'out', 1 FROM c
  UNION ALL SELECT net_id, res, t, 'in', takes FROM c JOIN steps s USING (action) WHERE takes > 0
  UNION ALL SELECT net_id, res, t, 'out', gives FROM c JOIN steps s USING (action) WHERE gives > 0
  UNION ALL SELECT net_id, p || '_waiting', t, 'out', 1 FROM c WHERE action IN ('normal', 'wait', 'rayon_join')
  UNION ALL SELECT net_id, p || '_waiting', t || '_ret', 'in', 1 FROM c WHERE action IN ('normal', 'wait', 'rayon_join')
  UNION ALL SELECT net_id, callee || '_start', t, 'out', 1 FROM c WHERE action IN ('normal', 'spawn')
  UNION ALL SELECT net_id, callee || '_end', t || '_ret', 'in', 1 FROM c WHERE action = 'normal'
  UNION ALL SELECT net_id, callee || '_end', t, 'in', 1 FROM c WHERE action = 'join'
  UNION ALL SELECT net_id, res2, t, 'out', 1 FROM c WHERE action = 'wait' UNION ALL SELECT net_id, res2, t || '_ret', 'in', 1 FROM c WHERE action = 'wait' UNION ALL SELECT net_id, res, t || '_ret', 'in', 1 FROM c WHERE action = 'wait'
  UNION ALL SELECT net_id, g || '_start', t, 'out', 1 FROM (SELECT *, unnest(callees) AS g FROM c WHERE action = 'rayon_join')
  UNION ALL SELECT net_id, g || '_end', t || '_ret', 'in', 1 FROM (SELECT *, unnest(callees) AS g FROM c WHERE action = 'rayon_join')),
places AS (SELECT net_id, CAST(row_number() OVER (PARTITION BY net_id ORDER BY name) - 1 AS INTEGER) AS place_id, * EXCLUDE (net_id) FROM named_places),
transitions AS (SELECT net_id, CAST(row_number() OVER (PARTITION BY net_id ORDER BY name) - 1 AS INTEGER) AS trans_id, * EXCLUDE (net_id) FROM named_trans),
weights AS (SELECT a.net_id, p.place_id, t.trans_id, direction, CAST(sum(weight) AS BIGINT) AS weight FROM named_arcs a JOIN places p ON p.net_id = a.net_id AND p.name = a.place JOIN transitions t ON t.net_id = a.net_id AND t.name = a.trans GROUP BY ALL)"""
