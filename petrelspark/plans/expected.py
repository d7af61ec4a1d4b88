"""Rows that queries on literal nets and programs give, worked out by hand or by a plain simulation apart from this engine, as SQL."""

from __future__ import annotations

from petrelspark.plans import derive

#: query -> columns, rows.
ROWS: dict[str, tuple[str, list[tuple]]] = {
    "reach_truncated": ("net_id, states, edges, deadlocks, truncated", [
        ('N1', 2, 1, 1, False),
        ('N10', 3, 2, 1, False),
        ('N11', 3, 2, 0, True),
        ('N2', 2, 2, 0, False),
        ('N4', 2, 1, 1, False),
        ('N5', 1, 2, 0, False),
        ('N6', 1, 3, 0, False),
        ('N7', 3, 2, 0, True),
        ('N8', 3, 2, 0, True),
        ('N9', 2, 1, 0, False),
    ]),
    "reach_reduced": ("net_id, states, edges, deadlocks, truncated", [
        ('N1', 2, 1, 1, False),
        ('N10', 3, 2, 1, False),
        ('N11', 4, 4, 1, False),
        ('N2', 2, 2, 0, False),
        ('N4', 2, 1, 1, False),
        ('N5', 1, 2, 0, False),
        ('N6', 1, 3, 0, False),
        ('N7', 15, 16, 2, False),
        ('N8', 14, 14, 1, False),
        ('N9', 2, 1, 0, False),
    ]),
    "invariants": ("net_id, kind, number, vector", [
        ('N1', 'place', 0, '0:1,1:1'),
        ('N10', 'place', 0, '0:-10,1:-10,2:1'),
        ('N10', 'place', 1, '0:1,1:1,3:1'),
        ('N11', 'place', 0, '0:1,1:1'),
        ('N11', 'place', 1, '2:1,3:1'),
        ('N2', 'place', 0, '0:1,1:1'),
        ('N2', 'transition', 0, '0:1,1:1'),
        ('N4', 'place', 0, '1:1'),
        ('N5', 'place', 0, '0:1'),
        ('N5', 'transition', 0, '0:1'),
        ('N5', 'transition', 1, '1:1'),
        ('N6', 'place', 0, '0:1'),
        ('N6', 'transition', 0, '0:1'),
        ('N6', 'transition', 1, '1:1'),
        ('N6', 'transition', 2, '2:1'),
        ('N7', 'place', 0, '0:1,1:1,4:1'),
        ('N7', 'place', 1, '0:1,1:1,5:1,6:1,7:1,8:1'),
        ('N7', 'place', 2, '2:-1,3:1,6:-1,10:1'),
        ('N7', 'place', 3, '2:1,6:1,7:1,11:1'),
        ('N7', 'place', 4, '0:1,1:1,3:-1,7:-1,9:1,12:1'),
        ('N8', 'place', 0, '0:1,1:1,4:1'),
        ('N8', 'place', 1, '0:1,1:1,5:1,6:1,7:1,8:1'),
        ('N8', 'place', 2, '2:1,3:-1,6:1,10:1'),
        ('N8', 'place', 3, '3:1,7:1,11:1'),
        ('N8', 'place', 4, '0:1,1:1,2:-1,6:-1,7:-1,9:1,12:1'),
        ('N9', 'place', 0, '0:-1,1:-10,2:1'),
        ('N9', 'place', 1, '0:1,1:1,3:1'),
    ]),
    "deadlock_report": ("net_id, state_id, reason, marking, path", [
        ('N1', 1, 'no_enabled', 'p1:1', 't0'),
        ('N11', 3, 'no_enabled', 'p1:1,q1:1', 'a,b'),
        ('N4', 1, 'no_enabled', 'blocked:1', 'block'),
        ('N7', 5, 'no_enabled', 'a1:1,b1:1,main_wait:1', 'spawn,a_lock0,b_lock1'),
        ('N9', 1, 'capacity', 'RwLock_0:9,w1:1', 'wlock'),
    ]),
    "boundedness": ("net_id, place_id, verdict, bound, witness", [
        ('N3', 0, 'Bounded', 1, None),
        ('N3', 1, 'Unbounded', None, '0'),
        ('N2', 0, 'Bounded', 1, None),
        ('N2', 1, 'Bounded', 1, None),
        ('N7', 0, 'Bounded', 1, None),
        ('N7', 1, 'Bounded', 1, None),
        ('N7', 2, 'Bounded', 1, None),
        ('N7', 3, 'Bounded', 1, None),
        ('N7', 4, 'Bounded', 1, None),
        ('N7', 5, 'Bounded', 1, None),
        ('N7', 6, 'Bounded', 1, None),
        ('N7', 7, 'Bounded', 1, None),
        ('N7', 8, 'Bounded', 1, None),
        ('N7', 9, 'Bounded', 1, None),
        ('N7', 10, 'Bounded', 1, None),
        ('N7', 11, 'Bounded', 1, None),
        ('N7', 12, 'Bounded', 1, None),
    ]),
    "coverability": ("net_id, depth, marking, path", [
        ('N3', 0, '1,0', ''),
        ('N3', 1, '1,w', '0'),
        ('N3', 2, '1,w', '0,0'),
        ('N2', 0, '1,0', ''),
        ('N2', 1, '0,1', '0'),
        ('N2', 2, '1,0', '0,1'),
        ('N7', 0, '1,0,1,1,0,0,0,0,0,0,0,0,0', ''),
        ('N7', 1, '0,0,1,1,1,1,0,0,0,1,0,0,0', '0'),
        ('N7', 2, '0,0,0,1,1,0,1,0,0,1,0,0,0', '0,1'),
        ('N7', 2, '0,0,1,0,1,1,0,0,0,0,1,0,0', '0,4'),
        ('N7', 3, '0,0,0,0,1,0,0,1,0,1,0,0,0', '0,1,2'),
        ('N7', 3, '0,0,0,0,1,0,1,0,0,0,1,0,0', '0,1,4'),
        ('N7', 3, '0,0,0,0,1,0,1,0,0,0,1,0,0', '0,4,1'),
        ('N7', 3, '0,0,0,0,1,1,0,0,0,0,0,1,0', '0,4,5'),
        ('N7', 4, '0,0,1,1,1,0,0,0,1,1,0,0,0', '0,1,2,3'),
        ('N7', 4, '0,0,1,1,1,1,0,0,0,0,0,0,1', '0,4,5,6'),
        ('N7', 5, '0,0,1,0,1,0,0,0,1,0,1,0,0', '0,1,2,3,4'),
        ('N7', 5, '0,0,0,1,1,0,1,0,0,0,0,0,1', '0,4,5,6,1'),
        ('N7', 6, '0,0,0,0,1,0,0,0,1,0,0,1,0', '0,1,2,3,4,5'),
        ('N7', 6, '0,0,0,0,1,0,0,1,0,0,0,0,1', '0,4,5,6,1,2'),
        ('N7', 7, '0,0,1,1,1,0,0,0,1,0,0,0,1', '0,1,2,3,4,5,6'),
        ('N7', 7, '0,0,1,1,1,0,0,0,1,0,0,0,1', '0,4,5,6,1,2,3'),
        ('N7', 8, '0,1,1,1,0,0,0,0,0,0,0,0,0', '0,1,2,3,4,5,6,7'),
        ('N7', 8, '0,1,1,1,0,0,0,0,0,0,0,0,0', '0,4,5,6,1,2,3,7'),
    ]),
    "deadlock_cycles": ("net_id, locks, states", [
        ('spin', '2', 2),
        ('two_sets', '4', 2),
    ]),
    "atomicity_on_net": ("net_id, var, load, stores", [
        ('N6', '0', '14:5', '10:5,12:5'),
    ]),
    "atomicity_search": ("net_id, rule, var, start, mid, end", [
        ('N6', 1, '0', 2, 1, 0),
        ('N6', 2, '0', 0, 1, 2),
        ('N6', 3, '0', 2, 1, 2),
    ]),
    "reduce_loops": ("net_id, transitions, places", [
        ('chain', 3, 4),
        ('live_cycle', 2, 2),
        ('resource_chain', 3, 4),
        ('locks', 8, 13),
    ]),
    "reduce_sequences": ("net_id, transitions, places", [
        ('chain', 1, 2),
        ('live_cycle', 2, 2),
        ('resource_chain', 3, 4),
        ('locks', 8, 13),
    ]),
    "reduce_intermediate": ("net_id, transitions, places", [
        ('chain', 1, 2),
        ('live_cycle', 2, 2),
        ('resource_chain', 2, 3),
        ('locks', 6, 11),
    ]),
    "reduce_trace": ("net_id, trans_id, name, ttype, orig_ids", [
        ('chain', 0, 't0+t1+t2', 'Normal', '0,1,2'),
        ('live_cycle', 0, 't0', 'Normal', '0'),
        ('live_cycle', 1, 't1', 'Normal', '1'),
        ('resource_chain', 0, 't0', 'Normal', '0'),
        ('resource_chain', 1, 't1+t2', 'Normal', '1,2'),
        ('locks', 0, 'spawn', 'Normal', '0'),
        ('locks', 1, 'a_lock0', 'Lock', '1'),
        ('locks', 2, 'a_lock1+a_unlock', 'Normal', '2,3'),
        ('locks', 3, 'b_lock1', 'Lock', '4'),
        ('locks', 4, 'b_lock0+b_unlock', 'Normal', '5,6'),
        ('locks', 5, 'join', 'Normal', '7'),
    ]),
    "translate_atomicity": ("net_id, var, load, stores", [
        ('flags', 'x', 'main:2', 'u:0,w:0'),
    ]),
    "translate_tasks": ("net_id, states, edges, deadlocks, truncated", [
        ('jobs', 22, 29, 3, False),
    ]),
    "mir_terminators": ("path, fn, bb, kind, targets, callee, dest, dropped", [
        ('ledger.mir', 'main', 0, 'call', '1', 'std::sync::Mutex::<i64>::lock', '_7', None),
        ('ledger.mir', 'main', 1, 'call', '2', 'balanced', '_5', None),
        ('ledger.mir', 'main', 2, 'drop', '4', None, None, '_7'),
        ('ledger.mir', 'main', 3, None, None, None, None, None),
        ('ledger.mir', 'main', 4, 'return', '', None, None, None),
        ('counter.mir', 'bump', 0, 'call', '1', 'std::sync::Mutex::<u64>::lock', '_2', None),
        ('counter.mir', 'bump', 1, 'call', '2', "Result::<std::sync::MutexGuard<'_, u64>, PoisonError<std::sync::MutexGuard<'_, u64>>>::expect", '_3', None),
        ('counter.mir', 'bump', 2, 'drop', '3', None, None, '_3'),
        ('counter.mir', 'bump', 3, 'return', '', None, None, None),
        ('counter.mir', 'bump', 4, None, None, None, None, None),
        ('counter.mir', 'main', 0, 'call', '1', 'std::sync::Mutex::<u64>::new', '_1', None),
        ('counter.mir', 'main', 1, 'call', '2', 'bump', '_6', None),
        ('counter.mir', 'main', 2, 'switch', '3,4', None, None, None),
        ('counter.mir', 'main', 3, 'goto', '1', None, None, None),
        ('counter.mir', 'main', 4, 'return', '', None, None, None),
        ('counter.mir', 'main', 5, None, None, None, None, None),
    ]),
    "mir_net": ("path, places, transitions, arcs", [
        ('ledger.mir', 8, 5, 14),
        ('counter.mir', 15, 12, 28),
    ]),
    "mir_warnings": ("path, function, basic_block, line, reason, callee", [
        ('ledger.mir', 'main', 'bb1', 12, 'unrecognized call, treated as CFG edge', 'balanced'),
        ('counter.mir', 'bump', 'bb1', 14, 'unrecognized call, treated as CFG edge', "Result::<std::sync::MutexGuard<'_, u64>, PoisonError<std::sync::MutexGuard<'_, u64>>>::expect"),
        ('counter.mir', 'main', 'bb0', 36, 'unrecognized call, treated as CFG edge', 'std::sync::Mutex::<u64>::new'),
        ('counter.mir', 'main', 'bb1', 40, 'unrecognized call, treated as CFG edge', 'bump'),
    ]),
    "collect_calls": ("func, bb, action, callee, res, res2, ordering, callees", [
        ('main', 0, 'spawn', 'app::work', None, None, None, None),
        ('main', 1, 'normal', 'app::helper', None, None, None, None),
        ('main', 2, 'notify', None, 'C', None, None, None),
        ('main', 3, 'join', 'app::work', None, None, None, None),
        ('main', 4, 'plain', None, None, None, None, None),
        ('main', 5, 'panic', None, None, None, None, None),
        ('main', 6, 'rayon_join', None, None, None, None, 'app::work+app::helper'),
        ('app::work', 0, 'mutex_lock', None, 'A', None, None, None),
        ('app::work', 1, 'write_lock', None, 'R', None, None, None),
        ('app::work', 2, 'send', None, 'ch', None, None, None),
        ('app::work', 3, 'atomic_store', None, 'flag', None, 'Release', None),
        ('app::work', 4, 'atomic_load', None, 'flag', None, 'Relaxed', None),
        ('app::work', 5, 'unlock_mutex', None, 'A', None, None, None),
        ('app::work', 6, 'unlock_write', None, 'R', None, None, None),
        ('app::work', 7, 'plain', None, None, None, None, None),
        ('app::work', 8, 'plain', None, None, None, None, None),
        ('app::work', 9, 'recv', None, 'ch', None, None, None),
        ('app::work', 10, 'plain', None, None, None, None, None),
        ('app::work', 11, 'mutex_lock', None, 'A', None, None, None),
        ('app::work', 12, 'panic', None, None, None, None, None),
    ]),
    "collect_call_edges": ("caller, callee, site_kind, location", [
        ('main', 'app::helper', 'direct', 'bb1'),
        ('main', 'app::work', 'closure_def', '_2'),
        ('main', 'app::work', 'spawn', 'bb0'),
        ('main', 'app::work', 'rayon_join', 'bb6'),
        ('main', 'app::helper', 'rayon_join', 'bb6'),
    ]),
    "collect_resources": ("func, local, what", [
        ('app::work', '_4', 'guard Std mutex'),
        ('app::work', '_5', 'guard ParkingLot write'),
        ('app::work', '_21', 'guard Std mutex'),
        ('main', '_8', 'condvar'),
        ('app::work', '_6', 'mpsc.sender u32'),
        ('app::work', '_9', 'mpsc.receiver u32'),
        ('app::work', '_1', 'atomic Release write@w:3+read@w:4'),
        ('app::helper', 'bb0', 'unsafe h:0+h:1'),
    ]),
}


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, bool | int) else "'" + x.replace("'", "''") + "'"


def sql(name: str) -> str:
    """The rows of a query as ``VALUES``."""
    columns, rows = ROWS[name]
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({columns.replace('end', chr(34) + 'end' + chr(34))})"


def spread(name: str, names: list[str], column: str = "net_id") -> str:
    """The rows of a query whose inputs are dealt to the orders by ``derive.spread``; without ``column`` among them they hold for every order."""
    own = column in [c.strip() for c in ROWS[name][0].split(",")]
    rest = f"e.* EXCLUDE ({column})" if own else "e.*"
    return f"WITH {derive.spread_sql(names)}, e AS ({sql(name)}) SELECT key AS {column}, {rest} FROM e JOIN spread ON {f'e.{column} = spread.name' if own else 'true'}"
