"""Whole programs from IR text: spawn, join, captured locks, channels, and calls that never return."""

import pytest

from petrelspark import __main__ as command
from petrelspark.operators import detect, explore
from petrelspark.sources import mir, mir_program

LOCK = "std::sync::Arc<std::sync::Mutex<i32>>"
GUARD = "std::sync::MutexGuard<'_, i32>"
RESULT = f"std::result::Result<{GUARD}, std::sync::PoisonError<{GUARD}>>"


def body(first, second):
    """A block sequence that locks two places in order and drops both guards."""
    out, bb = [], 0
    for place, base in ((first, 20), (second, 30)):
        out += [f"    bb{bb}: {{\n        _{base} = &{place};\n        _{base + 1} = <{LOCK} as std::ops::Deref>::deref(copy _{base}) -> [return: bb{bb + 1}, unwind continue];\n    }}",
                f"    bb{bb + 1}: {{\n        _{base + 2} = Mutex::<i32>::lock(copy _{base + 1}) -> [return: bb{bb + 2}, unwind continue];\n    }}",
                f"    bb{bb + 2}: {{\n        _{base + 3} = std::result::Result::<T, E>::unwrap(move _{base + 2}) -> [return: bb{bb + 3}, unwind continue];\n    }}"]
        bb += 3
    out += [f"    bb{bb}: {{\n        drop(_33) -> [return: bb{bb + 1}, unwind continue];\n    }}", f"    bb{bb + 1}: {{\n        drop(_23) -> [return: bb{bb + 2}, unwind continue];\n    }}"]
    return out, bb + 2


def program(main_order, thread_order):
    decl = "\n".join(f"    let mut _{b}: {t};" for b in (20, 30) for b, t in ((b + 2, RESULT), (b + 3, GUARD)))
    inner, end = body(*[f"((*_1).{k}: {LOCK})" if False else f"(_1.{k}: {LOCK})" for k in thread_order])
    thread = "fn main::{closure#0}(_1: {closure@src/main.rs:9:20: 9:27}) -> () {\n" + decl + "\n" + "\n".join(inner) + f"\n    bb{end}: {{\n        return;\n    }}\n}}\n"
    own, end = body(*[("_1", "_2")[k] for k in main_order])
    shift = 5
    import re

    own = [re.sub(r"bb(\d+)", lambda m: f"bb{int(m[1]) + shift}", x) for x in own]
    main = f"""fn main() -> () {{
    let _1: {LOCK};
    let _2: {LOCK};
    let _3: {LOCK};
    let _4: {LOCK};
    let _5: {{closure@src/main.rs:9:20: 9:27}};
    let _6: std::thread::JoinHandle<()>;
{decl}
    bb0: {{
        _1 = std::sync::Arc::<std::sync::Mutex<i32>>::new(const 0_i32) -> [return: bb1, unwind continue];
    }}
    bb1: {{
        _2 = std::sync::Arc::<std::sync::Mutex<i32>>::new(const 1_i32) -> [return: bb2, unwind continue];
    }}
    bb2: {{
        _3 = <{LOCK} as std::clone::Clone>::clone(copy _1) -> [return: bb3, unwind continue];
    }}
    bb3: {{
        _4 = <{LOCK} as std::clone::Clone>::clone(copy _2) -> [return: bb4, unwind continue];
    }}
    bb4: {{
        _5 = {{closure@src/main.rs:9:20: 9:27}} {{ a: move _3, b: move _4 }};
        _6 = std::thread::spawn::<{{closure@src/main.rs:9:20: 9:27}}, ()>(move _5) -> [return: bb5, unwind continue];
    }}
""" + "\n".join(own) + f"""
    bb{end + shift}: {{
        _7 = JoinHandle::<()>::join(move _6) -> [return: bb{end + shift + 1}, unwind continue];
    }}
    bb{end + shift + 1}: {{
        return;
    }}
}}
"""
    return main + "\n" + thread


EXITS = """fn main() -> () {
    bb0: {
        _1 = work(const 1_i32) -> [return: bb1, unwind continue];
    }
    bb1: {
        assert(const true, "x") -> [success: bb2, unwind continue];
    }
    bb2: {
        _2 = std::process::exit(const 1_i32) -> unwind continue;
    }
}

fn work(_1: i32) -> () {
    bb0: {
        return;
    }
}
"""
MAIL = """fn main() -> () {
    let _2: std::sync::mpsc::Sender<i32>;
    let _3: std::sync::mpsc::Receiver<i32>;
    let _4: {closure@a.rs:1:1: 1:9};
    let _5: std::thread::JoinHandle<()>;
    bb0: {
        _1 = std::sync::mpsc::channel::<i32>() -> [return: bb1, unwind continue];
    }
    bb1: {
        _2 = move (_1.0: std::sync::mpsc::Sender<i32>);
        _3 = move (_1.1: std::sync::mpsc::Receiver<i32>);
        _4 = {closure@a.rs:1:1: 1:9} { tx: move _2 };
        _5 = std::thread::spawn::<{closure@a.rs:1:1: 1:9}, ()>(move _4) -> [return: bb2, unwind continue];
    }
    bb2: {
        _6 = std::sync::mpsc::Receiver::<i32>::recv(copy _3) -> [return: bb3, unwind continue];
    }
    bb3: {
        _7 = std::thread::JoinHandle::<()>::join(move _5) -> [return: bb4, unwind continue];
    }
    bb4: {
        return;
    }
}

fn main::{closure#0}(_1: {closure@a.rs:1:1: 1:9}) -> () {
    let _2: std::sync::mpsc::Sender<i32>;
    bb0: {
        _2 = move (_1.0: std::sync::mpsc::Sender<i32>);
        _3 = std::sync::mpsc::Sender::<i32>::send(copy _2, const 1_i32) -> [return: bb1, unwind continue];
    }
    bb1: {
        return;
    }
}
"""
SILENT = MAIL.replace("_3 = std::sync::mpsc::Sender::<i32>::send(copy _2, const 1_i32) -> [return: bb1, unwind continue];", "goto -> bb1;")


@pytest.fixture(scope="module")
def graph(spark):
    texts = [("abba", program((0, 1), (1, 0))), ("ordered", program((0, 1), (0, 1))), ("exits", EXITS), ("mail", MAIL), ("silent", SILENT)]
    return explore.explore(mir_program.program_net(spark.createDataFrame(texts, "path string, text string")))


def test_deadlocks_of_programs(graph):
    found = {}
    for r in detect.deadlocks(graph).collect():
        found.setdefault(r["net_id"], []).append(r["marking"])
    assert sorted(found) == ["abba", "silent"] and len(found["abba"]) == 1 and len(found["silent"]) == 1
    kinds = {(r["net_id"], r["ttype"]) for r in graph.net.transitions.collect()}
    assert {("abba", "Lock"), ("abba", "Unlock"), ("abba", "Spawn"), ("abba", "Join"), ("exits", "Panic"), ("exits", "Assert"), ("mail", "Spawn")} <= kinds
    locks = {r["net_id"]: r["n"] for r in graph.net.places.where("place_type = 'Resources'").groupBy("net_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert locks == {"abba": 2, "ordered": 2, "mail": 1, "silent": 1}


def test_heads_that_are_not_understood(spark):
    text = "fn ok() -> () {\n    bb0: {\n        return;\n    }\n}\nfn broken(\n    _1: i32,\n) -> () {\n    bb0: {\n        return;\n    }\n}\n"
    w = mir.net_rows(spark.createDataFrame([("t", text)], "path string, text string"))["warnings"].collect()
    assert [(r["line"], r["reason"], r["callee"]) for r in w] == [(6, "function head not understood", "fn broken(")]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "abba.mir").write_text(program((0, 1), (1, 0)))
    command.main([str(tmp_path / "in"), "--out", str(tmp_path / "out")])
    out = (tmp_path / "out" / "deadlocks")
    assert out.exists() and any("t" in f.read_text() for f in out.rglob("*") if f.is_file() and f.suffix in (".json", ".csv", ".txt"))
