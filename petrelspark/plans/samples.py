"""A small program in IR text and a list of function and type names, for queries and tests."""

from __future__ import annotations

#: A balance behind a mutex, which a call in between may leave by unwinding.
LEDGER = """
fn main() -> () {
    let mut _0: ();
    let _2: std::sync::Mutex<i64>;
    let mut _5: bool;
    let _7: std::sync::MutexGuard<'_, i64>;

    bb0: {
        _7 = std::sync::Mutex::<i64>::lock(copy _2) -> [return: bb1, unwind: bb3];
    }

    bb1: {
        _5 = balanced(const 7_i64) -> [return: bb2, unwind: bb3];
    }

    bb2: {
        drop(_7) -> [return: bb4, unwind: bb3];
    }

    bb3 (cleanup): {
        resume;
    }

    bb4: {
        return;
    }
}
"""

#: A counter behind a mutex, with a helper function, a branch, a loop and cleanup blocks.
COUNTER = """
fn bump(_1: &std::sync::Mutex<u64>) -> u64 {
    let mut _0: u64;
    let mut _2: std::result::Result<std::sync::MutexGuard<'_, u64>, std::sync::PoisonError<std::sync::MutexGuard<'_, u64>>>;
    let mut _3: std::sync::MutexGuard<'_, u64>;
    scope 1 {
        debug guard => _3;
    }

    bb0: {
        _2 = std::sync::Mutex::<u64>::lock(copy _1) -> [return: bb1, unwind continue];
    }

    bb1: {
        _3 = Result::<std::sync::MutexGuard<'_, u64>, PoisonError<std::sync::MutexGuard<'_, u64>>>::expect(move _2, const "poisoned") -> [return: bb2, unwind: bb4];
    }

    bb2: {
        drop(_3) -> [return: bb3, unwind continue];
    }

    bb3: {
        return;
    }

    bb4 (cleanup): {
        resume;
    }
}

fn main() -> () {
    let _1: std::sync::Mutex<u64>;
    let mut _4: &std::sync::Mutex<u64>;
    let mut _5: bool;

    bb0: {
        _1 = std::sync::Mutex::<u64>::new(const 0_u64) -> [return: bb1, unwind continue];
    }

    bb1: {
        _4 = &_1;
        _6 = bump(copy _4) -> [return: bb2, unwind: bb5];
    }

    bb2: {
        switchInt(move _5) -> [0: bb3, otherwise: bb4];
    }

    bb3: {
        goto -> bb1;
    }

    bb4: {
        return;
    }

    bb5 (cleanup): {
        resume;
    }
}
"""
PROGRAMS = [("ledger.mir", LEDGER), ("counter.mir", COUNTER)]

FUNCTIONS = ["std::thread::spawn", "std::thread::Builder::spawn", "std::thread::JoinHandle::<()>::join", "std::thread::JoinHandle::join", "std::thread::scoped::scope::spawn", "std::thread::scoped::ScopedJoinHandle::join", "crossbeam::scope::Scope::spawn", "rayon_core::join", "rayon::join", "rayon::spawn", "tokio::task::spawn", "tokio::runtime::Runtime::spawn", "tokio::task::JoinHandle::await", "smol::spawn", "app::worker::run", "std::sync::atomic::AtomicUsize::load", "std::sync::atomic::AtomicUsize::store", "std::sync::atomic::AtomicBool::compare_exchange", "std::sync::atomic::AtomicU64::fetch_add", "std::sync::atomic::AtomicU64::swap", "std::sync::Condvar::notify_one", "std::sync::Condvar::wait", "std::sync::mpsc::Sender::send", "std::sync::mpsc::Receiver::recv", "app::config::_::serde::Deserialize::deserialize", "app::types::Point::fmt::Debug", "app::types::<Point as std::fmt::Debug>::fmt::inner", "app::tests::works", "lib::util::visit_seq", "app::net::Visitor::visit_map"]
TYPES = ["std::sync::MutexGuard<'_, i32>", "std::sync::RwLockReadGuard<'_, i32>", "std::sync::RwLockWriteGuard<'_, i32>", "lock_api::mutex::MutexGuard<R, T>", "parking_lot::RwLockReadGuard<T>", "spin::mutex::MutexGuard<T>", "spin::RwLockWriteGuard<T>", "tokio::sync::MutexGuard<T>", "async_lock::RwLockReadGuard<T>", "std::vec::Vec<std::sync::MutexGuard<i32>>", "std::sync::mpsc::Sender<i32>", "std::sync::mpsc::SyncSender<i32>", "std::sync::mpsc::Receiver<i32>", "std::string::String", "*mut i32", "*const u8", "&mut i32"]

#: A program as locals, call sites and statements, of which each call is dispatched another way.
APP = {
    "functions": ("net_id string, func string", [("app", "main"), ("app", "app::work"), ("app", "app::helper")]),
    "locals": ("net_id string, func string, local string, ty string", [
        ("app", "main", "_1", "std::sync::Arc<std::sync::Mutex<i32>>"), ("app", "main", "_2", "{closure@app::work}"), ("app", "main", "_3", "std::thread::JoinHandle<()>"), ("app", "main", "_8", "std::sync::Condvar"),
        ("app", "app::work", "_4", "std::sync::MutexGuard<'_, i32>"), ("app", "app::work", "_5", "parking_lot::RwLockWriteGuard<'_, u8>"), ("app", "app::work", "_6", "std::sync::mpsc::Sender<u32>"), ("app", "app::work", "_7", "tokio::sync::MutexGuard<'_, i32>"), ("app", "app::work", "_9", "std::sync::mpsc::Receiver<u32>"),
        ("app", "app::work", "_20", "std::result::Result<std::sync::MutexGuard<'_, i32>, std::sync::PoisonError<std::sync::MutexGuard<'_, i32>>>"), ("app", "app::work", "_21", "std::sync::MutexGuard<'_, i32>"),
    ]),
    "owners": ("net_id string, func string, local string, res string", [("app", "main", "_8", "C"), ("app", "app::work", "_4", "A"), ("app", "app::work", "_5", "R"), ("app", "app::work", "_6", "ch"), ("app", "app::work", "_9", "ch"), ("app", "app::work", "_1", "flag"), ("app", "main", "_4", "A"), ("app", "app::work", "_21", "A")]),
    "sites": ("net_id string, func string, bb int, target int, name string, args array<string>, dest string, span string", [
        ("app", "main", 0, 1, "std::thread::spawn", ["move _2"], "_3", "m:0"), ("app", "main", 1, 2, "app::helper", ["copy _1"], "_9", "m:1"), ("app", "main", 2, 3, "std::sync::Condvar::notify_one", ["copy _8"], "_10", "m:2"),
        ("app", "main", 3, 4, "std::thread::JoinHandle::join", ["move _3"], "_11", "m:3"), ("app", "main", 4, 5, None, ["copy _1"], "_12", "m:4"), ("app", "main", 5, None, "core::panicking::panic", ["const 1"], "_13", "m:5"),
        ("app", "main", 6, 7, "rayon::join", ["move _2", "const app::helper"], "_14", "m:6"),
        ("app", "app::work", 0, 1, "std::sync::Mutex::<i32>::lock", ["copy _1"], "_4", "w:0"), ("app", "app::work", 1, 2, "parking_lot::RwLock::write", ["copy _2"], "_5", "w:1"), ("app", "app::work", 2, 3, "std::sync::mpsc::Sender::send", ["copy _6", "const 1"], "_10", "w:2"),
        ("app", "app::work", 3, 4, "std::sync::atomic::AtomicUsize::store", ["copy _1", "const 7", "Ordering::Release"], "_11", "w:3"), ("app", "app::work", 4, 5, "std::sync::atomic::AtomicUsize::load", ["copy _1", "Ordering::Relaxed"], "_12", "w:4"),
        ("app", "app::work", 5, 6, "std::mem::drop", ["move _4"], "_13", "w:5"), ("app", "app::work", 6, 7, "std::mem::drop", ["move _5"], "_14", "w:6"), ("app", "app::work", 7, 8, "std::mem::drop", ["move _6"], "_15", "w:7"), ("app", "app::work", 8, 9, "app::unknown", [], "_16", "w:8"),
        ("app", "app::work", 9, 10, "std::sync::mpsc::Receiver::recv", ["copy _9"], "_17", "w:9"),
        ("app", "app::work", 10, 11, "std::sync::Mutex::<i32>::lock", ["copy _1"], "_20", "w:10"), ("app", "app::work", 11, 12, "std::result::Result::<T, E>::unwrap", ["move _20"], "_21", "w:11"), ("app", "app::work", 12, None, "std::process::exit", ["const 1"], "_22", "w:12"),
    ]),
    "statements": ("net_id string, func string, bb int, seq int, local string, deref boolean, raw boolean, write boolean, span string", [("app", "app::helper", 0, 0, "_1", True, True, False, "h:0"), ("app", "app::helper", 0, 1, "_1", True, True, True, "h:1"), ("app", "app::helper", 1, 0, "_2", True, False, True, "h:2"), ("app", "app::helper", 2, 0, "_1", False, True, True, "h:3")]),
}
