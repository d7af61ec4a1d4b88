"""Names of functions and types as CASE expressions.  Each takes and gives columns; null means none of the classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of function paths, substrings that exclude a function, and allowed orderings.
THREAD_SPAWN = [r"std::thread[:a-zA-Z0-9_#\{\}]*::spawn", "tokio::task::spawn", "tokio::runtime::Runtime::spawn", "async_std::task::spawn", "smol::Task::spawn", "smol::spawn", "rayon::spawn"]
THREAD_JOIN = [r"std::thread[:a-zA-Z0-9_#\{\}]*::join", "std::thread::JoinHandle::try_join", "tokio::task::JoinHandle::await", "tokio::task::JoinHandle::blocking_on"]
SCOPE_SPAWN = [r"std::thread::scoped[:a-zA-Z0-9_#\{\}]*::spawn", "std::thread::scope::Scope::spawn", "crossbeam::scope::Scope::spawn", "rayon::scope::Scope::spawn"]
SCOPE_JOIN = [r"std::thread::scoped[:a-zA-Z0-9_#\{\}]*::join", "std::thread::scope::Scope::join", "crossbeam::scope::Scope::join", "rayon::scope::Scope::join"]
CONDVAR_NOTIFY = [r"condvar[:a-zA-Z0-9_#\{\}]*::notify"]
CONDVAR_WAIT = [r"condvar[:a-zA-Z0-9_#\{\}]*::wait"]
CHANNEL_SEND = [r"mpsc[:a-zA-Z0-9_#\{\}]*::send"]
CHANNEL_RECV = [r"mpsc[:a-zA-Z0-9_#\{\}]*::recv"]
ATOMIC_LOAD = ["atomic[:a-zA-Z0-9]*::load"]
ATOMIC_STORE = ["atomic[:a-zA-Z0-9]*::store"]
IGNORED = ["::serialize", "::serialize_", "::deserialize", "::deserialize_", "::serde", "::serde_json", "::serde_yaml", "::serde_with", "::__serde", "::__private", "::Serializer::", "::Deserializer::", "::Serialize::", "::Deserialize::", "::visit_", "::Visitor::visit", "::fmt::", "::Debug::fmt", "::core::fmt", "::alloc::fmt", "::tests::", "::test::", "::bench"]
SERIALIZATION = ["::deserialize", "::serialize", "::visit_seq", "::visit_map"]
RAYON_JOIN = ["rayon_core::join", "rayon::join"]
ASYNC_SPAWN = ["tokio::task::spawn", "tokio::runtime::Runtime::spawn"]
RMW = ["::compare_exchange", "::fetch_add", "::fetch_sub", "::fetch_and", "::fetch_or", "::fetch_xor", "::swap"]
FOREIGN_RUNTIMES = ["async", "tokio", "future", "loom"]
ORDERINGS = ["Relaxed", "Release", "Acquire", "AcqRel", "SeqCst"]
ALLOWED_STORES = {"Relaxed": ["Relaxed", "Release", "Acquire", "AcqRel", "SeqCst"], "Acquire": ["Release", "AcqRel", "SeqCst"], "SeqCst": ["SeqCst"], "AcqRel": ["AcqRel", "SeqCst"], "Release": []}
ALIAS_RANK = {"Unknown": 0, "Unlikely": 1, "Possibly": 2, "Probably": 3}


def any_of(patterns: list[str]) -> str:
    """One pattern for several; without any it matches the empty text alone."""
    return "|".join(f"(?:{p})" for p in patterns) if patterns else "^$"


def has_any(name: Column, parts: list[str]) -> Column:
    """If ``name`` contains one of the parts."""
    return name.rlike("|".join(re.escape(p) for p in parts)) if parts else F.lit(False)


def thread_control(name: Column, flags: dict[str, Column] | None = None, patterns: dict[str, list[str]] | None = None) -> Column:
    """spawn, join, scope_spawn, scope_join, rayon_join, async_spawn, async_join.  ``flags``: boolean columns that come before any pattern."""
    p = {"scope_spawn": SCOPE_SPAWN, "scope_join": SCOPE_JOIN, "spawn": THREAD_SPAWN, "join": THREAD_JOIN} | (patterns or {})
    out = F
    for kind in ("spawn", "join", "scope_spawn", "scope_join", "rayon_join"):
        if flags and kind in flags:
            out = out.when(flags[kind], kind)
    out = out.when(has_any(name, RAYON_JOIN), "rayon_join").when(name.rlike(any_of(p["scope_spawn"])), "scope_spawn").when(name.rlike(any_of(p["scope_join"])), "scope_join")
    out = out.when(has_any(name, ASYNC_SPAWN), "async_spawn").when(name.contains("tokio::task::JoinHandle") & has_any(name, ["await", "blocking_on"]), "async_join")
    return out.when(name.rlike(any_of(p["spawn"])), "spawn").when(name.rlike(any_of(p["join"])), "join")


def lock_guard(type_path: Column) -> Column:
    """{Std,ParkingLot,Spin}{Mutex,Read,Write} of a guard type; null for asynchronous guards and other types."""
    head = F.substring_index(type_path, "<", 1)
    kind = F.when(head.contains("MutexGuard"), "Mutex").when(head.contains("RwLockReadGuard"), "Read").when(head.contains("RwLockWriteGuard"), "Write")
    maker = F.when(head.contains("spin"), "Spin").when(has_any(head, ["lock_api", "parking_lot"]), "ParkingLot").otherwise("Std")
    return F.when(~has_any(head, FOREIGN_RUNTIMES), F.concat(maker, kind))


def channel_endpoint(type_path: Column) -> Column:
    """mpsc.sender, mpsc.receiver or sync.sender."""
    at = lambda p: type_path.startswith(f"std::sync::mpsc::{p}")
    return F.when(at("Sender"), "mpsc.sender").when(at("Receiver"), "mpsc.receiver").when(at("SyncSender"), "sync.sender")


def atomic_api(name: Column) -> Column:
    """read, write or read_write."""
    return F.when(name.contains("::load"), "read").when(name.contains("::store"), "write").when(has_any(name, RMW), "read_write")


def ordering_argument(name: Column, n_args: Column) -> Column:
    """The place of the ordering among an atomic call's arguments."""
    api = atomic_api(name)
    return F.when(api == "read", F.lit(1)).when(api == "write", F.lit(2)).when(api == "read_write", n_args - 1)


def memory_ordering(code: Column) -> Column:
    """The ordering of a code from 0; any other code is the strictest."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(o) for o in ORDERINGS]), F.when(code >= 0, code.cast("int") + 1)), F.lit("SeqCst"))


def synchronization(name: Column) -> Column:
    """condvar_notify, condvar_wait, channel_send, channel_recv, atomic_load or atomic_store, on the path in lower case for the first four."""
    low = F.lower(name)
    return F.when(low.rlike(any_of(CONDVAR_NOTIFY)), "condvar_notify").when(low.rlike(any_of(CONDVAR_WAIT)), "condvar_wait").when(low.rlike(any_of(CHANNEL_SEND)), "channel_send").when(low.rlike(any_of(CHANNEL_RECV)), "channel_recv").when(low.rlike(any_of(ATOMIC_LOAD)), "atomic_load").when(low.rlike(any_of(ATOMIC_STORE)), "atomic_store")


def ignored(name: Column) -> Column:
    """Functions of serialization, formatting and tests."""
    return has_any(name, IGNORED)


def in_crates(name: Column, crate: str, white: list[str] = (), black: list[str] = ()) -> Column:
    """With a white list, names that start with one of it; else those of the crate; never those that start with one of the black list."""
    starts = lambda some: F.lit(False) if not some else F.greatest(F.lit(False), *[name.startswith(p) for p in some])
    return (starts(list(white)) if white else name.startswith(crate)) & ~starts(list(black))


def may_alias(kind: Column, conservative: bool = False) -> Column:
    """Probably and Possibly do, Unlikely doesn't, Unknown does under the conservative policy."""
    return F.when(kind.isin("Probably", "Possibly"), True).when(kind == "Unlikely", False).when(kind == "Unknown", F.lit(conservative))


def constant_index(projection: Column) -> Column:
    """The last constant index of a projection such as [field.1, const[3]]; none where an index is dynamic."""
    constants = F.filter(projection, lambda p: p.rlike(r"^const\[\d+\]$"))
    return F.when(~F.exists(projection, lambda p: p.rlike(r"^index\[")), F.regexp_extract(F.try_element_at(constants, F.lit(-1)), r"\d+", 0).cast("long"))


def index_alias(local_a: Column, index_a: Column, local_b: Column, index_b: Column) -> Column:
    """Two elements of one local: the same constant index probably, different ones unlikely, two without index probably; else null."""
    same = local_a == local_b
    return F.when(same & index_a.isNotNull() & index_b.isNotNull(), F.when(index_a == index_b, "Probably").otherwise("Unlikely")).when(same & index_a.isNull() & index_b.isNull(), "Probably")


def recognizers(name: Column) -> dict[str, Column]:
    """Flags of the calls that alias analysis treats on their own."""
    return {
        "is_rc_clone": has_any(name, ["Arc", "Rc"]) & name.contains("clone"),
        "is_ptr_read": name.contains("ptr::read"),
        "is_index": name.rlike(r"::index(_mut)?$"),
        "is_atomic_ptr_store": name.rlike(r"^(std|core)::sync::atomic::AtomicPtr(::<.*>)?::store$"),
    }


def raw_pointer(type_name: Column) -> Column:
    return type_name.rlike(r"^\*(const|mut) ")


def def_path(text: Column) -> Column:
    """A path without the numbers of crates and items, such as ``[0c1d]`` and ``#0``."""
    return F.regexp_replace(text, r"\[[0-9a-f]+\]|#\d+", "")


def local_of(operand: Column) -> Column:
    """The local that an operand such as ``move _4`` or ``copy _4.0`` names; null for constants and what is in parentheses."""
    bare = F.trim(F.replace(F.replace(F.trim(operand), F.lit("move "), F.lit("")), F.lit("copy "), F.lit("")))
    return F.nullif(F.regexp_extract(bare, "^_[0-9]+", 0), F.lit(""))


def first_local(arguments: Column) -> Column:
    """The first local of an argument list, such as ``_4`` of ``move _4, const 1``; null without one."""
    named = F.filter(F.transform(F.split(arguments, ","), local_of), lambda x: x.isNotNull())
    return F.try_element_at(named, F.lit(1))
