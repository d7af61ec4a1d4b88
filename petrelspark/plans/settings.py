"""Settings of an analysis, from a TOML file or defaults, and the stages it may stop after."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from petrelspark.functions import classify

STAGES = ("facts", "callgraph", "net", "reduce", "pointsto", "stategraph", "detect")
MODES = ("deadlock", "datarace", "atomic", "all", "pointsto")


@dataclass
class Settings:
    """``state_limit`` 0 or less: none.  The lists are patterns of function paths."""

    entry_reachable: bool = True
    concurrent_roots: bool = True
    reduce_net: bool = True
    por: bool = False
    state_limit: int = 50_000
    coverability_limit: int = 10_000
    search_states: int = 200_000
    search_depth: int = 10_000
    conservative_alias: bool = False
    crate_white_list: list[str] = field(default_factory=list)
    crate_black_list: list[str] = field(default_factory=list)
    thread_spawn: list[str] = field(default_factory=lambda: list(classify.THREAD_SPAWN))
    thread_join: list[str] = field(default_factory=lambda: list(classify.THREAD_JOIN))
    scope_spawn: list[str] = field(default_factory=lambda: list(classify.SCOPE_SPAWN))
    scope_join: list[str] = field(default_factory=lambda: list(classify.SCOPE_JOIN))

    @staticmethod
    def load(path: str) -> Settings:
        """The file's settings over the defaults; the defaults alone where there is no such file.  Unknown names are an error."""
        p = Path(path)
        given = tomllib.loads(p.read_text()) if p.exists() else {}
        if unknown := set(given) - {f.name for f in fields(Settings)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Settings(**given)

    @property
    def limit(self) -> int | None:
        return self.state_limit if self.state_limit > 0 else None


def goes_past(until: str | None, stage: str) -> bool:
    """If an analysis that stops after ``until`` goes on after ``stage``."""
    return until is None or STAGES.index(stage) < STAGES.index(until)


def crate_name(arguments: list[str]) -> str | None:
    """The crate that a compiler's command line names: ``--crate-name``, else the stem of its first source."""
    for k, x in enumerate(arguments):
        if x == "--crate-name" and k + 1 < len(arguments):
            return arguments[k + 1]
        if x.startswith("--crate-name="):
            return x.partition("=")[2]
    sources = [Path(x).stem for x in arguments if x.endswith(".rs")]
    return sources[0] if sources else None
