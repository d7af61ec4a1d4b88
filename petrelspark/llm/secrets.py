"""Secret scans with multipart linking.

Base findings are reported as they are: assigned secrets, access keys and long hexadecimal runs.  Weaker parts of a credential
(an access identifier, a secret that is only plausible, an endpoint) are reported only where a secret, found or plausible, stands
together with an identifier or an endpoint: within one scope, a run of lines without an empty line between, and within
``reach`` characters.  Parts of a text are sorted by place, and the interval join is a sweep over them in both directions, so
its cost grows with the parts and not with their pairs.

Defined results: an empty table gives an empty result; a null text is empty and has no finding.  Places are code points, the end exclusive.  Of one kind findings
do not overlap; those of different kinds may.  Texts are scanned whole.  Rows that repeat an id are scanned each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from petrelspark.llm.columns import in_place, small_batches, texts

Span = tuple[int, int, str]

#: Fixed patterns of the base kinds, in the order in which findings at one place are listed.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weaker parts, of any length: an access identifier, an endpoint, the password inside an endpoint, a value under a name that passwords have, and a
#: plausible secret.  Names may stand at the end of a longer one (``DB_USER``), and any run of blanks around ``=`` or ``:``.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account|access_?key(?:_?id)?)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b(?:https?|ftp|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|rediss?|amqps?|ldaps?|smtps?)://[^\s"'<>]{3,}""", re.ASCII)
USERINFO = re.compile(r"""(?<=://)[^\s"'<>/:@]*:([^\s"'<>/@]+)@""", re.ASCII)
NAMED = re.compile(r"""(?<![A-Za-z0-9])(?:pass|pwd|pass(?:phrase|code)|(?:access|secret|private|account|shared)_?(?:access_?)?key|auth|credentials?)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{6,})""", re.IGNORECASE | re.ASCII)
PLAUSIBLE = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
#: The roles that weak kinds and base kinds play in a credential.
ROLE = {"identifier": "who", "access": "who", "plausible": "what", "assign": "what", "hex": "what", "named": "what", "userinfo": "what", "endpoint": "where"}
ORDER = {k: n for n, k in enumerate((*BASE, "identifier", "named", "plausible", "endpoint", "userinfo"))}
_EMPTY_LINE = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[Span]:
    """The base findings by start, then kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def _looks_random(s: str) -> bool:
    """Digits, capitals and small letters mixed: not a word, a number or a constant's name."""
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def weak_parts(text: str) -> list[Span]:
    """What may be part of a credential, whether or not another part is near; of two secrets at one place the first in ``ORDER`` stands."""
    urls = "://" in text
    out = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if urls else []
    out += [(m.start(1), m.end(1), "userinfo") for m in USERINFO.finditer(text)] if urls else []
    secrets: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text) if not ACCESS.fullmatch(m[1])]
        secrets = [(m.start(1), m.end(1), "named") for m in NAMED.finditer(text) if not m[1].startswith("AKIA")]
    ends = [s[1] for s in secrets]
    for m in PLAUSIBLE.finditer(text):
        if _looks_random(m[0]):
            k = bisect_right(ends, m.start())
            if k == len(secrets) or secrets[k][0] >= m.end():
                out.append((m.start(), m.end(), "plausible"))
    return out + secrets


def linked(text: str, base: list[Span], reach: int = 200) -> tuple[list[Span], int]:
    """The weak parts of a credential, of which one part is a secret, and the number of links: each part is linked to the nearest one of another role on either side."""
    weak = weak_parts(text)
    if not weak:
        return [], 0
    covered = sorted(s for s in base)
    starts = [s[0] for s in covered]
    longest = max((s[1] - s[0] for s in covered), default=0)

    def inside(s: Span) -> bool:  # of a base finding of the same role
        k = bisect_left(starts, s[0] - longest)
        while k < len(covered) and covered[k][0] < s[1]:
            if covered[k][1] > s[0] and ROLE[covered[k][2]] == ROLE[s[2]]:
                return True
            k += 1
        return False

    weak = [s for s in weak if not inside(s)]
    parts = sorted([*base, *weak])
    breaks = [m.start() for m in _EMPTY_LINE.finditer(text)] if weak else []
    scope = [bisect_left(breaks, s[0]) for s in parts]
    links: set[tuple[int, int]] = set()
    for order, ahead in ((range(len(parts)), True), (range(len(parts) - 1, -1, -1), False)):
        near: dict[str, int] = {}  # of each role the part met so far that reaches furthest
        for k in order:
            a, b, kind = parts[k]
            for role, o in near.items():
                gap = a - parts[o][1] if ahead else parts[o][0] - b
                if role != ROLE[kind] and "what" in (role, ROLE[kind]) and gap <= reach and scope[o] == scope[k]:
                    links.add((min(k, o), max(k, o)))
            mine = near.get(ROLE[kind])
            if mine is None or not ahead or parts[mine][1] <= b:
                near[ROLE[kind]] = k
    found = {parts[k] for pair in links for k in pair if parts[k][2] not in BASE}
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]])), len(links)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every finding replaced by ``<kind>``; overlapping ones as one, by the name of the first."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], ORDER[s[2]])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of kind, start, end), n_links."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            base, every, links = [], [], []
            for text in batch.column("text").to_pylist():
                b = base_spans(text)
                weak, n = linked(text, b, reach)
                named = [[{"kind": k, "start": x, "end": y} for x, y, k in s] for s in (b, sorted(b + weak, key=lambda s: (s[0], ORDER[s[2]])))]
                base.append(named[0])
                every.append(named[1])
                links.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(every, kind), pa.array(links, pa.int64())], ["doc_id", "base", "spans", "n_links"])

    array = "array<struct<kind:string,start:long,end:long>>"
    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, f"doc_id long, base {array}, spans {array}, n_links long")


def redact(docs: DataFrame, reach: int = 200) -> DataFrame:
    """``docs`` with the findings in ``text`` replaced, and ``n_chars`` (where there is one) set to the new length of changed texts.  No row goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out, lengths = [], {}
            for k, text in enumerate(batch.column("text").to_pylist()):
                b = base_spans(text or "")
                weak, _ = linked(text or "", b, reach)
                out.append(redacted(text, b + weak) if b or weak else text)
                if b or weak:
                    lengths[k] = len(out[-1])
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if lengths:
                columns["text"] = pa.array(out, batch.column("text").type)
                if "n_chars" in columns:
                    n = columns["n_chars"]
                    columns["n_chars"] = pa.array([lengths.get(k, v) for k, v in enumerate(n.to_pylist())], n.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return in_place(docs, run)
