"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch counts values by bucket: a whole number's bucket is the number with only its ten leading bits kept, so quantiles
are exact below 1,024 and within one part in 512 above.  Sketches are tables of counts, so they merge by adding: those of each
(language, source) make those of each language, and those the sketch of the corpus.

Rates are in millionths and smoothed by one occurrence (and by some lines more, as texts have few), which is what a text of
that length cannot tell from none; so they are never 0, and ratios of quantiles say how far a group's own texts spread.  For
each measure a document fails above ``q75 * (q75 / q50) ** reach`` of its group or, for measures with a lower side, below
``q25 * (q25 / q50) ** reach``: Tukey's fences in logarithms.  There are no fixed bounds.  A group's quantiles are drawn
towards those of its language, and a language's towards those of the corpus, as if ``support`` documents more had them.  The
thresholds join the documents' measures, and the filter compares a value's bucket with them.

Defined results: words are maximal runs of other characters than space and U+0009 to U+000D.  A null text is empty: no
words, and the fixed base rule fails it.  A null language or source is a value like any other.  Repeated rows are counted
and judged each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrelspark.llm import words
from petrelspark.llm.columns import as_bytes, small_batches, texts
from petrelspark.staging import stage

#: The measures in millionths: SQL for the value, and the reach of the lower fence (none: no lower side) and of the upper one.
MEASURES = {
    "word_length": ("word_chars * 1000000 div greatest(n_words, 1)", 8, 5),
    "symbol_rate": ("(n_symbols + 1) * 1000000 div (n_words + 1)", None, 4),
    "repeat_rate": ("(n_repeat_words + 1) * 1000000 div (n_words + 1)", None, 3),
    "dup_line_rate": ("(n_dup_lines + 1) * 1000000 div (n_lines + 8)", None, 4),
}
Measures = dict[str, tuple[str, int | None, int]]
_SYMBOLS = b"#*$%&|<>"
#: (language, source) groups up to which their thresholds are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 10_000


def _repeated(h: np.ndarray) -> int:
    """Words of windows of three that occur twice or more; ``h``: the words' hashes."""
    n = len(h) - 2
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        w = h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            column = batch.column("text")
            hashed: list[list[np.ndarray]] = [[] for _ in range(len(column))]
            for numbers, data, text_ends in words.pieces(column):
                starts, ends, counts = words.split(data, text_ends)
                own, tops = words.hashes(data, starts, ends), np.cumsum(counts)
                for k, a, b in zip(numbers, (tops - counts).tolist(), tops.tolist(), strict=True):
                    hashed[k].append(own[a:b])
            rows = []
            for t, parts, chars in zip(as_bytes(column), hashed, pc.fill_null(pc.utf8_length(column), 0).to_pylist(), strict=True):
                h = parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])
                lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                spaces = len(t) - len(t.translate(None, b" \t\n\x0b\x0c\r"))
                rows.append((len(h), chars - spaces, len(t) - len(t.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), _repeated(h)))
            counts = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(counts[:, k]) for k in range(6)], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])

    return docs.mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def bucket(value: str) -> str:
    """SQL: the number with only its ten leading bits kept."""
    low = f"greatest(length(bin({value})) - 10, 0)"
    return f"shiftleft(shiftright(({value}), {low}), {low})"


def sketches(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """The sketch of each measure, a column of buckets, in each group: (by..., measure, bucket, n)."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures]))
    return rows.select(*by, values.alias("v")).select(*by, "v.measure", F.col("v.value").alias("bucket")).groupBy(*by, "measure", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., measure, n, q25, q50, q75): the least bucket with that share of the group's count at or below it.

    A group's sketch has 512 rows for each doubling of the values at most, so a window over it is bounded."""
    keys = ", ".join(f"`{b}`" for b in [*by, "measure"])
    run = sketch.selectExpr("*", f"sum(n) over (partition by {keys} order by bucket) as upto", f"sum(n) over (partition by {keys}) as total")
    least = [F.min(F.expr(f"case when 100 * upto >= {q} * total then greatest(bucket, 1) end")).cast("double").alias(f"q{q}") for q in (25, 50, 75)]
    return run.groupBy(*by, "measure").agg(F.max("total").alias("n"), *least)


def drawn(own: DataFrame, wider: DataFrame, on: list[str], support: int) -> DataFrame:
    """``own`` with its quantiles drawn towards those of the wider group that has the same ``on`` and measure."""
    w = wider.select(*[F.col(c).alias(f"of_{c}") for c in [*on, "measure", "q25", "q50", "q75"]])
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in [*on, "measure"]]
    q = {f"q{k}": (F.col("n") * F.col(f"q{k}") + support * F.col(f"of_q{k}")) / (F.col("n") + support) for k in (25, 50, 75)}
    return own.join(w, reduce(lambda a, b: a & b, same)).select(*[q[c].alias(c) if c in q else F.col(c) for c in own.columns])


def thresholds(rows: DataFrame, measures: Measures, support: int) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high): one row for each group."""
    fine = stage(sketches(rows, ["lang", "source"], list(measures)), "sketch")
    wide = merged(fine, ["lang"])
    own, lang, every = (quartiles(s, by) for s, by in ((fine, ["lang", "source"]), (wide, ["lang"]), (merged(wide, []), [])))
    chosen = drawn(own, drawn(lang, F.broadcast(every), [], support), ["lang"], support)  # ``every`` has a row for each measure

    def fence(m: str, q: str, reach: int | None) -> Column:
        power = reduce(lambda x, _: x * (F.col(q) / F.col("q50")), range(reach or 0), F.col(q))
        return F.max(F.when((F.col("measure") == m) & F.lit(reach is not None), power))

    fences = [f for m, (_, low, high) in measures.items() for f in (fence(m, "q25", low).alias(f"{m}_low"), fence(m, "q75", high).alias(f"{m}_high"))]
    return chosen.groupBy("lang", "source").agg(*fences)


def adaptive_quality(docs: DataFrame, support: int = 50, measures: Measures = MEASURES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept and failed (the measures that failed, or null)."""
    rows = stage(measured(texts(docs, "lang", "source", id_col=id_col, text_col=text_col).withColumns({"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")})), "measures")
    rows = rows.withColumns({m: F.expr(bucket(sql)) for m, (sql, _, _) in measures.items()})
    limits = stage(thresholds(rows, measures, support), "thresholds").withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    judged = rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")))
    fails = [F.when((F.col(m) > F.col(f"{m}_high")) | (F.col(m) < F.col(f"{m}_low") if low is not None else F.lit(False)), F.lit(m)) for m, (_, low, _) in measures.items()]
    base = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(base).alias("base_failed"), F.nullif(F.concat_ws(",", *fails), F.lit("")).alias("failed")).withColumn("kept", ~F.col("base_failed") & F.col("failed").isNull())
