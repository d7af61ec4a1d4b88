"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are grouped by (length, hash of a prefix) of the normalised text; the full content is hashed only for rows
whose group has company.  The surviving groups are told by a bitmap of bounded size (``marks``), so that neither texts nor
unbounded key sets move: a set bit may be a false alarm, which costs one needless hash and nothing else, since the full
hash decides.

Defined results: a null text is an empty text, and all empty texts are equal.  Of equal texts the row with the most
code points in the original text stays, then the smallest id; a null id is larger than any other.  Of rows that are equal
in both one stays, so that each group keeps exactly one row.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrelspark.llm import marks
from petrelspark.llm.columns import SPACES, texts, with_groups
from petrelspark.staging import stage


def squeezed(text: Column) -> Column:
    """The text without spaces and U+0009 to U+000D."""
    return reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), SPACES, text)


def prefix_key(norm: Column, prefix_chars: int) -> Column:
    """Length and prefix of a normalised text in one 64-bit hash."""
    return F.xxhash64(F.octet_length(norm), F.substring(norm, 1, prefix_chars))


def survivors(keys: DataFrame) -> tuple[DataFrame, int]:
    """The bitmap of the prefix keys (``key``) that two rows or more have, and its bits."""
    company = stage(keys.groupBy("key").count().where("count > 1").select("key"), "company")
    bits = marks.bits_for(company.count())
    return stage(marks.bitmap(company, F.col("key"), bits), "survivors"), bits


def refined(docs: DataFrame, prefix_chars: int = 256, hash_all: bool = False) -> DataFrame:
    """(doc_id, n, shared, text_sha256, at) of each row: its code points, if its group survived, the digest of the whole normalised text, and a number that no other row has.

    The digest is computed for surviving rows, in a second scan of the texts; with ``hash_all`` for every row, in the first."""
    norm, at = squeezed(F.col("text")), F.monotonically_increasing_id().alias("at")
    slim = docs.select("doc_id", F.length("text").alias("n"), "text", norm.alias("norm"))
    key = prefix_key(F.col("norm"), prefix_chars).alias("key")
    if hash_all:
        rows = stage(slim.select("doc_id", "n", key, F.sha2("norm", 256).alias("text_sha256"), at), "digests")
        found, bits = survivors(rows.select("key"))
        return marks.marked(rows, F.col("key"), found, bits, "shared")
    found, bits = survivors(slim.select(key))
    flagged = marks.marked(slim.select("doc_id", "n", "norm", key), F.col("key"), found, bits, "shared")
    return stage(flagged.select("doc_id", "n", "shared", F.when(F.col("shared"), F.sha2("norm", 256)).alias("text_sha256"), at), "refined")


def exact_groups(docs: DataFrame, prefix_chars: int = 256, hash_all: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (null where no hash was needed).

    Copies are counted with partial sums before the shuffle; the rows of very large groups get their group by broadcast."""
    rows = refined(texts(docs, id_col=id_col, text_col=text_col), prefix_chars, hash_all)
    # a larger id is a smaller complement, and the complement of no id runs over
    best = F.max_by(F.struct("doc_id", "at"), F.struct("n", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"), F.bitwise_not("at")))
    groups = stage(rows.where("shared").groupBy(F.col("text_sha256").alias("of")).agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    alone = rows.where("not shared").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    many = with_groups(rows.where("shared").drop("shared"), groups, "text_sha256", "of", "group_size", total)
    return alone.unionByName(many.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("best.at")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, prefix_chars: int = 256) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.  Rows proved alone do not move at all."""
    rows = docs.select(F.struct("*").alias("row"), squeezed(F.coalesce("text", F.lit(""))).alias("norm"))
    rows = rows.withColumn("key", prefix_key(F.col("norm"), prefix_chars))
    found, bits = survivors(rows.select("key"))
    flagged = marks.marked(rows, F.col("key"), found, bits, "shared")
    text, id_ = F.coalesce("row.text", F.lit("")), F.col("row.doc_id")
    best = F.max_by("row", F.struct(F.length(text), id_.isNotNull(), F.bitwise_not(id_.cast("long")), F.xxhash64(F.to_json("row"))))  # as JSON: a hash refuses maps
    many = flagged.where("shared").groupBy(F.sha2("norm", 256).alias("digest")).agg(best.alias("row"))
    return flagged.where("not shared").select("row.*").unionByName(many.select("row.*"))
