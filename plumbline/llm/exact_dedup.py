"""Exact deduplication by skew-safe combining of full contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, keyed, salted, table

#: Ranks pack (code points, id) into one decimal; ids take the low 20 digits.
_ID_SPAN, _ID_TOP = "100000000000000000000", "9223372036854775808"


def _whole(digits: str) -> Column:
    return F.lit(digits).cast("decimal(38,0)")


def _rank(n_chars: Column, id_col: Column) -> Column:
    """Larger for more code points, then for a smaller id; a null id comes last."""
    below = _whole(_ID_TOP) - F.coalesce(id_col.cast("decimal(38,0)"), _whole(_ID_TOP))
    return (n_chars.cast("decimal(15,0)") * F.lit(_ID_SPAN).cast("decimal(21,0)") + below.cast("decimal(20,0)")).cast("decimal(38,0)")


def _normal(df: DataFrame, id_col: str, text_col: str, *more: str | Column) -> DataFrame:
    """doc_id, n_chars, norm and digest of each row, and the columns of `more`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *more)
    more = rows.columns[2:]
    return rows.select("doc_id", F.length("text").alias("n_chars"), F.regexp_replace("text", SPACE, "").alias("norm"), *more).withColumn("digest", F.sha2("norm", 256))


def _key() -> list[Column]:
    """The digest, a second hash and the length: they stand for contents compared before."""
    return [F.col("digest"), F.xxhash64("norm").alias("h"), F.length("norm").alias("n_norm")]


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """Group rows whose texts are equal once white space is deleted.

    Three combining steps: map-side partial aggregates within each input
    partition, groups salted by row, and the salts' winners globally. The
    normalised text itself is a grouping key of every step, so full contents are
    compared; the digest only spreads the rows. A group of any size leaves at most
    one row per (input partition, salt) and then one per salt. The winner goes back to the
    group's salts, and rows meet it there: no task gets more than a salt's rows.

    Returns doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Defined cases: a null text counts as empty, and all empty or blank texts are
    one group; a null id is kept only where no row of its group with as many code
    points has an id; rows that repeat an id and tie in length are all kept=true if that id is
    the winner; an empty table gives no rows; other columns are ignored.
    """
    rows = _normal(keyed(df), id_col, text_col, F.pmod("_row", F.lit(salts)).alias("salt"))
    local = rows.select("digest", "norm", "salt", _rank(F.col("n_chars"), F.col("doc_id")).alias("rank"))
    final = salted(local, ["digest", "norm"], "salt", {"rank": (F.max("rank"), F.max("rank")), "group_size": (F.count("*"), F.sum("group_size"))})
    low = F.pmod(F.col("rank"), _whole(_ID_SPAN))
    winners = final.select(
        *_key(),
        "salt",
        F.when(low > 0, (_whole(_ID_TOP) - low).cast("long")).alias("keep_id"),
        ((F.col("rank") - low) / _whole(_ID_SPAN)).cast("long").alias("keep_chars"),
        "group_size",
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    joined = rows.select("doc_id", "n_chars", "salt", *_key()).join(winners, ["digest", "h", "n_norm", "salt"])
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """df with one row of each group of exact_dedup(), by the same rank; columns as they were.

    Rows are told apart by keyed(), so a group leaves one row whether its ids are null,
    repeated or neither; of rows that tie in length and id any one is left.
    """
    docs = keyed(df)
    rows = _normal(docs, id_col, text_col, "_row")
    local = rows.select("digest", "norm", F.pmod("_row", F.lit(salts)).alias("salt"), "_row", _rank(F.col("n_chars"), F.col("doc_id")).alias("rank"))
    part = local.groupBy("digest", "norm", "salt").agg(F.max_by("_row", "rank").alias("_row"), F.max("rank").alias("rank"))
    keep = part.groupBy("digest", "norm").agg(F.max_by("_row", "rank").alias("_row")).select("_row")
    return docs.join(keep, "_row", "left_semi").select(*df.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: exact_dedup() of documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS r,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
