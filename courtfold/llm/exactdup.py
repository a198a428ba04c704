"""Exact dedup by progressive refinement, in DataFrame functions only: by length, then by a prefix's hash, then by the hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import BROADCAST_IDS, joined_by_size, save, whole_number

#: Characters of the normalised text whose hash tells texts of one length apart before whole texts are hashed.
PREFIX = 64
#: Groups with at least 1/HOT of all rows, HOT of them at most, reach their rows by a broadcast, so that no key of the shuffled join has more rows than that.
HOT = 4096
#: The characters that don't count.
WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """A text without white space of ASCII."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _group_sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, and with digest text_sha256 of the normalised text.

    Texts are equal if the same characters remain without white space. Of equal texts the one with the most characters in the original stays, then that with the
    smallest id; ids that aren't whole numbers become null and come last. Of rows that agree in both, one stays. Null texts are empty, and empty ones equal
    each other. Other columns are ignored, whatever their names. An empty table gives an empty result.

    Lengths and prefix hashes are shuffled as counts. Only rows whose length and prefix recur are hashed in full, if the recurring ones fit a broadcast of
    BROADCAST_IDS rows; beyond that, or for the digest, each scanned text is hashed where it is read. Texts are never shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(whole_number(id_col).alias("doc_id"), F.length(text).alias("chars"), normalised(text).alias("plain"))
    shaped = own.withColumns({"len": F.length("plain"), "prefix": F.xxhash64(F.substring("plain", 1, PREFIX))})
    shapes = save(shaped.select("len", "prefix"), "shapes")
    lengths = save(_group_sizes(shapes, ["len"]), "lengths")
    alike = joined_by_size(shapes, lengths.withColumnRenamed("len", "known"), F.col("len") == F.col("known"))
    prefixes = save(_group_sizes(alike, ["len", "prefix"]), "prefixes")
    full = F.sha2("plain", 256)
    if prefixes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        known = F.broadcast(prefixes.select(F.col("len").alias("l"), F.col("prefix").alias("p"), F.lit(True).alias("recurs")))
        shaped = shaped.join(known, (F.col("len") == F.col("l")) & (F.col("prefix") == F.col("p")), "left")
        recurs = F.coalesce("recurs", F.lit(False))
    else:
        recurs = F.lit(True)
    hashed = shaped.select("doc_id", "chars", recurs.alias("recurs"), (full if digest else F.when(recurs, full)).alias("full"))
    rows = save(hashed.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = rows.filter("recurs").groupBy("full").agg(
        F.count("*").alias("n"), F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep")
    )
    groups = save(groups.filter("n > 1").select("full", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row")), "groups")
    total = rows.count()
    often = F.col("n") * HOT >= total
    hot, cold = (
        groups.filter(part).select(*[F.col(c).alias(f"{side}_{c}") for c in groups.columns]) for side, part in (("hot", often), ("cold", ~often))
    )
    # rows that are done or alone get a key that no group has, each its own
    key = F.when(F.col("recurs") & F.col("hot_n").isNull(), F.col("full")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))
    found = rows.join(F.broadcast(hot), F.col("full") == F.col("hot_full"), "left").withColumn("key", key).join(cold, F.col("key") == F.col("cold_full"), "left")
    n, keep_row = F.coalesce("hot_n", "cold_n", F.lit(1)), F.coalesce("hot_keep_row", "cold_keep_row", "row")
    keep_id = F.when(F.col("hot_n").isNotNull(), F.col("hot_keep_id")).when(F.col("cold_n").isNotNull(), F.col("cold_keep_id")).otherwise(F.col("doc_id"))
    out = found.select("doc_id", keep_id.alias("keep_id"), n.cast("long").alias("group_size"), (keep_row == F.col("row")).alias("kept"), F.col("full").alias("text_sha256"))
    return out if digest else out.drop("text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, columns as they are. Rows of one id stay or go together: they go if none of them is kept."""
    groups = exact_groups(docs, id_col, text_col, digest=False)
    gone = save(groups.groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).filter("not stays").select(F.col("doc_id").alias("gone_id")), "gone")
    own = docs.select(whole_number(id_col).alias("own_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return joined_by_size(own, gone, F.col("own_id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")


ORACLE = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), ranked AS (
  SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS n FROM plain
)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM ranked
"""
