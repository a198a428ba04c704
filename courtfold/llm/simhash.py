"""SimHash near-duplicate groups by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .work import joined_by_size, save, whole_number

BITS = 64
REFINE_FROM = 512


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text whose A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    xxh64 = xxhash.xxh64_intdigest
    hashes = np.array([xxh64(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row; a null or wordless text has fingerprint zero."""

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "").cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(whole_number(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one must differ by at most one bit."""
    n = max_distance // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _variants(fp, max_distance: int):
    """One key for each segment and each bit of it taken as a wildcard: equal keys, at most one bit differs there."""
    keys = []
    for s, (low, width) in enumerate(_segments(max_distance)):
        piece = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            keys.append(F.lit(((s << 6) + bit) << 40).bitwiseOR(piece.bitwiseAND(F.lit(~(1 << bit)))))
    return F.array(*keys)


def _near(a, b, max_distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_distance


def fingerprint_links(nodes: DataFrame, max_distance: int = 4) -> DataFrame:
    """(node, component) over distinct fingerprints(fp) within max_distance bits, straight or through others.

    Neighbours in each variant bucket's order are linked first. After that only buckets in which
    two or more components still meet need pairs, and of those only pairs across components, so a
    large group of near copies never emits its pairs. Large buckets are divided once more by equal blocks of
    all bits (one of max_distance + 1 blocks must be equal), which loses no pair.
    """
    if not 1 <= max_distance <= 8:
        raise ValueError("max_distance must be 1 to 8")
    keyed = nodes.select("fp", F.explode(_variants(F.col("fp"), max_distance)).alias("key"))
    order = Window.partitionBy("key").orderBy("fp")
    first = save(
        keyed.withColumn("before", F.lag("fp").over(order)).filter(_near("fp", "before", max_distance))
        .select(F.col("before").alias("u"), F.col("fp").alias("v")).distinct(),
        "neighbours",
    )
    groups = connected_components(first)
    held = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", F.coalesce("component", "fp").alias("c"))
    whole = Window.partitionBy("key")
    mixed = save(
        held.select("fp", "c", F.explode(_variants(F.col("fp"), max_distance)).alias("key"))
        .select("*", F.min("c").over(whole).alias("lo"), F.max("c").over(whole).alias("hi"), F.count("*").over(whole).alias("n"))
        .filter("lo < hi").select("key", "fp", "c", "n"),
        "mixed",
    )
    parts = max_distance + 1
    edges = [BITS * i // parts for i in range(parts + 1)]
    blocks = F.array(*[
        F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit(i << 40))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ])
    pieces = mixed.filter(F.col("n") <= REFINE_FROM).select("key", F.lit(-1).cast("long").alias("block"), "fp", "c").unionByName(
        mixed.filter(F.col("n") > REFINE_FROM).select("key", F.explode(blocks).alias("block"), "fp", "c")
    )
    a = pieces.select("key", "block", F.col("fp").alias("u"), F.col("c").alias("cu"))
    b = pieces.select("key", "block", F.col("fp").alias("v"), F.col("c").alias("cv"))
    across = a.join(b, (a.key == b.key) & (a.block == b.block) & (a.cu < b.cv) & _near("u", "v", max_distance))
    return connected_components(first.unionByName(across.select("u", "v")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Null, empty and wordless texts share fingerprint zero and link like any other. Rows with a null id
    keep their row and never name a group unless all of its ids are null; ids that aren't whole numbers become null. Repeated rows stay repeated.
    Other columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    prints = save(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = fingerprint_links(nodes.select("fp"), max_distance)
    labelled = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    labelled = save(labelled, "labelled")
    least = save(labelled.groupBy("c").agg(F.min("least").alias("component_id")), "least")
    named = save(labelled.join(least, "c").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4) -> DataFrame:
    """The rows of docs whose document is the smallest of its group; rows of one id stay or go together. Columns keep their names, whatever they are."""
    groups = simhash_groups(docs, id_col, text_col, width, max_distance)
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = save(groups.groupBy("doc_id").agg(stays.alias("stays")).filter("not stays").select(F.col("doc_id").alias("gone_id")), "gone")
    own = docs.select(whole_number(id_col).alias("own_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return joined_by_size(own, gone, F.col("own_id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")
