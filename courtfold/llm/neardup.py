"""Near-duplicate documents by word shingles: SimHash and MinHash bands retrieve pairs, exact Jaccard similarity decides.

Deletion-variant SimHash signatures (see simhash) find the nearest texts, but two texts of similarity 0.8 differ in about ten of 64 bits, which
no bucket of usable size holds. So bands of MinHashes retrieve the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import SECOND, byte_hashes, mix, near_hashes, range_hashes, text_slices, tidied, windows_of, words_of
from .components import connected_components
from .packing import runs
from .simhash import fingerprint_links
from .work import drop, joined_by_size, save, whole_number

#: 24 bands of 6 hashes miss a pair of similarity s with probability (1 - s**6)**24: 0.0007 at 0.8, 1e-8 at 0.9.
BANDS, ROWS = 24, 6
#: Bands whose neighbours are compared first; what they link need not be compared again in the others.
FIRST_BANDS = 6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SKETCH = "doc_id long, node long, n int, fp long, bands array<long>"
BLOCK = 1 << 16
CHUNK, COLUMNS = 256, 4096
#: A chunk of a bucket holds about so many shingles, or one longer text's.
CHUNK_SHINGLES = 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words (a shorter text is one shingle), and their row bounds."""
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets)
    words = byte_hashes(data, starts, ends)
    at = windows_of(first, width)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    hashes = np.concatenate([near_hashes(words, at, at + width), range_hashes(words, first[short], first[short + 1])])
    rows = np.concatenate([np.searchsorted(first, at, "right") - 1, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])])
        hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def band_keys(hashes: np.ndarray, begins: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each set (they begin at `begins`, none is empty) and band, from the least of `rows` hash functions each."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * SECOND)
    out = np.zeros((len(begins), bands), np.uint64)
    for i in range(bands * rows):
        least = np.minimum.reduceat((hashes ^ seeds[2 * i]) * (seeds[2 * i + 1] | np.uint64(1)), begins)
        band = i // rows
        out[:, band] = mix(out[:, band] * SECOND + least + np.uint64(band))
    return out


def fingerprints_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each set of shingle hashes; zero for an empty one."""
    counts = np.zeros((len(sizes), 64), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    for k in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cuts = runs(rows[k : k + BLOCK])
        counts[rows[k : k + BLOCK][cuts[:-1]]] += np.add.reduceat(bits, cuts[:-1], axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _nodes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    sizes = np.diff(bounds)
    filled = np.flatnonzero(sizes)
    node = np.zeros(len(sizes), np.uint64)
    if len(filled):
        node[filled] = mix(np.add.reduceat(mix(hashes ^ SECOND), bounds[filled]) + sizes[filled].astype(np.uint64))
    return node.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, node, n, fp, bands) of every row: node is a hash of the whole set of n shingles, fp its SimHash; a wordless text has no bands."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                hashes, bounds = shingle_sets(data, offsets, width)
                sizes = np.diff(bounds)
                filled = np.flatnonzero(sizes)
                keys = band_keys(hashes, bounds[filled]) if len(filled) else np.zeros((0, BANDS), np.uint64)
                ends = (np.concatenate([[0], np.cumsum(sizes > 0)]) * BANDS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array(_nodes(hashes, bounds)), pa.array(sizes.astype(np.int32)), pa.array(fingerprints_of(hashes, sizes).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["doc_id", "node", "n", "fp", "bands"],
                )

    return docs.select(whole_number(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), SKETCH)


def gram_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """(node, grams) of texts(text)."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in text_slices(batch, "text"):
                hashes, bounds = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_nodes(hashes, bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["node", "grams"]
                )

    return texts.select("text").mapInArrow(tidied(run), "node long, grams array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least the threshold of their union in common."""
    u, v = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")) for x in "uv")
    held = pairs.join(u, "u").join(v, "v").withColumn("shared", F.size(F.array_intersect("gu", "gv")))
    return held.filter(F.col("shared") / (F.size("gu") + F.size("gv") - F.col("shared")) >= threshold).select("u", "v")


def _bucket_links(mixed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links between components that meet in a bucket of mixed(band, key, node, n, c), as a forest for each pair of chunks of CHUNK nodes and CHUNK_SHINGLES shingles.

    The sizes of all intersections of a chunk pair are one matrix product, so no pair becomes a row.
    """

    def solve(table: pa.Table) -> pa.Table:
        node, c = table.column("node").to_numpy(), table.column("c").to_numpy()
        lists = table.column("grams").combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.float64)
        rows = np.repeat(np.arange(len(n)), n.astype(np.int64))
        _, gram = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        order = np.argsort(gram, kind="stable")
        rows, gram = rows[order], gram[order]
        shared = np.zeros((len(n), len(n)), np.float32)
        for k in range(0, int(gram[-1]) + 1 if len(gram) else 0, COLUMNS):
            a, b = np.searchsorted(gram, (k, k + COLUMNS))
            part = np.zeros((len(n), COLUMNS), np.float32)
            part[rows[a:b], gram[a:b] - k] = 1
            shared += part @ part.T
        near = (shared / (n[:, None] + n[None, :] - shared) >= threshold) & (c[:, None] < c[None, :])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            a, b = find(int(c[i])), find(int(c[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
        at = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"u": node[at[:, 0]], "v": node[at[:, 1]]})

    most = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES))
    counts = mixed.groupBy("band", "key").agg(F.greatest(most, F.lit(1)).alias("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    dealt = mixed.join(counts, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("other", other)
    dealt = dealt.select("band", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "c")
    return dealt.join(sets, "node").groupBy("band", "key", "i", "j").applyInArrow(solve, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable by pairs of Jaccard similarity `threshold` or more).

    Sets of equal shingles are one node. Neighbours in the buckets of the first bands and in groups of near fingerprints are checked first; then only pairs of
    different components that still meet in a bucket, so a large group of near copies never emits its pairs. A pair that no bucket
    holds is missed, see BANDS. Null, empty and wordless texts are equal. Rows with a null id, or one that isn't a whole number, keep their row and never
    name a group unless all of its ids are null. Other columns are ignored. An empty table gives an empty result.
    """
    prints = save(sketches(docs, id_col, text_col, width), "sketches")
    nodes = save(
        prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes"
    )
    keyed = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    met = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    close = fingerprint_links(nodes.filter("n > 0").select("fp").distinct())
    close = nodes.filter("n > 0").select("node", "n", "fp").join(close, F.col("fp") == close.node).select(nodes.node, "n", "component")
    heads = close.groupBy("component").agg(F.min(F.struct("node", "n")).alias("head"))
    close = save(close.join(heads, "component").select("node", "n", F.col("head.node").alias("u"), F.col("head.n").alias("m")).filter("u <> node"), "close")
    keyed = save(keyed.join(met, ["band", "key"]), "keyed")
    wanted = keyed.select("node").unionByName(close.select("node")).unionByName(close.select(F.col("u").alias("node"))).distinct()
    # one document of each node that meets another gives its set
    ids = save(nodes.join(wanted, "node").select(F.col("least").alias("wanted_id")).distinct(), "wanted")
    own = docs.select(whole_number(id_col).alias("own_id"), F.col(text_col).cast("string").alias("text"))
    sets = save(gram_sets(joined_by_size(own, ids, F.col("own_id").eqNullSafe(F.col("wanted_id"))), width).dropDuplicates(["node"]), "sets")
    alike = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-6

    def links(pairs, name):
        pairs = save(pairs.filter(alike).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-pairs")
        return save(_similar(pairs, sets, threshold), name)

    # the text that others are copies of meets most of them, so each bucket is compared with its most frequent member first
    weights = keyed.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = keyed.join(weights, "node")
    middle = weighed.groupBy("band", "key").agg(F.max_by(F.struct("node", "n"), F.struct("weight", "node")).alias("middle"))
    stars = keyed.join(middle, ["band", "key"]).select(F.col("node").alias("v"), "n", F.col("middle.node").alias("u"), F.col("middle.n").alias("m")).filter("u <> v")
    order = Window.partitionBy("band", "key").orderBy("n", "node")
    neighbours = keyed.filter(F.col("band") < FIRST_BANDS).select(F.col("node").alias("v"), "n", F.lag("node").over(order).alias("u"), F.lag("n").over(order).alias("m")).filter("u is not null")
    first = links(neighbours.unionByName(stars).unionByName(close.select(F.col("node").alias("v"), "n", "u", "m")), "neighbours")
    groups = connected_components(first)
    whole = Window.partitionBy("band", "key")
    held = keyed.join(groups, "node", "left").select("node", "n", F.coalesce("component", "node").alias("c"), "band", "key")
    mixed = save(
        held.select("*", F.min("c").over(whole).alias("lo"), F.max("c").over(whole).alias("hi")).filter("lo < hi").select("band", "key", "node", "n", "c"), "mixed"
    )
    across = save(_bucket_links(mixed, sets, threshold), "across")
    groups = connected_components(first.unionByName(across))
    labelled = save(nodes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c")), "labelled")
    least = save(labelled.groupBy("c").agg(F.min("least").alias("component_id")), "least")
    named = save(labelled.join(least, "c").select("node", "component_id"), "named")
    for table in (sets, keyed, mixed, close, labelled, least, nodes):
        drop(table)
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose document is the smallest of its group; rows of one id stay or go together. Columns keep their names, whatever they are."""
    groups = near_groups(docs, id_col, text_col, width, threshold)
    gone = save(groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).filter("not stays").select(F.col("doc_id").alias("gone_id")), "gone")
    own = docs.select(whole_number(id_col).alias("own_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return joined_by_size(own, gone, F.col("own_id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")
