"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .packing import flat, slices
from .work import save, whole_number

TABLES, FUNCTIONS, PROBES = 12, 2, 2
CHUNK = 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        x = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def cross_polytope(unit: np.ndarray, tables: int, functions: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, probes) bucket numbers: in each table the nearest signed axes of `functions` rotations, and the next likeliest."""
    n, d = unit.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = unit
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        codes, gaps = np.zeros((n, functions, 2), np.int64), np.zeros((n, functions))
        for f in range(functions):
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], size))
            size_of = np.abs(y)
            for k in range(2):
                top = size_of.argmax(axis=1)
                codes[:, f, k] = 2 * top + (y[rows, top] < 0)
                gaps[:, f] += (1 - 2 * k) * size_of[rows, top]
                size_of[rows, top] = -1
        choices, costs = [], []
        for mask in range(1 << functions):
            picks = [(mask >> f) & 1 for f in range(functions)]
            number = np.zeros(n, np.int64)
            for f, k in enumerate(picks):
                number = number * (2 * size) + codes[:, f, k]
            choices.append(number)
            costs.append(sum((gaps[:, f] for f, k in enumerate(picks) if k), np.zeros(n)))
        order = np.argsort(np.stack(costs, 1), axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(np.stack(choices, 1), order, axis=1)
    return out


def _hashed(reps: DataFrame, tables: int, functions: int, probes: int, seed: int) -> DataFrame:
    """A row for each rep: its components as bytes, its weight, and its buckets in all tables, which also tell where a pair first meets."""
    wide = np.float32 if reps.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                v = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(wide).reshape(-1, d)
                codes = cross_polytope(_unit(v), tables, functions, probes, seed).reshape(len(v), -1)
                if codes.max() > np.iinfo(np.int32).max:
                    raise ValueError("too many buckets for so many functions of so long vectors")
                bounds = pa.array(np.arange(len(v) + 1, dtype=np.int32) * codes.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(np.full(len(v), d, np.int64)), part.column("node"), part.column("n"), slices(v.ravel(), np.arange(len(v) + 1) * d),
                     pa.ListArray.from_arrays(bounds, pa.array(codes.ravel().astype(np.int32)))],
                    ["label", "d", "node", "n", "raw", "codes"],
                )

    return reps.mapInArrow(run, "label long, d long, node long, n long, raw binary, codes array<int>")


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _first_meeting(a: np.ndarray, b: np.ndarray, t: int, bucket: int) -> np.ndarray:
    """Of pairs that share bucket of table t, those that share no bucket of an earlier table and no smaller one of t."""
    same = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    earlier = same[:, :t].any(axis=(1, 2))
    smaller = (same[:, t] & (a[:, t] < bucket)).any(axis=1)
    return ~earlier & ~smaller


def _links(pairs: DataFrame, threshold: float, tables: int, probes: int, wide) -> DataFrame:
    """For each group of at most two chunks of a bucket: (node, links, root) with the linked weights first met there and a forest of the links."""
    keys = ["label", "d", "t", "bucket", "i", "j"]

    def solve(group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, n, chunk = group["node"], group["n"], group["chunk"]
        unit = _unit(group["raw"].view(wide).reshape(len(node), -1))
        codes = group["codes"].reshape(len(node), tables, probes)
        near = unit @ unit.T >= threshold
        np.fill_diagonal(near, False)
        if group["i"] != group["j"]:
            near &= chunk[:, None] != chunk[None, :]
        a, b = np.nonzero(np.triu(near))
        links = np.zeros(len(node), np.int64)
        for k in range(0, len(a), 1 << 15):
            x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
            first = _first_meeting(codes[x], codes[y], group["t"], group["bucket"])
            np.add.at(links, x[first], n[y[first]])
            np.add.at(links, y[first], n[x[first]])
        root = np.arange(len(node))
        while len(a):
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return node, links, node[root]

    def run(batches):
        held = None
        for batch in _chained(batches):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
                if held.num_rows < 4096:
                    continue
            if held is None or not held.num_rows:
                continue
            ids = np.stack([held.column(k).to_numpy() for k in keys], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1), [True]]))
            done = cuts if batch is None else cuts[:-1]  # the last group may go on
            sizes = np.diff(done)
            out = []
            for k in np.flatnonzero(sizes > 1):
                part = held.slice(int(done[k]), int(sizes[k]))
                group = dict(zip(keys, ids[done[k]])) | {c: part.column(c).to_numpy() for c in ("node", "n", "chunk")}
                out.append(solve(group | {"raw": flat(part.column("raw"), np.uint8), "codes": part.column("codes").flatten().to_numpy()}))
            if out:
                node, links, root = (np.concatenate(x) for x in zip(*out))
                some = (links > 0) | (root != node)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(root[some])], ["node", "links", "root"])
            held = held.slice(int(done[-1])) if len(done) else held

    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, links long, root long")


def _chained(batches):
    yield from batches
    yield None


def embedding_groups(
    vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = 7,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Vectors link at a cosine of `threshold` or more, in double precision.

    Only vectors of one label, not null, and of one length are compared. Null, empty and zero vectors, and those with null or non-finite
    components, have no links. Equal vectors are hashed once and weighted by their number. A bucket of any size is compared in
    pairs of chunks of CHUNK vectors; a pair is counted where it first meets, and only sums and a forest leave a task. Pairs that share
    no bucket of any table aren't found (see the recall test). Ids and labels that aren't whole numbers become null. Null ids keep their row; a group's id is its smallest that isn't null. Repeated rows
    are vectors of their own. An empty table gives an empty result.
    """
    kind = vectors.schema[embedding_col].dataType
    numbers = F.col(embedding_col) if kind.simpleString() == "array<float>" else F.col(embedding_col).cast("array<double>")
    finite = ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(F.col(label_col).isNotNull() & finite & F.exists(numbers, lambda x: x != 0), F.lit(False))
    own = save(vectors.select(whole_number(id_col).alias("vec_id"), whole_number(label_col).alias("label"), F.when(valid, numbers).alias("embedding")), "vectors")
    good = own.filter("embedding is not null and label is not null")
    reps = save(
        good.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "reps"
    )
    wide = np.float32 if reps.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    hashed = save(_hashed(reps.select("label", "embedding", "node", "n"), tables, functions, probes, seed), "hashed")
    bucket = ["label", "d", "t", "bucket"]
    # only numbers travel until it is known which buckets hold two vectors or more
    members = hashed.select("label", "d", "node", F.posexplode("codes").alias("pos", "bucket")).withColumn("t", F.floor(F.col("pos") / probes)).drop("pos")
    counts = members.groupBy(*bucket).agg(F.count("*").alias("size")).filter("size > 1").withColumn("chunks", F.ceil(F.col("size") / CHUNK))
    chunked = members.join(counts, bucket).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    dealt = chunked.withColumn("other", other).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).join(hashed.select("node", "n", "raw", "codes"), "node")
    found = save(_links(dealt.select(*bucket, "i", "j", "chunk", "node", "n", "raw", "codes"), threshold, tables, probes, wide), "links")
    groups = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = save(
        reps.join(groups, "node", "left").join(links, "node", "left")
        .select("node", "label", "embedding", "least", F.coalesce("component", "node").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "named",
    )
    least = save(named.groupBy("c").agg(F.min("least").alias("component_id")), "least")
    named = save(named.join(least, "c").select("label", "embedding", "n_links", "component_id"), "components")
    linked = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = own.filter("embedding is null or label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
