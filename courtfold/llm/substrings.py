"""Substring dedup by fixed-block anchors: repeated runs of words, whichever documents hold them.

Blocks that don't overlap are the index, every rolling window probes it, and blocks that another window equals are the hits. Each hit is
extended to the windows of `width` words around it; those whose words recur are kept, and runs of them make up the maximal repeats. No pair of places is ever
formed, so a passage in very many texts costs no more than its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SECOND, SECOND_INVERSE, byte_hashes, covered, near_hashes, text_slices, windows_of, words_of
from .packing import KEY, bucketed, flat, gathered, member, narrow, passed, runs, settled_rows, shard_bits, shard_parts, shard_rows, widen
from .work import drop, save, whole_number

WIDTH = 35
FLUSH_WORDS = 1 << 20
#: Bits by which hashes in the index exceed the number of words: one block in 2**SPARE is a candidate by chance, and verified away.
SPARE = 12


def _flushes(batches, column="text", functions=(0,)):
    """Word hashes of many texts at a time: (other columns of the rows, hashes by each of the functions, first word of each row)."""
    rows, hashes, firsts, n = [], [], [0], 0
    for batch in batches:
        for part, data, offsets in text_slices(batch, column):
            starts, ends, first = words_of(data, offsets)
            rows.append(part)
            hashes.append(np.stack([byte_hashes(data, starts, ends, f) for f in functions]))
            firsts.extend((first[1:] + n).tolist())
            n += len(starts)
            if n >= FLUSH_WORDS:
                yield rows, np.concatenate(hashes, axis=1), np.array(firsts)
                rows, hashes, firsts, n = [], [], [0], 0
    if rows:
        yield rows, np.concatenate(hashes, axis=1), np.array(firsts)


def _column(rows, name) -> np.ndarray:
    return np.concatenate([r.column(name).to_numpy(zero_copy_only=False) for r in rows])


INDEX = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("once", "again", "blocks", "keys", "places"))])


def _index(own: DataFrame, block: int, bits: int, shards: int) -> DataFrame:
    """A row for each shard and flush: every rolling window's hash, those that recur in the flush apart, and the blocks with their places.

    Blocks that recur in a flush are settled there, so a passage that many texts share weighs no more than others.
    """
    low = bits - shards

    def run(batches):
        for rows, (words,), first in _flushes(batches):
            at = windows_of(first, block)
            if not len(at):
                continue
            h = near_hashes(words, at, at + block) >> np.uint64(64 - bits)
            row = np.searchsorted(first, at, "right") - 1
            inside = at - first[row]
            whole = np.flatnonzero(inside % block == 0)
            key, place = _column(rows, "key")[row[whole]], (inside[whole] // block).astype(np.int32)
            probes = np.sort(h)
            cuts = runs(probes)
            probes, n = probes[cuts[:-1]], np.diff(cuts)
            once, again = probes[n == 1], probes[n > 1]
            hit = member(h[whole], again)
            yield settled_rows(key[hit], place[hit], shards, INDEX, (4, 5))
            order = np.flatnonzero(~hit)[np.argsort(h[whole][~hit], kind="stable")]
            blocks = h[whole][order]
            top = lambda x: (x >> np.uint64(low)).astype(np.int32)
            yield shard_rows(
                [(top(once), [narrow(once, low)]), (top(again), [narrow(again, low)]), (top(blocks), [narrow(blocks, low), key[order], place[order]])], INDEX
            )

    return own.select("key", "text").mapInArrow(run, "shard int, once binary, again binary, blocks binary, keys binary, places binary")


def _anchors(index: DataFrame, bits: int, shards: int) -> DataFrame:
    """(key, places): the blocks of each text that some other rolling window equals. A shard is folded part by part into its different hashes."""
    kind = f"V{(bits - shards + 7) // 8}"
    nothing = (np.zeros(0, np.uint64),) * 2, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def run(batches):
        (once, known), pending = nothing
        for shard, rows, last in shard_parts(batches):
            if shard < 0:
                yield passed(shard, rows, (4, 5))
                continue
            read = lambda c: widen(flat(rows.column(c), kind))
            known = np.union1d(known, read("again"))
            hashes, n = np.unique(np.concatenate([once, read("once")]), return_counts=True)
            known = np.union1d(known, hashes[n > 1])
            once = hashes[(n == 1) & ~member(hashes, known)]
            block, key, place = (np.concatenate([x, y]) for x, y in zip(pending, (read("blocks"), flat(rows.column("keys"), np.int64), flat(rows.column("places"), np.int32))))
            hit = member(block, known)
            yield bucketed(key[hit], place[hit], shards)
            pending = (block[~hit], key[~hit], place[~hit])
            if last:
                (once, known), pending = nothing

    found = index.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "bucket int, keys binary, values binary")
    return gathered(found, np.int32, "places")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _digest(text: bytes, gone: np.ndarray | None, keep_text: bool) -> tuple[int, int, str, str | None]:
    words = text.split()
    kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
    joined = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8") if keep_text else None


def _compressed(own: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), batch.column("id"), pa.array([squeeze((t or "").encode()) for t in texts], pa.binary())], ["doc_id", "key", "id", "packed"]
            )

    return own.mapInArrow(run, "doc_id long, key long, id long, packed binary")


def _apart(texts: DataFrame, keep_text: bool) -> DataFrame:
    """Results of texts without an anchor; texts with one go on."""

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids, keys, packed, places = (part.column(c).to_pylist() for c in ("doc_id", "key", "packed", "places"))
                done = [(None,) * 4 if p is not None else _digest(expand(z), None, keep_text) for z, p in zip(packed, places)]
                going = [z if p is not None else None for z, p in zip(packed, places)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                     part.column("key"), part.column("id"), pa.array(going, pa.binary()), part.column("places")],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "key", "id", "packed", "places"],
                )

    return texts.mapInArrow(run, RESULT + ", key long, id long, packed binary, places binary")


CANDIDATES = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("hashes", "checks", "keys", "places", "again", "again_checks"))])


def _equal(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both hashes, and where runs of equal ones begin, with the end."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h) + 1, bool)
    new[1:-1] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return order, np.flatnonzero(new) if len(h) else np.zeros(1, np.int64)


def _extended(going: DataFrame, width: int, block: int, shards: int) -> DataFrame:
    """(key, id, found): the windows of `width` words around the hits of each text that occur twice or more, by two 64-bit hashes, each over its own hash of each word.

    A window is looked at if all blocks inside it are hits. Windows that recur in a flush are settled there. A shard is folded part by part into its different windows.
    """

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress

        def texts():
            for batch in batches:
                plain = pa.array([expand(z) for z in batch.column("packed").to_pylist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), plain, batch.column("places")], ["key", "id", "text", "places"])

        for rows, (words, others), first in _flushes(texts(), functions=(0, 1)):
            anchors = np.zeros(len(words) + 1, bool)
            for start, end, places in zip(first[:-1].tolist(), first[1:].tolist(), (p for r in rows for p in r.column("places").to_pylist())):
                at = start + np.frombuffer(places, np.int32).astype(np.int64) * block
                anchors[at[at < end]] = True
            at = windows_of(first, width)
            row = np.searchsorted(first, at, "right") - 1
            inside = at - first[row]
            lead = first[row] + -(-inside // block) * block  # the first whole block in the window; there may be a second
            good = anchors[lead] & (anchors[np.minimum(lead + block, len(words))] | (lead + 2 * block > at + width))
            at, row, place = at[good], row[good], inside[good].astype(np.int32)
            if not len(at):
                continue
            key = np.zeros(len(at), KEY)
            key["key"], key["id"] = _column(rows, "key")[row], _column(rows, "id")[row]
            h, g = near_hashes(words, at, at + width, SECOND, SECOND_INVERSE), near_hashes(others, at, at + width)
            order, cuts = _equal(h, g)
            h, g, key, place = h[order], g[order], key[order], place[order]
            n = np.diff(cuts)
            single = np.repeat(n == 1, n)
            yield settled_rows(key[~single], place[~single], shards, CANDIDATES, (3, 4))
            again = cuts[:-1][n > 1]
            top = lambda x: (x >> np.uint64(64 - shards)).astype(np.int32)
            yield shard_rows(
                [(top(h[single]), [h[single], g[single], key[single], place[single]]), (top(h[again]), [h[again], g[again]])], CANDIDATES
            )

    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, KEY), np.zeros(0, np.int32)), (np.zeros(0, np.uint64),) * 2

    def settle(batches):
        once, known = nothing
        for shard, rows, last in shard_parts(batches):
            if shard < 0:
                yield passed(shard, rows, (3, 4))
                continue
            h, g, key, place = (np.concatenate([x, flat(rows.column(c), x.dtype)]) for x, c in zip(once, ("hashes", "checks", "keys", "places")))
            h2, g2 = (np.concatenate([x, flat(rows.column(c), x.dtype)]) for x, c in zip(known, ("again", "again_checks")))
            order, cuts = _equal(np.concatenate([h, h2]), np.concatenate([g, g2]))
            n = np.diff(cuts)
            # what recurs elsewhere counts twice
            twice = np.repeat((n > 1) | np.logical_or.reduceat(order >= len(h), cuts[:-1]), n) if len(order) else np.zeros(0, bool)
            hit = np.zeros(len(order), bool)
            hit[order] = twice
            heads = order[cuts[:-1]][twice[cuts[:-1]]] if len(order) else order
            known = tuple(np.concatenate([a, b])[heads] for a, b in ((h, h2), (g, g2)))
            hit = hit[: len(h)]
            yield bucketed(key[hit], place[hit], shards)
            once = (h[~hit], g[~hit], key[~hit], place[~hit])
            if last:
                once, known = nothing

    schema = "shard int, " + ", ".join(f"{c} binary" for c in CANDIDATES.names[1:])
    candidates = going.select("key", "id", "packed", "places").mapInArrow(run, schema)
    found = candidates.repartition("shard").sortWithinPartitions("shard").mapInArrow(settle, "bucket int, keys binary, values binary")
    return gathered(found, np.int32, "found", KEY)


def _cut(texts: DataFrame, width: int, keep_text: bool) -> DataFrame:
    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = []
                for doc_id, z, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "packed", "found"))):
                    text = expand(z)
                    gone = None if found is None else covered(np.frombuffer(found, np.int32).astype(np.int64), width, len(text.split()))
                    out.append((doc_id, *_digest(text, gone, keep_text)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return texts.mapInArrow(run, RESULT)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): texts without the words of repeated windows of `width` words.

    A window goes if its words also start anywhere else, in the same text too; all its occurrences go, the first as well. Windows
    never cross texts and are judged on the input. Blocks of (width + 1) / 2 words from the start of each text are the anchors: any repeated window
    holds one, so every repeat is found. Windows are compared by two independent 64-bit hashes
    of the bytes of their words. Null and empty texts have no
    words; repeated rows are texts of their own; null ids are kept, and ids that aren't whole numbers become null; other columns are ignored. An empty table gives an empty result.
    """
    if width < 2:
        raise ValueError("width must be 2 at least")
    block = (width + 1) // 2
    own = docs.select(whole_number(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns(
        {"key": F.xxhash64("doc_id", "text"), "id": F.xxhash64(F.lit(1), "doc_id", "text")}
    )
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, shards = min(64, max(32, total.bit_length() - 2 + SPARE)), shard_bits(total)
    anchors = save(_anchors(_index(own, block, bits, shards), bits, shards), "anchors")
    joined = _compressed(own.select("doc_id", "key", "id", "text")).join(anchors, "key", "left")
    apart = save(_apart(joined, keep_text), "apart")
    drop(anchors)
    going = apart.filter("packed is not null")
    found = save(_extended(going, width, block, shards), "found")
    cut = _cut(going.select("doc_id", "key", "id", "packed").join(found, ["key", "id"], "left").select("doc_id", "packed", "found"), width, keep_text)
    return apart.filter("packed is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").unionByName(cut)
