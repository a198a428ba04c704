"""Suffix-array dedup of byte strings by prefix-free parsing.

Rolling-hash triggers cut each text into phrases: a trigger is a gram whose hash is the least in the reach of some window, so every
window of `width` bytes holds its trigger, and equal windows hold the same one at the same place. A phrase is the run of windows that share
a trigger, with the bytes they reach. Only phrases whose trigger recurs go on. Equal phrases are one entry of the dictionary; its suffix array
(prefix doubling to `width` bytes, whole triggers at a time, which keeps equal suffixes together) and the places where the parse
puts its phrases give the corpus order of all windows that can recur: of equal suffixes the first in corpus order stays.

Triggers that very many phrases share are refined: their windows are told apart by where the trigger stands in them, and each of these
groups by the bytes that all its windows have. Equal windows still meet, so results don't depend on it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASE, BASE_INVERSE, SECOND, SECOND_INVERSE, mix, near_hashes, powers, text_slices, windows_of
from .packing import KEY, batch_of, bucketed, flat, gathered, member, passed, runs, settled_rows, shard_bits, shard_parts, shard_rows, slices
from .work import drop, save, whole_number

WIDTH, GRAM = 100, 32
FLUSH_BYTES = 8 << 20
SEGMENT = 1 << 20
#: Bytes of phrases that are ranked at once.
RANKED_BYTES = 1 << 20
#: A trigger is refined from so many phrases on, or from a share of the corpus's bytes that leaves at most MOST_REFINED such triggers (32 MB).
REFINED_FROM, MOST_REFINED = 1024, 1 << 22
#: Groups of places of the trigger, first of several places and then of one each.
GROUPS = 8
PLACE = np.uint64((1 << 24) - 1)
NO_ID = np.iinfo(np.int64).min


def _rolling(data: np.ndarray, gram: int) -> np.ndarray:
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=prefix[1:])
    return mix((prefix[gram:] - prefix[:-gram]) * powers(BASE_INVERSE, len(data) + 1)[: len(data) - gram + 1])


def parse(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, start, length and trigger place of each run of windows, in order."""
    found = []
    # a window is parsed the same wherever a segment begins; a run that was cut there is joined again below
    for k in range(0, max(1, len(data)), SEGMENT):
        part = data[k : k + SEGMENT + width - 1]
        if len(part) < width:
            break
        at = windows_of(np.clip(offsets - k, 0, len(part)), width)
        at = at[at < SEGMENT]
        if not len(at):
            continue
        low = (_rolling(part, gram) & ~PLACE) | np.arange(len(part) - gram + 1, dtype=np.uint64)
        reach, have = width - gram + 1, 1
        while 2 * have <= reach:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < reach:
            low = np.minimum(low[: len(low) - (reach - have)], low[reach - have :])
        trigger = (low[at] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)]))
        found.append((at[new] + k, np.diff(np.append(new, len(at))), trigger[new] + k))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, trigger = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(offsets, start, "right") - 1
    same = (trigger[1:] == trigger[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + length[:-1])
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    start, length, trigger = start[new], np.add.reduceat(length, new), trigger[new]
    return np.searchsorted(offsets, start, "right") - 1, start, length, trigger


def _trigger_hashes(data, trigger, gram):
    return near_hashes(data, trigger, trigger + gram, SECOND, SECOND_INVERSE)


def _ordinals(row: np.ndarray) -> np.ndarray:
    """Number of each run in its text."""
    cuts = runs(row)
    return np.arange(len(row)) - np.repeat(cuts[:-1], np.diff(cuts))


def _once(rows: pa.RecordBatch) -> np.ndarray:
    """Rows that aren't repetitions of one in the same batch: repeated rows have the same results."""
    return np.sort(np.unique(rows.column("key").to_numpy(), return_index=True)[1])


TRIGGERS = pa.schema([("shard", pa.int32()), ("hashes", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("twice", pa.binary())])


def _recurring(own: DataFrame, width: int, gram: int, shards: int, refined_from: int) -> DataFrame:
    """(key, places): the runs of each text, by number, whose trigger occurs twice or more; and triggers to refine as keys without places.

    A trigger that recurs in a flush is settled there and sent once, with its number of phrases. A shard is folded part by part into its
    different triggers, so one that is everywhere takes no more memory than others.
    """
    count = np.dtype([("hash", "<u8"), ("n", "<i8")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                row, _, _, trigger = parse(data, offsets, width, gram)
                new = np.zeros(rows.num_rows, bool)
                new[_once(rows)] = True
                keys = rows.column("key").to_numpy()
                place, h = _ordinals(row).astype(np.int32), _trigger_hashes(data, trigger, gram)
                held.append((h[new[row]], keys[row[new[row]]], place[new[row]]))
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        h, key, place = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, key, place = h[order], key[order], place[order]
        cuts = runs(h)
        single = np.repeat(np.diff(cuts) == 1, np.diff(cuts))
        yield settled_rows(key[~single], place[~single], shards, TRIGGERS, (2, 3))
        twice = np.zeros((np.diff(cuts) > 1).sum(), count)
        twice["hash"], twice["n"] = h[cuts[:-1]][np.diff(cuts) > 1], np.diff(cuts)[np.diff(cuts) > 1]
        h, key, place = h[single], key[single], place[single]
        top = np.uint64(64 - shards)
        yield shard_rows([((h >> top).astype(np.int32), [h, key, place]), ((twice["hash"] >> top).astype(np.int32), [twice])], TRIGGERS)

    def settle(batches):
        once, known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)), np.zeros(0, count)
        for shard, rows, last in shard_parts(batches):
            if shard < 0:
                yield passed(shard, rows, (2, 3))
                continue
            h, key, place = (np.concatenate([x, flat(rows.column(c), x.dtype)]) for x, c in zip(once, ("hashes", "keys", "places")))
            twice = np.concatenate([known, flat(rows.column("twice"), count)])
            hashes, which = np.unique(np.concatenate([h, twice["hash"]]), return_inverse=True)
            n = np.bincount(which, np.concatenate([np.ones(len(h)), twice["n"]]), len(hashes)).astype(np.int64)
            hit = n[which[: len(h)]] > 1
            yield bucketed(key[hit], place[hit], shards)
            once = (h[~hit], key[~hit], place[~hit])
            known = np.zeros((n > 1).sum(), count)
            known["hash"], known["n"] = hashes[n > 1], n[n > 1]
            if last:
                hot = known["hash"][known["n"] >= refined_from]
                if len(hot):
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), slices(hot, np.array([0, len(hot)])), slices(place[:0], np.array([0, 0]))], ["bucket", "keys", "values"])
                once, known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)), np.zeros(0, count)

    found = own.select("key", "text").mapInArrow(run, "shard int, hashes binary, keys binary, places binary, twice binary")
    found = found.repartition("shard").sortWithinPartitions("shard").mapInArrow(settle, "bucket int, keys binary, values binary")
    return gathered(found, np.int32, "places")


def _packed(own: DataFrame) -> DataFrame:
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([squeeze((t or "").encode()) for t in texts], pa.binary())], ["doc_id", "key", "packed"]
            )

    return own.mapInArrow(run, "doc_id long, key long, packed binary")


DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()),
])
GOING = pa.schema([*DIGEST, ("key", pa.int64()), ("packed", pa.binary()), ("places", pa.binary())])


def _digest(doc_id, text: bytes, spans: bytes | None, width: int, keep: bool) -> tuple:
    kept, n_spans = text, 0
    if spans:
        pairs = np.frombuffer(spans, np.int32).reshape(-1, 2)
        edges = np.zeros(len(text) + 1, np.int32)
        np.add.at(edges, pairs[:, 0], 1)
        np.add.at(edges, pairs.sum(axis=1) + width - 1, -1)
        gone = np.cumsum(edges[: len(text)], dtype=np.int32) > 0
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return doc_id, len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if keep else None


def _apart(texts: DataFrame, width: int, keep: bool) -> DataFrame:
    """Results of texts none of whose triggers recurs; the others go on."""

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for doc_id, key, z, places in zip(*(batch.slice(k, 256).column(c).to_pylist() for c in ("doc_id", "key", "packed", "places"))):
                    if places is None:
                        out.append((*_digest(doc_id, expand(z), None, width, keep), key, None, None))
                    else:
                        out.append((doc_id, *(None,) * 5, key, z, places))
                yield batch_of(out, GOING)

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, key long, packed binary, places binary")


PHRASES = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("triggers", "phrases", "lengths", "leads", "ids", "keys", "starts", "bytes"))])
KINDS = {"triggers": np.uint64, "phrases": np.uint64, "lengths": np.uint8, "leads": np.uint8, "ids": np.int64, "keys": np.int64, "starts": np.int32}


def _pick(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """The bytes data[start:start + size] of each item, one after the other."""
    out = [np.zeros(0, np.uint8)]
    for k in range(0, len(start), step):
        a, n = start[k : k + step], size[k : k + step]
        ends = np.cumsum(n)
        out.append(data[np.repeat(a - (ends - n), n) + np.arange(ends[-1])])
    return np.concatenate(out)


def refined(data, at, trigger, length, lead, reach: int, width: int, groups: int) -> tuple[np.ndarray, ...]:
    """Phrases cut by the place of the trigger in their windows, in `groups` groups: (which phrase, first window, number of windows, new trigger).

    The new trigger is a hash of the old one, the group, and the bytes that are in each window of the group.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    lead, length = lead.astype(np.int64), length.astype(np.int64)
    edges = [reach * j // groups for j in range(groups + 1)]
    for j, (low, high) in enumerate(zip(edges, edges[1:])):
        a, b = np.maximum(0, lead - high + 1), np.minimum(length - 1, lead - low)
        which = np.flatnonzero(a <= b)
        begin = (at + lead)[which] - low
        order = np.argsort(begin, kind="stable")
        common = np.zeros(len(which), np.uint64)
        common[order] = near_hashes(data, begin[order], begin[order] + low - high + 1 + width)
        out.append((which, a[which], (b - a)[which] + 1, mix(common ^ mix(trigger[which] + np.uint64(j) * SECOND))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _later(group: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which items come strictly later in corpus order than another of their group."""
    order = np.lexsort((starts, ids, group))
    g, i, s = group[order], ids[order], starts[order]
    cuts = runs(g)
    head = np.repeat(cuts[:-1], np.diff(cuts))
    late = np.zeros(len(g), bool)
    late[order] = (i != i[head]) | (s != s[head])
    return late


def suffix_ranks(data: np.ndarray, width: int) -> np.ndarray:
    """Rank of the `width` bytes from each place on among all places, equal for equal bytes: prefix doubling. Places near the end count on zero bytes."""
    padded = np.concatenate([data, np.zeros(width + 8, np.uint8)])
    rank = np.zeros(len(data), np.uint64)
    have = min(8, width)
    for k in range(have):
        rank = (rank << np.uint64(8)) | padded[k : k + len(data)]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while have < width:
        step = min(have, width - have)
        after = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])[: len(rank)] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def _keys(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), KEY)
    out["key"], out["id"] = keys, ids
    return out


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(start, length) of each run of windows in one integer."""
    return np.stack([starts.astype(np.int32), lengths.astype(np.int32)], 1).view(np.int64).ravel()


def _recurring_windows(p: dict, reach: int, width: int, groups: int):
    """(keys, spans) of the windows of phrases p that start earlier in another of them, RANKED_BYTES at a time.

    p has at most one entry for each phrase and place in the corpus. Windows recur only among phrases of one trigger, so whole triggers are ranked
    together; a trigger beyond the limit is refined. With one place for each group all windows are equal.
    """
    _, first = np.unique(np.stack([p["triggers"], p["phrases"]], 1).view("u8,u8").ravel(), return_index=True)
    same, sharing = np.unique(p["triggers"][first], return_counts=True)
    p = {k: (x if k == "bytes" else x[member(p["triggers"], same[sharing > 1])]) for k, x in p.items()}
    order = np.argsort(p["triggers"], kind="stable")
    p = {k: (x if k == "bytes" else x[order]) for k, x in p.items()}
    size = p["lengths"].astype(np.int64) + width - 1
    cuts = runs(p["triggers"])
    ends = np.cumsum(size)[cuts[1:] - 1] if len(size) else np.zeros(0, np.int64)
    k = 0
    while k < len(ends):
        done = ends[k - 1] if k else 0
        m = max(k + 1, int(np.searchsorted(ends, done + RANKED_BYTES, "right")))
        own = slice(cuts[k], cuts[m])
        part = {c: (x if c == "bytes" else x[own]) for c, x in p.items()}
        k = m
        if ends[m - 1] - done > RANKED_BYTES and groups < reach:
            groups_ = GROUPS if groups == 1 else reach
            which, begin, n, trigger = refined(part["bytes"], part["at"], part["triggers"], part["lengths"], part["leads"], reach, width, groups_)
            at = part["at"][which] + begin
            order = np.argsort(at, kind="stable")
            phrases = np.zeros(len(at), np.uint64)
            phrases[order] = near_hashes(part["bytes"], at[order], (at + n)[order] + width - 1)
            fine = {
                "triggers": trigger, "phrases": phrases, "lengths": n, "leads": part["leads"][which] - begin, "ids": part["ids"][which], "keys": part["keys"][which],
                "starts": part["starts"][which] + begin, "at": at, "bytes": part["bytes"],
            }
            late = _later(np.unique(np.stack([trigger, phrases], 1).view("u8,u8").ravel(), return_inverse=True)[1], fine["ids"], fine["starts"])
            yield _keys(fine["keys"][late], fine["ids"][late]), _spans(fine["starts"][late], n[late])
            yield from _recurring_windows({c: (x if c == "bytes" else x[~late]) for c, x in fine.items()}, reach, width, groups_)
            continue
        size = part["lengths"].astype(np.int64) + width - 1
        ranks = suffix_ranks(_pick(part["bytes"], part["at"], size), width)
        n = part["lengths"].astype(np.int64)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = part["starts"].astype(np.int64).repeat(n) + inside
        late = _later(ranks[(np.cumsum(size) - size).repeat(n) + inside], part["ids"].repeat(n), place)
        keys, place = _keys(part["keys"], part["ids"]).repeat(n)[late], place[late]
        if len(keys):
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (place[1:] != place[:-1] + 1)]))
            yield keys[new], _spans(place[new], np.diff(np.append(new, len(keys))))


def _repeats(going: DataFrame, width: int, gram: int, shards: int, hot: np.ndarray) -> DataFrame:
    """(key, id, spans): runs (start, length) of windows that start earlier elsewhere."""
    reach = width - gram + 1
    shared = going.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        held, size = [], 0
        for batch in batches:
            plain = pa.array([expand(z) for z in batch.column("packed").to_pylist()], pa.binary()).cast(pa.string())
            texts = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), plain, batch.column("places")], ["doc_id", "key", "text", "places"])
            for rows, data, offsets in text_slices(texts, "text"):
                row, at, length, place = parse(data, offsets, width, gram)
                lead = place - at
                on = np.zeros(len(row), bool)
                heads, tails = (np.searchsorted(row, np.arange(rows.num_rows), side) for side in ("left", "right"))
                for i in _once(rows).tolist():
                    places = np.frombuffer(rows.column("places")[i].as_py(), np.int32)
                    on[heads[i] + places[places < tails[i] - heads[i]]] = True
                trigger = _trigger_hashes(data, place, gram)
                fine = on & member(trigger, shared.value)
                parts = [(np.flatnonzero(on & ~fine), *(np.zeros((on & ~fine).sum(), np.int64), length[on & ~fine], trigger[on & ~fine]))]
                if fine.any():
                    which, *others = refined(data, at[fine], trigger[fine], length[fine], lead[fine], reach, width, GROUPS)
                    parts.append((np.flatnonzero(fine)[which], *others))
                which, begin, n, trigger = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(at[which] + begin, kind="stable")
                which, begin, n, trigger = which[order], begin[order], n[order], trigger[order]
                begin_at = at[which] + begin
                ids = rows.column("doc_id").fill_null(NO_ID).to_numpy()[row[which]]
                held.append((
                    trigger, near_hashes(data, begin_at, begin_at + n + width - 1), n.astype(np.uint8), (lead[which] - begin).astype(np.uint8), ids,
                    rows.column("key").to_numpy()[row[which]], (begin_at - offsets[row[which]]).astype(np.int32), _pick(data, begin_at, n + width - 1),
                ))
                size += len(held[-1][-1]) + len(data)
                if size >= FLUSH_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        data = np.concatenate([x[-1] for x in held])
        p = {k: np.concatenate(x) for k, x in zip(KINDS, zip(*(x[:-1] for x in held)))}
        held.clear()
        size = p["lengths"].astype(np.int64) + width - 1
        at = np.cumsum(size) - size
        late = _later(np.unique(np.stack([p["triggers"], p["phrases"]], 1).view("u8,u8").ravel(), return_inverse=True)[1], p["ids"], p["starts"])
        yield settled_rows(_keys(p["keys"], p["ids"])[late], _spans(p["starts"], p["lengths"])[late], shards, PHRASES, (6, 7))
        order = np.flatnonzero(~late)
        shard = (p["triggers"][order] >> np.uint64(64 - shards)).astype(np.int32)
        again = np.argsort(shard, kind="stable")
        order, shard = order[again], shard[again]
        data, size = _pick(data, at[order], size[order]), size[order]
        yield shard_rows([(shard, [x[order] for x in p.values()]), (shard.repeat(size), [data])], PHRASES)

    def settle(batches):
        p = None
        for shard, rows, last in shard_parts(batches):
            if shard < 0:
                yield passed(shard, rows, (6, 7))
                continue
            more = {c: flat(rows.column(c), kind) for c, kind in (KINDS | {"bytes": np.uint8}).items()}
            p = more if p is None else {c: np.concatenate([p[c], more[c]]) for c in p}
            del more
            size = p["lengths"].astype(np.int64) + width - 1
            at = np.cumsum(size) - size
            # equal phrases are one entry of the dictionary, at its first place in the corpus
            late = _later(np.unique(np.stack([p["triggers"], p["phrases"]], 1).view("u8,u8").ravel(), return_inverse=True)[1], p["ids"], p["starts"])
            yield bucketed(_keys(p["keys"], p["ids"])[late], _spans(p["starts"], p["lengths"])[late], shards)
            data = _pick(p["bytes"], at[~late], size[~late])
            p = {c: (data if c == "bytes" else x[~late]) for c, x in p.items()}
            del data
            if last:
                size = p["lengths"].astype(np.int64) + width - 1
                for keys, spans in _recurring_windows(p | {"at": np.cumsum(size) - size}, reach, width, 1):
                    yield bucketed(keys, spans, shards)
                p = None

    schema = "shard int, " + ", ".join(f"{c} binary" for c in PHRASES.names[1:])
    phrases = going.select("doc_id", "key", "packed", "places").mapInArrow(run, schema)
    found = phrases.repartition("shard").sortWithinPartitions("shard").mapInArrow(settle, "bucket int, keys binary, values binary")
    return gathered(found, np.int64, "spans", KEY)


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, keep_bytes: bool = True
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): texts without the bytes of strings of `width` bytes that also start earlier.

    Earlier is a smaller doc_id, or the same and an earlier start; null ids, and those that aren't whole numbers, come first. Texts are UTF-8 bytes; null texts are empty.
    Strings never cross texts, may overlap, and are judged on the input. Rows of one id are one document: strings that start
    at the same place in two of them aren't earlier than one another. What is kept may not be UTF-8, so it is binary. Repeated rows
    stay repeated, other columns are ignored, and an empty table gives an empty result. width - gram must be below 128.
    """
    if not 0 < gram < width or width - gram >= 128:
        raise ValueError("gram must be below width, by less than 128")
    own = docs.select(whole_number(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shard_bits(total)
    found = save(_recurring(own, width, gram, shards, max(REFINED_FROM, total // MOST_REFINED)), "recurring")
    hot = np.sort(np.array([r.key for r in found.filter("octet_length(places) = 0").select("key").collect()], np.int64).view(np.uint64))
    recurring = found.filter("octet_length(places) > 0")
    apart = save(_apart(_packed(own.select("doc_id", "key", "text")).join(recurring, "key", "left"), width, keep_bytes), "apart")
    drop(found)
    going = apart.filter("packed is not null")
    spans = save(_repeats(going, width, gram, shards, hot).withColumnRenamed("id", "own_id"), "spans")

    def cut(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = zip(*(batch.slice(k, 256).column(c).to_pylist() for c in ("doc_id", "packed", "spans")))
                yield batch_of([_digest(i, expand(z), s, width, keep_bytes) for i, z, s in rows], DIGEST)

    mine = going.select("doc_id", "key", "packed", F.coalesce("doc_id", F.lit(NO_ID)).alias("own_id")).join(spans, ["key", "own_id"], "left")
    done = mine.select("doc_id", "packed", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return apart.filter("packed is null").select(*[f.name for f in DIGEST]).unionByName(done)
