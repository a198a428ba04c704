"""Quality rules: base text counts and language-specific perplexity bands of a modified Kneser-Ney model.

The model counts n-grams of a tokenizer's pieces where one is given, PIECE_ORDER of them; texts are encoded once and the pieces written. Without one it counts n-grams of ORDER
symbols out of SYMBOL_COUNT, so a language has at most SYMBOL_COUNT ** ORDER of them (5.3 million), however large
the corpus. The order is the same at every size. Each text is scored by the model of the other half of the texts, so no text is known
from its own counts. Costs are whole numbers of 1/UNIT bit, so sums, medians and verdicts are the same for any partitioning.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from .arrays import SECOND, WHITE, byte_hashes, covered, mix, range_hashes, text_slices, tidied, windows_of, words_of
from .pieces import PieceModel
from .work import drop, save, whole_number

ORDER = 4
#: Of 2, 3 and 4 pieces, two tell the labelled texts apart best (README).
PIECE_ORDER = 2
#: The symbol of each byte. 0 stands before a text; letters by name, whatever their case; digits; white space; marks; bytes beyond ASCII by their role.
SYMBOL_COUNT, BITS = 48, 6
SYMBOL = np.full(256, 34, np.uint8)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[48:58] = 27
SYMBOL[32] = 28
SYMBOL[[9, 10, 11, 12, 13]] = 29
for _symbol, _marks in ((30, b"."), (31, b",;:"), (32, b"!?"), (33, b"'\"()-")):
    SYMBOL[np.frombuffer(_marks, np.uint8)] = _symbol
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 35
SYMBOL[128:192] = 36 + np.arange(64) % 8
SYMBOL[192:224] = 44 + np.arange(32) // 16
SYMBOL[224:240] = 46
SYMBOL[240:] = 47
UNIT = 1024
#: Entries of the models that are sent to tasks at once; further languages are scored in a round of their own.
ROUND_ENTRIES = 8_000_000
#: The median is that of the bits in steps of 2 ** (1 / CELLS), so exact to 1 in 11,000 at any size.
CELLS = 4096
STEP = 1 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
#: Bytes of letters and digits; every byte of a character beyond ASCII counts as one. Characters from U+3000 on, whose first byte is ALONE at least, are written without spaces and
#: count each by itself.
ALONE = 0xE3
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NEW_ROWS = 1 << 20


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, its symbol and the order - 1 before it packed into an integer; zeros stand before a text. offsets below 0 are texts that began before data."""
    wide = SYMBOL[data].astype(np.int32)
    out = wide.copy()
    for k in range(1, order):
        out[k:] |= wide[: max(0, len(wide) - k)] << (BITS * k)
    for k in range(order - 1):
        at = offsets[:-1] + k
        at = at[(offsets[:-1] >= 0) & (at < np.minimum(offsets[1:], len(data)))]
        out[at] &= (1 << BITS * (k + 1)) - 1
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, order: int):
    """(place, grams) of the bytes, a stretch at a time."""
    for k in range(0, len(data), STEP):
        low = max(0, k - order + 1)
        yield k, grams(data[low : k + STEP], offsets - low, order)[k - low :]


def _sum_runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def failed(n_words, n_repeat_words, min_words: int):
    """The base rule, for columns and for arrays."""
    return (n_words < min_words) | (100 * n_repeat_words > 30 * n_words)


def _summed(kinds):
    """Batches of (lang, half, g, c) from ((lang, half), grams) of stretches, sums of at most NEW_ROWS grams held."""
    held: dict[tuple, tuple] = {}

    def rows(key):
        grams_, counts = held.pop(key)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(grams_)), pa.array(np.full(len(grams_), key[1], np.int32)), pa.array(grams_), pa.array(counts)], ["lang", "half", "g", "c"])

    for kind, g in kinds:
        new = np.sort(g)
        if len(new):
            first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
            old = held.get(kind, (new[:0], np.zeros(0, np.int64)))
            held[kind] = _sum_runs(np.concatenate([old[0], new[first]]), np.concatenate([old[1], np.diff(np.append(first, len(new)))]))
        while sum(len(g) for g, _ in held.values()) > NEW_ROWS:
            yield rows(max(held, key=lambda x: len(held[x][0])))
    for kind in list(held):
        yield rows(kind)


def count_grams(docs: DataFrame, order: int = ORDER, min_words: int = 20) -> DataFrame:
    """(lang, half, g, c) from docs(lang, half, text): how often each n-gram of the highest order occurs in the texts that pass the base rule."""

    def stretches(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                counts = base_counts(data, offsets)
                good = ~failed(counts[0], counts[4], min_words)
                kinds = list(zip(part.column("lang").to_pylist(), part.column("half").to_pylist()))
                for kind in set(kinds):
                    own = np.array([k == kind for k in kinds]) & good
                    wanted = np.repeat(own, np.diff(offsets))
                    for k, g in _pieces(data, offsets, order):
                        yield kind, g[wanted[k : k + len(g)]]

    return docs.mapInArrow(tidied(lambda batches: _summed(stretches(batches))), "lang string, half int, g int, c long").groupBy("lang", "half", "g").agg(F.sum("c").alias("c"))


def encoded(docs: DataFrame, pieces: PieceModel) -> DataFrame:
    """docs(lang, half, text and others) with COUNTS, runs (of letters and digits, see ALONE) and ids, the text's pieces as the bytes of whole numbers of piece_type()."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(pieces), piece_type(pieces)

    def run(batches):
        encoder = shared.value.encoder(by_merges=True)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                ids = [np.frombuffer(x, np.int32).astype(kind).tobytes() for x in encoder.encode([t or "" for t in rows.column("text").to_pylist()])]
                counts = [c.astype(np.int64) for c in (*base_counts(data, offsets), _runs(data, offsets))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, counts), pa.array(ids, pa.binary())], [*rows.schema.names, *COUNTS, "runs", "ids"])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, *METRICS[:-1], StructField("runs", LongType()), StructField("ids", BinaryType())]))


def piece_type(pieces: PieceModel) -> type:
    return np.uint16 if len(pieces.pieces) <= 1 << 16 else np.int32


def piece_bits(pieces: PieceModel) -> int:
    """Bits of a piece in a gram: 0 stands before a text, piece i is i + 1."""
    return len(pieces.pieces).bit_length()


def piece_stretches(batch: pa.RecordBatch, kind: type, order: int, bits: int):
    """(rows, grams, bounds) of an encoded batch, about STEP pieces at a time: for each piece, it and the order - 1 before it in its text packed into an integer."""
    column = batch.column(batch.schema.get_field_index("ids"))
    sizes = pc.binary_length(column).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
    upto = np.concatenate([[0], np.cumsum(sizes)])
    row = 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(upto, upto[row] + STEP, "right")) - 1)
        bounds = upto[row : end + 1] - upto[row]
        ids = np.frombuffer(b"".join(column.slice(row, end - row).to_pylist()), kind).astype(np.int64) + 1
        g = ids.copy()
        place = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
        for k in range(1, order):
            g[k:] |= np.where(place[k:] >= k, ids[: len(ids) - k], 0) << (bits * k)
        yield batch.slice(row, end - row), g, bounds
        row = end


def count_piece_grams(docs: DataFrame, pieces: PieceModel, order: int = PIECE_ORDER, min_words: int = 20) -> DataFrame:
    """count_grams() of pieces, from what encoded() gives."""
    kind, bits = piece_type(pieces), piece_bits(pieces)

    def stretches(batches):
        for batch in batches:
            for rows, g, bounds in piece_stretches(batch, kind, order, bits):
                kinds = list(zip(rows.column("lang").to_pylist(), rows.column("half").to_pylist()))
                for own in set(kinds):
                    yield own, g[np.repeat([k == own for k in kinds], np.diff(bounds))]

    good = docs.filter(~failed(F.col("n_words"), F.col("n_repeat_words"), min_words)).select("lang", "half", "ids")
    return good.mapInArrow(tidied(lambda batches: _summed(stretches(batches))), "lang string, half int, g long, c long").groupBy("lang", "half", "g").agg(F.sum("c").alias("c"))


class HashArray:
    """Costs by 64-bit hash: sorted hashes, and for each possible top part of a hash where its run starts."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        hashes = mix(keys.astype(np.uint64))  # a bijection, so two grams never share a hash
        order = np.argsort(hashes)
        self.hashes, self.costs = hashes[order], costs[order].astype(np.int32)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.starts).max(initial=0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs of the keys, and which keys are known."""
        out, known = np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        if not len(self.hashes):
            return out, known
        h = mix(keys.astype(np.uint64))
        at = self.starts[h >> self.shift]
        todo = None
        for _ in range(self.longest):
            at_ = np.minimum(at, len(self.hashes) - 1)
            hit = self.hashes[at_] == h
            where = np.flatnonzero(hit) if todo is None else todo[hit]
            out[where] = self.costs[at_[hit]]
            known[where] = True
            rest = ~hit
            todo = np.flatnonzero(rest) if todo is None else todo[rest]
            if not len(todo):
                break
            at, h = at[rest] + 1, h[rest]
        return out, known


def _discounts(c: np.ndarray) -> np.ndarray:
    """Discount of each count: the usual ones of modified Kneser-Ney from the numbers of counts 1 to 4, within 0.1 and the count; 0.5 where those are missing."""
    n = [np.count_nonzero(c == i) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else None
    d = [0.5 if y is None or not n[i] else min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 1) for i in range(3)]
    return np.array(d)[np.minimum(c, 3) - 1]


def kneser_ney(g: np.ndarray, c: np.ndarray, order: int = ORDER, bits: int = BITS, size: int = SYMBOL_COUNT) -> list[tuple[np.ndarray, ...]]:
    """For orders 1 to `order`: grams, costs of their last symbols, contexts, costs of backing off from them.

    g are all grams of the highest order, sorted, and c their counts; an item has so many bits, and one of `size` values. Orders below count the different symbols that stand before a gram.
    """
    levels = [(g.astype(np.int64), c)]
    for k in range(order - 1, 0, -1):
        levels.insert(0, np.unique(levels[0][0] & ((1 << bits * k) - 1), return_counts=True))
    out, lower = [], None
    for k, (keys, counts) in enumerate(levels, 1):
        d = _discounts(counts)
        ctx, which = np.unique(keys >> bits, return_inverse=True)
        total = np.bincount(which, counts)
        gamma = np.bincount(which, d) / total
        below = 1 / size if lower is None else lower[1][np.searchsorted(lower[0], keys & ((1 << bits * (k - 1)) - 1))]
        p = (counts - d) / total[which] + gamma[which] * below
        lower = (keys, p)
        out.append((keys, np.rint(-UNIT * np.log2(p)).astype(np.int32), ctx, np.rint(-UNIT * np.log2(gamma)).astype(np.int32)))
    return out


def build_model(docs: DataFrame, order: int = ORDER, min_words: int = 20, pieces: PieceModel | None = None) -> DataFrame:
    """(lang, half, entries, model): the tables of kneser_ney() over the texts of docs(lang, half, text), or of what encoded() gives, by language and half."""
    bits, size = (BITS, SYMBOL_COUNT) if pieces is None else (piece_bits(pieces), len(pieces.pieces))

    def tables(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g, c = table.column("g").to_numpy(), table.column("c").to_numpy()
        by = np.argsort(g)
        out = io.BytesIO()
        levels = kneser_ney(g[by], c[by], order, bits, size)
        np.savez(out, **{f"{k}{i}": x for k, level in enumerate(levels) for i, x in enumerate(level)})
        entries = sum(len(level[0]) + len(level[2]) for level in levels)
        return pa.table({"lang": [key[0].as_py()], "half": pa.array([key[1].as_py()], pa.int32()), "entries": [entries], "model": pa.array([out.getvalue()], pa.binary())})

    counts = count_grams(docs, order, min_words) if pieces is None else count_piece_grams(docs, pieces, order, min_words)
    return save(counts.groupBy("lang", "half").applyInArrow(tables, "lang string, half int, entries long, model binary"), "model")


def read_model(data: bytes, order: int = ORDER) -> list[tuple[HashArray, HashArray]]:
    held = np.load(io.BytesIO(data))
    return [(HashArray(held[f"{k}0"], held[f"{k}1"]), HashArray(held[f"{k}2"], held[f"{k}3"])) for k in range(order)]


def costs_of(g: np.ndarray, tables: list[tuple[HashArray, HashArray]], bits: int = BITS, size: int = SYMBOL_COUNT) -> np.ndarray:
    """Cost of each packed gram's last symbol: the longest known gram's, with those of the contexts skipped."""
    out = np.zeros(len(g), np.int32)
    left = np.arange(len(g))
    for k in range(len(tables), 0, -1):
        keys = g[left] & ((1 << bits * k) - 1)
        found, known = tables[k - 1][0].find(keys)
        out[left[known]] += found[known]
        left, keys = left[~known], keys[~known]
        if not len(left):
            return out
        out[left] += tables[k - 1][1].find(keys >> bits)[0]
    out[left] += int(np.rint(UNIT * np.log2(size)))
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _row_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order, and which sorted items equal the one before or after in the same row."""
    keys = mix(hashes ^ mix((row + 1).astype(np.uint64) * SECOND))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not len(keys):
        return order, same, same
    return order, np.concatenate([[False], same]), np.concatenate([same, [False]])


def base_counts(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> list[np.ndarray]:
    """COUNTS of each text in the bytes."""
    starts, ends, first = words_of(data, offsets)
    rows = np.arange(len(offsets) - 1)
    chars = ~WHITE[data] & ((data & 0xC0) != 0x80)
    feeds = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_rows = np.repeat(rows, np.bincount(np.searchsorted(offsets, feeds, "right") - 1, minlength=len(rows)) + 1)
    line_ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines, line_rows = byte_hashes(data, line_starts[with_word], line_ends[with_word]), line_rows[with_word]
    order, again, _ = _repeats(lines, line_rows)
    dup_lines = np.bincount(line_rows[order[again]], minlength=len(rows))
    at = windows_of(first, window)
    hashes = range_hashes(byte_hashes(data, starts, ends), at, at + window)
    order, before, after = _repeats(hashes, np.searchsorted(first, at, "right") - 1)
    repeated = covered(at[order[before | after]], window, len(starts))
    return [np.diff(first), _row_sums(chars, offsets), _row_sums(SYMBOLS[data], offsets), dup_lines, _row_sums(repeated, first)]


def _runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of letters and digits of each text, see ALONE."""
    runs = LETTERS[data]
    runs[1:] &= ~runs[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    runs[at] = LETTERS[data[at]]
    runs |= data >= ALONE
    return _row_sums(runs, offsets)


METRICS = [*(StructField(c, LongType()) for c in COUNTS), StructField("bits", DoubleType())]


def score(docs: DataFrame, models: dict, order: int = ORDER) -> DataFrame:
    """docs(row, lang, half, text) with COUNTS and bits: the cost in bits of the text over its runs of letters and digits (see ALONE), by the model of the other half.

    What stands between and inside words counts too and raises the figure; null if there is no such run.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own_models: dict[tuple, list] = {}
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                counts = base_counts(data, offsets)
                kinds = list(zip(rows.column("lang").to_pylist(), rows.column("half").to_pylist()))
                total = np.zeros(len(kinds), np.int64)
                kind_of = {kind: i for i, kind in enumerate(set(kinds))}
                byte_kinds = np.repeat([kind_of[k] for k in kinds], np.diff(offsets))
                for kind, i in kind_of.items():
                    if kind not in own_models:
                        data_ = shared.value.get((kind[0], 1 - kind[1]))
                        own_models[kind] = read_model(data_, order) if data_ else []
                for k, g in _pieces(data, offsets, order):
                    cost = np.zeros(len(g), np.int32)
                    for kind, i in kind_of.items():
                        own = np.flatnonzero(byte_kinds[k : k + len(g)] == i)
                        cost[own] = costs_of(g[own], own_models[kind])
                    total += _row_sums(cost, np.clip(offsets - k, 0, len(g)))
                tokens = _runs(data, offsets)
                bits = pa.array(total / UNIT / np.maximum(tokens, 1), mask=tokens == 0)
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, (c.astype(np.int64) for c in counts)), bits], [*rows.schema.names, *COUNTS, "bits"])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, *METRICS]))


def score_pieces(docs: DataFrame, models: dict, pieces: PieceModel, order: int = PIECE_ORDER) -> DataFrame:
    """score() by pieces: what encoded() gives, with bits in place of runs and ids."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind, bits, size = piece_type(pieces), piece_bits(pieces), len(pieces.pieces)
    fields = [f for f in docs.schema.fields if f.name not in ("runs", "ids")]

    def run(batches):
        own_models: dict[tuple, list] = {}
        for batch in batches:
            for rows, g, bounds in piece_stretches(batch, kind, order, bits):
                kinds = list(zip(rows.column("lang").to_pylist(), rows.column("half").to_pylist()))
                cost = np.zeros(len(g), np.int32)
                for own in set(kinds):
                    if own not in own_models:
                        data = shared.value.get((own[0], 1 - own[1]))
                        own_models[own] = read_model(data, order) if data else []
                    at = np.flatnonzero(np.repeat([k == own for k in kinds], np.diff(bounds)))
                    cost[at] = costs_of(g[at], own_models[own], bits, size)
                runs = rows.column("runs").to_numpy()
                bits_ = pa.array(_row_sums(cost, bounds) / UNIT / np.maximum(runs, 1), mask=runs == 0)
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in fields), bits_], [*(f.name for f in fields), "bits"])

    return docs.mapInArrow(tidied(run), StructType([*fields, METRICS[-1]]))


def _judged(
    docs: DataFrame, row: Column, text_col: str, lang_col: str, order: int | None, upper: float, lower: float, min_words: int, with_text: bool, pieces: PieceModel | None,
) -> DataFrame:
    """row, text (null unless asked for), COUNTS, base_failed, kept, bits, lo and hi of each document."""
    text = F.col(text_col).cast("string")
    own = docs.select(
        row.alias("row"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"), text.alias("text")
    )
    order = order or (ORDER if pieces is None else PIECE_ORDER)
    if pieces is None:
        model = build_model(own.select("lang", "half", "text"), order, min_words)
    else:
        own = encoded(own, pieces)
        own = save(own if with_text else own.drop("text"), "encoded", "zstd")
        model = build_model(own, order, min_words, pieces)
    rounds: list[list[str]] = [[]]
    size = 0
    # a language's entries are bounded, so only a list of languages and their sizes grows
    for r in model.groupBy("lang").agg(F.sum("entries").alias("entries")).orderBy("lang").toLocalIterator():
        if rounds[-1] and size + r.entries > ROUND_ENTRIES:
            rounds.append([])
            size = 0
        rounds[-1].append(r.lang)
        size += r.entries
    scored = None
    for i, langs in enumerate(rounds):
        models = {(r.lang, r.half): bytes(r.model) for r in model.filter(F.col("lang").isin(langs)).toLocalIterator()}
        first = i == 0  # also takes the languages without a model, whose texts all fail the base rule
        others = [x for other in rounds[1:] for x in other]
        part = own.filter(~F.col("lang").isin(others)) if first and others else own if first else own.filter(F.col("lang").isin(langs))
        part = score(part, models, order) if pieces is None else score_pieces(part, models, pieces, order)
        scored = part if scored is None else scored.unionByName(part)
    scored = scored.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"), min_words))
    scored = save(scored if with_text else scored.drop("text"), "scored")
    if pieces is not None:
        drop(own)
    cell = F.floor(F.log2(F.greatest("bits", F.lit(1 / UNIT))) * CELLS).alias("cell")
    cells = scored.filter("not base_failed and bits is not null").groupBy("lang", cell).agg(F.count("*").alias("n"))
    upto = cells.withColumns({
        "upto": F.sum("n").over(Window.partitionBy("lang").orderBy("cell")), "all": F.sum("n").over(Window.partitionBy("lang"))
    })
    middle = upto.filter(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.pow(2.0, (F.min("cell") + 0.5) / CELLS).alias("middle"))
    bands = save(middle.select("lang", (lower * F.col("middle")).alias("lo"), (upper * F.col("middle")).alias("hi")), "bands")
    kept = ~F.col("base_failed") & F.col("bits").between(F.col("lo"), F.col("hi"))
    return scored.join(bands, "lang", "left").withColumn("kept", F.coalesce(kept, F.lit(False)))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int | None = None,
    upper: float = 1.25, lower: float = 0.6, min_words: int = 20, pieces: PieceModel | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, bits, low_bits, high_bits.

    The model's n-grams are of the pieces of the tokenizer `pieces`, or of symbols where none is given. It is counted over all texts that pass the base rule, by language and by half (a hash of the text says which, so equal texts are in one); a text
    is scored by the other half of its language. A language's band goes from `lower` to `upper` times the median bits (log2 of perplexity, by
    word, or by character where there are no spaces) of its documents that pass the base rule; outside it a document is rejected. A null language is the language "und"; null and
    empty texts have no words and fail the base rule; a language with no document that passes has no band, and one whose documents that pass
    are all in one half (a single one, or copies) costs them the same for every byte. Repeated rows are rows of
    their own; ids that aren't whole numbers become null; other columns are ignored, whatever their names. An empty table gives an empty result. Of
    a text of any length, counts take about 30 bytes a byte of it in a task, scores a constant.
    """
    judged = _judged(docs, F.struct(whole_number(id_col).alias("doc_id")), text_col, lang_col, order, upper, lower, min_words, False, pieces)
    return judged.select(
        "row.doc_id", *COUNTS, "base_failed", "kept", "bits", F.col("lo").alias("low_bits"), F.col("hi").alias("high_bits"),
    )


def quality_filter(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int | None = None, upper: float = 1.25, lower: float = 0.6, min_words: int = 20, pieces: PieceModel | None = None,
) -> DataFrame:
    """The rows of docs that the rules keep, each judged by itself; ids play no part. Columns keep their names, types and order."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(0).alias("nothing"))
    judged = _judged(docs, row, text_col, lang_col, order, upper, lower, min_words, True, pieces)
    kind = docs.schema[text_col].dataType
    return judged.filter("kept").select(*[F.col("text").cast(kind).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
