"""Ranked lexical search: every document is scored for every item in whole numbers, and the best of each item are kept.

Documents are read twice where they lie. The first reading counts, the second scores: item-document-impact arrays of a stretch of documents are concatenated, radix-sorted by a
packed key and summed by runs, and a heap for each item keeps its best. Only counts of terms and the heaps leave a task; heaps meet in ranges of (item, doc_id).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import text_slices, words_of
from .packing import runs
from .work import drop, save, whole_number

#: Bytes of items that tasks get at a time. More items are searched in further blocks, each with its own readings of the documents.
BLOCK_BYTES = 8 << 20
#: Impacts that are sorted at a time, cut between documents; one document has at most as many as a block has (item, term) pairs.
IMPACTS = 1 << 20
#: Bytes that end a term: ASCII but for digits and letters. A to Z count as a to z.
OTHER = np.ones(256, bool)
OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the first one of each text (one more at the end)."""
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets, OTHER)
    if not len(starts):
        return pa.array([], pa.large_binary()), first
    # terms and what stands between them are items of one array over the bytes, of which each second is taken
    bounds = np.ascontiguousarray(np.stack([starts, ends], axis=1)).ravel().astype(np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return every.take(pa.array(np.arange(0, len(bounds) - 1, 2))), first


def matched(data: np.ndarray, offsets: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, how often) of the known terms in each text, by row; and each text's number of terms."""
    terms, first = terms_of(data, offsets)
    at = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[at >= 0]
    keys, n = np.unique(row * np.int64(max(1, len(known))) + at[at >= 0], return_counts=True)
    return keys // max(1, len(known)), keys % max(1, len(known)), n, np.diff(first)


class Items:
    """The terms of a block of items, and for each term the items that hold it, with how often."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("item_id").to_pylist()
        # one slice, whatever its size: the block is bounded
        batches = [x for b in table.combine_chunks().to_batches() for x in text_slices(b, "text")]
        lists = [terms_of(data, offsets) for _, data, offsets in batches]
        every = pa.concat_arrays([terms for terms, _ in lists]) if lists else pa.array([], pa.large_binary())
        self.terms = every.unique()
        item = np.repeat(np.arange(len(self.ids)), np.concatenate([np.diff(first) for _, first in lists]) if lists else [])
        term = pc.index_in(every, value_set=self.terms).to_numpy().astype(np.int64)
        keys, self.times = np.unique(term * np.int64(max(1, len(self.ids))) + item, return_counts=True)
        self.item = keys % max(1, len(self.ids))
        self.starts = np.searchsorted(keys // max(1, len(self.ids)), np.arange(len(self.terms) + 1))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers, by digits of 16 bits, the lowest first; numpy sorts each by radix."""
    order, shift, most = np.arange(len(keys)), 0, int(keys.max(initial=0))
    while most >> shift:
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulated(row: np.ndarray, item: np.ndarray, impact: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, row, score) from concatenated impacts: sorted by packed (item, row), summed by runs."""
    keys = item * np.int64(rows) + row
    order = radix_order(keys)
    keys = keys[order]
    cuts = runs(keys)[:-1]
    return keys[cuts] // rows, keys[cuts] % rows, np.add.reduceat(impact[order], cuts) if len(cuts) else impact[:0]


class Best:
    """A heap for each item: the k highest scores, equal ones by the smaller id, null ids last."""

    def __init__(self, k: int):
        self.k, self.heaps, self.least = k, {}, np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: list) -> None:
        if len(item) and item.max() >= len(self.least):
            self.least = np.concatenate([self.least, np.zeros(int(item.max()) + 1 - len(self.least), np.int64)])
        for i in np.flatnonzero((score > 0) & (score >= self.least[item])).tolist():
            it, doc = int(item[i]), ids[i]
            heap = self.heaps.setdefault(it, [])
            entry = (int(score[i]), doc is not None, -(doc or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[it] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, int | None]]:
        for it, heap in self.heaps.items():
            yield from ((it, score, -doc if known else None) for score, known, doc in heap)


HELD = "item int, item_id long, doc_id long, score long"


def _counts(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """(term, n): of each known term the documents that hold it; at -1 the documents with a term, at -2 all terms."""

    def run(batches):
        df, totals = np.zeros(len(terms), np.int64), [0, 0]
        for batch in batches:
            for _, data, offsets in text_slices(batch, "text"):
                _, term, _, n = matched(data, offsets, terms)
                df += np.bincount(term, minlength=len(terms))
                totals[0] += int(np.count_nonzero(n))
                totals[1] += int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([df[some], totals]))], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _scored(docs: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """HELD rows: the k best documents of each item in each task."""
    used = np.repeat(weights, np.diff(items.starts)) > 0
    kept = {
        "terms": items.terms, "starts": np.concatenate([[0], np.cumsum(used)])[items.starts], "item": items.item[used],
        "weight": (np.repeat(weights, np.diff(items.starts)) * items.times)[used], "ids": items.ids,
    }
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def run(batches):
        of = shared.value
        starts, best = of["starts"], Best(k)
        per = np.diff(starts)
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                row, term, tf, n = matched(data, offsets, of["terms"])
                m = 25 + (75 * n.astype(np.int64) * n_docs) // n_terms
                impact = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 8 * m[row])
                ids = part.column("doc_id")
                upto = np.concatenate([[0], np.cumsum(per[term])])
                first = np.searchsorted(row, np.arange(len(n) + 1))  # a document's first match
                a = 0
                while a < len(n):
                    b = max(a + 1, int(np.searchsorted(upto[first], upto[first[a]] + IMPACTS, "right")) - 1)
                    at = slice(first[a], first[b])
                    times = per[term[at]]
                    where = np.arange(times.sum()) + np.repeat(starts[term[at]] - (upto[at] - upto[first[a]]), times)
                    item, doc, score = accumulated(np.repeat(row[at] - a, times), of["item"][where], np.repeat(impact[at], times) * of["weight"][where], b - a)
                    near = score >= np.concatenate([best.least, np.zeros(len(of["ids"]), np.int64)])[item]
                    best.add(item[near], score[near], ids.take(pa.array(doc[near] + a)).to_pylist())
                    a = b
        out = list(best.rows())
        yield _held([(it, of["ids"][it], doc, score) for it, score, doc in out])

    return docs.mapInArrow(run, HELD)


def _held(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["item", "item_id", "doc_id", "score"])


def _selected(held: DataFrame, k: int) -> DataFrame:
    """The k best of each item of HELD rows: a heap in each range of (item, doc_id), so that no item's rows need meet in a task, then the few that are left."""

    def run(batches):
        best, ids = Best(k), {}
        for batch in batches:
            item = batch.column("item").to_numpy()
            ids.update(zip(item.tolist(), batch.column("item_id").to_pylist()))
            best.add(item.astype(np.int64), batch.column("score").to_numpy(), batch.column("doc_id").to_pylist())
        yield _held([(it, ids[it], doc, score) for it, score, doc in best.rows()])

    ranged = held.repartitionByRange("item", "doc_id").mapInArrow(run, HELD)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return ranged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item with a score above 0, equal scores by smaller id.

    Terms are runs of digits, letters and characters beyond ASCII, A to Z as a to z. Every row of items is searched for by itself, repeated ones too; so is every document, and rows with
    one id can each be found. Null texts have no terms and are neither found nor find any. Ids that aren't whole numbers become null, those of documents come last
    among equal scores. Other columns are ignored, whatever their names. An empty table on either side gives an empty result.

    All arithmetic is in whole numbers of 64 bits, but for a term's weight floor(1000 ln((2N + 2) / (2 df + 1))). A task holds its items' block and about 1 MB of documents, or one longer document.
    """
    spark = docs.sparkSession
    own = docs.select(whole_number(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = items.select(whole_number(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    wanted = save(wanted, "items")
    blocks = -(-(wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    found = None
    for block in range(blocks):
        held = Items(wanted.filter(F.pmod("row", F.lit(blocks)) == block).select("item_id", "text").toArrow())
        counts = {r.term: r.n for r in _counts(own, held.terms).collect()}  # no more rows than the block has terms
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        if not n_terms or not len(held.terms):
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(held.terms))], np.int64)
        scored = save(_scored(own, held, weights, n_docs, n_terms, k), "scored")
        best = save(_selected(scored, k), "best")
        drop(scored)
        found = best if found is None else found.unionByName(best)
    drop(wanted)
    return found if found is not None else spark.createDataFrame([], RESULT)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM lengths),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf CROSS JOIN totals
  WHERE term IN (SELECT term FROM asked) GROUP BY term
), scores AS (
  SELECT item_id, tf.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths ON lengths.doc_id = tf.doc_id CROSS JOIN totals GROUP BY item_id, tf.doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
