"""SentencePiece encoding and decoding by batched Viterbi: words of equal length advance together in numpy.

At each end position all words probe the sorted piece keys with the hashes of all substrings that end there; the best total is stored with its start as
backpointer. For a unigram model totals are sums of scores. For a merge (BPE) model a step from one piece to the next is possible only if
merging the two pieces' text by itself gives exactly those two, else it counts minus infinity. A text's merges never cross the
borders of its final pieces, so each pair of neighbours is what merging the pair alone gives, and the other way round: just one path
has possible steps only, and it is the library's encoding. merges() decides pairs of pieces, and those are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASE, BASE_INVERSE, SECOND, mix, powers, tidied
from .work import whole_number

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
UNKNOWN_SURFACE = " ⁇ "
LONG = 40
CACHE, PAIRS = 250_000, 300_000
#: Texts whose new words are learnt together, and texts that are cut into words at a time.
LEARNT, CUT = 4096, 256
NOTHING = np.float64(-np.inf)
#: Bits of a hash below those that number a slot of a table.
TOP = np.uint64(44)


@dataclass
class PieceModel:
    """Pieces of a model file with what encoding needs; small and of fixed size, so it may be broadcast."""

    kind: str
    pieces: list[str]
    scores: np.ndarray
    byte_ids: dict[int, int]
    unknown: int
    hidden: set[int]
    usable: list[int]
    dummy_prefix: bool
    surfaces: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        codes = [np.array([ord(c) for c in self.pieces[i]], np.uint64) for i in self.usable]
        keys = np.array([_hash_one(c) for c in codes], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(self.usable, np.int64)[order]
        self.present = np.zeros(1 << 20, bool)
        self.present[self.keys >> TOP] = True
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.longest = max((len(c) for c in codes), default=1)
        self._encoders: dict[bool, Encoder] = {}
        self.pairs = {self.pieces[i][k : k + 2] for i in self.usable for k in range(len(self.pieces[i]) - 1)}
        self.worst = float(self.scores[self.usable].min()) if self.usable else 0.0
        by_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.surfaces = [
            by_byte.get(i) or (b"" if i in self.hidden else UNKNOWN_SURFACE.encode() if i == self.unknown else p.replace(SPACE, " ").encode())
            for i, p in enumerate(self.pieces)
        ]

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a .model file; raises for normalisation rules other than identity, which this operator doesn't apply."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, {1: "unigram", 2: "bpe"}
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation is supported")
        if proto.trainer_spec.model_type not in kinds or any(p.type == 4 for p in proto.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        pieces = proto.pieces
        return cls(
            kinds[proto.trainer_spec.model_type], [p.piece for p in pieces], np.array([p.score for p in pieces], np.float64),
            {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == 6}, next(i for i, p in enumerate(pieces) if p.type == 2),
            {i for i, p in enumerate(pieces) if p.type == 3}, [i for i, p in enumerate(pieces) if p.type == 1], norm.add_dummy_prefix,
        )

    def encoder(self, by_merges: bool = False) -> Encoder:
        """One encoder for all tasks of a worker, so that words and steps known to one task are known to the next; it holds no more than one of a single task may."""
        if by_merges not in self._encoders:
            self._encoders[by_merges] = Encoder(self, by_merges)
        return self._encoders[by_merges]

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids (-1 if none) and scores by substring hash."""
        ids = np.full(hashes.shape, -1, np.int64)
        maybe = np.nonzero(self.present[hashes >> TOP])  # most substrings are no pieces
        h = hashes[maybe]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        ids[maybe] = np.where(self.keys[at] == h, self.key_ids[at], -1)
        return ids, np.where(ids >= 0, self.scores[ids], NOTHING)


def _hash_one(codes: np.ndarray) -> int:
    total = ((codes + np.uint64(1)) * powers(BASE, len(codes))).sum(dtype=np.uint64)
    return int(mix(np.array([(int(total) + len(codes) * int(SECOND)) % (1 << 64)], np.uint64))[0])


class _Words:
    """Words of one length as a matrix of code points, with substring hashes from prefix sums."""

    def __init__(self, words: list[str]):
        self.n, self.length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(self.n, self.length).astype(np.uint64)
        self.prefix = np.zeros((self.n, self.length + 1), np.uint64)
        np.cumsum((codes + np.uint64(1)) * powers(BASE, self.length), axis=1, out=self.prefix[:, 1:])
        self.back = powers(BASE_INVERSE, self.length + 1)

    def hashes(self, rows, starts, ends) -> np.ndarray:
        h = (self.prefix[rows, ends] - self.prefix[rows, starts]) * self.back[starts]
        return mix(h + (ends - starts).astype(np.uint64) * SECOND)


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def viterbi(words: list[str], model: PieceModel) -> Spans:
    """Word, start, end and id (or -1) of the best pieces of each word, in order; the words have one length.

    At each end position all words try all starts at once; the maximum and its start are the backpointer. A character
    without a piece of its own costs the lowest score less a penalty. On equal scores the longest last piece wins.
    """
    w = _Words(words)
    rows = np.arange(w.n)
    best = np.full((w.n, w.length + 1), NOTHING)
    best[:, 0] = 0
    start_of, id_of = np.zeros((w.n, w.length + 1), np.int64), np.full((w.n, w.length + 1), -1, np.int64)
    for end in range(1, w.length + 1):
        starts = np.arange(max(0, end - model.longest), end)
        grid = np.broadcast_to(starts, (w.n, len(starts)))
        ids, scores = model.probe(w.hashes(rows[:, None], grid, np.full_like(grid, end)))
        scores[:, -1] = np.where(ids[:, -1] < 0, model.worst - UNKNOWN_PENALTY, scores[:, -1])
        total = best[:, starts] + scores
        pick = total.argmax(axis=1)
        best[:, end], start_of[:, end], id_of[:, end] = total[rows, pick], starts[pick], ids[rows, pick]
    return _traced(w, start_of, id_of)


def _traced(w: _Words, start_of: np.ndarray, id_of: np.ndarray) -> Spans:
    """The pieces that the backpointers lead to from the ends of the words."""
    rows = np.arange(w.n)
    steps, ends = [], np.full(w.n, w.length)
    while len(rows):
        steps.append((rows, start_of[rows, ends], ends, id_of[rows, ends]))
        ends = steps[-1][1]
        rows, ends = rows[ends > 0], ends[ends > 0]
    row, start, end, ids = (np.concatenate(x) for x in zip(*steps))
    order = np.lexsort((start, row))
    return row[order], start[order], end[order], ids[order]


class Steps:
    """Which pieces of a merge model may follow one another. -1 stands for a character without a piece, -2 for the start of a word."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}
        self.size = len(model.pieces) + 2
        self.slots, self.answers = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def possible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left + 2) * self.size + right + 2
        slot = (mix(keys.astype(np.uint64)) >> TOP).astype(np.int64)
        out, new = self.answers[slot], np.flatnonzero(self.slots[slot] != keys)
        if len(new):
            asked, which = np.unique(keys[new], return_inverse=True)
            asked = asked.tolist()
            if len(self.known) > PAIRS:
                self.known.clear()
            self._learn([k for k in asked if k not in self.known])
            out[new] = np.array([self.known[k] for k in asked], bool)[which]
            self.answers[slot[new]], self.slots[slot[new]] = out[new], keys[new]
        return out

    def _learn(self, keys: list[int]) -> None:
        by_length: dict[int, list] = {}
        for key in keys:
            left, right = key // self.size - 2, key % self.size - 2
            if right < 0:
                self.known[key] = True  # no piece holds such a character
                continue
            first = self.model.pieces[left] if left >= 0 else ""
            by_length.setdefault(len(first) + len(self.model.pieces[right]), []).append((key, len(first), first + self.model.pieces[right]))
        for group in by_length.values():
            row, start, _, _ = merges([text for _, _, text in group], self.model)
            bounds = np.searchsorted(row, np.arange(len(group) + 1))
            for k, (key, cut, _) in enumerate(group):
                self.known[key] = start[bounds[k] : bounds[k + 1]].tolist() == ([0, cut] if cut else [0])


def merge_viterbi(words: list[str], model: PieceModel, steps: Steps) -> Spans:
    """As viterbi(), for models whose scores are merge ranks: a total is 0 where all steps are possible, else minus infinity."""
    w = _Words(words)
    rows = np.arange(w.n)
    start_of, id_of = np.zeros((w.n, w.length + 1), np.int64), np.full((w.n, w.length + 1), -1, np.int64)
    id_of[:, 0] = -2
    for end in range(1, w.length + 1):
        starts = np.arange(max(0, end - model.longest), end)
        grid = np.broadcast_to(starts, (w.n, len(starts)))
        ids, _ = model.probe(w.hashes(rows[:, None], grid, np.full_like(grid, end)))
        some = ids >= 0
        some[:, -1] = True
        r, c = np.nonzero(some)
        total = np.full(ids.shape, NOTHING)
        total[r, c] = np.where(steps.possible(id_of[r, starts[c]], ids[r, c]), 0.0, NOTHING)
        pick = total.argmax(axis=1)
        start_of[:, end], id_of[:, end] = starts[pick], ids[rows, pick]
    return _traced(w, start_of, id_of)


def merges(words: list[str], model: PieceModel) -> Spans:
    """As viterbi(), for models whose scores are merge ranks: every word makes its best merge (the leftmost of equals) at each step."""
    w = _Words(words)
    n, length = w.n, w.length
    ends = np.broadcast_to(np.arange(1, length + 2), (n, length + 1)).copy()
    before = np.broadcast_to(np.arange(-1, length), (n, length + 1)).copy()
    alive = np.ones((n, length), bool)
    scores = np.full((n, length), NOTHING)
    rows = np.repeat(np.arange(n), length - 1)
    at = np.tile(np.arange(length - 1), n)
    if length > 1:
        scores[rows, at] = model.probe(w.hashes(rows, at, at + 2))[1]
    live = np.arange(n)
    while len(live):
        j = scores[live].argmax(axis=1)
        go = scores[live, j] > NOTHING
        live, j = live[go], j[go]
        if not len(live):
            break
        gone = ends[live, j]
        ends[live, j] = ends[live, gone]
        alive[live, gone], scores[live, gone] = False, NOTHING
        nxt = ends[live, j]
        before[live, nxt] = j
        for left, ok in ((j, nxt < length), (before[live, j], before[live, j] >= 0)):
            r, s = live[ok], left[ok]
            scores[r, s] = model.probe(w.hashes(r, s, ends[r, ends[r, s]]))[1]
        no_next = nxt >= length
        scores[live[no_next], j[no_next]] = NOTHING
    starts = np.flatnonzero(alive)
    r, s = starts // length, starts % length
    e = ends[r, s]
    return r, s, e, model.probe(w.hashes(r, s, e))[0]


class Encoder:
    """Encodes texts by their words; ids of words seen are kept, up to CACHE words.

    by_merges: words of up to LONG characters of a merge model make their merges themselves, at about a third of the Viterbi's time, which learns its steps from merges.
    """

    def __init__(self, model: PieceModel, by_merges: bool = False):
        self.model, self.known, self.steps, self.by_merges = model, {}, Steps(model), by_merges and model.kind == "bpe"

    def _ids(self, word: str, starts, ends, ids) -> bytes:
        """int32 ids of a word's pieces; unknown characters become their bytes, or one unknown id a run."""
        out: list[int] = []
        lone = False
        for s, e, i in zip(starts.tolist(), ends.tolist(), ids.tolist()):
            if i >= 0:
                out.append(i)
            elif self.model.byte_ids:
                out += [self.model.byte_ids[b] for b in word[s:e].encode("utf-8", "surrogatepass")]
            elif not lone:
                out.append(self.model.unknown)
            lone = i < 0
        return np.array(out, np.int32).tobytes()

    def _parts(self, word: str) -> list[str]:
        """Cut where no piece holds both neighbours, so nothing can be joined across."""
        pairs = self.model.pairs
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        merging = self.model.kind == "bpe"
        by_length: dict[int, list[str]] = {}
        cut: dict[str, list[str]] = {}
        if self.by_merges and self.model.byte_ids:  # parts of long words are words like others, as no unknown id can stand for characters of two parts
            cut = {w: self._parts(w) for w in words if len(w) > LONG}
            words = {w for w in words if len(w) <= LONG}.union(*cut.values())
        for word in words:
            if merging and len(word) > LONG:
                self._learn_long(word)
            else:
                by_length.setdefault(len(word), []).append(word)
        for length, group in by_length.items():
            step = max(1, 200_000 // (length + 1))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                self._keep(part, self._spans(part))
        for word, parts in cut.items():
            self.known[word] = b"".join([self.known[p] for p in parts])

    def _spans(self, words: list[str]) -> Spans:
        if self.by_merges and len(words[0]) <= LONG:
            return merges(words, self.model)
        return merge_viterbi(words, self.model, self.steps) if self.model.kind == "bpe" else viterbi(words, self.model)

    def _keep(self, words: list[str], spans: Spans) -> None:
        row, starts, ends, ids = spans
        bounds = np.searchsorted(row, np.arange(len(words) + 1))
        odd = set(row[ids < 0].tolist())
        plain, cuts = ids.astype(np.int32).tobytes(), (4 * bounds).tolist()
        for k, word in enumerate(words):
            if k in odd:
                own = slice(bounds[k], bounds[k + 1])
                self.known[word] = self._ids(word, starts[own], ends[own], ids[own])
            else:
                self.known[word] = plain[cuts[k] : cuts[k + 1]]

    def _learn_long(self, word: str) -> None:
        """Only parts of a long word can merge, so each is a word of its own here."""
        spans, shift = [], 0
        for part in self._parts(word):
            _, starts, ends, ids = self._spans([part])
            spans.append((starts + shift, ends + shift, ids))
            shift += len(part)
        self.known[word] = self._ids(word, *(np.concatenate(x) for x in zip(*spans)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """int32 ids of each text, as bytes."""
        out: list[bytes] = []
        for k in range(0, len(texts), LEARNT):
            group = texts[k : k + LEARNT]
            words = {u for j in range(0, len(group), CUT) for u in {x for t in group[j : j + CUT] for x in self._units(t)}}
            new = words - self.known.keys()
            if len(self.known) + len(new) > CACHE:
                new = words  # all that is known goes
            if new:
                self.learn(new)
            get = self.known.__getitem__
            out += [b"".join(map(get, self._units(t))) for t in group]
        return out

    def _units(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            text = SPACE + text
        if SPACE * 2 not in text and text[0] == SPACE and text[-1] != SPACE and self._spaces_end_words:
            return [SPACE + w for w in text[1:].split(SPACE)]
        return self._cut.findall(text) if self._spaces_end_words else [text]

    _cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)

    @property
    def _spaces_end_words(self) -> bool:
        """No piece has a space mark after another character."""
        if not hasattr(self, "_ends"):
            self._ends = not any(p[1] == SPACE and p[0] != SPACE for p in self.model.pairs)
        return self._ends

    def decode(self, ids) -> str:
        surfaces = self.model.surfaces
        raw = b"".join([surfaces[i] for i in ids])
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def encode_documents(
    docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): piece ids of whole texts, and whether decoding them gives the text again.

    Null and empty texts have no ids and a null text's round trip is null. A text that holds the space mark itself comes back
    with a space there, so its round trip is false. Ids that aren't whole numbers become null. Repeated rows stay repeated; null ids are kept; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        encoder = shared.value.encoder()
        for batch in batches:
            for k in range(0, batch.num_rows, LEARNT):
                part = batch.slice(k, LEARNT)
                texts = part.column(1).to_pylist()
                coded = encoder.encode([t or "" for t in texts])
                same = [None if t is None else encoder.decode(np.frombuffer(c, np.int32).tolist()) == t for t, c in zip(texts, coded)]
                for j in range(0, len(texts), CUT):
                    own = coded[j : j + CUT]
                    sizes = np.array([len(c) // 4 for c in own], np.int64)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(own), np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(j, CUT), pa.array(sizes), ids, pa.array(same[j : j + CUT], pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"]
                    )

    return docs.select(whole_number(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        tidied(run), "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
    )


def decode_documents(coded: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from piece ids; null ids give a null text, and ids outside the model give nothing."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        encoder = Encoder(shared.value)
        top = len(encoder.model.pieces)
        for batch in batches:
            texts = [None if ids is None else encoder.decode([i for i in ids if i is not None and 0 <= i < top]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(whole_number(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
