"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The symbols of all words of a batch lie in one flat numpy array. Each round ranks the adjacent
pairs, takes the best rank of every word, merges all its leftmost non-overlapping occurrences at
once and compacts the array, until no pair remains. Words that aren't done after a number of rounds
(long ones without a space) go on in rounds that touch only the pairs of one rank and their
neighbours, so that a word's cost grows with its merges, not with its square. Equal words are
encoded once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import slices, text_or_empty

SPACE = "▁"
NO_RANK = np.iinfo(np.int64).max
#: Rounds over whole words; what is left then is merged rank by rank.
WHOLE_ROUNDS = 32
#: A run of word marks and what follows it: no piece of a supported model crosses the end of one.
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@dataclass
class Model:
    """Lookup tables of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    path: str
    pieces: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(self.path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a BPE model with byte fallback, identity normalisation and a dummy prefix is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.pieces = [p.piece for p in proto.pieces]
        known = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in known):
            raise ValueError("a piece crosses words")
        # Ranks order as scores do; equal scores share a rank, so that the leftmost pair is first.
        scores = sorted({proto.pieces[i].score for i in known.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        symbols = dict(known)
        for p in known:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols) - len(known))
        self.size = 1 << (len(self.pieces) + len(symbols)).bit_length()
        pairs = {}
        for p, i in known.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (i, place[proto.pieces[i].score])
        keys = np.array(sorted(pairs), np.int64)
        self.table = _PairTable(keys, np.array([pairs[k][0] for k in keys.tolist()], np.int64), np.array([pairs[k][1] for k in keys.tolist()], np.int64))
        self.unknown = self.size - 1
        top = max(map(ord, (c for c in symbols if len(c) == 1)), default=0) + 2
        self.of_char = np.full(top, self.unknown, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.char_of = np.zeros(self.size, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char_of[i] = ord(s)
        self.n_pieces = len(self.pieces)
        self.byte_ids = np.zeros(256, np.int64)
        self.raw: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.raw.append(b"" if p.type == kinds.CONTROL else p.piece.replace(SPACE, " ").encode())
        self.digits = [str(i).encode() for i in range(len(self.pieces))]


class _PairTable:
    """Open addressing over int64 keys, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray, piece: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        n = 1 << self.bits
        self.keys, self.value = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.piece, self.rank, self.longest = np.append(piece, -1), np.append(rank, NO_RANK), 1
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == -1
            order = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)[1]
            win = order[free[order]]
            self.keys[at[win]], self.value[at[win]] = keys[left[win]], left[win]
            lost = np.ones(len(left), bool)
            lost[win] = False
            left = left[lost]
            slots[left] = (slots[left] + 1) & (n - 1)
            self.longest += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged piece, rank) of every pair; -1 and NO_RANK where the pair doesn't merge."""
        slot = self._slot(keys)
        held = self.keys[slot]
        found = np.where(held == keys, self.value[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        mask = len(self.keys) - 1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return self.piece[found], self.rank[found]


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def merge_rounds(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols and their number per word; words lie one after the other in ``symbols``.

    A word merges all leftmost occurrences of its best pair at once, unless one of the symbols so
    made would pair up at the same or a better rank: then only the leftmost one is merged in this
    round, because a queue would take the new pair first. Words without a pair leave the rounds.
    """
    n_words = len(lengths)
    done_word, done_symbol = [], []
    word = np.repeat(np.arange(n_words), lengths)
    sym, rounds = symbols, 0
    while len(sym):
        if rounds == WHOLE_ROUNDS:
            sym, word = ranked_rounds(model, sym, word)
            done_word.append(word)
            done_symbol.append(sym)
            break
        rounds += 1
        n = len(sym)
        piece, rank = np.full(n, -1, np.int64), np.full(n, NO_RANK, np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        piece[inside], rank[inside] = model.table.find(sym[inside] * model.size + sym[inside + 1])
        first = np.ones(n, bool)
        first[1:] = word[1:] != word[:-1]
        starts = np.flatnonzero(first)
        best = np.minimum.reduceat(rank, starts)
        local = np.cumsum(first) - 1
        over = best == NO_RANK
        if over.any():
            stay = over[local]
            done_word.append(word[stay])
            done_symbol.append(sym[stay])
            go = ~stay
            word, sym, piece, rank, local = word[go], sym[go], piece[go], rank[go], local[go]
            if not len(sym):
                break
            n = len(sym)
        hit = rank == best[local]
        # In a run of hits that overlap, every second one merges.
        at = np.flatnonzero(hit)
        new_run = np.ones(len(at), bool)
        new_run[1:] = at[1:] != at[:-1] + 1
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        owner = word[at]
        several = np.zeros(len(at), bool)
        several[1:] |= owner[1:] == owner[:-1]
        several[:-1] |= owner[1:] == owner[:-1]
        if several.any():
            at = _without_rivals(model, sym, word, piece, best[local], at, several)
        sym[at] = piece[at]
        keep = np.ones(n, bool)
        keep[at + 1] = False
        sym, word = sym[keep], word[keep]
    if not done_word:
        return symbols[:0], np.zeros(n_words, np.int64)
    word, sym = np.concatenate(done_word), np.concatenate(done_symbol)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n_words)


def _without_rivals(model: Model, sym: np.ndarray, word: np.ndarray, piece: np.ndarray, best: np.ndarray, at: np.ndarray, several: np.ndarray) -> np.ndarray:
    """``at`` without the later merges of words in which a merge would make a pair of the same or a better rank."""
    made = np.zeros(len(sym), bool)
    made[at] = True
    gone = np.zeros(len(sym), bool)
    gone[at + 1] = True
    view = np.where(made, piece, sym)
    # Every neighbour that a new symbol may meet: its state before and after the other merges of the round.
    m = at[several]
    rival = np.zeros(len(m), bool)
    left = m - 1
    ok = (left >= 0) & (word[left] == word[m])
    for other in (sym, view):
        before = np.where(ok & gone[left] & (other is view), left - 1, left)
        rival |= ok & (model.table.find(other[before] * model.size + piece[m])[1] <= best[m])
    right = np.minimum(m + 2, len(sym) - 1)
    ok = (m + 2 < len(sym)) & (word[right] == word[m])
    for other in (sym, view):
        rival |= ok & (model.table.find(piece[m] * model.size + other[right])[1] <= best[m])
    bad = np.unique(word[m[rival]])
    first = np.ones(len(at), bool)
    first[1:] = word[at[1:]] != word[at[:-1]]
    return at[first | ~np.isin(word[at], bad)]


def ranked_rounds(model: Model, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of all words, and the word of each; the same order of merges, one rank a round.

    Symbols are linked to their neighbours and pairs wait by rank. A round takes the best rank that
    waits anywhere, merges its leftmost pairs that don't overlap, and ranks the pairs so made. A rank
    can come back when a merge makes a better pair; words don't touch one another, so each still
    sees its own pairs in the order of a queue.
    """
    n = len(sym)
    sym = sym.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[np.append(word[1:] != word[:-1], True)] = -1
    before[np.append(True, word[1:] != word[:-1])] = -1
    piece, rank, alive = np.full(n, -1, np.int64), np.full(n, NO_RANK, np.int64), np.ones(n, bool)
    made, gone = np.zeros(n, bool), np.zeros(n, bool)  # marks within one round
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def ranked(at: np.ndarray) -> None:
        """Ranks the pairs that begin at ``at`` and lets them wait."""
        last = after[at] < 0
        piece[at[last]], rank[at[last]] = -1, NO_RANK
        at = at[~last]
        piece[at], rank[at] = model.table.find(sym[at] * model.size + sym[after[at]])
        at = at[rank[at] != NO_RANK]
        wait(at[np.argsort(rank[at], kind="stable")])

    def wait(at: np.ndarray) -> None:
        r = rank[at]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for part in np.split(at, cuts) if len(cuts) else [at] if len(at) else []:
            key = int(rank[part[0]])
            if key not in waiting:
                waiting[key] = []
                heapq.heappush(ranks, key)
            waiting[key].append(part)

    ranked(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        held = waiting.pop(r)
        at = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
        at = at[rank[at] == r]
        if not len(at):
            continue
        # In a run of pairs that overlap, every second one merges.
        new_run = np.ones(len(at), bool)
        new_run[1:] = at[1:] != after[at[:-1]]
        k = np.arange(len(at))
        at = at[(k - np.maximum.accumulate(np.where(new_run, k, 0))) % 2 == 0]
        owner = word[at]
        if len(at) > 1 and (owner[1:] == owner[:-1]).any():
            at, put_off = _leftmost_of_rivals(model, sym, word, piece, after, before, r, at, made, gone)
            wait(put_off)
        dead = after[at]
        beyond = after[dead]
        sym[at] = piece[at]
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        alive[dead], rank[dead] = False, NO_RANK
        left = before[at]
        ranked(np.unique(np.concatenate([at, left[left >= 0]])))
    return sym[alive], word[alive]


def _leftmost_of_rivals(model: Model, sym, word, piece, after, before, r: int, at: np.ndarray, made: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs to merge now, pairs to put off): where a merge of a word would make a pair of rank ``r`` or better, only the word's leftmost pair goes first."""
    made[at], gone[after[at]] = True, True
    rival = np.zeros(len(at), bool)
    left = before[at]
    ok = left >= 0
    rival[ok] |= model.table.find(sym[left[ok]] * model.size + piece[at[ok]])[1] <= r
    ok &= gone[left]  # the merge to the left takes the neighbour
    rival[ok] |= model.table.find(piece[before[left[ok]]] * model.size + piece[at[ok]])[1] <= r
    right = after[after[at]]
    ok = right >= 0
    rival[ok] |= model.table.find(piece[at[ok]] * model.size + sym[right[ok]])[1] <= r
    ok &= made[right]
    rival[ok] |= model.table.find(piece[at[ok]] * model.size + piece[right[ok]])[1] <= r
    made[at], gone[after[at]] = False, False
    if not rival.any():
        return at, at[:0]
    first = np.ones(len(at), bool)
    first[1:] = word[at[1:]] != word[at[:-1]]
    now = first | ~np.isin(word[at], word[at[rival]])
    return at[now], at[~now]


def encode_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of all words, end to end, and their number per word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    symbols = model.of_char[np.minimum(chars, len(model.of_char) - 1)]
    merged, counts = merge_rounds(model, symbols, lengths)
    odd = np.flatnonzero(merged >= model.n_pieces)
    if not len(odd):
        return merged, counts
    # Unknown characters never merge, so they are still there and in order.
    codes = model.char_of[merged[odd]]
    codes[merged[odd] == model.unknown] = chars[symbols == model.unknown]
    widths = np.ones(len(merged), np.int64)
    widths[odd] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    out = np.repeat(merged, widths)
    ends = np.cumsum(widths)
    inside = np.zeros(len(out), np.int64)
    inside[ends[odd] - widths[odd]] += 1
    at_end = ends[odd]
    inside = np.cumsum(inside) - np.cumsum(np.bincount(at_end, minlength=len(out) + 1)[: len(out)])
    octets = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    out[inside > 0] = model.byte_ids[octets]
    totals = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return out, np.diff(totals)


class Encoder:
    """Encodes batches of texts; words met before are looked up until ``most`` different ones are held, then all are forgotten."""

    def __init__(self, model: Model, most: int = 1 << 19):
        self.model, self.most = model, most
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words without their first mark, which all have."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[-1] == " " or text[0] == " ":
            return [w[1:] for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Identifiers of each text; an empty text has none."""
        split = [self._words(t) for t in texts]
        flat = list(chain.from_iterable(split))
        if len(self.number) > self.most:
            self._forget()
        new = [w for w in dict.fromkeys(flat) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            ids, counts = encode_words(self.model, [SPACE + w for w in new])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        order = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        n = self.counts[order]
        ends = np.cumsum(n)
        every = self.ids[np.repeat(self.starts[order] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[np.cumsum([len(ws) for ws in split])] if texts else []
        return np.split(every, stops[:-1]) if texts else []


def decode(model: Model, ids: list[int]) -> str:
    """The text of ``ids``: pieces with word marks as spaces, without the dummy prefix; bytes that are no UTF-8 become U+FFFD."""
    if not ids:
        return ""
    raw = b"".join(map(model.raw.__getitem__, ids))
    text = raw.decode("utf-8", "replace")
    return text[1:] if model.pieces[ids[0]].startswith(SPACE) else text


def encoded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int) and decoded (string).

    * Null or empty text: no identifiers, decoded empty. Characters outside the vocabulary become bytes.
    * Repeated rows and null doc_ids are returned as they are; only the two columns are read.
    * There is no shuffle; batches are encoded in slices bounded by rows and bytes. An empty table gives none.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        encoder = Encoder(m)
        for batch in slices(batches):
            ids = encoder.batch(batch.column("text").to_pylist())
            texts = [decode(m, x.tolist()) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    src = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    return src.mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", doc_id)
