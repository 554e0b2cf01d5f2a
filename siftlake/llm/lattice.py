"""Lattices of a unigram vocabulary over texts, many at a time.

A text is cut where no piece can cross: before each run of the word mark, at line ends, and between a word of letters and a
comma or full stop, if the vocabulary has no piece over that place. So the best and the sampled segmentations of a text
are those of its cuts side by side, and equal cuts share one lattice. An Aho-Corasick automaton over the vocabulary lists the
pieces that end at every place (for the forward pass); a trie, walked from all places at once, lists those that begin there
(for sampling). A character that no piece covers alone is an unknown of one character, which is spelt in bytes.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np

MARK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class Trie:
    """Children by (state, character) in one open-addressed table, so that many places step at once."""

    def __init__(self, pieces: dict[str, int]):
        child: dict[int, int] = {}
        piece = [-1]
        for p, i in pieces.items():
            state = 0
            for c in p:
                key = state << 21 | ord(c)
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                state = child[key]
            piece[state] = i
        self.piece = np.array(piece, np.int32)
        self.bits = max(8, (4 * len(child)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for slot, key, to in zip(self._slot(np.array(list(child), np.int64)).tolist(), child, child.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (1 << self.bits) - 1
            self.keys[slot], self.to[slot] = key, to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each state by its character, or -1."""
        key = state.astype(np.int64) << 21 | code
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.to[slot], np.int32(-1))
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (1 << self.bits) - 1
            held = self.keys[slot[todo]]
            same = held == key[todo]
            out[todo[same]] = self.to[slot[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return out


class Vocabulary:
    """Pieces and scores of a SentencePiece model file, read as a unigram model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float64)
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown_id = sp.unk_id()
        #: Ten below the least score: the library's penalty.
        self.unknown_score = min(self.score[i] for i in range(n) if usable[i]) - 10.0
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.automaton = ahocorasick.Automaton()
        for i in range(n):
            if usable[i]:
                self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        self.usable = np.array(usable)
        inner = "".join(f"{p}\n" for i, p in enumerate(self.pieces) if usable[i])
        crossing = re.search(f"[{LETTERS}][.,]", inner) or re.search(f"[^{MARK}\n]{MARK}", inner)
        self.newline = any("\n" in p for i, p in enumerate(self.pieces) if usable[i])
        if re.search(f"[^{MARK}\n]{MARK}", inner) or self.newline:
            self.cuts = re.compile("(?s).+")
        elif crossing:
            self.cuts = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        else:
            self.cuts = re.compile(f"{MARK}*[{LETTERS}]+(?=[.,])|\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    @cached_property
    def trie(self) -> Trie:
        return Trie({self.pieces[i]: i for i in np.flatnonzero(self.usable).tolist()})

    def chunks(self, text: str) -> list[str]:
        """With the mark for blanks and before the text; an empty text has none."""
        return self.cuts.findall(MARK + text.replace(" ", MARK)) if text else []


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@dataclass
class Lattice:
    """Edges of many chunks. Chunk c has the nodes first[c] to last[c], one for each place between its characters."""

    text: str
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray  # -1: unknown
    score: np.ndarray


def _joined(chunks: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The chunks in one text, each with a separator behind it; their first places and sizes. Chunks that are the separator itself become a character without a piece."""
    sep = "\x00" if any("\n" in c and c != "\n" for c in chunks) else "\n"
    shown = ["\ufffe" if c == sep else c.replace(sep, "\ufffe") if sep in c else c for c in chunks]
    size = np.fromiter(map(len, shown), np.int64, len(shown))
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(shown) else np.zeros(0, np.int64)
    return sep.join(shown) + sep, first, size


def build(v: Vocabulary, chunks: list[str]) -> Lattice:
    """Edges by their ends, as the automaton lists them; unknowns last."""
    text, first, size = _joined(chunks)
    hits = np.fromiter(itertools.chain.from_iterable(v.automaton.iter(text)), np.int64).reshape(-1, 2)
    end, piece = hits[:, 0] + 1, hits[:, 1]
    start = end - v.length[piece]
    bare = np.ones(len(text), bool)
    bare[start[v.length[piece] == 1]] = False
    bare[first + size] = False
    places = np.flatnonzero(bare)
    start, end = np.concatenate([start, places]), np.concatenate([end, places + 1])
    score = np.concatenate([v.score[piece], np.full(len(places), v.unknown_score)])
    return Lattice(text, first, first + size, start, end, np.concatenate([piece, np.full(len(places), -1)]), score)


def build_by_start(v: Vocabulary, chunks: list[str]) -> tuple[Lattice, np.ndarray]:
    """The same edges ordered by their starts, then by length; and low: node n's edges are low[n] to low[n + 1] - 1."""
    text, first, size = _joined(chunks)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    inside = np.ones(len(codes), bool)
    inside[first + size] = False
    at = np.flatnonzero(inside)
    state, found = np.zeros(len(at), np.int32), []
    while len(at):
        there = at + len(found) < len(codes)
        if not there.all():
            at, state = at[there], state[there]
        state = v.trie.step(state, codes[at + len(found)])
        piece = v.trie.piece[state]
        piece[state < 0] = -1
        hit = piece >= 0
        found.append((at[hit], piece[hit]) if found else (at, piece))  # of one character: a piece or an unknown
        alive = state >= 0
        at, state = at[alive], state[alive]
    low = np.zeros(len(codes) + 2, np.int64)
    for a, _ in found:
        low[a + 1] += 1
    np.cumsum(low, out=low)
    place = low.copy()
    start, end, piece = (np.empty(low[-1], np.int64) for _ in range(3))
    for n, (a, p) in enumerate(found):
        i = place[a]
        start[i], end[i], piece[i] = a, a + n + 1, p
        place[a] += 1
    score = np.where(piece >= 0, v.score[piece], v.unknown_score)
    # An unknown of one byte has its byte's piece already; the separator stands for itself here.
    real = text[-1].join(chunks) + text[-1]
    alone = np.flatnonzero(piece < 0)
    if v.byte_ids and len(alone):
        code = np.frombuffer(real.encode("utf-32-le", "surrogatepass"), "<u4")[start[alone]]
        one = code < 128
        piece[alone[one]] = np.array([v.byte_ids[i] for i in range(128)])[code[one]]
    return Lattice(text, first, first + size, start, end, piece, score), low


def _by_depth(depth: np.ndarray, node: np.ndarray):
    """Edges ordered by depth and node, else as they are; and the slices of equal depth."""
    order = np.argsort(depth << 40 | node, kind="stable")
    d = depth[order]
    return order, np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1, [len(d)]])


def _chunk_of(lat: Lattice, node: np.ndarray) -> np.ndarray:
    return np.searchsorted(lat.first, node, side="right") - 1


def unknown_lengths(lat: Lattice, chunks: list[str]) -> np.ndarray:
    """Byte pieces of every edge that is an unknown; 1 for the rest."""
    out = np.ones(len(lat.start), np.int64)
    at = np.flatnonzero(lat.piece < 0)
    own = _chunk_of(lat, lat.start[at])
    out[at] = [len(chunks[c][p].encode("utf-8", "replace")) for c, p in zip(own.tolist(), (lat.start[at] - lat.first[own]).tolist())]
    return out


def viterbi(lat: Lattice, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score of every chunk and the summed weight of its pieces. Of equal scores the piece that starts first wins."""
    best, count = np.full(len(lat.text) + 1, -np.inf), np.zeros(len(lat.text) + 1, np.int64)
    best[lat.first] = 0
    # The automaton lists an end's pieces from the longest, and unknowns come last: smaller starts first.
    order, cut = _by_depth(lat.end - lat.first[_chunk_of(lat, lat.start)], lat.end)
    start, end, score, w = lat.start[order], lat.end[order], lat.score[order], weight[order]
    for lo, hi in zip(cut, cut[1:]):
        s, e = start[lo:hi], end[lo:hi]
        cand = best[s] + score[lo:hi]
        group = np.concatenate([[0], np.flatnonzero(np.diff(e)) + 1])
        top = np.maximum.reduceat(cand, group)
        wins = cand == np.repeat(top, np.diff(np.concatenate([group, [hi - lo]])))
        at = np.flatnonzero(wins)
        at = at[np.concatenate([[True], np.diff(e[at]) != 0])]  # the first of each node: the smallest start
        best[e[at]], count[e[at]] = cand[at], count[s[at]] + w[lo:hi][at]
    return best[lat.last], count[lat.last]


def conditionals(lat: Lattice, low: np.ndarray, alpha: float) -> np.ndarray:
    """Each edge's log probability given that its start is reached, for weights exp(alpha * score). Edges lie by their starts; a node's only edge has exactly 0."""
    total = np.full(len(lat.text) + 1, -np.inf)
    total[lat.last] = 0
    left = (np.repeat(lat.last, lat.last - lat.first + 1) - np.arange(len(lat.text)))[lat.start]  # places to the cut's end
    order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
    depth = left[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
    start, end, score = lat.start[order], lat.end[order], alpha * lat.score[order]
    for lo, hi in zip(cut, cut[1:]):
        s = start[lo:hi]
        x = score[lo:hi] + total[end[lo:hi]]
        group = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1]) if hi > lo else np.zeros(0, np.int64)
        if not len(group):
            continue
        top = np.maximum.reduceat(x, group)
        sums = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.concatenate([group, [hi - lo]])))), group)
        total[s[group]] = top + np.log(sums)
    out = np.minimum(alpha * lat.score + total[lat.end] - total[lat.start], 0.0)
    out[low[lat.start + 1] - low[lat.start] == 1] = 0.0
    return out
