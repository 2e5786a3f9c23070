"""A deterministic automaton over tokens, built from byte-pair merges by successive merge gadgets.

Start with one state and an arc for each base symbol.  The gadget of a merge (u, v) -> w, applied in
the order of the merges, changes the automaton so that it reads w where it read u v:

* the state behind an arc u loses its arc v (``cut``),
* wherever an arc u starts, an arc w starts as well (``arc_of``), and
* it leads to a copy of the state behind v (``clone_of``).

States stand for the last token read, so the three tables hold the whole automaton: whether state p
has an arc s is found by taking the gadgets back, newest first.  A path from the start spells a
sequence of tokens exactly if that sequence is the tokenization of its text; there is one such path
for each text.  Reading a text byte by byte needs one more table, a trie with failure links whose
states know the longest token that ends there; the last token of every prefix is then the longest one
with an arc from the last token of what precedes it.

All steps run over many words at once in numpy.
"""

from __future__ import annotations

import numpy as np

from .common import coded_spans

START = -1
NONE = -2
FAR = np.iinfo(np.int32).max
#: Words of more bytes than this are read one by one.
LONG = 256


def ragged(data: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate data[offsets[i]:offsets[i + 1]] for i in picks; also the offsets of the result."""
    size = offsets[picks + 1] - offsets[picks]
    ends = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return data[np.arange(ends[-1]) + np.repeat(offsets[picks] - ends[:-1], size)], ends


class TokenAutomaton:
    """``pieces``: byte strings of the tokens, base symbols first, then products in order of priority.

    ``merges``: (u, v, w) of every merge, by index in pieces; ``made``: for each piece, the merge
    (u, v) that makes it in a text of its own, None for base symbols and for pieces that never arise.
    ``unknown``: whether a character without a piece may occur, which then counts one token a byte.
    """

    def __init__(self, pieces: list[bytes], n_base: int, merges: list[tuple[int, int, int]], made: list[tuple[int, int] | None], unknown: bool = False):
        n = len(pieces)
        self.n, self.n_base, self.unknown = n, n_base, unknown
        self.size = np.array([len(p) for p in pieces] + [1, 2, 3, 4], np.int32)  # the last four: unknown characters
        self.weight = np.ones(n + 4, np.int32)
        self.weight[n:] = [1, 2, 3, 4]
        self.arc_of, self.clone_of = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        keys, times = [], []
        for u, v, w in merges:  # the gadgets, in order
            keys.append(u * n + v)
            times.append(w)
            if made[w] == (u, v):
                self.arc_of[w], self.clone_of[w] = u, v
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.cut_key, self.cut_time = np.array(keys, np.int64)[order], np.array(times, np.int32)[order]
        self._hash_cuts()
        self._trie([p if i < n_base or made[i] else b"" for i, p in enumerate(pieces)])
        self.longest = int(max(self.size.max(), 4))
        self.held: dict[int, bool] = {}  # whether a state has an arc, for words that are read one by one
        self.seen_key, self.seen = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _hash_cuts(self) -> None:
        """An open-addressing table over the keys of ``cut``."""
        bits = max(10, int(np.ceil(np.log2(4 * len(self.cut_key) + 4))))
        self.slot_shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_time = np.full(1 << bits, -1, np.int64), np.full(1 << bits, FAR, np.int32)
        todo, at = np.arange(len(self.cut_key)), self._slot(self.cut_key)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slot_key[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_time[at[put]] = self.cut_key[todo[put]], self.cut_time[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & mask
        self.slot_mask = mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.slot_shift).astype(np.int64)

    def _cut(self, key: np.ndarray) -> np.ndarray:
        """The time at which the state behind u lost its arc v; FAR if it has it still."""
        at = self._slot(key)
        time = np.full(len(key), FAR, np.int32)
        left = np.arange(len(key))
        for _ in range(self.probes + 1):
            found = self.slot_key[at]
            hit = found == key[left]
            time[left[hit]] = self.slot_time[at[hit]]
            on = ~hit & (found >= 0)
            left, at = left[on], (at[on] + 1) & self.slot_mask
            if not len(left):
                break
        return time

    def _trie(self, pieces: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        own = [NONE]
        home = np.zeros(self.n, np.int32)
        for i, piece in enumerate(pieces):
            at = 0
            for b in piece:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                    own.append(NONE)
                at = nxt
            if piece:
                own[at], home[i] = i, at
        self.goto = np.zeros((len(children), 256), np.int32)
        fail, self.out = np.zeros(len(children), np.int32), np.array(own, np.int32)
        level = [0]
        while level:
            below = [(node, b, child) for node in level for b, child in children[node].items()]
            for node, b, child in below:
                fail[child] = self.goto[node, b]  # still where the failure state goes, or the root
            for node in level:
                for b, child in children[node].items():
                    self.goto[node, b] = child
            level = [child for _, _, child in below]
            if level:
                self.goto[level] = self.goto[fail[level]]
                missing = np.array(level)[self.out[level] == NONE]
                self.out[missing] = self.out[fail[missing]]
        self.shorter = self.out[fail[home]]

    def has_arc(self, p: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Whether state p has an arc s, for each pair."""
        key = p.astype(np.int64) * self.n + s
        at = (key * 0x9E3779B97F4A7C1 >> 24) & (len(self.seen) - 1)
        known = self.seen_key[at] == key
        ok = self.seen[at]
        new = np.flatnonzero(~known)
        if len(new):
            ok[new] = self._replay(p[new], s[new], key[new])
            self.seen_key[at[new]], self.seen[at[new]] = key[new], ok[new]
            # Of pairs that share a slot one was stored; the answers above do not depend on it.
            self.seen_key[at[new[self.seen_key[at[new]] != key[new]]]] = -1
        return ok

    def _replay(self, p: np.ndarray, s: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Take the gadgets back, newest first, until both are base symbols or an arc was cut in time."""
        ok = np.ones(len(p), bool)
        left, until = np.arange(len(p)), np.full(len(p), FAR, np.int32)
        p, s = p.astype(np.int32), s.astype(np.int32)
        while len(left):
            cut = self._cut(p.astype(np.int64) * self.n + s) < until
            ok[left[cut]] = False
            on = ~cut & (np.maximum(p, s) >= self.n_base)
            left, p, s = left[on], p[on], s[on]
            newer = p > s
            # A cut that as new as s would have come first, as it is further left.
            until = np.where(newer, p, s + 1)
            p, s = np.where(newer, self.clone_of[p], p), np.where(newer, s, self.arc_of[s])
        return ok

    def start(self) -> tuple[int, list[int], list[int]]:
        """The state in which words begin: a node of the trie, and token and count of the last prefixes."""
        return 0, [START], [0]

    def advance(self, state: tuple[int, list[int], list[int]], data: bytes) -> tuple[int, list[int], list[int]]:
        """The state after ``data``, which ends with a character.

        What follows depends on no more than the prefixes that a token can still start from, so a state
        holds as many of them as the longest token has bytes: there are finitely many, up to what is
        added to their counts.
        """
        for at in range(0, len(data), 4096):
            end = at + 4096
            while at and data[at : at + 1] and data[at] & 0xC0 == 0x80:
                at += 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            node, last, count = self._run(state, data[at:end])
            state = node, last[-self.longest - 1 :], count[-self.longest - 1 :]
        return state

    def _run(self, state: tuple[int, list[int], list[int]], data: bytes) -> tuple[int, list[int], list[int]]:
        """Read ``data``; token and count of each of its prefixes are added to the state's."""
        node, last, count = state
        last, count = list(last), list(count)
        goto, out, size, weight, held = self.goto, self.out, self.size, self.weight, self.held
        first = len(last)
        for i, b in enumerate(data):
            node = int(goto[node, b])
            t = int(out[node])
            while t >= 0:
                p = last[first + i - size[t]]
                if p == START or p >= self.n:
                    break
                key = p * self.n + t
                if (ok := held.get(key)) is None:
                    if len(held) > 1_000_000:
                        held.clear()
                    ok = held[key] = p >= 0 and bool(self.has_arc(np.array([p]), np.array([t]))[0])
                if ok:
                    break
                t = int(self.shorter[t])
            if t < 0:
                t = NONE
                # Only at the end of a character; within one, no token ends.
                if self.unknown and (i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80):
                    k = 1
                    while k < 4 and i - k >= 0 and data[i - k + 1] & 0xC0 == 0x80:
                        k += 1
                    t = self.n + k - 1
            last.append(t)
            count.append(count[first + i - size[t]] + int(weight[t]) if t != NONE else 0)
        return node, last, count

    @staticmethod
    def settled(state: tuple[int, list[int], list[int]]) -> tuple[tuple[int, list[int], list[int]], int]:
        """A state with what all its counts have in common taken off, and that number."""
        node, last, count = state
        least = min((c for c, t in zip(count, last, strict=True) if t != NONE), default=0)
        return (node, last, [c - least if t != NONE else 0 for c, t in zip(count, last, strict=True)]), least

    def _scalar(self, word: bytes) -> np.ndarray:
        """The last token of each prefix of one long word."""
        parts, state = [np.array([START], np.int32)], self.start()
        step = 4096
        at = 0
        while at < len(word):
            end = min(at + step, len(word))
            while self.unknown and end < len(word) and word[end] & 0xC0 == 0x80:
                end += 1
            known = len(state[1])
            full = self._run(state, word[at:end])
            parts.append(np.array(full[1][known:], np.int32))
            state = full[0], full[1][-self.longest - 1 :], full[2][-self.longest - 1 :]
            at = end
        return np.concatenate(parts)

    def _read(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The last tokens of all prefixes of words of at most LONG bytes, longest first, as a matrix."""
        most = int(size[0])
        last = np.full((most + 1, len(size)), NONE, np.int32)
        last[0] = START
        node = np.zeros(len(size), np.int32)
        for i in range(1, most + 1):
            k = int(np.searchsorted(-size, -i, "right"))
            node = self.goto[node[:k], raw[start[:k] + (i - 1)]]
            rows, token = np.arange(k), self.out[node]
            if self.unknown:
                some = token >= 0
                rows, token = rows[some], token[some]
            while len(rows):
                p = last[i - self.size[token], rows]
                ok = (p == START) | (p >= self.n)
                ask = np.flatnonzero(~ok & (p >= 0))
                ok[ask] = self.has_arc(p[ask], token[ask])
                last[i, rows[ok]] = token[ok]
                rows, token = rows[~ok], self.shorter[token[~ok]]
                if self.unknown:
                    some = token >= 0
                    rows, token = rows[some], token[some]
            if self.unknown:
                bare = np.flatnonzero(last[i, :k] == NONE)
                ends = bare[(size[bare] == i) | ((raw[np.minimum(start[bare] + i, len(raw) - 1)] & 0xC0) != 0x80)]
                if len(ends):
                    width = np.ones(len(ends), np.int64)
                    for j in range(1, 4):
                        more = (width == j) & (i - j > 0) & ((raw[np.maximum(start[ends] + i - j, 0)] & 0xC0) == 0x80)
                        width[more] += 1
                    last[i, ends] = self.n + width - 1
        return last

    def _groups(self, size: np.ndarray):
        """Word indices by like length, longest first in each."""
        order = np.argsort(-size, kind="stable")
        edges = [np.searchsorted(-size[order], -x, "left") for x in (LONG, 64, 24, 12, 0)]
        return order[: edges[0]], [order[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a]

    def encode(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words raw[start : start + size], concatenated, and the offsets of each word's."""
        count = np.zeros(len(size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, place from the end, token
        long, groups = self._groups(size)
        for j in long:
            last = self._scalar(raw[start[j] : start[j] + size[j]].tobytes())
            at, path = int(size[j]), []
            while at > 0:
                path.append(last[at])
                at -= int(self.size[last[at]])
            count[j] = len(path)
            parts.append((np.full(len(path), j), np.arange(len(path)), np.array(path, np.int32)))
        for words in groups:
            last = self._read(raw, start[words], size[words])
            at, rows, step = size[words].astype(np.int64), np.arange(len(words)), 0
            while len(rows):
                token = last[at, rows]
                parts.append((words[rows], np.full(len(rows), step), token))
                count[words[rows]] += 1
                at = at - self.size[token]
                on = at > 0
                rows, at, step = rows[on], at[on], step + 1
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        tokens = np.zeros(ends[-1], np.int32)
        for word, place, token in parts:
            tokens[ends[word + 1] - 1 - place] = token
        return tokens, ends

    def count(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each word: the sum of the counts on the transitions of its path."""
        total = np.zeros(len(size), np.int64)
        long, groups = self._groups(size)
        for j in long:
            last = self._scalar(raw[start[j] : start[j] + size[j]].tobytes())
            at = int(size[j])
            while at > 0:
                total[j] += int(self.weight[last[at]])
                at -= int(self.size[last[at]])
        for words in groups:
            last = self._read(raw, start[words], size[words])
            at, rows = size[words].astype(np.int64), np.arange(len(words))
            while len(rows):
                token = last[at, rows]
                total[words[rows]] += self.weight[token]
                at = at - self.size[token]
                on = at > 0
                rows, at = rows[on], at[on]
        return total


def distinct_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of a representative of each distinct span, by its bytes, and for each span its representative's place."""
    words, place = coded_spans(raw, start, end)
    pick = np.zeros(len(words), np.int64)
    pick[place[::-1]] = np.arange(len(place))[::-1]
    return pick, place
