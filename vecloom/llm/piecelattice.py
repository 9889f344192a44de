"""The lattice of BPE pieces over units of text, in arrays.

Substrings of every unit grow by a character at a time and are joined with the prefixes of pieces; those that are pieces
are edges, grouped by unit and by the place where they end. A Viterbi pass over these places keeps one path to each.

BPE has no additive score, but its answer is a path of this lattice: pieces t1 ... tn are the encoding of their text if
and only if every neighbouring pair (a, b) is that of the text ab, since the merges inside a pair go on as they would
without the rest. So the pass admits an edge only behind a piece that it may follow, and the encoding of a prefix being
one, just one edge is left at every place. Whether b may follow a is found by running both pieces' own merges side by
side, best first, and looking whether a merge across the border ever comes before both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from vecloom.llm.wordkit import mix, run_starts

START, UNKNOWN = -1, -2
_NEVER = np.float32(-np.inf)
CACHE_BITS = 18
#: Units of more characters than this are folded one by one, edge by edge, so that they do not make the others wait.
LONG = 256


def merged(text: str, score: dict[str, float]) -> Iterator[tuple[float, list[str]]]:
    """The merges of a text: the score of each, and the parts that there are after it. The best pair goes first, of
    equal ones the one farther left."""
    parts = [*text]
    while True:
        some = [(-score[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if p + q in score]
        if not some:
            return
        loss, i = min(some)
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        yield -loss, parts


class PieceLattice:
    """score: the pieces of a BPE model, by id, with their scores. All characters of pieces must be pieces themselves.

    Holds some 300 bytes a piece; made once and sent to executors."""

    def __init__(self, score: dict[int, tuple[str, float]]) -> None:
        self.ids = np.array(sorted(score), np.int64)
        texts = [score[i][0] for i in self.ids.tolist()]
        known = {t: s for t, s in score.values()}
        number = {t: i for i, t in enumerate(texts)}
        alphabet = sorted({c for t in texts for c in t})
        if missing := [c for c in alphabet if c not in number]:
            raise ValueError(f"characters of pieces that are no pieces: {missing[:5]}")
        self.alphabet = np.array([ord(c) for c in alphabet], np.uint32)
        self.longest = max(map(len, texts), default=0)
        n = len(texts)
        # What each piece's own merges do to its two ends.
        self.steps = np.full((n, max(self.longest, 1)), _NEVER, np.float32)
        self.first, self.last = (np.zeros((n, max(self.longest, 1)), np.int32) for _ in "ab")
        whole = np.zeros(n, bool)
        for i, t in enumerate(texts):
            parts, k = [*t], 0
            self.first[i], self.last[i] = number[t[0]], number[t[-1]]
            for k, (s, parts) in enumerate(merged(t, known), 1):  # noqa: B007
                self.steps[i, k - 1] = s
                self.first[i, k:], self.last[i, k:] = number[parts[0]], number[parts[-1]]
            whole[i] = parts == [t]  # pieces that their own text does not give are on no path
        pairs = sorted({(number[t[:k]] * n + number[t[k:]], known[t]) for t in texts for k in range(1, len(t)) if t[:k] in number and t[k:] in number})
        self.pair, self.pair_score = np.array([p for p, _ in pairs], np.int64), np.array([s for _, s in pairs], np.float32)
        # Prefixes of pieces: a prefix's number and a character give the longer prefix's number.
        letter = {c: i for i, c in enumerate(alphabet)}
        prefix = {"": 0}
        for t in sorted({t[:k] for t in texts for k in range(1, len(t) + 1)}):
            prefix[t] = len(prefix)
        grown = sorted((prefix[t[:-1]] * len(alphabet) + letter[t[-1]], at) for t, at in prefix.items() if t)
        self.grow, self.grown = (np.array([g[k] for g in grown], np.int64) for k in (0, 1))
        self.piece_at = np.full(len(prefix), UNKNOWN, np.int64)
        for t, i in number.items():
            if whole[i]:
                self.piece_at[prefix[t]] = i

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "cached"}

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of the text ab is the pieces a and b."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(live):
            left, right = a[live], b[live]
            key = self.last[left, i].astype(np.int64) * len(self.ids) + self.first[right, j]
            at = np.searchsorted(self.pair, key).clip(max=max(len(self.pair) - 1, 0))
            across = np.where(self.pair[at] == key, self.pair_score[at], _NEVER) if len(self.pair) else np.full(len(key), _NEVER)
            own, other = self.steps[left, i], self.steps[right, j]
            cross = (across > own) & (across >= other)
            ok[live[cross]] = False
            on = ~cross & (np.maximum(own, other) > _NEVER)
            step = own >= other
            i, j, live = (i + step)[on], (j + ~step)[on], live[on]
        return ok

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow(), with answers kept in a table of fixed size, where a new pair takes an older one's place."""
        if "cached" not in self.__dict__:
            self.cached = np.full(1 << CACHE_BITS, -1, np.int64)  # pairs times two, plus the answer
        key = a * len(self.ids) + b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        held = self.cached[slot]
        out, new = (held & 1).astype(bool), held >> 1 != key
        if new.any():
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.may_follow(a[new][first], b[new][first])
            out[new] = found[back]
            self.cached[slot[new][first]] = key[new][first] * 2 + found
        return out

    def edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, piece) of the substrings that are pieces; room: characters from each place to its unit's end. A
        character that is no piece is an edge of its own."""
        place = np.searchsorted(self.alphabet, codes).clip(max=max(len(self.alphabet) - 1, 0))
        fine = self.alphabet[place] == codes if len(self.alphabet) else np.zeros(len(codes), bool)
        at, node = np.flatnonzero(fine), np.zeros(int(fine.sum()), np.int64)
        odd = np.flatnonzero(~fine)
        out = [(odd, np.ones(len(odd), np.int64), np.full(len(odd), UNKNOWN))]
        for size in range(1, self.longest + 1):
            if size > 1:
                more = room[at] >= size
                at, node = at[more], node[more]
                more = fine[at + size - 1]
                at, node = at[more], node[more]
            key = node * len(self.alphabet) + place[at + size - 1]
            found = np.searchsorted(self.grow, key).clip(max=max(len(self.grow) - 1, 0))
            is_prefix = self.grow[found] == key
            at, node = at[is_prefix], self.grown[found[is_prefix]]
            if not len(at):
                break
            piece = self.piece_at[node]
            whole = piece >= 0
            out.append((at[whole], np.full(int(whole.sum()), size), piece[whole]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece or UNKNOWN, place of its first character in the joined units, unit) of the units' paths, in order.
        Pieces are by number, ids[number] being the model's."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), sizes)
        begins = np.cumsum(sizes) - sizes
        within = np.arange(len(codes)) - begins[unit]
        begin, size, piece = self.edges(codes, sizes[unit] - within)
        of = unit[begin]
        # Places between characters: one more than characters in every unit.
        start, end, level = begin + of, begin + of + size, within[begin] + size
        last, back = np.full(len(codes) + len(units), START), np.full(len(codes) + len(units), -1)
        long = sizes[of] > LONG
        for of_long in (False, True):
            order = np.flatnonzero(long == of_long)
            order = order[np.lexsort((end[order], level[order]))] if not of_long else order[np.argsort(end[order], kind="stable")]
            self.fold(start[order], end[order], piece[order], last, back, None if of_long else level[order])
        on, at = np.zeros(len(last), bool), (np.cumsum(sizes + 1) - 1)[sizes > 0]
        while len(at):
            on[at] = True
            at = back[at]
            at = at[back[at] >= 0]
        ends = np.flatnonzero(on)
        owner = np.repeat(np.arange(len(units)), sizes + 1)[ends]
        return last[ends], back[ends] - owner, owner

    def fold(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, last: np.ndarray, back: np.ndarray, level: np.ndarray | None) -> None:
        """The Viterbi pass: last[place] is the last piece of the path to a place, back[place] where that begins. Edges
        come by level, all of one at once; without levels by their end, one by one."""
        if level is None:
            known: dict[tuple[int, int], bool] = {}
            for s, e, p in zip(start.tolist(), end.tolist(), piece.tolist(), strict=True):
                q = int(last[s])
                if q >= 0 and p >= 0 and (q, p) not in known:
                    known[q, p] = bool(self.may_follow(np.array([q]), np.array([p]))[0])
                if q < 0 or p < 0 or known[q, p]:
                    last[e], back[e] = p, s
            return
        firsts = run_starts(level).tolist()
        for lo, hi in zip(firsts, [*firsts[1:], len(level)], strict=True):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            q = last[s]
            fits = (q < 0) | (p < 0)
            open_ = np.flatnonzero(~fits)
            fits[open_] = self.follows(q[open_], p[open_])
            last[e[fits]], back[e[fits]] = p[fits], s[fits]

    def encode(self, units: list[str], fallback: Callable[[str], list[int]], run: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of all units, one after another, and their number for each. fallback gives the ids of a
        character that is no piece. Units are worked on in runs of about `run` characters."""
        flat, counts, at = [np.empty(0, np.int32)], np.zeros(len(units), np.int64), 0
        while at < len(units):
            to, total = at, 0
            while to < len(units) and (to == at or total + len(units[to]) <= run):
                total += len(units[to])
                to += 1
            piece, place, owner = self.paths(units[at:to])
            odd = np.flatnonzero(piece < 0)
            many = np.ones(len(piece), np.int64)
            joined = "".join(units[at:to]) if len(odd) else ""
            spelt = [fallback(joined[i]) for i in place[odd].tolist()]
            many[odd] = [*map(len, spelt)]
            ids = np.repeat(np.where(piece < 0, 0, self.ids[piece] if len(self.ids) else 0), many)
            if spelt:
                begin = (np.cumsum(many) - many)[odd]
                ids[np.repeat(begin - np.cumsum(many[odd]) + many[odd], many[odd]) + np.arange(many[odd].sum())] = np.concatenate(spelt)
            flat.append(ids.astype(np.int32))
            counts[at:to] = np.bincount(owner, many, to - at).astype(np.int64)
            at = to
        return np.concatenate(flat), counts
