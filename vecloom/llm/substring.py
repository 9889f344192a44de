"""Operator 3: repeated passages by relative Lempel-Ziv parsing against indexed blocks of the corpus.

The reference is the corpus itself, cut into stretches of text: as long as the least hash among the 3-word groups of a
window of n words (its anchor) stays the same, windows belong to one stretch. A block holds the stretches of some
anchors, so all places of a window lie in one block, and a document need only be parsed against the blocks of its own
anchors. In a block, windows are indexed under their earliest document; a match is taken up at a window that an earlier
document holds, its words are compared one by one, and it is extended while the source goes on alike: a factor, with its
source, place and length. The windows across a factor's end are looked up in turn, so the next factor may begin inside
it. Factors meet again at their document, where those that carry on in one source become one; all are n words or more,
and the words that they cover are removed.

Map side: a lot of documents is parsed against itself first and sends only what is new there, so a passage found in a
third of all documents sends one stretch a lot. Blocks take stretches in bounded portions and keep what is new, so a
portion costs no more than the block's distinct windows. Words travel as 40 bits of their hash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.shared import lean, table
from vecloom.llm.tokens_file import as_bytes
from vecloom.llm.wordkit import _WORD_BASE, mix, pieces, powers, run_starts, runs, word_hashes

#: A factor in transit: doc, check, place, windows, and the source's doc and place.
_FACTOR = ("i8", "u4", "u4", "u4", "i8", "u4")
_SPACED = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_BLOCK = "block int, settled boolean, body binary"
_FACTORS = "home int, body binary"
#: Words of an anchor; bytes of text that a map task parses at once, shares of a block that are parsed one by one, and
#: words of a share that are taken at once.
ANCHOR, LOT, SHARES, PORTION = 3, 12 << 20, 4, 2_000_000


def _press(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a.tobytes()) for a in arrays)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def _unpress(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(body)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)[1:]
    at = 8 * (len(kinds) + 1) + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(raw[a:b], k) for k, a, b in zip(kinds, at[:-1], at[1:], strict=True)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run after another."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)


def sums(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    last = max(len(words) - n + 1, 0)
    total = np.zeros(last, np.uint64)
    for k, p in enumerate(powers(_WORD_BASE, n)):
        total += words[k : k + last] * p
    return mix(total)


def anchors(words: np.ndarray, n: int) -> np.ndarray:
    """The least hash among the ANCHOR-word groups of every run of n words."""
    k = min(ANCHOR, n)
    least, width = sums(words, k), 1
    while 2 * width <= n - k + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    more = n - k + 1 - width
    return np.minimum(least[: len(least) - more], least[more:]) if more else least


class Stretches:
    """Stretches of text, ordered by document and place: all words, and each one's document (doc, and check of its text,
    which tells rows of one doc_id apart), place there and number of words."""

    KINDS = ("u4", "i8", "u4", "u4", "u4", "u4", "u1", "u1")

    def __init__(self, words: np.ndarray, doc: np.ndarray, check: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        self.words, self.doc, self.check, self.place, self.size = words, doc, check, place, size
        self.start = np.cumsum(size) - size

    def take(self, which: np.ndarray, skip: np.ndarray | int = 0, size: np.ndarray | None = None) -> Stretches:
        """Parts of stretches: those from word `skip` on, `size` words."""
        size = self.size[which] if size is None else size
        return Stretches(self.words[ragged(self.start[which] + skip, size)], self.doc[which], self.check[which], self.place[which] + skip, size)

    def pressed(self, share: np.ndarray) -> bytes:
        """As bytes: where each share of the block begins (share: that of each stretch, in order), the distinct words,
        often ones first, and each word's number there, its low bytes first."""
        known, at, many = np.unique(self.words, return_inverse=True, return_counts=True)
        order = np.argsort(-many, kind="stable")
        rank = np.empty(len(known), "u4")
        rank[order] = np.arange(len(known))
        known = known[order]
        numbers = rank[at].view("u1").reshape(-1, 4)[:, : max(1, -(-len(known).bit_length() // 8))]
        return _press(np.searchsorted(share, np.arange(SHARES + 1)).astype("u4"), self.doc, self.check.astype("u4"), self.place.astype("u4"), self.size.astype("u4"), known.astype("u4"), (known >> np.uint64(32)).astype("u1"), numbers.T.copy())

    @classmethod
    def read(cls, body: bytes, share: int) -> Stretches:
        begin, doc, check, place, size, low, high, numbers = _unpress(body, *cls.KINDS)
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        some = slice(*begin[share : share + 2].tolist())
        first, last = upto[some.start], upto[some.stop]
        at = np.zeros((last - first, 4), "u1")
        numbers = numbers.reshape(-1, upto[-1])[:, first:last]
        at[:, : len(numbers)] = numbers.T
        return cls((low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))[at.view("u4").ravel()], doc[some], check[some], place[some].astype(np.int64), size[some].astype(np.int64))

    @classmethod
    def ordered(cls, parts: list[Stretches]) -> Stretches:
        whole = cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("words", "doc", "check", "place", "size")))
        return whole.take(np.lexsort((whole.place, whole.check, whole.doc)))


def factors_of(x: Stretches, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The factors of the stretches against each other: arrays of doc, check, place and windows, and the source's doc and
    place; then of the windows without an earlier document: stretch and place in it."""
    many = x.size - n + 1
    stretch = np.repeat(np.arange(len(many), dtype=np.int32), many)
    skip = ragged(np.zeros(len(many), np.int64), many).astype(np.int32)
    at = (x.start[stretch] + skip).astype(np.int32 if len(x.words) < 1 << 31 else np.int64)
    h = sums(x.words, n)[at]
    order = np.argsort(h, kind="stable").astype(np.int32)
    h = h[order]
    new = run_starts(h)
    first = np.empty(len(h), np.int32)  # the window's place of smallest doc
    first[order] = np.repeat(order[new], np.diff(np.append(new, len(h))))
    del h, order, new
    found = np.flatnonzero(x.doc[stretch] != x.doc[stretch[first]]).astype(np.int32)
    same = np.ones(len(found), bool)
    for k in range(n):
        same &= x.words[at[found] + k] == x.words[at[first[found]] + k]
    found = found[same]
    fresh = np.ones(len(at), bool)
    fresh[found] = False
    source = first[found]
    s, t = stretch[found], stretch[source]
    place, origin = x.place[s] + skip[found], x.place[t] + skip[source]
    goes_on = (np.diff(at[found]) == 1) & (np.diff(origin) == 1) & (np.diff(x.doc[t]) == 0) & (np.diff(x.check[t]) == 0)
    begin = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(found) else found
    windows = np.diff(np.append(begin, len(found)))
    fresh = np.flatnonzero(fresh)
    return [x.doc[s[begin]], x.check[s[begin]], place[begin], windows, x.doc[t[begin]], origin[begin]], stretch[fresh], skip[fresh]


def cut_anew(x: Stretches, stretch: np.ndarray, skip: np.ndarray, n: int, anchor: np.ndarray | None = None) -> tuple[Stretches, np.ndarray]:
    """The stretches of windows given in order, ending also where their anchors change; and their first windows."""
    if not len(stretch):
        return x.take(stretch), stretch
    ends = (np.diff(stretch) != 0) | (np.diff(skip) != 1)
    if anchor is not None:
        ends |= anchor[1:] != anchor[:-1]
    begin = np.flatnonzero(np.concatenate([[True], ends]))
    return x.take(stretch[begin], skip[begin], np.diff(np.append(begin, len(stretch))) + n - 1), begin


def home_of(doc: np.ndarray, homes: int) -> np.ndarray:
    return ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % homes


def factor_rows(docs: DataFrame, n: int, blocks: int, homes: int) -> DataFrame:
    """Rows (home, body): factors against documents of smaller doc_id, by home of doc_id."""

    def send(factors: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        home = home_of(factors[0], homes)
        order = np.argsort(home, kind="stable")
        for lo, hi in runs(home[order]):
            at = order[lo:hi]
            yield int(home[at[0]]), _press(*(f[at].astype(k) for f, k in zip(factors, _FACTOR, strict=True)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            ids = batch.column(0).to_numpy()[order]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()[order]
            for lo, hi in pieces(sizes.tolist(), LOT):
                texts = as_bytes(batch.column(1).take(pa.array(order[lo:hi])))
                checks = np.array([zlib.crc32(t) for t in texts], np.uint32)
                words, counts = (np.concatenate(x) for x in zip(*(word_hashes(texts[a:b]) for a, b in pieces([len(t) for t in texts])), strict=True))
                words &= np.uint64((1 << 40) - 1)
                del texts
                long = np.flatnonzero(counts >= n)
                x = Stretches(words, ids[lo:hi], checks, np.zeros(hi - lo, np.int64), counts).take(long)
                if not len(long):
                    continue
                found, stretch, skip = factors_of(x, n)
                rows = [(home % blocks, True, home.to_bytes(4, "little") + body) for home, body in send(found)]
                anchor = anchors(x.words, n)[x.start[stretch] + skip]
                fresh, begin = cut_anew(x, stretch, skip, n, anchor)
                part = (anchor[begin] % np.uint64(blocks * SHARES)).astype(np.int64)
                del x, words, anchor, found, stretch, skip
                by = np.argsort(part, kind="stable")
                part = part[by]
                rows += [(int(part[a]) // SHARES, False, fresh.take(by[a:b]).pressed(part[a:b] % SHARES)) for a, b in runs(part // SHARES)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["block", "settled", "body"])

    def resolve(block: pa.Table) -> pa.Table:
        """All stretches of one block, a share after the other: factors against the earliest documents. A share that is
        large is taken in portions, of which what is new stays."""
        lean()
        out, bodies = [], []
        for settled, body in zip(block.column("settled").to_pylist(), block.column("body").to_pylist(), strict=True):
            if settled:
                out.append((int.from_bytes(body[:4], "little"), body[4:]))
            else:
                bodies.append(body)
        for share in range(SHARES):
            some, size = [], 0
            for i, body in enumerate(bodies):
                some.append(Stretches.read(body, share))
                size += len(some[-1].words)
                if (last := i + 1 == len(bodies)) or size >= PORTION:
                    x = Stretches.ordered(some)
                    some, size = [], 0
                    found, stretch, skip = factors_of(x, n)
                    out += send(found)
                    if not last:
                        some = [cut_anew(x, stretch, skip, n)[0]]
                    del x, stretch, skip
        return pa.table({"home": pa.array([x[0] for x in out], pa.int32()), "body": pa.array([x[1] for x in out], pa.binary())})

    picked = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(index, _BLOCK).groupBy("block").applyInArrow(resolve, _FACTORS)


def joined(place: np.ndarray, windows: np.ndarray, source: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """The factors of one document in order, as rows of place, windows, source and place there: those that carry on where
    another ends, in the same source, are one."""
    place, windows, source, origin = np.unique(np.stack([place, windows, source, origin], axis=1), axis=0).T  # rows may repeat
    ends = place[:-1] + windows[:-1]
    apart = (place[1:] != ends) | (source[1:] != source[:-1]) | (origin[1:] != origin[:-1] + windows[:-1])
    begin = np.flatnonzero(np.concatenate([[True], apart]))
    return np.stack([place[begin], np.add.reduceat(windows, begin), source[begin], origin[begin]], axis=1)


def covered(factors: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """Which of a document's words lie in its factors."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, factors[:, 0], 1)
    np.add.at(edge, factors[:, 0] + factors[:, 1] + n - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, n: int = 13, carry: tuple[str, ...] = (), layout: bool = False, min_blocks: int = 8) -> DataFrame:
    """docs without the words of passages that a document with a smaller doc_id holds as well.

    docs has doc_id and text; columns named in carry are returned too, all others are dropped. Words are runs of
    characters other than ASCII white space; a passage is n words or more. Returns doc_id, carry, n_words, n_removed,
    kept (the words left, joined by single spaces; with layout, the text without the removed words and the white space
    behind each) and factors (array of start and length in words, source, the doc_id that holds the same words, and
    source_start there; each is n words or more, and they may overlap).

    Null text counts as empty, as does text of white space: no words, nothing removed. Rows of one doc_id do not count
    as earlier than each other; a row with null doc_id is kept whole. No input rows give no rows.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 << max(int(math.log2(min_blocks)), math.ceil(math.log2(max(size, 1) / (12 << 20))))  # about two million words of text a block
    homes = blocks
    found = factor_rows(picked, n, blocks, homes)
    extra = [f.name for f in picked.schema.fields[2:]]

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            home = home_of(ids, homes)
            packer = zstandard.ZstdCompressor(level=3)
            texts = [packer.compress(t) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), b.column(0), pa.array(texts, pa.binary()), *b.columns[2:]], names=["home", "doc_id", "z", *extra])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[2:])
    pressed = picked.mapInArrow(press, f"home int, doc_id long, z binary{kinds}")

    def parse(rows: pa.Table, found: pa.Table) -> pa.Table:
        lean()
        of: dict[tuple[int, int], tuple[int, int]] = {}
        if bodies := found.column("body").to_pylist():
            d, c, *rest = (np.concatenate(x) for x in zip(*(_unpress(b, *_FACTOR) for b in bodies), strict=True))
            order = np.lexsort((c, d))
            d, c, rest = d[order], c[order], [x[order].astype(np.int64) for x in rest]
            new = np.union1d(run_starts(d), run_starts(c)).astype(np.int64).tolist()
            of = {(int(d[lo]), int(c[lo])): (lo, hi) for lo, hi in zip(new, [*new[1:], len(d)], strict=True)}
        n_words, n_removed, kept, factors = [], [], [], []
        unpack = zstandard.ZstdDecompressor()
        for doc, z in zip(rows.column("doc_id").to_pylist(), rows.column("z").to_pylist(), strict=True):
            text = unpack.decompress(z)
            words = text.split()
            hit = of.get((doc, zlib.crc32(text))) if of and doc is not None else None
            n_words.append(len(words))
            if not hit:
                n_removed.append(0), kept.append(text if layout else b" ".join(words)), factors.append([])
                continue
            own = joined(*(x[slice(*hit)] for x in rest))
            gone = covered(own, len(words), n)
            n_removed.append(int(gone.sum()))
            whole = _SPACED.findall(text) if layout else words
            kept.append((b"" if layout else b" ").join([w for w, g in zip(whole, gone.tolist(), strict=True) if not g]))
            factors.append([{"start": a, "length": w + n - 1, "source": s, "source_start": o} for a, w, s, o in own.tolist()])
        kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "source", "source_start")]))
        out = {"doc_id": rows.column("doc_id")} | {e: rows.column(e) for e in extra}
        return pa.table(out | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "factors": pa.array(factors, kind)})

    schema = f"doc_id long{kinds}, n_words long, n_removed long, kept string, factors array<struct<start: long, length: long, source: long, source_start: long>>"
    out = pressed.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(parse, schema)
    return out.withColumnsRenamed(dict(zip(extra, carry, strict=True)))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_substring_dedup": substring_dedup}
SQL = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM p),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
r AS (SELECT DISTINCT g.doc_id, g.i + k AS j FROM g JOIN f USING (gram), (SELECT unnest(range(13)) AS k) WHERE first < g.doc_id),
d AS (SELECT doc_id, list(j) AS gone FROM r GROUP BY doc_id),
x AS (SELECT doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN d USING (doc_id))
SELECT doc_id, len(words) AS n_words, len(gone) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda v, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM x"""
}
