"""Byte-pair encoding (X7-X13): byte alphabet, merges, vocabulary, decoding. Merge and vocabulary files are parameters."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions import text


def byte_symbols() -> dict[int, str]:
    """A printable symbol for each byte: itself where printable, else the next code points from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def read_merges(lines: Iterable[str]) -> dict[tuple[str, str], int]:
    """Ranks of merges, one "a b" a line behind a header line."""
    return {tuple(x.split()[:2]): i for i, x in enumerate([*lines][1:]) if len(x.split()) >= 2}


def read_vocab(body: str) -> dict[str, int]:
    return json.loads(body)


class Bpe:
    def __init__(self, ranks: dict[tuple[str, str], int], vocab: dict[str, int], context: int = text.CONTEXT) -> None:
        self.ranks, self.vocab, self.context = ranks, vocab, context
        self.symbols = byte_symbols()
        self.bytes, self.names = {s: b for b, s in self.symbols.items()}, {i: p for p, i in vocab.items()}
        self.start, self.end = vocab.get("<|startoftext|>", text.START_ID), vocab.get("<|endoftext|>", text.END_ID)
        self._split = re.compile("<\\|startoftext\\|>|<\\|endoftext\\|>|'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|\\d|(?:[^\\s\\w]|_)+")
        self.merged = lru_cache(100_000)(self._merged)

    def _merged(self, token: str) -> tuple[str, ...]:
        """The pieces of one token; its last symbol carries the end-of-word mark."""
        if token in ("<|startoftext|>", "<|endoftext|>"):
            return (token,)
        parts = [*token[:-1], token[-1] + "</w>"]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            pair, joined, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    joined.append("".join(pair))
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return tuple(parts)

    def pieces(self, body: str) -> list[str]:
        return [p for t in self._split.findall(body.lower()) for p in self.merged("".join(self.symbols[b] for b in t.encode()))]

    def encode(self, body: str) -> list[int]:
        """Pieces that the vocabulary lacks are dropped."""
        return [self.vocab[p] for p in self.pieces(body) if p in self.vocab]

    def encode_full(self, body: str) -> list[int]:
        """Start, ids (cut to fit), end, zeros up to the context length."""
        ids = [self.start, *self.encode(body)[: self.context - 2], self.end]
        return ids + [0] * (self.context - len(ids))

    def decode(self, ids: Iterable[int]) -> str:
        spelled = "".join(self.names[i] for i in ids if i in self.names and i not in (self.start, self.end)).replace("</w>", " ")
        return b"".join(bytes([self.bytes[c]]) if c in self.bytes else c.encode() for c in spelled).decode(errors="replace").strip()


def encode_column(bpe: Bpe, body: Column, full: bool = False) -> Column:
    """Ids of a text column, in Arrow batches."""
    ranks, vocab, context = bpe.ranks, bpe.vocab, bpe.context

    @F.pandas_udf("array<int>")
    def ids(x: pd.Series) -> pd.Series:
        own = Bpe(ranks, vocab, context)
        go = own.encode_full if full else own.encode
        return x.map(lambda t: None if t is None else go(t))

    return ids(body)


def decode_column(bpe: Bpe, ids: Column) -> Column:
    ranks, vocab = bpe.ranks, bpe.vocab

    @F.pandas_udf("string")
    def texts(x: pd.Series) -> pd.Series:
        own = Bpe(ranks, vocab)
        return x.map(lambda i: None if i is None else own.decode(i))

    return texts(ids)
