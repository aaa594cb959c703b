"""Byte-level BPE encoding of whole corpora by longest matches with backtracking.

The text is cut into pieces by the tokenizer's public pattern. A piece that is no token itself is mapped to Latin-1 (one
character a byte) and run once through an Aho-Corasick automaton over all tokens, which gives the longest token starting
at each byte. Tokens are then laid from left to right: a token may follow another only if the two are compatible, that is,
if merging their joined bytes by rank gives exactly these two tokens back. Compatibility is memoised. Where nothing fits,
the last token is taken back and a shorter one is tried; a byte position once found dead is never entered again, so the
work is linear in the piece. A sequence whose neighbours are all compatible is the one that the merges give.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from redolent.session import spread

#: Where the public vocabularies lie; a parameter of every function that reads one.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept by the memos of one worker; beyond it a memo starts anew (speed only, never results).
MEMO = 400_000


class ByteBpe:
    """One vocabulary of token bytes and ranks, as read from a .tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.size = {i: len(t) for i, t in self.bytes.items()}
        self.trie = ahocorasick.Automaton()
        for token, i in self.rank.items():
            self.trie.add_word(token.decode("latin-1"), i)
        self.trie.make_automaton()
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)
        self.split = regex.compile(PATTERN).findall

    def merged(self, raw: bytes) -> list[int]:
        """The merges done one by one, lowest rank first, leftmost among equals."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of the joined bytes end in exactly these two tokens."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > MEMO:
                self._fits.clear()
            known = self._fits[left, right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 for single bytes."""
        known = self._shorter.get(token)
        if known is None:
            raw = self.bytes[token]
            known = self._shorter[token] = next((self.rank[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.rank), -1)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        longest = [-1] * len(raw)
        for end, token in self.trie.iter(raw.decode("latin-1")):
            longest[end + 1 - self.size[token]] = token  # ends come in order, so the last one stored is the longest
        alive, laid, at = bytearray(b"\x01") * (len(raw) + 1), [], 0
        token = longest[0]
        while at < len(raw):
            while token >= 0 and not (alive[at + self.size[token]] and (not laid or self.fits(laid[-1], token))):
                token = self.shorter(token)
            if token >= 0:
                laid.append(token)
                at += self.size[token]
                token = longest[at] if at < len(raw) else -1
            else:
                alive[at] = 0
                token = laid.pop()
                at -= self.size[token]
                # the end of the token just taken back is dead now, so the search goes on below it
        return laid

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text; empty for null and empty texts. Strings of special tokens are ordinary text."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.split(text)))) if text else 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "surrogatepass")


class _Pieces(dict):
    """Memo of encoded pieces: filled on first use, emptied when it outgrows its bound."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> list[int]:
        if len(self) > MEMO:
            self.clear()
        ids = self.bpe.encode_piece(piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The vocabulary of a worker, read once."""
    return ByteBpe(path)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids array<int>): one row for each row of docs.

    Null and empty texts give an empty list; repeated rows give repeated rows; a null key stays null; other columns of
    docs are left out, whatever they are called. One narrow pass over two columns: no shuffle but where the scan has
    fewer splits than the cluster has cores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                flat: list[int] = []
                ends = [0]
                for x in part.column(1).to_pylist():
                    if x:
                        flat.extend(chain.from_iterable(map(bpe.pieces.__getitem__, bpe.split(x))))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(docs.select(key, text)).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, tokens int): the length of each text in tokens, 0 for null and empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            n = pa.array([bpe.count(x) for x in batch.column(1).to_pylist()], type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[key, "tokens"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("tokens", T.IntegerType())])
    return spread(docs.select(key, text)).mapInArrow(run, schema)
