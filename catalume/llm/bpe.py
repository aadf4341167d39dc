"""Byte-level BPE: exact encoding by longest matches and backtracking, and decoding.

A text is cut by a pretokenizer pattern. Each piece is searched once with an
Aho-Corasick automaton over the vocabulary (bytes mapped to Latin-1), which gives
the longest token that starts at each position. The encoder takes longest matches
and steps back to shorter ones when two neighbours could not both be left by the
merges in rank order. Whether a pair of tokens may stand side by side is a
property of the pair alone, so it is memoised, and a position that led nowhere is
never tried again: the work is linear in the length of a piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalume.llm.common import held

#: Entries a worker keeps in each of its caches before it starts afresh.
CACHE = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of ``base64 rank`` lines without gaps."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


class BytePairEncoder:
    """Encodes and decodes with token bytes listed in merge order."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        # the rank files' tools match white space by its Unicode property
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.text_ids = [str(i) for i in range(len(tokens))]
        self.size = [len(t) for t in tokens]
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right, self.shorter = [], [], []
        automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            automaton.add_word(token.decode("latin-1"), i)
            self.shorter.append(next((k for n in range(len(token) - 1, 0, -1) if (k := self.ids.get(token[:n])) is not None), -1))
            a, b = self._parts(i, token)
            self.left.append(a)
            self.right.append(b)
            if a != b or a != i:
                self.merged[a, b] = i
        automaton.make_automaton()
        self.matches = automaton.iter
        self.fits.clear()

    def _parts(self, i: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes token ``i``; itself twice if none does."""
        for n in range(len(token) - 1, 0, -1):
            a, b = self.ids.get(token[:n], i), self.ids.get(token[n:], i)
            if a < i and b < i and self._adjacent(a, b):
                return a, b
        return i, i

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether merging in rank order can leave ``a`` and ``b`` side by side.

        Undo the later of the two merges again and again along the border; a
        known merge across the border that comes before the merges undone so far
        would have been made first.
        """
        bound = len(self.tokens)
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            if a > b:
                bound = a
                a = self.right[a]
                if a == bound:  # a single byte: nothing left to undo on this side
                    bound = b + 1
                    b = self.left[b]
                    if b + 1 == bound:
                        return True
            else:
                bound = b + 1
                b = self.left[b]
                if b + 1 == bound:
                    bound = a
                    a = self.right[a]
                    if a == bound:
                        return True

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        n, size, shorter, fits = len(piece), self.size, self.shorter, self.fits
        longest = [-1] * n
        for last, i in self.matches(piece.decode("latin-1")):  # ends rise, so the last one kept is the longest
            start = last - size[i] + 1
            if longest[start] < 0 or size[longest[start]] < size[i]:
                longest[start] = i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            placed = False
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    if not out:
                        placed = True
                        break
                    pair = (out[-1], token)
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= CACHE:
                            fits.clear()
                        ok = fits[pair] = self._adjacent(*pair)
                    if ok:
                        placed = True
                        break
                token = shorter[token]
            if placed:
                out.append(token)
                at += size[token]
                if at == n:
                    return tuple(out)
                token = longest[at]
            else:
                if not out:
                    raise ValueError("a byte of the text is not in the vocabulary")
                dead[at] = 1
                token = out.pop()
                at -= size[token]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for piece in self.find(text):
            ids = pieces.get(piece)
            if ids is None:
                if len(pieces) >= CACHE:
                    pieces.clear()
                ids = self.encode_piece(piece.encode())
                if len(piece) < 64:
                    pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoder(tokens: list[bytes], pattern: str) -> BytePairEncoder:
    """The encoder of this Python worker, kept until another operator's task runs there."""
    key = ("bpe", len(tokens), hashlib.sha256(b"\0".join(tokens)).digest(), pattern)
    return held(key, lambda: BytePairEncoder(tokens, pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode the whole ``text`` of every row; rows are neither merged nor dropped.

    Returns the ``keep`` columns, ``n_tokens`` long and, as asked for, ``token_ids``
    array<int> and ``ids_sha256``, ``decoded_sha256`` (of the decimal ids joined by
    one space, and of the bytes that the ids decode to). Null and empty texts have
    no tokens; repeated rows give repeated results; other columns are ignored. An
    empty table gives an empty result. The vocabulary is broadcast: it is one file,
    of a size that doesn't depend on the data.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if ids else []
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] if digests else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokens.value, pattern)
        for batch in batches:
            counts, flat, id_sums, text_sums = [], array("i"), [], []
            for value in batch.column(len(keep)):
                found = bpe.encode(value.as_py() or "")
                counts.append(len(found))
                if ids:
                    flat.extend(found)
                if digests:
                    id_sums.append(hashlib.sha256(" ".join(map(bpe.text_ids.__getitem__, found)).encode()).hexdigest())
                    text_sums.append(hashlib.sha256(bpe.decode(found)).hexdigest())
            out = [*batch.columns[: len(keep)], pa.array(counts, pa.int64())]
            if ids:
                ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))))
            if digests:
                out += [pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select(*keep, F.col(text)).mapInArrow(run, T.StructType(fields))


def decode_documents(encoded: DataFrame, ranks_path: str, *, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """Turn ``ids`` back into text; bytes that aren't UTF-8 become U+FFFD. Null stays null."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(T.StringType())
    def decode(col):
        table = tokens.value
        return col.map(lambda x: None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace"))

    return encoded.withColumn(out, decode(F.col(ids)))
