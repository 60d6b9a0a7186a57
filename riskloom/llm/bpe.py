"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece there is one token that its encoding ends with.  It is the token t for which
the pair (last token of the prefix without t, t) is one that the merges leave apart, and no other token that
fits there passes that test.  An automaton over the vocabulary names the tokens that end at a byte, the longest
first, so that only these are tested.  The table of the last tokens is all that an encoding needs: reading it from
the end gives the ids, appended bytes only add entries, and after an edit only entries from the edit on are
made again, up to the point where as many as the longest token has bytes agree with the old ones.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ship

#: Pieces whose ids a task remembers, and the bytes up to which a piece is remembered.
REMEMBERED_PIECES = 400_000
REMEMBERED_BYTES = 64
REMEMBERED_PAIRS = 500_000
#: Of these, the pieces and pairs met first are kept for the next task of a worker; frequent ones are met early.
KEPT_PIECES = 100_000
KEPT_PAIRS = 200_000
#: Bytes of text or ids that a task puts into one batch of results.
BATCH_BYTES = 4_000_000


class Vocabulary:
    """Tokens by rank, and which pairs of them the merges leave apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.sizes.values())
        #: Finds (token, its length) at every byte where a token ends, the longest first.
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        #: Results of `test`, remembered up to a bound.
        self.apart: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; none for a byte."""
        if token not in self._halves:
            parts = merged(self.ranks, self.tokens[token], keep=2)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at one edge while `token` is being merged, each with the rank of the merge that ends it."""
        known = self._edges[side].get(token)
        if known is None:
            known, inner, end = [], token, float("inf")
            while True:
                known.append((self.tokens[inner], end))
                parts = self.halves(inner)
                if parts is None:
                    break
                inner, end = parts[side], inner
            self._edges[side][token] = known
        return known

    def test(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both tokens gives these two tokens.

        Merges come in order of rank, the leftmost first.  A merge across the seam happens if two edge
        tokens form a token whose rank is reached before either of them is merged away on its own side.
        """
        get, right_edge = self.ranks.get, self._edge(right, 0)
        result = True
        for a, a_end in self._edge(left, 1):
            for b, b_end in right_edge:
                rank = get(a + b)
                if rank is not None and rank < a_end and rank <= b_end:
                    result = False
        if len(self.apart) > REMEMBERED_PAIRS:
            self.apart.clear()
        self.apart[left << 32 | right] = result
        return result


def merged(ranks: dict[bytes, int], piece: bytes, keep: int = 1) -> list[int]:
    """Plain merging: join the adjacent pair of lowest rank until none is left, or `keep` parts are."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > keep:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Prefixes:
    """The bytes of one piece with the last token of each of their prefixes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = b""
        self.last: list[int] = []
        self.append(piece)

    def _extend(self, upto: int) -> None:
        vocabulary, last = self.vocabulary, self.last
        known, test, filled = vocabulary.apart.get, vocabulary.test, len(last)
        begin = max(0, filled + 1 - vocabulary.longest)  # no token that ends behind `filled` starts earlier
        for at, (token, size) in vocabulary.endings.iter(self.piece[begin:upto].decode("latin-1")):
            at += begin
            if at < filled:
                continue
            if at >= size:
                before = last[at - size]
                fits = known(before << 32 | token)
                if fits is None:
                    fits = test(before, token)
                if not fits:
                    continue
            last.append(token)
            filled += 1

    def append(self, more: bytes) -> None:
        self.piece += more
        self._extend(len(self.piece))

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put `new` in place of piece[start:stop]; entries far enough behind the edit are taken over."""
        old, shift = self.last, len(new) - (stop - start)
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last = old[:start]
        agree = 0
        for end in range(start + 1, len(self.piece) + 1):
            self._extend(end)
            before = end - shift
            same = end > start + len(new) and self.last[-1] == old[before - 1]
            agree = agree + 1 if same else 0
            if agree == self.vocabulary.longest:
                self.last += old[before:]
                return

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        last, sizes = self.last, self.vocabulary.sizes
        while end:
            token = last[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


class Encoder(dict):
    """Ids of pieces as little-endian 32-bit integers, remembered up to a bound."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = load(path)
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.ranks.get(raw)
        ids = [whole] if whole is not None else Prefixes(self.vocabulary, raw).ids()
        found = pack(f"<{len(ids)}I", *ids)
        if len(raw) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = found
        return found

    def forget(self) -> None:
        """At the end of a task: an idle worker must not hold all that its tasks remembered."""
        for known, kept in ((self, KEPT_PIECES), (self.vocabulary.apart, KEPT_PAIRS)):
            for name in list(islice(known, kept, None)):
                del known[name]

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _mapped(batches: Iterable[pa.RecordBatch], column: str, path: str, pattern: str, work: Callable[[Encoder, object], tuple], made: list[str]) -> Iterator[pa.RecordBatch]:
    """Replace `column` by the columns `made` = work(encoder, value), in batches of bounded size."""
    coder = encoder(path, pattern)
    try:
        for batch in batches:
            kept = [n for n in batch.schema.names if n != column]
            values, start, size = [], 0, 0
            for i, value in enumerate(batch.column(column)):
                values.append(work(coder, value.as_py()))
                size += sum(map(len, values[-1]))
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    rows = batch.slice(start, i + 1 - start)
                    columns = [pa.array(list(c), pa.binary()) for c in zip(*values)]
                    yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), *columns], names=[*kept, *made])
                    values, start, size = [], i + 1, 0
    finally:
        coder.forget()


def _applied(df: DataFrame, column: str, path: str, pattern: str, work: Callable[[Encoder, object], tuple], made: list[str]) -> DataFrame:
    ship(__name__)
    schema = f"doc_id {dict(df.dtypes)['doc_id']}, " + ", ".join(f"{m} binary" for m in made)
    return df.select("doc_id", column).mapInArrow(lambda batches: _mapped(batches, column, path, pattern, work, made), schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `ids`: the token ids of `text` as little-endian unsigned 32-bit integers.

    docs needs doc_id and text; other columns are left out.  A null text is encoded as an empty one, to no ids.
    `path` is a rank file that every executor can open; special tokens are ordinary text.  Repeated rows give
    repeated rows; an empty table gives none.
    """
    return _applied(docs, "text", path, pattern, lambda coder, text: (coder.encode(text),), ["ids"])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `decoded`: the bytes that `ids` stand for; null ids are none."""
    return _applied(encoded, "ids", path, pattern, lambda coder, ids: (coder.decode(ids or b""),), ["decoded"])


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, `ids`, and `decoded` from these ids, in one pass over the texts."""

    def both(coder: Encoder, text: str | None) -> tuple[bytes, bytes]:
        ids = coder.encode(text)
        return ids, coder.decode(ids)

    return _applied(docs, "text", path, pattern, both, ["ids", "decoded"])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of tokens of every document, and digests of its ids and of the bytes decoded from them."""
    return encode_and_decode(docs, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
