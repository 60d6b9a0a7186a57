"""Importance resampling: documents drawn by how much more likely their n-grams are in a target than in the corpus.

Every document is scanned once.  It is reduced to words joined by single spaces, and the running CRC-32 is kept at the
start and the end of every word.  CRC-32 is linear over GF(2): the CRC of a prefix, moved on by as many zero
bytes as an n-gram has, cancels out of the CRC of the prefix that ends with the n-gram.  Two prefixes give the
CRC of any n-gram, and with it its bucket, without reading its bytes again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ship, stored
from riskloom.plans.ordered import global_position

#: Longest n-gram, number of buckets, fewest words of a document that may be drawn, percent drawn, and seed.
LONGEST = 2
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of a text that are scanned together; a longer text is scanned in pieces.
PIECE_BYTES = 1_000_000
#: Bytes of buckets that a task puts into one batch of results, and rows that are numbered by one task.
BATCH_BYTES = 4_000_000
BLOCK_ROWS = 20_000

#: Separators become spaces and A-Z a-z; bytes from 0x80 on belong to words, so this is right for UTF-8.
NORMALISED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
POLYNOMIAL = 0xEDB88320


class Shifts:
    """CRC-32 registers moved on by zero bytes, one length for each, from tables that are made once per task.

    A register after `n` zero bytes is the sum over GF(2) of what becomes of its four bytes.  Short lengths have
    tables of their own; longer ones go through tables for powers of two.
    """

    SHORT = 256

    def __init__(self) -> None:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
        self.byte = table
        now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        self.short = np.empty((self.SHORT, 4, 256), dtype=np.uint32)
        for length in range(self.SHORT):
            self.short[length] = now
            now = self.zero_byte(now)
        self.powers = [now]  # SHORT zero bytes, then twice as many each

    def zero_byte(self, register: np.ndarray) -> np.ndarray:
        return self.byte[register & 0xFF] ^ (register >> 8)

    @staticmethod
    def through(table: np.ndarray, register: np.ndarray) -> np.ndarray:
        return table[0][register & 0xFF] ^ table[1][(register >> 8) & 0xFF] ^ table[2][(register >> 16) & 0xFF] ^ table[3][register >> 24]

    def __call__(self, register: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        flat, base = self.short.reshape(-1), (lengths % self.SHORT) * 1024
        out = flat[base + (register & 0xFF)]
        for i in (1, 2, 3):
            out ^= flat[base + 256 * i + ((register >> (8 * i)) & 0xFF)]
        rest, power = lengths // self.SHORT, 0
        while rest.any():
            if power == len(self.powers):
                self.powers.append(self.through(self.powers[-1], self.powers[-1]))
            odd = np.nonzero(rest & 1)[0]
            out[odd] = self.through(self.powers[power], out[odd])
            rest, power = rest >> 1, power + 1
        return out

    def space(self, crc: np.ndarray) -> np.ndarray:
        """The CRC after one more space."""
        return ~self.zero_byte(~crc ^ np.uint32(0x20))


def ngram_crcs(shifts: Shifts, tokens: list[bytes], longest: int, known: int = 0) -> list[np.ndarray]:
    """CRC-32 of all runs of 1, 2, ... `longest` words; each token is a space and a word.

    Runs inside the first `known` tokens belong to the piece before and are left out.
    """
    ends = np.fromiter(accumulate(tokens, lambda crc, token: crc32(token, crc), initial=0), np.uint32, len(tokens) + 1)
    at = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)), out=at[1:])
    starts = shifts.space(ends[:-1])
    found = []
    for n in range(1, longest + 1):
        first, runs = max(known - n + 1, 0), max(len(tokens) - n + 1, 0)
        found.append(ends[first + n : runs + n] ^ shifts(starts[first:runs], at[first + n : runs + n] - at[first:runs] - 1))
    return found


def document_buckets(shifts: Shifts, text: bytes | None, longest: int = LONGEST, buckets: int = BUCKETS, piece: int = PIECE_BYTES) -> tuple[int, np.ndarray]:
    """The number of words of a text in UTF-8, and the bucket of each of its n-grams, repeats included."""
    raw, tokens_of = b" " + (text or b"").translate(NORMALISED), re.compile(rb" [^ ]+").findall
    small = np.uint16 if buckets <= 1 << 16 else np.uint32
    words, found, carried, start = 0, [], [], 0
    while start < len(raw):
        stop = raw.find(b" ", start + piece)
        stop = len(raw) if stop < 0 else stop
        new = tokens_of(raw, start, stop)
        tokens = carried + new
        found += [(c % np.uint32(buckets)).astype(small) for c in ngram_crcs(shifts, tokens, longest, len(carried))]
        words, start, carried = words + len(new), stop, tokens[len(tokens) - longest + 1 :] if len(tokens) >= longest else tokens
    return words, np.concatenate(found)


def _held(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featured(docs: DataFrame, key: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """`key`, n_words, n_features and, packed into `buckets`, the bucket of each feature of every text."""
    ship(__name__)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, dtype = Shifts(), _held(buckets)
        for batch in batches:
            words, features, packed, start, size = [], [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                n, found = document_buckets(shifts, text.as_py(), longest, buckets)
                words.append(n)
                features.append(len(found))
                packed.append(found.astype(dtype).tobytes())
                size += len(packed[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    columns = [pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), *columns], names=["key", "n_words", "n_features", "buckets"])
                    words, features, packed, start, size = [], [], [], i + 1, 0

    schema = f"key {dict(docs.dtypes)[key]}, n_words long, n_features long, buckets binary"
    return docs.select(F.col(key).alias("key"), F.col("text").cast("binary")).mapInArrow(scan, schema)


def bucket_totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket.

    A task sends one number a bucket at most; the driver gets as many, whatever the input.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                found = np.frombuffer(packed.as_py(), _held(buckets))
                if len(found) < buckets // 8:
                    np.add.at(total, found, 1)
                else:
                    total += np.bincount(found, minlength=buckets)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in features.select("buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds, in floored thousandths of the logarithm of its likelihood ratio."""
    s, t, buckets = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features and weight of every row: the floored mean of the gains of its features."""
    held = gain.tobytes()

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(held, np.int64)
        for batch in batches:
            sums = (int(own[np.frombuffer(packed.as_py(), _held(len(own)))].sum()) for packed in batch.column(3))
            weights = pa.array([total // max(n.as_py(), 1) for total, n in zip(sums, batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), weights], names=["key", "n_words", "n_features", "weight"])

    return features.mapInArrow(weigh, f"key {dict(features.dtypes)['key']}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that are not drawn.

    Documents are drawn without replacement by the largest of weight plus Gumbel noise of their id, which draws in
    proportion to the importance weights.  docs needs an integer doc_id and text, target text; other columns, whatever
    their names, are left out.  A null text has no words, no features and weight 0.  Documents without an id share
    the noise of an empty one and stand behind others of equal score; repeated rows are drawn row by row.  With
    an empty target only the corpus decides; an empty corpus gives no rows.  The buckets of all features are stored, two
    bytes each, so that no text is scanned twice.
    """
    scanned = stored(featured(docs, "doc_id", longest, buckets), "features")
    aims = featured(target.select(F.lit(0).alias("item"), "text"), "item", longest, buckets)
    known = weighed(scanned, gains(bucket_totals(scanned, buckets), bucket_totals(aims, buckets)))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    fit = F.col("n_words") >= min_words
    turn = F.when(fit, -F.col("score")).otherwise(F.lit(2**53))  # those too short stand behind all others
    last = F.coalesce(F.col("key").cast("long"), F.lit(2**63 - 1))
    scored = stored(known.withColumn("score", F.col("weight") + noise).withColumns({"turn": turn, "last": last}), "scores")
    drawn = scored.where(fit).count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return global_position(scored, ["turn", "last"], "place", block_rows).select(F.col("key").alias("doc_id"), "n_features", "weight", "score", rank.alias("rank"))
