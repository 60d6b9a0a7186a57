"""Benchmark passages in documents.

The benchmark is the stated query set.  It is cut into blocks of bounded size, and each block is held against
all documents, so only a block is ever broadcast.  A window is as long as an item.  Windows get a SimHash of
their word shingles, and a multi-index of the items' fingerprints (eight blocks of eight bits, each probed up
to two bits away) returns every item within RADIUS: 23 differing bits cannot put three into each of
eight blocks.  What it returns is verified by the exact weighted Jaccard similarity of the shingles.  A window
that holds no shingle of an item as long as itself has similarity zero to all such items, so only
windows around a shared shingle are made.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import ship, words

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCK_BITS, NEAR_BITS = 8, 2
#: Bytes of benchmark text that one pass over the documents looks for.
BLOCK_BYTES = 4_000_000
#: Words of documents that are hashed together.
WORDS_AT_ONCE = 500_000
#: Windows that are fingerprinted together.
WINDOWS_AT_ONCE = 256
FILTER_BITS = 22
SEED = 42

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split(text: str | None) -> list[bytes]:
    """Words parted by ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(ws: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Runs of `width` words; fewer words make one run, none make none."""
    wide = min(width, len(ws))
    return [b" ".join(ws[i : i + wide]) for i in range(len(ws) - wide + 1)] if ws else []


def mixed(hashes: np.ndarray, width: int) -> np.ndarray:
    """One number for each run of `width` word hashes."""
    out = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        out += hashes[k : k + len(out)] * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    return out ^ (out >> np.uint64(29))


def word_hashes(ws: Iterable[bytes], n: int) -> np.ndarray:
    """Numbers of words that hold within this process only."""
    return np.fromiter(map(hash, ws), dtype=np.int64, count=n).view(np.uint64)


class Items:
    """One block of the benchmark: shingles, weights, fingerprints and their multi-index."""

    def __init__(self, rows: list[tuple], total: int, similarity: float):
        self.similarity = similarity
        self.weights: dict[bytes, int] = {}
        self.rare = self.weight(1, total)
        self.ids, self.counts, self.sums, self.sizes = [], [], [], []
        for item_id, text, shared in rows:
            ws = split(text)
            if not ws:
                continue
            self.weights.update((s.encode("utf-8", "surrogatepass"), self.weight(n, total)) for s, n in shared)
            count = Counter(shingles(ws))
            self.ids.append(item_id)
            self.counts.append(count)
            self.sums.append(sum(n * self.weights.get(s, self.rare) for s, n in count.items()))
            self.sizes.append(len(ws))
        self.widths = sorted({min(WIDTH, n) for n in self.sizes})
        self.anchors: dict[int, dict[int, list[int]]] = {w: defaultdict(list) for w in self.widths}
        for i, count in enumerate(self.counts):
            for s in count:
                ws = s.split()
                self.anchors[len(ws)][int(mixed(word_hashes(ws, len(ws)), len(ws))[0])].append(i)
        self.filters = {}
        for w, places in self.anchors.items():
            flags = np.zeros(1 << FILTER_BITS, dtype=bool)
            flags[np.fromiter(places, dtype=np.uint64, count=len(places)) >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[w] = flags
        self.prints = np.concatenate([self.fingerprints(self.bits(list(c.elements()))[None]) for c in self.counts]) if self.ids else np.empty(0, np.uint64)
        self.index = [self._near(self.block(self.prints, b)) for b in range(64 // BLOCK_BITS)]

    @staticmethod
    def weight(items: int, total: int) -> int:
        """Shingles that many items hold say less."""
        return max(1, round(16 * math.log(1 + total / items)))

    def bits(self, some: list[bytes]) -> np.ndarray:
        """The weighted vote of each shingle on each bit."""
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in some], dtype="<u8")
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        return (2 * ones - 1) * np.array([[self.weights.get(s, self.rare)] for s in some], dtype=np.int32)

    @staticmethod
    def fingerprints(votes: np.ndarray) -> np.ndarray:
        """votes: windows x shingles x bits."""
        return np.packbits(votes.sum(axis=1) > 0, axis=1, bitorder="little").view("<u8").ravel()

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)

    @staticmethod
    def _near(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every value of a block, the items whose block is at most NEAR_BITS away: ends and items."""
        lists = [np.flatnonzero(np.bitwise_count(values ^ np.uint64(v)) <= NEAR_BITS) for v in range(1 << BLOCK_BITS)]
        return np.concatenate(([0], np.cumsum([len(x) for x in lists]))), np.concatenate(lists)

    def candidates(self, prints: np.ndarray) -> dict[int, dict[int, int]]:
        """For each window the items within RADIUS, with their distances."""
        n = len(self.prints)
        pairs = []
        for b, (ends, items) in enumerate(self.index):
            values = self.block(prints, b).astype(np.int64)
            many = ends[values + 1] - ends[values]
            which = np.repeat(np.arange(len(prints)), many)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(which * n + items[ends[values][which] + place])
        found = np.unique(np.concatenate(pairs))
        window, item = found // n, found % n
        far = np.bitwise_count(prints[window] ^ self.prints[item])
        out: dict[int, dict[int, int]] = defaultdict(dict)
        for w, i, d in zip(window[far <= RADIUS].tolist(), item[far <= RADIUS].tolist(), far[far <= RADIUS].tolist()):
            out[w][i] = d
        return out

    def similar(self, window: Counter, item: int) -> float:
        """Weighted Jaccard similarity of the shingles with their numbers of occurrences."""
        get, rare, other = self.weights.get, self.rare, self.counts[item]
        mine = sum(n * get(s, rare) for s, n in window.items())
        both = sum(min(n, other[s]) * get(s, rare) for s, n in window.items() if s in other)
        return both / (mine + self.sums[item] - both)

    def shared(self, texts: list[str | None]) -> dict[int, tuple[list[bytes], dict[int, list[int]]]]:
        """For texts that hold a shingle of an item: their words, and the places of shared shingles by item."""
        split_texts = [split(t) for t in texts]
        ends = np.cumsum([len(ws) for ws in split_texts])
        total = int(ends[-1]) if len(ends) else 0
        hashes = word_hashes((w for ws in split_texts for w in ws), total)
        found: dict[int, tuple[list[bytes], dict[int, list[int]]]] = {}
        for width in self.widths:
            runs = mixed(hashes, width)
            hits = np.flatnonzero(self.filters[width][runs >> np.uint64(64 - FILTER_BITS)])
            for at, run, doc in zip(hits.tolist(), runs[hits].tolist(), np.searchsorted(ends, hits, side="right").tolist()):
                items = self.anchors[width].get(run)
                if items and at + width <= ends[doc]:
                    places = found.setdefault(doc, (split_texts[doc], defaultdict(list)))[1]
                    start = at - int(ends[doc]) + len(split_texts[doc])
                    for i in items:
                        places[i].append(start)
        return found

    def matches(self, ws: list[bytes], places: dict[int, list[int]]) -> list[tuple]:
        """The best window of every item in one text: item, similarity, first word, words, differing bits."""
        by_size: dict[int, list[int]] = defaultdict(list)
        for i in places:
            by_size[min(self.sizes[i], len(ws))].append(i)
        best: dict[int, tuple] = {}
        for size, items in by_size.items():
            width = min(WIDTH, size)
            starts = sorted({s for i in items for p in places[i] for s in range(max(0, p - size + width), min(p, len(ws) - size) + 1)})
            for at in range(0, len(starts), WINDOWS_AT_ONCE):
                some = starts[at : at + WINDOWS_AT_ONCE]
                made = {k: b" ".join(ws[k : k + width]) for k in sorted({k for s in some for k in range(s, s + size - width + 1)})}
                row = {k: r for r, k in enumerate(made)}
                votes = self.bits(list(made.values()))
                rows = np.array([row[s] for s in some])[:, None] + np.arange(size - width + 1)
                near = self.candidates(self.fingerprints(votes[rows]))
                for w, found in near.items():
                    start, count = some[w], None
                    for i, far in found.items():
                        if i not in places:
                            continue
                        count = count or Counter(made[k] for k in range(start, start + size - width + 1))
                        score = self.similar(count, i)
                        if score >= self.similarity and (i not in best or (score, -start) > (best[i][0], -best[i][1])):
                            best[i] = (score, start, size, far)
        return [(self.ids[i], *found) for i, found in sorted(best.items())]

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple]]]:
        """Places of texts with their matches; texts without a match are left out."""
        if self.ids:
            for doc, (ws, places) in sorted(self.shared(texts).items()):
                found = self.matches(ws, places)
                if found:
                    yield doc, found


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have a bounded number of bytes together (or one text)."""
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")]
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= 6 * WORDS_AT_ONCE or i == len(sizes) - 1:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple], int]]:
    """Blocks of items as (item_id, text, [(shingle, items that hold it)] for shingles of several items), and the number of all items."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    size, total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    many = -(-size // block_bytes) or 1
    items = benchmark.select("item_id", "text", words(lower).alias("ws")).withColumn("row", F.xxhash64("item_id", "text")).dropDuplicates(["row"])
    run = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - WIDTH), lambda i: F.array_join(F.slice(ws, i + 1, WIDTH), " "))
    held = items.select("row", F.explode(F.array_distinct(F.when(F.size("ws") > WIDTH, run(F.col("ws"))).otherwise(F.array(F.array_join("ws", " "))))).alias("shingle"))
    several = held.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    shared = held.join(several, "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "n")).alias("shared"))
    full = items.join(shared, "row", "left")
    for b in range(many):
        part = full.filter(F.pmod("row", F.lit(many)) == b).select("item_id", "text", "shared").collect()
        yield [(r["item_id"], r["text"], [(s["shingle"], s["n"]) for s in r["shared"] or []]) for r in part], total


def _held(holder: dict, shared, total: int, similarity: float) -> Items:
    """The block's tables, made once in a task."""
    if "items" not in holder:
        holder["items"] = Items(shared.value, total, similarity)
    return holder["items"]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, first word, words, differing bits.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored.  Null and empty texts and
    items without words match nothing.  An item of fewer than five words is one shingle.  A text shorter
    than an item is one window.  Repeated documents give repeated rows, repeated items are one item.
    """
    ship(__name__)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("similarity", T.DoubleType()),
        T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("differing_bits", T.LongType()),
    ])
    names, found = schema.names, None
    for rows, total in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def work(batches: Iterable[pa.RecordBatch], shared=shared, total=total) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for part in portions(batch):
                    ids = part.column("doc_id").to_pylist()
                    hits = [(ids[doc], *m) for doc, ms in _held(held, shared, total, similarity).scan(part.column("text").to_pylist()) for m in ms]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*hits)], names=names)

        one = docs.select("doc_id", "text").mapInArrow(work, schema)
        found = one if found is None else found.unionByName(one)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no item is found, with their own columns; rows are filtered where they are read."""
    ship(__name__)
    for rows, total in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def work(batches: Iterable[pa.RecordBatch], shared=shared, total=total) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for part in portions(batch):
                    clean = np.ones(part.num_rows, dtype=bool)
                    for doc, _ in _held(held, shared, total, similarity).scan(part.column("text").to_pylist()):
                        clean[doc] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(work, docs.schema)
    return docs

