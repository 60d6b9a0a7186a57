"""Near duplicates by SimHash, found with a hierarchical index in Gray order.

Fingerprints are reduced to distinct ones first.  Two fingerprints within the distance agree on at least
`BLOCKS - distance` of BLOCKS bit blocks, so every choice of that many blocks is a bucket key and each linked
pair shares a bucket.  In a bucket the fingerprints are sorted by the Gray rank of their bits, neighbours in
this order share most bits, and runs of them form a tree: a node holds the bits that all of its members share.
Pairs of nodes are walked from the root.  A pair whose shared bits already differ in more than `distance`
places is pruned with everything below; a pair whose open and differing bits together are at most `distance`
links everything below at once.  A bucket returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import ship, small_side, stored

SHINGLE = 4
DISTANCE = 4
BLOCKS = 6
SEED = 42
#: Children of a node of the tree.
FANOUT = 8
#: Fingerprints of a bucket that are compared in one task; larger buckets are cut into chunks that meet in pairs.
CHUNK = 4096
#: Pairs of nodes that are looked at together.
FRONT = 1_000_000
#: Shingles that are counted together.
SHINGLES_AT_ONCE = 65_536

BITS = 64
U64 = np.uint64


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    wide = min(width, len(words))
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - wide + 1].tolist(), stops[wide - 1 :].tolist())
    hashes = [hashed(joined[a:b], SEED) for a, b in pairs]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        some = np.array(hashes[at : at + SHINGLES_AT_ONCE], dtype="<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The columns of docs but `text`, and `fp`: the 64 bits of the fingerprint of the text, as a long."""
    ship(__name__)
    kept = [c for c in docs.columns if c != "text"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], dtype=U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found)], names=[*kept, "fp"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("fp", T.LongType())])
    return docs.select(*kept, "text").mapInArrow(work, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> U64(shift)
    return x


class GrayTree:
    """Nodes over fingerprints that are sorted by bucket and Gray rank; level 0 are the fingerprints themselves."""

    def __init__(self, values: np.ndarray, bucket_starts: np.ndarray):
        full = np.full(len(values), ~U64(0))
        self.levels = [(values, full, np.arange(len(values)), np.arange(len(values)) + 1)]
        starts, stops = bucket_starts, np.append(bucket_starts[1:], len(values))
        while (stops - starts > 1).any():
            values, full, *_ = self.levels[-1]
            cuts = -(-(stops - starts) // FANOUT)
            first_node = np.concatenate(([0], np.cumsum(cuts)))
            which = np.repeat(np.arange(len(starts)), cuts)
            left = starts[which] + (np.arange(first_node[-1]) - first_node[which]) * FANOUT
            right = np.minimum(left + FANOUT, stops[which])
            ones, some = np.bitwise_and.reduceat(values & full, left), np.bitwise_or.reduceat(values | ~full, left)
            shared = ~(ones ^ some)
            self.levels.append((ones & shared, shared, left, right))
            starts, stops = first_node[:-1], first_node[1:]
        self.roots = starts

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places that are linked, enough to connect all that are."""
        top = len(self.levels) - 1
        waiting = [(top, self.roots, self.roots)]
        while waiting:
            level, a, b = waiting.pop()
            if len(a) > FRONT:
                half = len(a) // 2
                waiting += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            values, shared, left, right = self.levels[level]
            both = shared[a] & shared[b]
            apart = (values[a] ^ values[b]) & both
            least = np.bitwise_count(apart)
            near = least <= distance
            a, b, most = a[near], b[near], (np.bitwise_count(apart | ~both))[near]
            sure = most <= distance
            if sure.any():
                yield from self._all_linked(level, a[sure], b[sure])
            a, b = a[~sure], b[~sure]
            if level and len(a):
                a, b = self._children(left, right, a, b)
                other = (a != b) if level == 1 else slice(None)
                waiting.append((level - 1, a[other], b[other]))

    @staticmethod
    def _children(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide, high = right[a] - left[a], right[b] - left[b]
        many = wide * high
        which = np.repeat(np.arange(len(a)), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        x, y = left[a][which] + place // high[which], left[b][which] + place % high[which]
        return x[x <= y], y[x <= y]

    def _all_linked(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every member of a and of b is linked to the first of a."""
        first, stop_a, start_b, stop_b = a, a + 1, b, b + 1
        for down in range(level, 0, -1):
            _, _, left, right = self.levels[down]
            first, stop_a = left[first], right[stop_a - 1]
            start_b, stop_b = left[start_b], right[stop_b - 1]
        for start, stop in ((first, stop_a), (start_b, stop_b)):
            many = stop - start
            which = np.repeat(np.arange(len(first)), many)
            yield first[which], start[which] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def roots_of(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of linked places in `parent`, a forest in which every root is the least of its tree."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low < high
        if not open_.any():
            return parent
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped


def forest(fps: np.ndarray, buckets: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole buckets, sorted by bucket: fingerprints, and those that stand for their groups inside the bucket."""
    new = np.concatenate(([True], buckets[1:] != buckets[:-1]))
    alone = new & np.append(new[1:], True)
    fps, buckets = fps[~alone], buckets[~alone]
    if not len(fps):
        return fps, fps
    values = fps[np.lexsort((gray_rank(fps), buckets))]
    starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    parent = np.arange(len(values))
    for a, b in GrayTree(values, starts).links(distance):
        parent = roots_of(parent, a, b)
    linked = parent != np.arange(len(values))
    return values[linked], values[parent[linked]]


def _bucket_links(distance: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, keys = np.empty(0, U64), np.empty(0, np.int64)

        def emit(upto: int) -> Iterator[pa.RecordBatch]:
            if upto:
                a, b = forest(fps[:upto], keys[:upto], distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            fps = np.concatenate((fps, batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)))
            keys = np.concatenate((keys, batch.column("bucket").to_numpy(zero_copy_only=False)))
            if len(fps) >= 16 * CHUNK:
                last = int(np.searchsorted(keys, keys[-1], side="left"))
                yield from emit(last)
                fps, keys = fps[last:], keys[last:]
        yield from emit(len(fps))

    return work


def block_masks(blocks: int = BLOCKS) -> list[int]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bucketed(distinct: DataFrame, distance: int, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """fp and bucket: each fingerprint under every choice of blocks, in buckets of two chunks at most.

    A bucket is named by a hash of its choice and bits; two that share a name only cost a few comparisons.
    A bucket of more than `chunk` fingerprints is cut by hash into chunks, and each two chunks meet.
    """
    masks = block_masks(blocks)
    kept = [sum(masks[i] for i in choice) for choice in combinations(range(blocks), blocks - distance)]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for i, m in enumerate(kept)))
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    large = sizes.filter(F.col("n") > chunk).select(F.col("key").alias("large_key"), F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks"))
    sized = rows.join(small_side(stored(large, "large-buckets")), F.col("key") == F.col("large_key"), "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.xxhash64("key", F.least(other, mine), F.greatest(other, mine)))
    return sized.select("fp", F.explode(F.when(F.col("chunks").isNull(), F.array("key")).otherwise(meets)).alias("bucket"))


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Pairs a, b of distinct fingerprints that connect whatever is within `distance`, directly or in steps."""
    ship(__name__)
    sorted_ = bucketed(distinct, distance, blocks, chunk).repartition("bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(_bucket_links(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of `edges`: nodes with the same root are connected.

    Each round every node goes to the least of its neighbours and itself in a random order, and edges are
    rewritten to where their ends went; the number of nodes falls by a constant factor.  The rounds are
    then followed from the last to the first.
    """
    order = lambda c: F.xxhash64(F.lit(SEED), c)
    edges, moves = stored(edges.filter("a != b"), "edges"), []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min_by("other", order("other")).alias("other"))
        moved = stored(least.select("node", F.when(order("other") < order("node"), F.col("other")).otherwise(F.col("node")).alias("root")), "moves")
        moves.append(moved)
        to = lambda end: moved.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        ends = edges.join(to("a"), "a").join(to("b"), "b").filter("a_root != b_root")
        edges = stored(ends.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    if not moves:
        return edges.toDF("node", "root")
    found = moves.pop()
    while moves:
        later = found.toDF("later", "later_root")
        earlier = moves.pop()
        found = earlier.join(later, earlier["root"] == later["later"], "left").select("node", F.coalesce("later_root", "root").alias("root"))
    return found


def classes(marked: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """fp, root and component of every distinct fingerprint of `marked` (doc_id, fp).

    Fingerprints with the same root are connected; component is the least doc_id among their documents,
    null where none of them has one.
    """
    least = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("fp"), distance, blocks, chunk))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "named")
    return rooted.join(named, F.col("root") == F.col("named")).select(F.col("fp").alias("class_fp"), "root", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, and component_id of every document.

    docs needs doc_id and text; other columns are ignored.  A null or empty text has fingerprint zero and is
    linked like any other.  Repeated rows and equal texts share their fingerprint, and every row gets its row.
    A component none of whose documents has a doc_id has a null name.
    """
    marked = stored(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    found = marked.join(classes(marked), F.col("fp") == F.col("class_fp"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the least doc_id of every component, with its own columns; of equal ids, one row.

    Where no document of a component has a doc_id, one of them stays.
    """
    wide = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "documents")
    marked = stored(fingerprints(wide.select("id", "row.doc_id", "row.text")), "fingerprints")
    found = marked.join(classes(marked), F.col("fp") == F.col("class_fp")).filter(F.col("doc_id").eqNullSafe(F.col("component")))
    first = found.groupBy("root").agg(F.min("id").alias("kept"))
    return wide.join(first, F.col("id") == F.col("kept"), "left_semi").select("row.*")
