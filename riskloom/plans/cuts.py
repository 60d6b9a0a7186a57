"""Exact-size random subsets by hash, without a sort or a limit over the rows.

A row's place in the random order is (hash of its id, id).  Choosing the n first
rows of a class means finding the n-th place.  One job counts rows per class and
leading hash bits, which also gives the class sizes; a second looks only into the
slots that hold a wanted place.  The choice itself is then a plain filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.hashes import HASH_BITS, text_hash
from riskloom.session import cut_lineage

BITS = 12
FEW_ROWS = 50_000


class HashOrder:
    """A random but repeatable order of the rows of each class."""

    def __init__(self, df: DataFrame, id_col: str, label: str, seed: int = 42, few_rows: int = FEW_ROWS, store: bool = False):
        """`store`: keep classes, hashes and ids in the shared folder, where `df` is dear to make again."""
        self.label, self.id_col, self.few_rows = label, id_col, few_rows
        self.hashed = text_hash(seed, F.col(id_col))
        self.rows = df.select(F.col(label).alias("s"), self.hashed.alias("h"), F.col(id_col).alias("id"))
        self.rows = cut_lineage(self.rows) if store else self.rows
        slots = self.rows.groupBy("s", _slot(HASH_BITS - BITS)).count().collect()  # at most classes x 4096 rows
        self.slots: dict = {}
        for r in sorted(slots, key=lambda r: r["slot"]):
            self.slots.setdefault(r["s"], []).append((r["slot"], r["count"]))
        self.counts = {s: sum(n for _, n in sizes) for s, sizes in self.slots.items()}

    def first(self, *wanted: dict) -> list[Column]:
        """For each {class: n} a boolean column, true for exactly n rows of the class (all of it, if smaller)."""
        places = {}
        for s, n in {(s, n) for targets in wanted for s, n in targets.items()}:
            places[s, n] = self._slot_of(s, n)
        edges = self._edges({k: p for k, p in places.items() if p not in ("none", "all")})
        place = F.struct(self.hashed.alias("h"), F.col(self.id_col).alias("id"))
        columns = []
        for targets in wanted:
            chosen = F.lit(False)
            for s, n in targets.items():
                if places[s, n] in ("none", "all"):
                    inside = F.lit(places[s, n] == "all")
                else:
                    h, row_id = edges[s, n]
                    inside = place <= F.struct(F.lit(h).alias("h"), F.lit(row_id).alias("id"))
                chosen = F.when(F.col(self.label) == F.lit(s), inside).otherwise(chosen)
            columns.append(chosen)
        return columns

    def _slot_of(self, s, n: int):
        if n <= 0:
            return "none"
        return _locate(self.slots.get(s, []), n) or "all"

    def _edges(self, places: dict) -> dict:
        """(h, id) of each wanted place: class, slot and number inside the slot."""
        small = {k: p for k, p in places.items() if p[2] <= self.few_rows}
        found = {k: self._narrow(k[0], p) for k, p in places.items() if k not in small}
        if small:
            spots = [(F.col("s") == k[0]) & (F.col("slot") == p[0]) & (F.col("place") == p[1]) for k, p in small.items()]
            slots = [(F.col("s") == k[0]) & (F.col("slot") == p[0]) for k, p in small.items()]
            held = self.rows.withColumn("slot", _slot(HASH_BITS - BITS)).where(_any(slots))
            inside = W.partitionBy("s", "slot").orderBy("h", "id")  # at most few_rows rows
            hits = held.withColumn("place", F.row_number().over(inside)).where(_any(spots)).collect()
            at = {(r["s"], r["slot"], r["place"]): (r["h"], r["id"]) for r in hits}
            found |= {k: at[k[0], p[0], p[1]] for k, p in small.items()}
        return found

    def _narrow(self, s, place: tuple) -> tuple:
        """A slot too large to sort at once: count its next bits, until few rows are left."""
        rows, shift = self.rows.where(F.col("s") == s), HASH_BITS - BITS
        while True:
            slot, n, size = place
            rows = rows.where(F.shiftright("h", shift) == slot)
            if size <= self.few_rows or shift < BITS:
                r = rows.orderBy("h", "id").offset(n - 1).limit(1).first()
                return r["h"], r["id"]
            shift -= BITS
            sizes = sorted((r["slot"], r["count"]) for r in rows.groupBy(_slot(shift)).count().collect())  # 4096 rows
            place = _locate(sizes, n)


def _slot(shift: int) -> Column:
    return F.shiftright("h", shift).alias("slot")


def _locate(sizes: Sequence[tuple], n: int) -> tuple | None:
    """(slot, number inside it, rows in it) of the n-th row."""
    for slot, size in sizes:
        if n <= size:
            return slot, n, size
        n -= size
    return None


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
