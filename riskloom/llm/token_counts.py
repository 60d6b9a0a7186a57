"""Token counts of texts: Arrow batches go to the tokenizer in calls of equal bytes, only lengths come back.

A long text is split where its tokens cannot depend on what stands on the other side, so no call grows with
a text: the encoding of the parts has as many tokens as that of the whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ship

#: Characters above which a text is split, and bytes that one call of the tokenizer gets.
PART_CHARS = 16_384
CALL_BYTES = 262_144
#: Tokens above which a document is over the limit.
LIMIT = 1024


class Counter:
    """A tokenizer file, and where texts may be split for it.

    The pattern of byte-level pre-tokenizers always begins a match at white space that follows something else, and
    where an ASCII digit and an ASCII letter meet.  Nothing in it looks further across such a place, and merges stay
    inside a match.  Tokenizers of other kinds get whole texts, as do texts without such a place.
    """

    PLACES = {"space": r"(?<=\S)(?=[ \n])", "digit": r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"}

    def __init__(self, path: str, part_chars: int = PART_CHARS, call_bytes: int = CALL_BYTES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.places = self._places(json.load(file))
        self.part_chars, self.call_bytes = part_chars, call_bytes

    def _places(self, config: dict) -> re.Pattern | None:
        before = config.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        added = config.get("added_tokens") or []
        if not plain or config.get("normalizer") or any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added):
            return None
        kinds = [k for k in self.PLACES.values() if not any(re.search(k, a["content"]) for a in added)]
        return re.compile("|".join(kinds)) if kinds else None

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about `part_chars` characters, split at safe places only."""
        start = 0
        while self.places and len(text) - start > self.part_chars:
            place = self.places.search(text, start + self.part_chars)
            if place is None:
                break
            yield text[start : place.start()]
            start = place.start()
        yield text[start:]

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        found: list[int] = []
        parts, rows, size = [], [], 0

        def call() -> None:
            for row, encoding in zip(rows, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
                found[row] += len(encoding)
            parts.clear()
            rows.clear()

        for row, text in enumerate(texts):
            found.append(0)
            for part in self.parts(text or ""):
                parts.append(part)
                rows.append(row)
                size += len(part) if part.isascii() else len(part.encode())
                if size >= self.call_bytes:
                    call()
                    size = 0
        call()
        return np.array(found, dtype=np.int64)


def token_count(text: Column, path: str, part_chars: int = PART_CHARS, call_bytes: int = CALL_BYTES) -> Column:
    """The number of tokens of a text column, as the tokenizer file at `path` encodes it; a null text has none."""
    ship(__name__)

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Counter(path, part_chars, call_bytes)
        for texts in batches:
            yield pa.array(known.counts(t.as_py() for t in texts), pa.int64())

    return lengths(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every document.

    Whole texts are counted, without begin, end or added special tokens; special strings inside a text are what the
    tokenizer takes them for.  A null or empty text has no bytes and no tokens.  Repeated rows, also of one doc_id or
    without one, stay rows of their own; an empty table gives none; other columns, whatever their names, are left
    out.  `path` is a tokenizer file that every executor can open.  A text without a safe place, such as one endless
    word, is encoded in one call.
    """
    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return sized.withColumn("over_limit", F.col("n_tokens") > limit)
