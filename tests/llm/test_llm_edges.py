"""Every operator and pipeline stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import bpe, chat, decontaminate, html_text, pii, quality, sharding, simhash, suffix_tree, warc

GOOD = " ".join(f"word{i} and thing{i}" for i in range(40))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, GOOD, "en", "a", 7), (1, GOOD, "en", "a", 7), (2, GOOD, None, None, 8), (3, None, "en", "a", 9), (4, "", "en", "a", 9),
    (None, GOOD + " joe@example.com", "en", "b", 1), (5, LONG, "de", "b", 2), (6, " \n\t ", "de", None, 3), (7, "the secret benchmark item has words enough " + GOOD, "en", "a", 0),
]
#: Columns that operators use as names of their own.
CLASHING = ["id", "fp", "row", "n_words", "kept", "shard", "slot", "ids", "part", "component", "start", "words"]
ITEMS = [(1, "The secret benchmark item has words enough"), (2, None), (3, ""), (3, "")]


def frame(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("words", F.lit(1))


REPORTS = {
    "bpe": lambda s, d: bpe.round_trip(d, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "quality": lambda s, d: quality.quality_report(d),
    "suffix_tree": lambda s, d: suffix_tree.score(d),
    "pii": lambda s, d: pii.find_personal_data(d),
    "sharding": lambda s, d: sharding.shard_report(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_per_document(spark, name):
    found = REPORTS[name](spark, frame(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert REPORTS[name](spark, frame(spark, [])).collect() == []


def test_encoding_and_decoding_apart(spark):
    path, pattern = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(frame(spark), path, pattern), path, pattern).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in decoded) == sorted((r[0] or 0, (r[1] or "").encode()) for r in ROWS)


def test_decontamination(spark):
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark), benchmark(spark)).collect()] == [(7, 1)]
    assert decontaminate.contaminated(frame(spark, []), benchmark(spark)).collect() == []
    assert decontaminate.contaminated(frame(spark), benchmark(spark, [])).collect() == []


def test_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://h/x", "<p>a</p>"), (2, "http://h/y", ""), (3, "no host", "<p>" + "b " * 50_000 + "</p>"), (4, "http://h/z", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("host", "seed", "text", "data", "mark", "chunk", "stats")})
    texts = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert texts == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0), (3, " ".join("b" * 50_000), 99_999), (4, "a", 1)]
    records = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.archive_report(pages).collect())
    assert records == [(0, 8, "revisit", 4), (1, 0, "response", 0), (1, 0, "response", 0), (2, 0, "revisit", 1), (3, 100_007, "response", 0), (4, 8, "response", 0)]
    empty = pages.limit(0)
    assert html_text.extract(empty).count() == 0
    assert warc.archive_report(empty).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (None, 0, "user", "x" * 100_000), (2, None, "user", ""), (3, 5, "system", "s"), (4, 0, None, "t")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("call_id", "name", "json", "n", "after")})
    found = sorted((r["conv_id"] or 0, r["status"], r["n_calls"], r["n_results"], r["valid"]) for r in chat.format_chats(chats).collect())
    assert found == [(0, "unanswered", 1, 0, True), (1, "linked", 2, 1, True), (2, "unanswered", 1, 0, True)]
    assert chat.format_chats(chats.limit(0)).count() == 0


def test_stages_keep_columns_and_rows(spark, tmp_path):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = frame(spark)
        found = stage(spark, docs, str(tmp_path))
        if name != "byte-level BPE":
            assert found.columns == docs.columns
        rows = found.collect()
        kept[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
        if "start" in found.columns:
            assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
    every = sorted((r[0] is None, r[0] or 0) for r in ROWS)
    gone = lambda *ids: [k for k in every if k[1] not in ids]
    assert kept["quality rules"] == gone(3, 4, 6)
    #: 1 and its copies are one group with 2 and the nameless row, the empty texts are one.
    prints = {i: brute.simhash(r[1]) for i, r in enumerate(ROWS)}
    groups = brute.near_groups(prints)
    assert len(kept["near duplicates"]) == len(set(groups.values()))
    assert kept["benchmark decontamination"] == gone(7)
    assert kept["personal data"] == every == kept["byte-level BPE"]


def test_pipeline_over_the_smallest_tables(spark, folder):
    """Each stage against its plain rewriting, on what the stage before it kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = kept["quality rules"]
    passed = {r["doc_id"] for r in quality.quality_report(spark.read.parquet(f"{folder}/documents.parquet")).filter("kept").collect()}
    assert set(good) == passed and all(texts[i] == t for i, t in good.items())
    groups = brute.near_groups({i: brute.simhash(t) for i, t in good.items()})
    assert set(kept["near duplicates"]) == set(groups.values())
    leaked = {d for d, _ in brute.leaks(kept["near duplicates"], items)}
    assert set(kept["benchmark decontamination"]) == set(kept["near duplicates"]) - leaked
    for i, masked in kept["personal data"].items():
        whole = kept["benchmark decontamination"][i]
        assert (masked == whole) == (not brute.base_spans(whole)) and not [s for s in brute.base_spans(masked) if s[3] != "card"]
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(last) == set(kept["personal data"])
    for i, text in kept["personal data"].items():
        assert last[i]["decoded_sha256"] == brute.hashlib.sha256(text.encode()).hexdigest() and last[i]["n_tokens"] * 4 == len(last[i]["ids"])
