"""The operators against plain rewritings, SQL, round trips and held-out accuracy."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from riskloom.llm import bpe, chat, decontaminate, html_text, pii, quality, sharding, simhash, suffix_tree, warc
from riskloom.llm.queries import QUERIES, SQL

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, name):
    ours, theirs = oracle.twins(spark, name, folder)
    assert ours == theirs


# byte-level BPE


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(RANKS, public_tokenizers.PATTERN)


def test_encodes_as_the_library(encoder):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x300)] + [chr(c) for c in (0x85, 0x1680, 0x2028, 0x3000, 0x200B, 0x660, 0xB2, 0x1F600, 0x4E00, 0x301, 0x1C, 0x1F)] * 6
    letters += ["the ", "'s", "'LL", "tion", "  ", "\n\n", " 12", "aaaa", "<|endoftext|>"] * 20
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 3000, "".join(rng.choice("etaoin") for _ in range(4000))]
    for text in texts:
        ids = encoder.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_appends_and_edits_equal_encoding_anew(encoder):
    rng = random.Random(5)
    for _ in range(200):
        piece = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 400))).encode()
        table = bpe.Prefixes(encoder.vocabulary, piece[:9])
        table.append(piece[9:])
        assert table.last == bpe.Prefixes(encoder.vocabulary, piece).last
        start = rng.randint(0, len(piece))
        stop = rng.randint(start, min(len(piece), start + 5))
        new = bytes(rng.choice(b"xyzthe") for _ in range(rng.randint(0, 6)))
        table.replace(start, stop, new)
        fresh = bpe.Prefixes(encoder.vocabulary, piece[:start] + new + piece[stop:])
        assert (table.last, table.ids()) == (fresh.last, fresh.ids())
        assert table.ids() == bpe.merged(encoder.vocabulary.ranks, table.piece)


# SimHash


def test_groups_of_fingerprints(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(800)}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 90)):
            y = x
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                y ^= 1 << bit
            prints.add(y)
            x = y if rng.random() < 0.3 else x
    ids = dict(enumerate(sorted(prints)))
    marked = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in ids.items()], "doc_id long, fp long")
    want = brute.near_groups(ids)
    for chunk in (4096, 16):
        found = marked.join(simhash.classes(marked, chunk=chunk), F.col("fp") == F.col("class_fp")).collect()
        assert {r["doc_id"]: r["component"] for r in found} == want


def test_simhash_of_documents(spark, folder):
    found = QUERIES["op2_simhash"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: brute.simhash(t) for i, t in texts.items()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in found} == prints
    assert {r["doc_id"]: r["component_id"] for r in found} == brute.near_groups(prints)


# Quality


def test_repeated_words_on_both_ways(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 90)))) for i in range(200)] + [(200, "x " * 500), (201, " ".join(str(i) for i in [*range(300), *range(300)]))]
    found = spark.createDataFrame(rows, "id long, text string").select("id", quality.text_counts(F.col("text"))["n_repeat_words"].alias("n")).collect()
    for r in found:
        words = dict(rows)[r["id"]].split()
        windows = Counter(zip(words, words[1:], words[2:]))
        assert r["n"] == len({i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)})


def test_thresholds_follow_the_group(spark):
    def text(sign, k):
        return " ".join([f"word{k}{j}" + (sign if j % 2 else "") for j in range(60)])

    rows = [(i, text("$", i), "en", "signs") for i in range(250)] + [(1000 + i, text("", i), "en", "plain") for i in range(250)] + [(2000, text("$", 1), "en", "plain"), (2001, text("$", 1), "en", "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs).collect()}
    assert all(kept[i] for i in [*range(250), *range(1000, 1250)]) and not kept[2000]


def test_spread_comes_from_the_group_and_not_from_a_constant(spark):
    def text(words, signs, k):
        return " ".join(f"word{k}{j}" + ("$" if j < signs else "") for j in range(words))

    rows = [(i, text(60, 0, i), "en", "short") for i in range(250)] + [(1000 + i, text(2000, 0, i), "en", "long") for i in range(250)]
    rows += [(2000 + k, text(60, 4, 7), "en", source) for k, source in enumerate(("short", "long"))]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in [*range(250), *range(1000, 1250), 2000]) and not kept[2001]


def test_quality_follows_the_labels(spark, folder):
    folder = folder.replace("0.001", "0.01")
    found = QUERIES["op3_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    good, bad = [r["kept"] for r in found if r["quality"] == 1], [r["kept"] for r in found if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.05


# Decontamination


def test_finds_what_all_windows_give(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 50))) for i in range(60)} | {60: "", 61: None}
    items[62] = items[3].upper()

    def noisy(text):
        ws = text.split()
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        if rng.random() < 0.3:
            ws.insert(rng.randrange(len(ws) + 1), "zz")
        return " ".join(ws)

    filler = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    texts = {k: f"{filler(80)} \n{noisy(items[rng.randrange(60)])} {filler(30)}" for k in range(250)} | {400: None, 401: "", 402: items[5]}
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute.leaks(texts, items)
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()} == set(texts) - {d for d, _ in want}


def test_blocks_of_the_benchmark_find_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"alpha{i} beta gamma delta epsilon zeta{i} eta theta iota kappa{i}") for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"start alpha{i} beta gamma delta epsilon zeta{i} eta theta iota kappa{i} end") for i in range(0, 40, 3)], "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (200,))
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == one and len(one) == 10


# HTML


def test_text_of_pages(spark, folder):
    import html

    def plain(source):
        inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = [html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))) for p in re.split(r"</?(?:p|h1)>", inside)]
        return "\n".join(p for p in (re.sub(r"\s+", " ", p).strip() for p in parts) if p)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = QUERIES["op5_html_text"](spark, folder).collect()
    assert {r["page_id"]: r["text"] for r in found} == {i: plain(s) for i, s in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_wrapper_of_a_host_without_marks(spark):
    page = "<body><div>Our site &amp; menu</div><div class=c><h2>{0}</h2><p>Text about {0}<br>and more</div><div>All rights reserved</div></body>"
    rows = [(i, f"https://h.example/{i}", page.format(w)) for i, w in enumerate("apples pears plums figs dates".split())]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in found} == {f"{w}\nText about {w} and more" for w in "apples pears plums figs dates".split()}


WORDS = "apples pears plums figs dates limes grapes kiwis".split()


def texts_of(spark, pages):
    """Main texts of one host's pages, in order."""
    rows = [(i, f"https://h.example/{i}", source) for i, source in enumerate(pages)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def test_pages_without_article_tags_give_the_same(spark, folder):
    folder = folder.replace("0.001", "0.1")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    renamed = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    tagged, plain = ({r["page_id"]: r["text"] for r in html_text.extract(p).collect()} for p in (pages, renamed))
    assert tagged == plain


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><article>Teaser {0}</article><div class=c><h2>{0}</h2><p>Long and special text about {0}</p><p>More of {0} for all who read on</p><p>And a last word on {0} in three parts</p></div>", "{0}\nLong and special text about {0}\nMore of {0} for all who read on\nAnd a last word on {0} in three parts"),
        ("<body><article><h2>{0}</h2><p>Text about {0}</p><div>About the author</div></article>", "{0}\nText about {0}"),
        ("<body><div>Menu</div><div><article><p>First on {0}</p></article><article><p>Then much more on {0}</p></article></div>", "First on {0}\nThen much more on {0}"),
        ("<body><div>Byline<p>Text about {0}</p><p>{0} again</p></div>", "Text about {0}\n{0} again"),
    ],
)
def test_the_slot_decides_and_tags_do_not(spark, page, text):
    assert texts_of(spark, [page.format(w) for w in WORDS]) == [text.format(w) for w in WORDS]


def test_copies_of_a_page_are_one_page(spark):
    page = "<body><nav>{1}</nav><div>Our menu</div><div class=c><h2>{0}</h2><p>Text about {0}</p></div></body>"
    words = WORDS + ["apples"] * 30
    assert texts_of(spark, [page.format(w, "") for w in words]) == [f"{w}\nText about {w}" for w in words]
    assert texts_of(spark, [page.format(w, i) for i, w in enumerate(words)]) == [f"{w}\nText about {w}" for w in words]


def test_each_layout_of_a_host_has_its_wrapper(spark):
    blog = "<body><div class=top>Menu</div><div class=post><h2>{0}</h2><p>Text about {0}</p><div>Posted by us</div></div></body>"
    shop = "<body><div class=wide>Goods</div><section><div class=item><h2>Buy {0}</h2><p>Price of {0}</p></div><div class=note>Free delivery</div></section></body>"
    found = texts_of(spark, [x.format(w) for w in WORDS for x in (blog, shop)] + ["<p>gone"])
    assert found == [x for w in WORDS for x in (f"{w}\nText about {w}", f"Buy {w}\nPrice of {w}")] + ["gone"]


def test_template_that_the_seed_lacks(spark):
    page = "<body><div class=c><h2>{0}</h2><p>Text about {0}</p></div></body>"
    noted = "<body><div class=c><h2>{0}</h2><p>Text about {0}</p><blockquote>Read more here</blockquote></div></body>"
    found = texts_of(spark, [page.format(w) for w in WORDS] + [noted.format(w + "x") for w in WORDS[:4]])
    assert found == [f"{w}\nText about {w}" for w in [*WORDS, *(w + "x" for w in WORDS[:4])]]


@pytest.mark.parametrize(
    "source, text",
    [
        ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a\nb"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"), ("<p>one<span class='ad'>buy</span> two", "one two"), ("<script>'</p>'</script><p>v", "v"),
        ("<article><header><h1>T</h1></header><p>x</p><section id=comments><p>c</p></section><form>f</form></article><p>y", "T\nx"), ("<a href='open>closed <p>hi</p>", "closed\nhi"), ("<!-- open <p>x", ""),
        ("<article><h2 id=discussion>D</h2><p>x</p><h2 id='related-work'>R</h2><p id=share>y</p></article>", "D\nx\nR\ny"), ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>", "Let x=2 hold."),
        ("<article><section id='comments-on-law'><p>a</p></section><div class='notice-of-motion'><p>b</p></div></article>", "a\nb"), ("<object data=x>seen</object> <svg><text>t</text></svg>", "seen"),
        ("<div class='comment-list'>c</div><div class='wide site-footer'>f</div><section id=discussion><p>k</p></section><div class='cookie-banner x'>z</div><div id=sidebar2>s</div>", "k"),
        ("<div hidden>h</div><main>k</main><footer>z", "k"), ("<header>site</header><p>s", "s"),
    ],
)
def test_markup(source, text):
    assert html_text.main_text(html_text.Page(source), None, set(), {}) == text


def test_deep_and_wide_pages_end():
    assert html_text.main_text(html_text.Page("<div>" * 30_000 + "x"), None, set(), {}) == "x"
    seed, page = html_text.Page("<body>" + "<p>w</p>" * 300), html_text.Page("<body><nav>a</nav>" + "<p>w</p>" * 9000)
    assert len(html_text.matched(seed, page)) == 302
    assert len(html_text.matched(html_text.Page("<div>" * 30_000 + "x"), html_text.Page("<div>" * 20_000 + "<p>y"))) == 20_001


def test_long_lists_of_unlike_items_are_aligned():
    rng = random.Random(1)
    ends = ("", "<p>y</p>", "<div>q<p>z</p></div>", "<ul><li>1<li>2</ul>")
    source = lambda: "<ul>" + "".join(f"<li><div><h3>t</h3><p>x</p>{rng.choice(ends)}</div></li>" for _ in range(3000)) + "</ul>"
    start = time.process_time()
    assert len(html_text.matched(html_text.Page(source()), html_text.Page(source()))) > 3000 * 4
    assert time.process_time() - start < 10


def test_alignment_is_as_large_as_can_be(monkeypatch):
    rng = random.Random(1)

    def tree(depth):
        tag = rng.choice(["div", "ul", "section", "p"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4)) if depth) + f"</{tag}>"

    def most(a, b, x=0, y=0):
        if a.labels[x] != b.labels[y]:
            return 0
        rows = [[0] * (len(b.children[y]) + 1)]
        for c in a.children[x]:
            rows.append([0])
            for j, d in enumerate(b.children[y]):
                rows[-1].append(max(rows[-2][j + 1], rows[-1][j], rows[-2][j] + most(a, b, c, d)))
        return 1 + rows[-1][-1]

    for cells in (400, 0):
        monkeypatch.setattr(html_text, "PLAIN_CELLS", cells)
        for _ in range(200):
            a, b = html_text.Page(tree(3) + tree(2)), html_text.Page(tree(3) + tree(3))
            pairs = html_text.matched(a, b)
            assert len(pairs) == most(a, b) and len(set(pairs.values())) == len(pairs)
            assert all(a.labels[x] == b.labels[y] and (not x or pairs[a.parents[x]] == b.parents[y]) for x, y in pairs.items())


def test_alignment_does_not_depend_on_how_much_there_is(monkeypatch):
    """Many unlike items weigh as few do: by all that matches in them, and a large alignment is that of a small one."""
    rng = random.Random(2)
    item = lambda bits, text: "<li><div>" + "".join("<p>x</p>" if b == "1" else "<div>x</div>" for b in f"{bits:07b}") + f"</div>{text}</li>"
    page = lambda kinds: html_text.Page("<ul>" + "".join(item(k, "<table><tr><td>y</table>" * rng.randint(0, 2)) for k in kinds) + "</ul>")
    a, b = page(rng.sample(range(128), 120)), page(rng.sample(range(128), 120))

    def most(x, y, known={}):
        if a.labels[x] != b.labels[y]:
            return 0
        if (x, y) not in known:
            rows = [[0] * (len(b.children[y]) + 1)]
            for c in a.children[x]:
                rows.append([0])
                for j, d in enumerate(b.children[y]):
                    rows[-1].append(max(rows[-2][j + 1], rows[-1][j], rows[-2][j] + most(c, d)))
            known[x, y] = 1 + rows[-1][-1]
        return known[x, y]

    whole = html_text.matched(a, b)
    assert len(whole) == most(0, 0)
    monkeypatch.setattr(html_text, "HELD_CELLS", 1000)
    assert html_text.matched(a, b) == whole


# Suffix tree


def test_counts_and_scores(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), " "] for i, t in texts.items()}
    training = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, kinds = sum(training.values()), len(training)
    gain = 0.0
    for r in QUERIES["op6_suffix_tree"](spark, folder).collect():
        ws = tokens[r["doc_id"]]
        base = sum(np.log10((training[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(training[w] > 0 for w in ws), total)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        gain += (r["score"] - r["base_score"]) if r["held_out"] else 0
    assert gain > 0


def test_contexts_are_kept_by_what_they_tell(spark):
    """In a corpus of a million tokens a context that is seen forty times is kept if its next symbols diverge."""
    rows = [(7, 1, 40, 0.01), (8, 1, 20, 0.5), (8, 2, 20, 0.5), (9, 1, 19, 0.01)]
    runs = spark.createDataFrame(rows, "context long, next long, n long, expected double")
    assert suffix_tree.retained(runs, 1_000_000) == [(7, 40)]
    words = [f"w{i}" for i in range(1000)]
    assert suffix_tree.Symbols([*words, suffix_tree.END], [50] * 1000 + [100], 2_000_000, 1000).size == 1000


def test_texts_are_split_as_words_and_runs_counted(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", *("".join(rng.choice(["a", "B", "É", "ſ", "\x1c", "\x85", "\xa0", " ", "\t", "\x0b", "\r\n"]) for _ in range(rng.randint(1, 80))) for _ in range(300))]
    plain = [(t or "").encode().lower().split() for t in texts]
    words, sizes = suffix_tree.split(pa.array(texts))
    assert (words.cast(pa.binary()).to_pylist(), sizes.tolist()) == ([w for ws in plain for w in ws], [len(ws) for ws in plain])

    docs = spark.createDataFrame([(t, i % 7 == 0) for i, t in enumerate(texts)], "text string, held_out boolean")
    symbols = suffix_tree.Symbols(["a", "b", "ab", suffix_tree.END], [9, 9, 9, 9], 99, 9)
    coded = suffix_tree.coded(docs, spark.sparkContext.broadcast(symbols))
    runs = [[symbols.start, *(symbols.place.get(w, symbols.other) for w in ws), symbols.end] for i, ws in enumerate(plain) if i % 7]
    pairs = Counter(p for run in runs for p in zip(run, run[1:]))
    triples = Counter(p for run in runs for p in zip(run, run[1:], run[2:]))
    some = sorted({p for p in pairs if symbols.end not in p})[::2]
    key = lambda *run: sum(s * symbols.count**k for k, s in enumerate(reversed(run)))
    counted = lambda *given: {r["key"]: r["n"] for r in suffix_tree.run_counts(coded, symbols.count, symbols.kind, *given).collect()}
    assert counted() == {key(*p): n for p, n in pairs.items()}
    assert counted(np.array([key(*p) for p in some])) == {key(*p): n for p, n in triples.items() if p[:2] in some}
    rare = lambda ws: Counter(w.decode() for w in ws if w not in symbols.place)
    assert [dict(zip(r["words"], r["times"])) for r in coded.collect()] == [rare(ws) for ws in plain]


def test_texts_are_read_for_the_counts_and_once_more(spark):
    """Runs and scores come from the stored symbols: splitting every text in each pass took most of the time."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text_of(i):
        read.add(1)
        return f"some words and w{i}"

    docs = spark.range(1, 101).select(F.col("id").alias("doc_id"), text_of.asNondeterministic()("id").alias("text")).repartition(2)
    assert suffix_tree.score(docs).count() == 100
    assert read.value <= 200


def test_contexts_do_not_depend_on_the_size_of_the_corpus(spark):
    """What is seen twenty times and diverges is kept among a billion tokens as among a million: shares of the corpus left it out."""
    rows = [(7, 1, 40, 0.01), (8, 1, 20, 0.5), (8, 2, 20, 0.5), (9, 1, 19, 0.01)]
    runs = spark.createDataFrame(rows, "context long, next long, n long, expected double")
    assert suffix_tree.retained(runs, 1_000_000_000) == [(7, 40)]


def test_a_tree_in_parts_scores_as_a_whole_one(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(x for _ in range(rng.randint(0, 60)) for x in rng.choice([("a", "b", "c"), ("a", "d", "e"), ("f", "a"), (f"r{rng.randrange(99)}",)]))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (None, "a b c")], "doc_id long, text string")
    scores = lambda: sorted((str(r["doc_id"]), round(r["base_score"], 9), round(r["score"], 9)) for r in suffix_tree.score(docs).collect())
    seen, scored = [], suffix_tree.scored_locally
    monkeypatch.setattr(suffix_tree, "scored_locally", lambda *a: seen.append(a[-1]) or scored(*a))
    whole = scores()
    assert len(seen) == 1 and len({s for _, _, s in whole}) > 200
    monkeypatch.setattr(suffix_tree, "TREE_ROWS", 60)
    assert scores() == whole
    parts = seen[1:]
    assert len(parts) > 4 and parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert suffix_tree.ranges([(0, 5), (3, 5), (4, 9), (8, 1)], 10, 10) == [(0, 4), (4, 10)]


def test_chances_of_a_state_add_up(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(x for _ in range(60) for x in rng.choice([("a", "b", "c"), ("a", "d", "e"), ("f",), (f"r{rng.randrange(999)}",)]))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    symbols = suffix_tree.known_words(suffix_tree.token_counts(docs))
    tree = suffix_tree.grown(docs, symbols, spark.sparkContext.broadcast(symbols))
    assert len(tree.parents) > 3
    for state in range(len(tree.parents)):
        assert abs(tree.chance(np.full(symbols.count, state), np.arange(symbols.count)).sum() - 1) < 1e-9
    a, b, c, d = (symbols.place[w] for w in (b"a", b"b", b"c", b"d"))
    at = lambda x, y: tree.states(np.array([x]), np.array([y]))
    assert tree.chance(at(a, b), np.array([c]))[0] > 0.9 > tree.chance(at(-1, a), np.array([d]))[0] > 0.3


# Chat


def test_calls_results_and_chains(spark):
    from json import dumps

    calls = [{"id": "a", "name": "add", "arguments": {"y": 2, "x": 1.50}}, {"id": "b", "name": "add", "arguments": {"x": "1"}, "after": "c"}, {"id": "c", "name": "add", "arguments": {"x": 1, "z": 0}, "after": "a"}]
    calls += [{"id": "d", "name": "no", "arguments": {}}, {"id": "e", "name": "add", "arguments": 5, "after": "f"}, {"id": "f", "name": "add", "arguments": {"x": 3}, "after": "e"}]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", dumps({"tool_calls": calls})), (1, 2, "tool", dumps({"tool_call_id": "a", "content": {"k": [1, 2], "a": None}})), (1, 3, "tool", dumps({"tool_call_id": "zz", "content": 1}))]
    schemas = chat.SCHEMAS | {"add": (("x", ("integer", "number"), True), ("y", ("integer",), False))}
    found = {r["call_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    assert {i: (r["depth"], r["status"], r["problems"]) for i, r in found.items()} == {
        "turn-0": (0, "unanswered", ""), "a": (0, "linked", ""), "b": (2, "unanswered", "x: string"), "c": (1, "unanswered", "z: unexpected"), "d": (0, "unanswered", "unknown tool"),
        "e": (-1, "unanswered", "arguments: not an object"), "f": (-1, "unanswered", ""), "zz": (0, "orphan", ""),
    }
    assert found["a"]["record"] == '{"arguments":{"x":1.5,"y":2},"id":"a","name":"add","result":{"a":null,"k":[1,2]}}'


def test_every_message_is_a_row(spark, folder):
    from json import dumps, loads

    told = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    found = QUERIES["op7_chat_messages"](spark, folder).collect()
    says = lambda r: loads(r["record"]).get("text") or (loads(r["record"]).get("arguments") or {}).get("prompt") or (loads(r["record"]).get("result") or {}).get("text")
    key = lambda rows, text: sorted((r["conv_id"], r["turn"], r["role"], text(r) or "") for r in rows)
    assert key(found, says) == key(told, lambda r: r["text"])

    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 1, "user", "hello"), (1, 2, "assistant", dumps({"content": "I look", "tool_calls": [{"id": "a", "name": "f"}, {"id": "a", "name": "g"}]}))]
    rows += [(1, 3, "tool", dumps({"tool_call_id": "a", "content": 1})), (1, 4, "tool", dumps({"tool_call_id": "a", "content": 2, "took": 5})), (1, 5, "assistant", dumps({"tool_calls": []})), (1, 6, None, "x")]
    found = chat.every_message(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(((r["turn"], r["part"], r["kind"], r["call_id"], r["n_calls"], r["n_results"], r["status"], r["record"]) for r in found), key=lambda r: r[:3] + (r[7],)) == sorted([
        (0, 0, "message", None, 0, 0, "unlinked", '{"text":"be kind"}'), (1, 0, "call", "turn-1", 2, 0, "unanswered", '{"arguments":{"prompt":"hi"},"id":"turn-1","name":"reply"}'),
        (1, 0, "call", "turn-1", 2, 0, "unanswered", '{"arguments":{"prompt":"hello"},"id":"turn-1","name":"reply"}'), (2, 0, "message", None, 0, 0, "unlinked", '{"content":"I look"}'),
        (2, 1, "call", "a", 2, 2, "linked", '{"id":"a","name":"f"}'), (2, 2, "call", "a", 2, 2, "linked", '{"id":"a","name":"g"}'), (3, 0, "result", "a", 2, 2, "linked", '{"id":"a","result":1}'),
        (4, 0, "result", "a", 2, 2, "linked", '{"id":"a","result":2}'), (4, 0, "message", None, 0, 0, "unlinked", '{"took":5}'), (5, 0, "message", None, 0, 0, "unlinked", "{}"), (6, 0, "message", None, 0, 0, "unlinked", '{"text":"x"}'),
    ], key=lambda r: r[:3] + (r[7],))


# Personal data


def test_spans_equal_plain_patterns(spark, folder):
    rng = random.Random(5)
    parts = [*"ab.1259+@- ()é_%\n0٠😀", "@a.b", "4111 1111 1111 1111", "+1 555 123 4567", "1.2.3.4", "255.0.01.300"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    rows += [(9002, "1" * 20_000), (9003, "a" * 20_000 + "@b.c " + "1." * 3000), (9004, "+1 " + " " * 9000), (9005, "a@b.com_x@y.org"), (9006, "x@y.z " * 700)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{folder}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in pii.find_personal_data(docs).collect():
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == brute.personal(texts[r["doc_id"]])


def test_added_kinds_and_masks(spark):
    rows = [(1, "iban DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00"), (2, "my ssn is 123-45-6789"), (3, "part 123-45-6789"), (4, "é😀 joe@x.com, 4111 1111 1111 1111 end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert spans == {1: "iban:5:32", 2: "ssn:10:21", 3: "", 4: "email:3:12,card:14:33"}
    masked = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert masked[4] == "é😀 [EMAIL], [CARD] end" and masked[3] == rows[2][1]


# Sharding


def test_shards_are_exact_gapless_and_mixed(spark, tmp_path):
    found = sharding.shuffled_shards(spark.range(0, 20_001, 1, 7), 8, 1, part_bits=10, stretch_rows=300)
    again = sharding.shuffled_shards(spark.range(0, 20_001, 1, 7), 8, 1, part_bits=10, stretch_rows=300)
    rows = found.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect())) and {r["id"] for r in rows} == set(range(20_001))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [2500] * 7 + [2501] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert abs(np.corrcoef([r["id"] for r in rows], [r["shard"] * 2501 + r["slot"] for r in rows])[0, 1]) < 0.03
    sharding.write_shards(found, f"{tmp_path}/shards", 4)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 20_001


def test_draws_follow_the_law():
    rng = np.random.default_rng(1)
    ours = np.array([sharding.hypergeometric(rng.random(), 300, 700, 100) for _ in range(20_000)])
    theirs = rng.hypergeometric(300, 700, 100, 20_000)
    assert abs(ours.mean() - theirs.mean()) < 0.15 and abs(ours.std() - theirs.std()) < 0.1
    big = [sharding.hypergeometric(rng.random(), 10**10, 7 * 10**10, 262_144) for _ in range(200)]
    assert abs(np.mean(big) - 32_768) < 60
    matrix = np.array(sharding.communication_matrix([5, 0, 17, 3], [7, 6, 6, 6], 3))
    assert matrix.sum(axis=1).tolist() == [5, 0, 17, 3] and matrix.sum(axis=0).tolist() == [7, 6, 6, 6]


def test_shard_report(spark, folder):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op9_sharding"](spark, folder).collect():
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "rows", None)


# WARC


def test_archives_round_trip(spark):
    import base64
    import hashlib

    rng = random.Random(1)
    pieces = ["\r\n", "\r\n\r\n", "WARC/1.1\r\n", "é", "<p>abcdefg", "\r"]
    rows = [(i, f"http://x/{i}", "".join(rng.choice(pieces) for _ in range(rng.randint(0, 400)))) for i in range(150)] + [(400 + i, "u", rows) for i, rows in enumerate(["", "dup", "dup", None])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, text in rows:
        first[text or ""] = min(i, first.get(text or "", i))
    for chunk in (64, 300, 32_768):
        found = {r["page_id"]: r for r in warc.archive_report(pages, chunk).collect()}
        assert len(found) == len(rows)
        for i, url, text in rows:
            payload, origin = (text or "").encode(), first[text or ""]
            r = found[i]
            assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), url)
            assert (r["record_type"], r["refers_to"]) == (("response", None) if origin == i else ("revisit", origin))


def test_damage_is_found():
    record = warc._head([("WARC-Type", "response")], b"block")
    assert warc.parse(record)[1] == b"block"
    with pytest.raises(ValueError):
        warc.parse(record[:-1])
    with pytest.raises(ValueError):
        warc.parse(record[:-1] + b"x")
