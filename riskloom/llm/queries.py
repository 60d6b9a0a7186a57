"""The queries of the numbered operators, and SQL for those that SQL can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from riskloom.llm import bpe, chat, clustering, decontaminate, html_text, pii, quality, resampling, sharding, simhash, suffix_tree, token_counts, warc
from riskloom.llm.common import read

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def _quality_sql() -> str:
    metrics = {r.name: f"CASE WHEN {r.below} > 0 THEN CAST((1000 * {r.top}) // {r.below} AS BIGINT) END" for r in quality.RULES}
    metrics |= {quality.unit_of(r.name): f"CASE WHEN {r.below} > 0 THEN CAST({1000 * r.event} // {r.below} AS BIGINT) END" for r in quality.RULES if r.event}
    values = " UNION ALL ".join(f"SELECT rid, lang, source, '{n}' AS rule, {e} AS value FROM usable" for n, e in metrics.items())
    quantiles = {"q1": 25, "q3": 75, "top": quality.UNIT_PERCENT}
    quart = ", ".join(f"min(CASE WHEN upto * 100 >= total * {p} THEN value END) AS {q}" for q, p in quantiles.items()) + ", max(total) AS documents"
    ranked = "SELECT *, sum(n) OVER (PARTITION BY {keys}rule ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {keys}rule) AS total FROM {sketch}"
    reach = " ".join(f"WHEN '{r.name}' THEN {r.reach}" for r in quality.RULES)
    high = ", ".join(f"'{r.name}'" for r in quality.RULES if r.high)
    low = ", ".join(f"'{r.name}'" for r in quality.RULES if r.low)
    picks = ", ".join(
        f"CASE WHEN coalesce(o.documents, 0) >= {quality.GROUP_DOCUMENTS} THEN o.{q} WHEN coalesce(l.documents, 0) >= {quality.GROUP_DOCUMENTS} THEN l.{q} ELSE a.{q} END AS {q}"
        for q in quantiles
    )
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
                FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3) x),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) x WHERE n > 1),
    covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest([0, 1, 2]) AS k FROM twice) x GROUP BY rid),
    lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
              FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) x
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
    c AS (SELECT d.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
                 coalesce(n_dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
          FROM d LEFT JOIN covered ON covered.rid = d.rid LEFT JOIN lines ON lines.rid = d.rid),
    judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
    usable AS (SELECT * FROM judged WHERE NOT base_failed),
    vals AS ({values}),
    s AS (SELECT lang, source, rule, value, count(*) AS n FROM vals WHERE value IS NOT NULL GROUP BY ALL),
    sl AS (SELECT lang, rule, value, sum(n) AS n FROM s GROUP BY ALL),
    sa AS (SELECT rule, value, sum(n) AS n FROM s GROUP BY ALL),
    o AS (SELECT lang, source, rule, {quart} FROM ({ranked.format(keys="lang, source, ", sketch="s")}) x GROUP BY ALL),
    l AS (SELECT lang, rule, {quart} FROM ({ranked.format(keys="lang, ", sketch="sl")}) x GROUP BY ALL),
    a AS (SELECT rule, {quart} FROM ({ranked.format(keys="", sketch="sa")}) x GROUP BY ALL),
    picked AS (SELECT o.lang, o.source, o.rule, {picks} FROM o
               LEFT JOIN l ON l.lang IS NOT DISTINCT FROM o.lang AND l.rule = o.rule LEFT JOIN a ON a.rule = o.rule),
    fence AS (SELECT p.*, CASE p.rule {reach} END * greatest(p.q3 - p.q1, coalesce(u.top, 0), 1) AS away
              FROM picked p LEFT JOIN picked u ON u.rule = p.rule || ' unit' AND u.lang IS NOT DISTINCT FROM p.lang AND u.source IS NOT DISTINCT FROM p.source),
    bad AS (SELECT DISTINCT v.rid FROM vals v JOIN fence f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source
            AND f.rule = v.rule WHERE (f.rule IN ({high}) AND v.value > q3 + away) OR (f.rule IN ({low}) AND v.value < q1 - away))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM judged"""


@query("op3_quality_rules", _quality_sql())
def quality_query(spark, folder):
    return quality.quality_report(read(spark, folder, "documents"))


@query("op8_pii")
def pii_query(spark, folder):
    return pii.find_personal_data(read(spark, folder, "documents"))


@query("op9_sharding")
def sharding_query(spark, folder):
    return sharding.shard_report(read(spark, folder, "documents"))


@query("op1_byte_bpe")
def bpe_query(spark, folder):
    return bpe.round_trip(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op2_simhash")
def simhash_query(spark, folder):
    return simhash.near_duplicates(read(spark, folder, "documents"))


@query("op4_decontamination")
def decontamination_query(spark, folder):
    return decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op10_warc")
def warc_query(spark, folder):
    return warc.archive_report(read(spark, folder, "pages"))


@query("op5_html_text")
def html_query(spark, folder):
    return html_text.extract(read(spark, folder, "pages"))


@query("op6_suffix_tree")
def suffix_tree_query(spark, folder):
    return suffix_tree.score(read(spark, folder, "documents"))


CHAT_SQL = """
WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, 'turn-' || turn AS call_id, min(turn) AS call_turn, min(text) AS prompt, count(*) AS n_calls FROM m WHERE role = 'user' GROUP BY ALL),
r AS (SELECT conv_id, 'turn-' || (turn - 1) AS call_id, min(turn) AS result_turn, min(text) AS answer, count(*) AS n_results FROM m WHERE role = 'assistant' GROUP BY ALL)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(call_turn, result_turn) AS order_turn, 0 AS depth, call_turn, result_turn,
       coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       CASE WHEN n_results IS NULL THEN 'unanswered' WHEN n_calls IS NULL THEN 'orphan' WHEN result_turn < call_turn THEN 'early' ELSE 'linked' END AS status,
       n_calls IS NULL OR prompt IS NOT NULL AS valid, CASE WHEN n_calls IS NULL OR prompt IS NOT NULL THEN '' ELSE 'prompt: missing' END AS problems,
       '{' || concat_ws(',', CASE WHEN n_calls IS NOT NULL THEN '"arguments":{' || coalesce('"prompt":' || to_json(prompt), '') || '}' END,
                        '"id":' || to_json(coalesce(c.call_id, r.call_id)), CASE WHEN n_calls IS NOT NULL THEN '"name":"reply"' END,
                        CASE WHEN n_results IS NOT NULL THEN '"result":{' || coalesce('"text":' || to_json(answer), '') || '}' END) || '}' AS record
FROM c FULL JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id"""


@query("op7_chat_format", CHAT_SQL)
def chat_query(spark, folder):
    return chat.format_chats(read(spark, folder, "conversations"))


@query("op7_chat_messages")
def chat_messages_query(spark, folder):
    return chat.every_message(read(spark, folder, "conversations"))


@query("op11_token_counts")
def token_counts_query(spark, folder):
    return token_counts.count_tokens(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _clustering_sql() -> str:
    """Rounds as a chain of common table expressions; a floor division that goes down for sums below zero."""
    k, rounds = clustering.CLUSTERS, clustering.ROUNDS
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE len(embedding) = {clustering.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS cluster, e AS c
            FROM (SELECT sha256('{clustering.SEED}:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k}) x)""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT rid, min(struct_pack(distance := d, cluster := cluster)) AS near FROM
                (SELECT rid, cluster, CAST(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i}) x GROUP BY rid)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS MATERIALIZED (SELECT cluster, list(mean ORDER BY pos) AS c FROM (SELECT cluster, pos, (s - ((s % n) + n) % n) // n AS mean FROM
                    (SELECT near.cluster AS cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM
                        (SELECT near, unnest(e) AS x, unnest(range(1, {clustering.SIZE + 1})) AS pos FROM a{i} JOIN v USING (rid)) u GROUP BY ALL) t) t GROUP BY cluster)"""
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, near.cluster AS cluster, near.distance AS distance, CAST(sum(near.distance) OVER (PARTITION BY near.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(near.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} f ON f.cluster = near.cluster"""


@query("op12_centroid_clusters", _clustering_sql())
def clustering_query(spark, folder):
    return clustering.cluster(read(spark, folder, "embeddings"))


def _resampling_sql() -> str:
    """CRC-32 byte by byte over distinct n-grams."""
    r, words = resampling, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    table = ", ".join(f"list_reduce([{i}] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor({r.POLYNOMIAL}, c >> 1) ELSE c >> 1 END)" for i in range(256))
    grams = " || ".join(f"list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))" for n in range(1, r.LONGEST + 1))
    crc = "xor(4294967295, list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, crc_table[CAST((xor(c, b) & 255) + 1 AS INT)])))"

    def features(table: str, key: str) -> str:
        lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"SELECT *, {grams} AS grams FROM (SELECT row_number() OVER () AS rid, {key}, regexp_extract_all({lowered}, '{words}') AS ws FROM {table}) x"

    return f"""
    WITH bytes_table AS MATERIALIZED (SELECT [{table}] AS crc_table),
    d AS MATERIALIZED ({features("documents", "doc_id")}),
    b AS ({features("benchmark", "item_id")}),
    df AS MATERIALIZED (SELECT rid, gram, count(*) AS n FROM (SELECT rid, unnest(grams) AS gram FROM d) x GROUP BY ALL),
    bf AS MATERIALIZED (SELECT gram, count(*) AS n FROM (SELECT unnest(grams) AS gram FROM b) x GROUP BY ALL),
    hashed AS MATERIALIZED (SELECT gram, {crc} % {r.BUCKETS} AS bucket FROM
        (SELECT gram, list_transform(range(1, CAST(len(h) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || h[2 * i - 1:2 * i] AS BIGINT)) AS bytes FROM
            (SELECT gram, hex(encode(gram)) AS h FROM (SELECT gram FROM df UNION SELECT gram FROM bf) x) x) x, bytes_table),
    s AS (SELECT bucket, sum(n) AS s FROM df JOIN hashed USING (gram) GROUP BY ALL),
    t AS (SELECT bucket, sum(n) AS t FROM bf JOIN hashed USING (gram) GROUP BY ALL),
    gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s)::DOUBLE + {r.BUCKETS})) / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + {r.BUCKETS})))) AS BIGINT) AS g
             FROM s LEFT JOIN t USING (bucket)),
    w AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS total FROM df JOIN hashed USING (gram) JOIN gain USING (bucket) GROUP BY rid),
    scored AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
                      CAST('0x' || sha256('{r.SEED}:' || doc_id)[1:8] AS BIGINT) AS h FROM d LEFT JOIN w USING (rid)),
    placed AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {r.MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= {r.MIN_WORDS}) OVER () AS eligible FROM placed)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {r.MIN_WORDS} AND place <= eligible * {r.PERCENT} // 100 THEN place END AS rank FROM ranked"""


@query("op13_importance_resampling", _resampling_sql())
def resampling_query(spark, folder):
    return resampling.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
