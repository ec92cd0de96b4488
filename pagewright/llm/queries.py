"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation, decontam, license_scan, line_dedup, ngram_join, packing, pii, quality, sharding, spelling, token_count, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents"), ngram_join.JoinParams(words=3, percent=90))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(table(spark, sf_dir, "conversations"), damage=True)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_url_filter,
    op2_best_fit_packing,
    op3_toxicity,
    op4_line_dedup,
    op5_license_scan,
    op6_token_counts,
    op7_ngram_jaccard_join,
    op8_pii,
    op9_benchmark_decontamination,
    op10_quality_rules,
    op11_spelling_variants,
    op12_conversation_repair,
    op13_sharding,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


#: Quality rules, line by line: normalised lines in place of their hashes. 0.02, 20, 100 and 0.5 are the operator's parameters.
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM windows),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE k > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, line, translate(lower(line), E'0123456789 \t\r.,;:!?', '0000000000') AS norm FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host),
counted AS (SELECT host, norm, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM lines GROUP BY host, norm),
frequent AS (SELECT c.host, c.norm, f.text AS first_text FROM counted c JOIN hosts h ON h.host = c.host JOIN d f ON f.doc_id = c.first_doc WHERE n_docs > least(100.0, greatest(20.0, 0.02 * h.n))),
gone AS (SELECT doc_id, sum(length(line)) AS n FROM lines JOIN frequent USING (host, norm) WHERE text <> first_text GROUP BY doc_id),
own AS (SELECT doc_id, sum(length(line)) AS n, count(*) - count(DISTINCT line) AS dup FROM lines GROUP BY doc_id),
out AS (SELECT doc_id, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
  coalesce(own.dup, 0)::bigint AS n_dup_lines, coalesce(repeats.n, 0)::bigint AS n_repeat_words, CASE WHEN own.n > 0 THEN 1 - coalesce(gone.n, 0)::double / own.n ELSE 1.0 END::double AS left_share
  FROM w LEFT JOIN own USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_share >= 0.5 AS kept FROM out
"""



def _crc_table() -> list[int]:
    """CRC-32 of the sixteen half bytes."""
    table = list(range(16))
    for _ in range(4):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8."""
    octets = f"list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda c: ('0x' || c)::bigint))"
    half = lambda x: f"xor(({x}) >> 4, {_crc_table()}[(({x}) & 15) + 1])"
    return f"xor(list_reduce({octets}, lambda x, y: {half(half('xor(x, y)'))}), 4294967295)"


#: Spelling variants by patterns and deletions as strings.
SPELLING_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, k, {_crc32("doc_id || ':' || run")} AS h FROM runs),
words AS (SELECT word, sum(k)::bigint AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::int AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
  UNION ALL SELECT DISTINCT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word UNION ALL SELECT DISTINCT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
first AS (SELECT word, min(other) AS other FROM near JOIN best USING (word) WHERE n = top GROUP BY word),
judged AS (SELECT word, n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN top >= 2 * n THEN other END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM words LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
way AS (SELECT word, form AS goal, 1 AS steps FROM judged WHERE form IS NOT NULL UNION ALL SELECT w.word, j.form, steps + 1 FROM way w JOIN judged j ON j.word = w.goal WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(goal, steps) AS root FROM way GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM judged LEFT JOIN ends USING (word)
"""


def _more(best: str, cost: str | int, mark: str) -> str:
    """A (cost, audit) pair as text, nine digits first, with an edit more; null stays null."""
    return f"(lpad((left({best}, 9)::int + {cost})::varchar, 9, '0') || substr({best}, 10) || '{mark}')"


def _conversation_sql() -> str:
    insert = lambda c: _more(c, 5, "I")
    kept, extra = "fault NOT IN ('blank', 'duplicate')", "CASE fault WHEN 'truncated' THEN 5 ELSE 0 END"
    ways = {1: ("s", (0,)), 2: ("u", (0, 1, 3)), 3: ("a", (2,))}

    def state(k: int) -> str:
        options = [_more(f"s{k}", 2, "D")]
        if k:
            initial, sources = ways[k]
            options += [f"CASE WHEN {kept} AND left(role, 1) = '{initial}' THEN {_more(f's{j}', extra, 'K')} END" for j in sources]
            options += [f"CASE WHEN {kept} THEN {_more(f's{j}', f'1 + {extra}', 'R')} END" for j in sources if k > 1]
        return f"least({', '.join(options)}, NULL) AS n{k}"

    close = f"n0, n1, least(n2, {insert('n0')}, {insert('n1')}, {insert('n3')}) AS m2, least(n3, {insert('n2')}) AS m3"
    return rf"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations),
kinds AS (SELECT *, {_crc32('key')} % 20 AS kind FROM base),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM kinds)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
vit AS (SELECT conv_id, 0::bigint AS i, '000000000' AS s0, NULL::varchar AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, n0, n1, least(m2, {insert('m3')}), least(m3, {insert('m2')}) FROM (SELECT conv_id, i, {close} FROM (SELECT v.conv_id, f.i, {', '.join(state(k) for k in range(4))} FROM vit v JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1))),
best AS (SELECT conv_id, arg_max(least(s0, s3), i) AS best FROM vit GROUP BY conv_id),
edits AS (SELECT conv_id, p, edit, sum((edit <> 'I')::int) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM (SELECT conv_id, unnest(range(length(substr(best, 10)))) AS p, unnest(string_split(substr(best, 10), '')) AS edit FROM best WHERE length(best) > 9)),
kept AS (SELECT e.conv_id, p, edit, role, CASE edit WHEN 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS nth FROM edits e JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND (f.i = e.i OR (e.i = 0 AND f.i = 1)) WHERE edit <> 'D'),
begun AS (SELECT conv_id, max((nth = 1 AND edit = 'K' AND left(role, 1) = 's')::int) AS shift FROM kept GROUP BY conv_id),
written AS (SELECT k.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, E'\n' ORDER BY p) AS whole FROM kept k JOIN begun b ON b.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal,
  left(best, 9)::bigint AS cost, substr(best, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256 FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def _sharding_sql(levels: int = 3, whole: int = 50) -> str:
    """The k-d tree level by level, with running sums over all points in place of passes by digits."""
    number = lambda text, k: f"('0x' || left(md5({text}), {k}))::bigint"
    own = f"[p * 68719476736 + {number('doc_id::varchar', 6)} * 4096 for p in places]"
    sql = f"""
WITH ends AS (SELECT min(n_chars) AS low, max(n_chars) AS high, sum(strlen(coalesce(text, '')) + 1)::bigint AS total FROM documents),
measured AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, [coalesce({number('source', 3)}, 0), coalesce({number('lang', 3)}, 0), coalesce((n_chars - low) * 4095 // nullif(high - low, 0), 0)] AS places, total FROM documents, ends),
groups AS (SELECT text, sum(size)::bigint AS size, arg_min(places, doc_id) AS places, any_value(total) // {(1 << levels) * whole} AS heaviest FROM measured GROUP BY text),
n0 AS (SELECT text, NULL::bigint AS doc_id, size, [p * 68719476736 + {number('text', 6)} * 4096 for p in places] AS keys, 1 AS node FROM groups WHERE size <= heaviest
  UNION ALL SELECT m.text, m.doc_id, m.size, {own.replace('places', 'm.places').replace('doc_id', 'm.doc_id')}, 1 FROM measured m JOIN groups g USING (text) WHERE g.size > heaviest)"""
    for k in range(levels):
        shards = 1 << levels - k
        sql += f""",
w{k} AS (SELECT node, dim, max(keys[dim] // 68719476736) - min(keys[dim] // 68719476736) AS width FROM n{k}, (SELECT unnest([1, 2, 3]) AS dim) GROUP BY node, dim),
d{k} AS (SELECT node, arg_min(dim, (-width, dim)) AS dim FROM w{k} GROUP BY node),
k{k} AS (SELECT text, doc_id, size, keys, node, keys[dim] AS key FROM n{k} JOIN d{k} USING (node)),
s{k} AS (SELECT node, key, sum(size)::bigint AS w, (sum(sum(size)) OVER (PARTITION BY node ORDER BY key))::bigint AS upto, (sum(sum(size)) OVER (PARTITION BY node))::bigint AS total FROM k{k} GROUP BY node, key),
n{k + 1} AS (SELECT text, doc_id, size, keys, node * 2 + ((2 * upto - w) * {shards} > {shards} * total)::int AS node FROM k{k} JOIN s{k} USING (node, key))"""
    return sql + f""",
dealt AS (SELECT m.doc_id, m.size::bigint AS size, m.text, (n.node - {1 << levels})::int AS shard FROM measured m JOIN n{levels} n ON n.text = m.text AND (n.doc_id IS NULL OR n.doc_id = m.doc_id)),
parts AS (SELECT *, {number('doc_id::varchar', 8)} % (SELECT greatest(1, floor(sqrt(count(*) // {1 << levels})))::bigint FROM documents) AS part FROM dealt)
SELECT doc_id, size, {_crc32('text')} AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id) - 1 AS slot, NULL::int AS grown_shard FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_quality_rules": QUALITY_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_conversation_repair": _conversation_sql(), "op13_sharding": _sharding_sql()}
