"""The opN_ queries: each operator with production parameters over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filter
from .decontaminate import contained_items
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .langid import language_id
from .line_dedup import line_dedup
from .mixing import mix_sources
from .quality import quality
from .resample import resample
from .simhash import simhash_groups
from .substring import substring_dedup
from .token_count import token_counts
from .warc import new_folder, read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).taken().select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), new_folder(spark))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_SOLID = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, {_SOLID} AS solid FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER same AS keep_id,
       count(*) OVER (PARTITION BY solid) AS group_size,
       doc_id = first_value(doc_id) OVER same AS kept,
       sha256(solid) AS text_sha256
FROM d
WINDOW same AS (PARTITION BY solid ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
win AS (SELECT doc_id, pos, string_agg(word, ' ') OVER nxt AS key, count(*) OVER nxt AS n FROM w
        WINDOW nxt AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1 AS again FROM win WHERE n = 20),
m AS (SELECT w.doc_id, w.pos, word, coalesce(bool_or(again) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
      FROM w LEFT JOIN k USING (doc_id, pos)),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


#: Shingles of five words, distinct for each text; a shorter text is one shingle.
SHINGLES = r"""
SELECT DISTINCT {id}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
      FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table})
      WHERE len(w) > 0)
"""

OP5_SQL = f"""
WITH d AS ({SHINGLES.format(id='doc_id', table='documents')}), b AS ({SHINGLES.format(id='item_id', table='benchmark')}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*)::DOUBLE / n_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 5 >= n_shingles * 4
"""

OP8_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
p AS (SELECT doc_id, i, line, h, lag(h) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM h),
s AS (SELECT doc_id, regexp_replace(string_agg(CASE WHEN p IS NOT NULL AND (h = p OR ((p * 1000003 + h) >> 6) % 3 = 0) THEN '1' ELSE '0' END, '' ORDER BY i), '1.', '10', 'g') AS signs FROM p GROUP BY doc_id),
b AS (SELECT doc_id, i, line, substr(signs, i, 1) = '1' AS border FROM p JOIN s USING (doc_id)),
c AS (SELECT doc_id, i, line, coalesce(sum(border::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
t AS (SELECT doc_id, k, min(i) AS i, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, k),
u AS (SELECT doc_id, k, i, n < 2 AS tail, CASE WHEN n < 2 THEN lag(chunk) OVER (PARTITION BY doc_id ORDER BY k) || chr(10) || chunk ELSE chunk END AS key FROM t),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY tail, key ORDER BY doc_id, i) AS nth FROM u WHERE key IS NOT NULL),
m AS (SELECT c.doc_id, c.i, line, coalesce(nth, 1) > 1 AS gone FROM c LEFT JOIN r USING (doc_id, k)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS low FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> low THEN low END AS refers_to
FROM f
"""


_FOLDED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, instr(url, '://') AS mark FROM pages),
t AS (SELECT *, CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^?#]*') ELSE '' END AS tail FROM p),
h AS (SELECT r, page_id, url, {_FOLDED.format("regexp_extract(tail, '^[^/]*')")} AS host, substr(tail, length(regexp_extract(tail, '^[^/]*')) + 1) AS path FROM t),
rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in url_filter.RULES)}),
terms(word, weight) AS (VALUES {", ".join(f"('{t}', {w})" for t, w in url_filter.TERMS.items())}),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
        FROM h JOIN rules ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY r),
w AS (SELECT r, unnest(regexp_extract_all(regexp_replace({_FOLDED.format("url")}, '%[0-9a-f][0-9a-f]', ' ', 'g'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS word FROM h),
c AS (SELECT r, word, weight, count(*) AS n FROM w JOIN terms USING (word) GROUP BY ALL),
s AS (SELECT r, sum(n) FILTER (WHERE weight >= {url_filter.LIMIT}) AS strict, sum(n) FILTER (WHERE weight < {url_filter.LIMIT}) AS soft, count(*) FILTER (WHERE weight < {url_filter.LIMIT}) AS kinds, sum(weight) AS total FROM c GROUP BY r)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN total >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(strict, 0)::BIGINT AS strict_hits, coalesce(soft, 0)::BIGINT AS soft_hits, coalesce(kinds, 0) AS soft_distinct
FROM h LEFT JOIN fit USING (r) LEFT JOIN s USING (r)
"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_FOLDED.format("text")} AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(n.total, 0) + v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u QUALIFY part = 'pair' OR rank <= 200
"""


_PLAIN_WORDS = f"unnest(regexp_extract_all({_FOLDED.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word"

#: crc: each byte is mixed in, then eight bits are shifted out.
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} FROM documents), t AS (SELECT {_PLAIN_WORDS} FROM benchmark),
words AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM d UNION ALL SELECT word FROM t)),
bits AS (SELECT word, list_transform(range(0, 4 * len(x)), lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(x, (i // 4 + 1)::INT, 2))::BIGINT ELSE 0 END) AS b FROM words),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, e: CASE WHEN xor(c, e) & 1 = 1 THEN xor(xor(c, e) >> 1, 3988292384) ELSE xor(c, e) >> 1 END), 4294967295) % 10000 AS bucket FROM bits),
db AS (SELECT doc_id, bucket, count(*) AS n FROM d JOIN crc USING (word) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM db GROUP BY bucket), tb AS (SELECT bucket, count(*) AS t FROM t JOIN crc USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE)
                                     / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM tb) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN tb USING (bucket)),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM db JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM documents LEFT JOIN w USING (doc_id)),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(place) // 100 FROM o) THEN place END AS rank FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL, "op5_decontaminate": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op8_line_dedup": OP8_SQL, "op10_warc": OP10_SQL,
        "op11_url_filter": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_resample": OP13_SQL,
    }
