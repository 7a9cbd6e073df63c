"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontam, fim, htmltext, licenses, lines, minhash, packing, quality, secrets, sharding, substring, tokens
from .common import read


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(read(spark, sf_dir, "documents"), n_shards=24)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.drop_repeats(read(spark, sf_dir, "documents"), window=50))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(read(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=1024)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.drop_common_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(read(spark, sf_dir, "documents"), percent=90, spm_percent=20, salt="1"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), least=100, longest=5, percent=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hilbert_sharding, op2_substring_dedup, op3_html_extraction, op4_license_scan, op5_decontamination,
        op6_best_fit_packing, op7_token_counts, op8_minhash_near_dedup, op9_quality_rules, op10_secret_scan,
        op11_line_dedup, op12_fill_in_middle, op13_phrase_collocations,
    )
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows are whole strings (no word holds a space), so equal ones are equal word for word.
SUBSTRING_SQL = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER ahead = 50 THEN string_agg(word, ' ') OVER ahead END AS win FROM p WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
f AS (SELECT win, min(doc_id) AS first_id FROM v WHERE win IS NOT NULL GROUP BY win),
c AS (SELECT doc_id, i, word, bool_or(coalesce(first_id < doc_id, false)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM v LEFT JOIN f USING (win)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

NEAR_DEDUP_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
v AS (SELECT doc_id, n, count(*) OVER ahead AS held, string_agg(word, ' ') OVER ahead AS shingle, i FROM p WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, shingle FROM v WHERE held = 4 OR (n < 4 AND i = 1)), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE e.b > r.root), g AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM g LEFT JOIN z USING (doc_id)"""

LINE_DEDUP_SQL = f"""WITH s AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT row, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
k AS (SELECT *, {LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM p),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
g AS (SELECT row, count(f.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL) AS kept FROM k LEFT JOIN f USING (key) GROUP BY row)
SELECT doc_id, len(ls)::BIGINT AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM s JOIN g USING (row)"""

FIM_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS one, ('0x' || x[9:16])::BIGINT % (n + 1) AS two, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(one, two) AS a, greatest(one, two) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
 WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, '<P>' || t[:a] AS p, '<M>' || substring(t, a + 1, b - a) AS m, '<S>' || substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""

COLLOCATIONS_SQL = rf"""WITH x AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
y AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM x), t AS (SELECT lang, sum(len(ws)) AS n FROM y GROUP BY lang),
f AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM y), range(1, 6) r(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.*, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT c.*, u.k, array_to_string(ws[1 : u.k], ' ') AS p1, array_to_string(ws[u.k + 1 : m], ' ') AS p2 FROM c, range(1, 5) u(k) WHERE u.k < m),
s AS (SELECT k.lang, k.phrase, k.a, k.k, g.a AS l, h.a AS r, t.n, (1000::HUGEINT * k.a * t.n) // (g.a::HUGEINT * h.a) AS score
 FROM k JOIN f g ON g.lang = k.lang AND g.phrase = p1 JOIN f h ON h.lang = k.lang AND h.phrase = p2 JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT lang, a, array_to_string(ws[j : j + v - 1], ' ') AS phrase FROM c, range(2, 5) z(v), range(1, 5) o(j) WHERE v < m AND j + v - 1 <= m),
d AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM d WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000"""

#: The other queries return columns of their methods, which SQL cannot express; tests/llm has brute-force versions.
ORACLE: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING_SQL, "op8_minhash_near_dedup": NEAR_DEDUP_SQL, "op11_line_dedup": LINE_DEDUP_SQL,
    "op12_fill_in_middle": FIM_SQL, "op13_phrase_collocations": COLLOCATIONS_SQL,
}
