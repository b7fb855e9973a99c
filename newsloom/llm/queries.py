"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import changes, chat, decontaminate, importance, langid, licenses, lm, ngramjoin, packing, repeats, spelling, tokenfile, winnow


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_edits(_read(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '{said}'")
    return chat.digest(chat.chat(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)))


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(lm.score_held_out(_read(spark, sf_dir, "documents")))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(_read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(langid.identify(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(tokenfile.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op11_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply(_read(spark, sf_dir, "client_changes"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.find(_read(spark, sf_dir, "documents")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_fingerprint, op3_chat, op4_perplexity, op5_importance, op6_pack, op7_jaccard_join, op8_language, op9_token_file, op10_licenses, op11_apply_changes, op12_repeats, op13_spelling)}

SQL: dict[str, str] = {}

SQL["op1_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, m, unnest(list_transform(range(1, greatest(2, len(w) - m + 2)), lambda i: list_slice(w, i, i + m - 1))) AS g
        FROM (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM win),
dg AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, ms WHERE len(w) >= m),
hit AS (SELECT DISTINCT doc_id, dg.m AS m, i, item_id FROM dg JOIN win ON win.m = dg.m AND list_slice(w, i, i + dg.m - 1) = g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL["op7_jaccard_join"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM d),
one AS MATERIALIZED (SELECT min(doc_id) AS rep, list_sort(s) AS k, len(s) AS n FROM sh WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
ex AS MATERIALIZED (SELECT rep, n, unnest(k) AS g FROM one),
often AS MATERIALIZED (SELECT g FROM ex GROUP BY g HAVING count(*) > 1),
both_ AS MATERIALIZED (SELECT a.rep AS u, b.rep AS v, count(*) AS i, any_value(a.n) AS x, any_value(b.n) AS y
        FROM ex a JOIN often USING (g) JOIN ex b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS MATERIALIZED (SELECT u, v FROM both_ WHERE 100 * i >= 80 * (x + y - i) UNION ALL SELECT v, u FROM both_ WHERE 100 * i >= 80 * (x + y - i)),
reach AS (SELECT rep AS node, rep AS to_ FROM one UNION SELECT reach.node, link.v FROM reach JOIN link ON reach.to_ = link.u),
comp AS (SELECT node, min(to_) AS c FROM reach GROUP BY node)
SELECT sh.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, sh.doc_id) AS component_id
FROM sh LEFT JOIN one ON list_sort(s) = k LEFT JOIN comp ON comp.node = one.rep
"""

SQL["op10_licenses"] = licenses.oracle()

SQL["op3_chat"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(role, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g') AS er,
             regexp_replace(regexp_replace(text, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g') AS et FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(10 + length(er) + 9 + length(et) + 5) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL["op13_spelling"] = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
r AS (SELECT doc_id, w, count(*) AS k FROM d WHERE length(w) >= 6 GROUP BY 1, 2),
x AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r),
b AS (SELECT w, k, list_transform(range(0, length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b FROM x),
h AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(t[CAST(xor(c, y) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) AS h FROM b, tab),
v AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, k FROM h),
n AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
e AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n),
l AS MATERIALIZED (SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM e),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM l a JOIN l b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM l a JOIN n b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM l a JOIN n b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -other_n, b := other)) AS m FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.a >= 5 * n THEN m.b END AS form, CASE WHEN -m.a >= 5 * n THEN -m.a END AS form_n FROM n LEFT JOIN best USING (word)),
go AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT go.word, f.word, f.form FROM go JOIN f ON go.next = f.word)
SELECT f.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN go ON f.word = go.word AND go.next IS NULL
"""

SQL["op12_repeats"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN m USING (h) WHERE doc_id > first),
r AS (SELECT doc_id, list(p) AS p FROM c GROUP BY doc_id),
k AS (SELECT doc_id, p, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d JOIN r USING (doc_id)),
t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM k WHERE NOT list_contains(p, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN p IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""
