"""The registered queries of this subpackage: thin calls of the operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hardwood.llm import exact, importance, language, licenses, middle, oddsketch, packing, pieces, rules, secrets, suffixes, variants, wavelet
from hardwood.session import scratch_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if sql:
            _ORACLES[name] = sql
        return fn

    return add


def query_table() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_texts() -> dict[str, str]:
    return dict(_ORACLES)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op3_wavelet_tokens")
def op3(spark, sf_dir):
    base = scratch_folder(spark, "tokens")
    shards = wavelet.write_shards(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), base)
    return wavelet.read_documents(spark, base, shards)


@query("op4_exact_dedup", r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)""")
def op4(spark, sf_dir):
    return exact.label_copies(_documents(spark, sf_dir))


@query("op5_cost_packing")
def op5(spark, sf_dir):
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_odd_sketch_dedup")
def op6(spark, sf_dir):
    return oddsketch.near_duplicates(_documents(spark, sf_dir), percent=85)


@query("op7_entropy_secrets")
def op7(spark, sf_dir):
    return secrets.scan(_documents(spark, sf_dir))


def _rules_sql() -> str:
    """The counts by string functions and windows, and the sketches as counts of bins."""
    m, base = rules.METRICS, rules.BASE
    union = " UNION ALL ".join(f"SELECT lang_key, source_key, '{k}' AS metric, {k} AS v FROM measured WHERE NOT base_failed" for k in m)
    slack = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " END"

    def level(keys: str) -> str:
        group = f"{keys}, " if keys else ""
        return f"""
  SELECT {group}metric, n, q1 - {rules.REACH} * (q3 - q1) - {slack} AS low, q3 + {rules.REACH} * (q3 - q1) + {slack} AS high FROM (
    SELECT {group}metric, max(total) AS n, min(CASE WHEN upto >= 0.25 * total THEN value END) AS q1, min(CASE WHEN upto >= 0.75 * total THEN value END) AS q3
    FROM (SELECT {group}metric, CASE WHEN bin IS NULL THEN 0.0::DOUBLE ELSE 2 * pow({base}::DOUBLE, bin) / (1 + {base}::DOUBLE) END AS value,
            sum(n) OVER (PARTITION BY {group}metric ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {group}metric) AS total
          FROM (SELECT {group}metric, bin, sum(n) AS n FROM bins GROUP BY ALL)) GROUP BY {group}metric)"""

    fails = " ".join(f"WHEN {k} < low_{k} OR {k} > high_{k} THEN '{k}'" for k in m)
    pick = ", ".join(f"max(CASE WHEN metric = '{k}' THEN {c} END) AS {c}_{k}" for k in m for c in ("low", "high"))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t)),
g AS (SELECT r, i, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, word, w2, w3) > 1 AS t FROM g),
rep AS (SELECT r, count(*) AS n_words, count(*) FILTER (t OR b1 OR b2) AS n_repeat_words
  FROM (SELECT r, t, lag(t, 1, false) OVER p AS b1, lag(t, 2, false) OVER p AS b2 FROM twice WINDOW p AS (PARTITION BY r ORDER BY i)) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (SELECT t.*, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM t LEFT JOIN rep USING (r) LEFT JOIN l USING (r)),
measured AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_rate,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_rate, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_rate,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce('=' || lang, '?') AS lang_key, coalesce('=' || source, '?') AS source_key FROM counted),
bins AS (SELECT lang_key, source_key, metric, CASE WHEN v > 0 THEN ceil(ln(v) / ln({base}::DOUBLE))::INT END AS bin, count(*) AS n FROM ({union}) GROUP BY ALL),
cell AS ({level("lang_key, source_key")}), by_lang AS ({level("lang_key")}), every AS ({level("")}),
cells AS (SELECT DISTINCT lang_key, source_key FROM measured),
limits AS (SELECT lang_key, source_key, {pick} FROM (
  SELECT k.lang_key, k.source_key, e.metric, CASE WHEN c.n >= {rules.LEAST} THEN c.low WHEN b.n >= {rules.LEAST} THEN b.low ELSE e.low END AS low,
    CASE WHEN c.n >= {rules.LEAST} THEN c.high WHEN b.n >= {rules.LEAST} THEN b.high ELSE e.high END AS high
  FROM cells k CROSS JOIN every e LEFT JOIN cell c ON c.lang_key = k.lang_key AND c.source_key = k.source_key AND c.metric = e.metric
  LEFT JOIN by_lang b ON b.lang_key = k.lang_key AND b.metric = e.metric) GROUP BY lang_key, source_key),
judged AS (SELECT m.*, CASE WHEN base_failed THEN 'base' {fails} END AS failed_rule FROM measured m LEFT JOIN limits USING (lang_key, source_key))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM judged"""


@query("op10_adaptive_rules", _rules_sql())
def op10(spark, sf_dir):
    return rules.judge(_documents(spark, sf_dir))


@query("op1_importance_quality")
def op1(spark, sf_dir):
    return importance.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op2_kernel_language")
def op2(spark, sf_dir):
    return language.identify(_documents(spark, sf_dir))


@query("op8_streaming_pieces")
def op8(spark, sf_dir):
    return pieces.digest(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_license_windows")
def op9(spark, sf_dir):
    return licenses.scan(_documents(spark, sf_dir))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

VARIANTS_SQL = rf"""
WITH RECURSIVE polynomial AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {variants.LEAST} GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))), lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1]))) AS h
  FROM counted, polynomial),
cut AS (SELECT CASE WHEN h % {variants.ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {variants.LEAST} GROUP BY word HAVING sum(n) >= {variants.TWICE}),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT * FROM (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (other_n = most) AS first FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word),
linked AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {variants.TIMES} * n THEN first END AS form, CASE WHEN top >= {variants.TIMES} * n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM linked UNION ALL SELECT chain.word, linked.form FROM chain JOIN linked ON linked.word = chain.root WHERE linked.form IS NOT NULL),
last AS (SELECT chain.word, chain.root FROM chain JOIN linked ON linked.word = chain.root WHERE linked.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN last USING (word)"""


@query("op11_spelling_variants", VARIANTS_SQL)
def op11(spark, sf_dir):
    return variants.group_variants(_documents(spark, sf_dir))


_P, _S, _M = middle.MARKS

MIDDLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{middle.SEED}' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, {", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '{_P}') OR contains(text, '{_S}') OR contains(text, '{_M}') OR h3 % 100 >= {middle.RATE} THEN 'plain'
    WHEN h4 % 100 < {middle.SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_P}' || prefix || '{_S}' || suffix || '{_M}' || middle ELSE '{_S}' || suffix || '{_P}' || prefix || '{_M}' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""


@query("op12_fill_in_middle", MIDDLE_SQL)
def op12(spark, sf_dir):
    return middle.digest(_documents(spark, sf_dir))


@query("op13_suffix_blocks")
def op13(spark, sf_dir):
    return suffixes.digest(_documents(spark, sf_dir))
