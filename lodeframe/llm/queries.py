"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import align, decontaminate, divergence, lm, maintext, pieces, quality, sharding, simhash, tokenfile, toxicity, urlfilter, warc
from lodeframe.session import table
from lodeframe.storage import holding, shared_dir


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on every node; operators take such paths as parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ledger entry, with the verdicts of the base and the strict policy."""
    entries = quality.ledger(table(spark, sf_dir, "documents"), "doc_id")
    both = quality.apply_policy(quality.apply_policy(entries, quality.BASE, "base_kept"), quality.STRICT, "kept", "policy")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = [m for m in quality.MEASURES if m not in first]
    return both.select(*first, (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits", *rest, "policy")


def _op1_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)
    word, space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{word}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM c WHERE n > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
  length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower,
  length(t) - length(replace(t, '!', '')) AS n_bangs,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & {quality.BASE.mask()} <> 0 AS base_failed, fail_bits & {quality.STRICT.mask()} = 0 AS kept,
  fail_bits, n_lines, n_upper, n_lower, n_bangs, n_stutter, '{quality.STRICT.label}' AS policy FROM b"""


ORACLE["op1_quality_rules"] = _op1_sql()


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits of the benchmark; null and empty texts have no words, repeated rows stay repeated."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op9_benchmark_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g))),
h AS (SELECT rid, i, k, item FROM s JOIN g USING (k, gram)),
n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM h) GROUP BY rid),
a AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN a USING (rid)"""


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; texts without words have fingerprint zero and link like any other."""
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what is labelled as of good quality and not toxic, the background every document.

    Texts without words score zero; repeated rows stay repeated; without labels the target model is its smoothing alone.
    """
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return lm.score(docs, good)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written token files say of every document; null and empty texts are one end id, equal ids go by their texts."""
    path = f"{shared_dir(spark)}/lodeframe/tokens-{uuid.uuid4().hex}"
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return holding(tokenfile.read_token_files(spark, path), path)


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; a null URL and one without ``://`` have an empty host and path."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), "page_id")


ORACLE["op4_url_filters"] = r"""
WITH a AS (SELECT page_id, position('://' IN coalesce(url, '')) AS p, coalesce(url, '') AS u FROM pages),
r AS (SELECT page_id, CASE WHEN p > 0 THEN regexp_extract(substr(u, p + 3), '^[^?#]*') ELSE '' END AS rest FROM a),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM r),
k AS (SELECT page_id, host, path, '.' || host AS dotted FROM h),
v AS (SELECT *, CASE
    WHEN dotted LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN dotted LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN dotted LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN dotted LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN dotted LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM k)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN (path = '' OR path LIKE '/%') AND regexp_matches(dotted, 'spam.*\.') THEN 'block'
    WHEN path LIKE '/%' AND regexp_matches(dotted, '(casino|cheap-|-pills|free-..).*\.') THEN 'block'
    WHEN regexp_matches(path, '/login[^/]*$') OR path LIKE '%.exe' THEN 'block'
    WHEN path = '' AND dotted LIKE '%.exe' THEN 'block'
    ELSE 'allow' END AS verdict FROM v"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model that learnt outside the held-out third; texts without words have one, too."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, "doc_id")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of pieces, the sums of its ids and of the text they decode to; empty texts have no ids."""
    docs = table(spark, sf_dir, "documents")
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), "doc_id", ids=False, remember=800_000, slice_bytes=6 << 20)


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot; equal texts, null and empty ones among them, are one group."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records of every page; a null page has an empty body, a null URL no target."""
    made = warc.page_derivatives(table(spark, sf_dir, "pages"), "page_id")
    return made.withColumn("record_crc32", F.crc32("record")).drop("record")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others, and its own terms; null texts, languages and sources are empty."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op11_source_divergence"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT lang, source, rid, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v)::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
a AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT e.lang, e.source, f.source AS other, sum(abs(e.p - f.p)) AS value FROM e JOIN e f
      ON e.lang = f.lang AND e.term = f.term AND e.source <> f.source GROUP BY ALL) x
    ON x.lang = g.lang AND x.source = g.source AND x.other = h.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM e WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *,
    (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM a)
WHERE part = 'pair' OR rank <= 50"""


@query
def op12_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; a null page has an empty one."""
    return maintext.extract(table(spark, sf_dir, "pages"), "page_id", "url")


#: For pages with one article element, as the tables have: its blocks, without tags and with the references they use.
ORACLE["op12_html_main_text"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(replace(t, '<br>', ' '), '</?(p|h[1-6])>', chr(7), 'g'), '</?b>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, list_transform(string_split(t, chr(7)), lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
      '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS bs FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(bs, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of byte-level and sentencepiece tokens; null and empty texts have none."""
    paths = {"a": tokenizer_path("byte_bpe_50k.json"), "b": tokenizer_path("piece_bpe_32k.model")}
    return align.align(table(spark, sf_dir, "documents"), "doc_id", **paths)
