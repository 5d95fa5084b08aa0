"""The registered queries of this subpackage: each applies one operator to its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.llm import bytebpe, divergence, filteraudit, hnsw, mixing, packing, prefixfree, sharding, simhash, tokens, topk, toxicity, urlfilter
from foliomatch.plans.stages import materialize, new_path, spread

#: Second from which the URL query counts its fetches and list entries: the start of 2024.
START = 1_704_067_200
BYTE_BPE, WORD_BPE, MULTI_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "doc_id") if name == "documents" else df


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path(BYTE_BPE), end_id=2)
    return tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), capacity=2048, end_id=0)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(materialize(slim, "pieces"), capacity=2048)


def _hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", _hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = topk.clean_vectors(_table(spark, sf_dir, "embeddings"))
    whole = clean.select("vec_id", topk.quantized(F.col("x"), 256).alias("x"))
    return topk.top_k(whole, whole.where("vec_id % 50 = 0"), k=5)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.95)


def _digits(digest: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(digest, at, n), 16, 10).cast("int")


def url_list_events(pages: DataFrame) -> DataFrame:
    """Dated list entries for the registered query, which has no list table: hosts whose MD5 begins with 0 to 5.

    The first digit chooses the list, others the moment in 2024 of the addition, the time until the removal and that until
    a second addition, all to the second. Every third entry is on the host's parent domain instead.
    """
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    digest = F.md5(F.col("host").cast("binary"))
    first = _digits(digest, 1, 1)
    parent = F.when((_digits(digest, 2, 1) % 3 == 0) & (F.size(F.split("host", r"\.")) > 2), F.regexp_replace("host", r"^[^.]+\.", "")).otherwise(F.col("host"))
    name = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (first % 3 + 1).cast("int"))
    added = F.lit(START) + _digits(digest, 3, 2) * 86_400 + _digits(digest, 9, 4)
    removed = added + (_digits(digest, 5, 2) + 1) * 86_400 + _digits(digest, 13, 4)
    back = removed + (_digits(digest, 7, 2) + 1) * 43_200
    steps = (("add", added), ("remove", removed), ("add", back))
    events = F.array(*[F.struct(F.lit(action).alias("action"), F.timestamp_seconds(at).alias("at")) for action, at in steps])
    listed = hosts.where(first <= 5).select(name.alias("list"), parent.alias("pattern"), F.inline(events))
    return listed


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    fetched = F.lit(START) + (F.col("page_id") * 7919) % (730 * 86_400)
    captures = pages.select("page_id", "url", F.timestamp_seconds(fetched).alias("fetched_on"))
    out = urlfilter.filter_urls(captures, url_list_events(pages))
    return out.select("page_id", "host", F.unix_seconds("fetched_on").alias("fetched_at"), "n_entries", "lists", "blocked")


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, 1704067200 + (page_id * 7919) % (730 * 86400) AS fetched,
         regexp_extract(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[0-9a-f:.]*\]|[^/?#:]*)', 1) AS raw FROM pages),
p AS (SELECT page_id, fetched, regexp_replace(CASE WHEN contains(raw, '%') THEN lower(url_decode(raw)) ELSE raw END, '^www\.|\.$', '') AS host FROM u),
h AS (SELECT DISTINCT host, md5(host) AS d FROM p WHERE host <> ''),
l AS (
  SELECT ['adult', 'malware', 'spam'][CAST(('0x' || d[1:1]) AS INTEGER) % 3 + 1] AS list,
         CASE WHEN CAST(('0x' || d[2:2]) AS INTEGER) % 3 = 0 AND len(string_split(host, '.')) > 2
              THEN regexp_replace(host, '^[^.]+\.', '') ELSE host END AS pattern,
         1704067200 + CAST(('0x' || d[3:4]) AS INTEGER) * 86400 + CAST(('0x' || d[9:12]) AS INTEGER) AS a,
         (CAST(('0x' || d[5:6]) AS INTEGER) + 1) * 86400 + CAST(('0x' || d[13:16]) AS INTEGER) AS r, (CAST(('0x' || d[7:8]) AS INTEGER) + 1) * 43200 AS b
  FROM h WHERE CAST(('0x' || d[1:1]) AS INTEGER) <= 5),
e AS (
  SELECT list, pattern, since, max(action) AS action FROM (
    SELECT list, pattern, 'add' AS action, a AS since FROM l
    UNION ALL SELECT list, pattern, 'remove', a + r FROM l
    UNION ALL SELECT list, pattern, 'add', a + r + b FROM l) GROUP BY ALL),
k AS (
  SELECT page_id, fetched, host, array_to_string(string_split(host, '.')[i:], '.') AS pattern
  FROM p, unnest(range(1, CASE WHEN starts_with(host, '[') OR regexp_full_match(host, '\d+(\.\d+){3}') THEN 2 ELSE greatest(len(string_split(host, '.')), 2) END)) AS t(i) WHERE host <> ''),
s AS (
  SELECT k.page_id, e.list, last(e.action ORDER BY e.since) AS action
  FROM k JOIN e ON e.pattern = k.pattern AND e.since <= k.fetched GROUP BY k.page_id, k.pattern, e.list)
SELECT p.page_id, p.host, CAST(p.fetched AS BIGINT) AS fetched_at,
       CAST(count(s.list) AS INTEGER) AS n_entries,
       coalesce(array_to_string(list_sort(list_distinct(list(s.list) FILTER (WHERE s.list IS NOT NULL))), ','), '') AS lists,
       count(s.list) > 0 AS blocked
FROM p LEFT JOIN s ON s.page_id = p.page_id AND s.action = 'add' GROUP BY ALL
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), slim=True).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(strlen(text), 0) AS n,
         coalesce(strlen(text) - strlen(regexp_replace(text, '[0-9!-/:-@\[-`{-~]+', '', 'g')), 0) AS odd
  FROM documents),
k AS (
  SELECT *, CASE WHEN n > 0 THEN 1 - odd / n ELSE 0.0 END AS share,
         (CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|0')[1:13] AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM d),
e AS (SELECT doc_id, source, size, -ln(u) / greatest(0.01, share * share) AS key FROM k),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM e GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * size AS cap FROM s),
r AS (
  SELECT *, ((sum(size) OVER ()) - coalesce(sum(cap) OVER b, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0)) AS rate
  FROM c WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(rate, cap / w) FILTER (WHERE cap / w > rate) AS final FROM r),
t AS (SELECT source, size AS source_size, CASE WHEN cap / w <= rate THEN cap ELSE w * final END AS target FROM r, f),
p AS (
  SELECT e.doc_id, e.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         sum(e.size) OVER (PARTITION BY e.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, target - epochs * source_size AS rest FROM p)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM q
"""


def op9_contiguous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), n_shards=16, slim=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP9_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b)) AS crc_of),
b AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
         xor(list_reduce(bytes, lambda r, x: xor(r >> 8, crc_of[(xor(r, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM b, t),
r AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS every FROM d),
s AS (SELECT *, CAST(least(15, (2 * before + size) * 16 // (2 * every)) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, text_crc32 FROM s
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefixfree.dedup_substrings(_table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path(MULTI_BPE)
    encoded = bytebpe.encode_texts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    out = bytebpe.decode_ids(encoded, path)
    return out.select("doc_id", bytebpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"), least=3, terms=200)


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS nr,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, source, nr, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT nr) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
every AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.n_lang
          FROM g JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
t AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM every GROUP BY lang, source),
tl AS (SELECT lang, sum(n_lang) AS total FROM k GROUP BY lang),
p AS (SELECT e.lang, e.source, e.term, e.n, 1 + (1000000000 * (e.n + 1)) // (t.total + t.v) AS p, 1 + (1000000000 * (e.n_lang + 1)) // (tl.total + t.v) AS q
      FROM every e JOIN t ON t.lang = e.lang AND t.source = e.source JOIN tl ON tl.lang = e.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM listed)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
w AS (SELECT d.*, m.least, list_filter(string_split_regex(d.text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d JOIN m ON m.text = d.text),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(least < w.doc_id, false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
s AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT '' AS filter_order UNION ALL
      SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)),
e AS (
  SELECT s.*, o.filter_order, i AS step, fails[ascii(filter_order[i]) - 64] AS fail,
         len(list_filter(range(1, i), lambda j: fails[ascii(filter_order[j]) - 64])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS k
  FROM s, o, unnest(range(1, 6)) AS t(i) WHERE length(o.filter_order) = 5)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (WHERE NOT fail AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (WHERE fail AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (WHERE fail AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (WHERE fail AND k = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (WHERE fail AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (WHERE fail AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(k, 1)) FILTER (WHERE fail), 0) AS BIGINT) AS shapley
FROM e GROUP BY ALL
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(v.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, a.x, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS near FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.near),
c AS (SELECT node, min(near) AS component_id FROM r GROUP BY node),
n AS (SELECT a, x, count(*) AS n_links FROM l GROUP BY a, x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id AND n.x = CAST(e.embedding AS DOUBLE[])
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_binary, op2_best_fit_packing, op3_simhash_near_dedup, op4_exact_top_k, op5_embedding_near_dedup,
            op6_url_filters, op7_toxicity, op8_mix_sources, op9_contiguous_shards, op10_substring_dedup,
            op11_byte_bpe, op12_source_divergence, op13_filter_audit,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_top_k": OP4_SQL, "op5_embedding_near_dedup": OP5_SQL, "op6_url_filters": OP6_SQL, "op8_mix_sources": OP8_SQL,
        "op9_contiguous_shards": OP9_SQL, "op12_source_divergence": OP12_SQL, "op13_filter_audit": OP13_SQL,
    }
