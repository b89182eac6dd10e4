"""The registered queries of the text operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.llm.backoff import backoff_scores
from onefold.llm.bit_sliced import top_inner_products
from onefold.llm.decontaminate import contained_items
from onefold.llm.html_text import main_text
from onefold.llm.importance import importance_resample
from onefold.llm.lang_id import fit_languages, predict_languages
from onefold.llm.manifest import merkle_manifest
from onefold.llm.near_dup import near_duplicates
from onefold.llm.packing import pack_documents
from onefold.llm.personal import fit_field, labelled_table, personal_data
from onefold.llm.revisits import resolve_revisits
from onefold.llm.substring_dedup import remove_repeats
from onefold.llm.toxicity import fit_toxicity, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records of the pages: each is fetched in full, then asked for again under another spelling of its URL.

    By page_id modulo 4 the second request names the right etag, only the right date, an outdated etag, or nothing.
    """
    tag, date = F.concat(F.lit('W/"'), F.md5("html"), F.lit('"')), F.concat(F.lit("day "), F.col("page_id") % 365)
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"),
        date.alias("last_modified"), F.md5("html").alias("digest"),
        F.create_map(F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Date"), date, F.lit("Server"), F.lit("a")).alias("headers"),
    )
    way = F.col("page_id") % 4
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?:", "http:"), F.lit("#again")).alias("url"),
        (F.col("page_id") + 50).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(way == 0, F.concat(F.lit('"'), F.md5("html"), F.lit('"'))).when(way == 2, F.lit('"old"')).alias("etag"),
        F.when(way == 1, date).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("later "), date), F.lit("ETag"), F.lit("x")).alias("headers"),
    )
    return first.unionByName(again)


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses that not-modified answers confirm, with merged headers, over the captures of all pages."""
    found = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url_key", "response_id", "outcome", "digest", F.array_join(lines, "; ").alias("headers"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when every 13-word window that starts in an earlier document is cut."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER_WORDS = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP2_SQL = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs)
),
earliest AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM windows JOIN earliest USING (g) WHERE least < doc_id)
),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM docs),
kept AS (
  SELECT w.doc_id, count(g.p) AS n_removed, string_agg(w.word, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS kept
  FROM words w LEFT JOIN gone g USING (doc_id, p) GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

def op6_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from toxic and unlabelled rows outside the held-out fold."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs.where(~held), table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every hundredth vector with all others."""
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a similarity of 0.8 of their sets of 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 512 to 4096 words packed from all documents, with the pieces in each."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff score of every document under the counts of all documents."""
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), "n_backed_off")


def op4_benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every benchmark text under the counts of all documents, where most longer n-grams are unseen."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    scored = backoff_scores(items, counts_from=table(spark, sf_dir, "documents"))
    return scored.select(F.col("doc_id").alias("item_id"), "n_words", F.round("log_score", 5).alias("log_score"), "n_backed_off")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held).select("doc_id", "text", "lang"))
    found = predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of the five-word shingles of a benchmark item."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark texts, and the tenth that is drawn."""
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: spans of the patterns and those that the trained field adds."""
    found = personal_data(table(spark, sf_dir, "documents"), fit_field(labelled_table(spark)))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document; half of them are read with their line breaks taken away."""
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    made = merkle_manifest(table(spark, sf_dir, "documents"), tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, when=half)
    return made.leaves


QUERIES = {
    "op1_revisit_resolution": op1_revisit_resolution,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_backoff_scores": op4_backoff_scores,
    "op4_benchmark_scores": op4_benchmark_scores,
    "op5_html_extraction": op5_html_extraction,
    "op6_pu_toxicity": op6_pu_toxicity,
    "op7_bit_sliced_top_k": op7_bit_sliced_top_k,
    "op8_minhash_near_dup": op8_minhash_near_dup,
    "op9_language_id": op9_language_id,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_personal_data": op12_personal_data,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# Every row is a document or an item of its own; of several with one id the best pair counts.
OP10_SQL = rf"""
WITH words AS (
  SELECT true AS is_doc, row_number() OVER () AS r, doc_id AS id, {_LOWER_WORDS} AS ws FROM documents
  UNION ALL SELECT false, row_number() OVER (), item_id, {_LOWER_WORDS} FROM benchmark
),
shingles AS (
  SELECT DISTINCT is_doc, r, id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT is_doc, r, id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0 AND id IS NOT NULL)
),
items AS (SELECT r, id AS item_id, g, count(*) OVER (PARTITION BY r) AS n_item FROM shingles WHERE NOT is_doc),
shared AS (
  SELECT d.r AS doc, i.r AS item, any_value(d.id) AS doc_id, any_value(i.item_id) AS item_id, any_value(i.n_item) AS n_item, count(*) AS n_shared
  FROM shingles d JOIN items i USING (g) WHERE d.is_doc GROUP BY 1, 2
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_shared::DOUBLE / n_item DESC, n_item DESC) AS place
  FROM shared WHERE 100 * n_shared >= 80 * n_item
)
SELECT doc_id, item_id, n_item::INTEGER AS n_item, n_shared::INTEGER AS n_shared, n_shared::DOUBLE / n_item AS containment FROM best WHERE place = 1
"""

def _backoff_sql(counted: str, scored: str, key: str) -> str:
    """Trigram scores of the rows of one table under the counts of another."""
    grams = "i, ws[i] AS g1, CASE WHEN i > 1 THEN ws[i - 1:i] END AS g2, CASE WHEN i > 2 THEN ws[i - 2:i] END AS g3"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, {key}, {_WORDS} AS ws FROM {scored}),
corpus AS (SELECT {_WORDS} AS ws FROM {counted}),
told AS (SELECT {grams} FROM (SELECT unnest(range(1, len(ws) + 1)) AS i, ws FROM corpus)),
asks AS (SELECT r, {grams} FROM (SELECT r, unnest(range(1, len(ws) + 1)) AS i, ws FROM docs)),
c1 AS (SELECT g1, count(*) AS n1 FROM told GROUP BY g1),
c2 AS (SELECT g2, count(*) AS n2 FROM told WHERE g2 IS NOT NULL GROUP BY g2),
c3 AS (SELECT g3, count(*) AS n3 FROM told WHERE g3 IS NOT NULL GROUP BY g3),
known AS (
  SELECT g.r, g.g2, g.g3, c1.n1, before.n1 AS before1, c2.n2, before2.n2 AS before2, c3.n3, (SELECT count(*) FROM told) AS total
  FROM asks g LEFT JOIN c1 USING (g1)
  LEFT JOIN c1 before ON before.g1 = g.g2[1] LEFT JOIN c2 ON c2.g2 = g.g2
  LEFT JOIN c2 before2 ON before2.g2 = g.g3[1:2] LEFT JOIN c3 ON c3.g3 = g.g3
),
scored AS (
  SELECT r, CASE WHEN g3 IS NOT NULL THEN n3 IS NULL WHEN g2 IS NOT NULL THEN n2 IS NULL ELSE false END AS backed,
    CASE WHEN n3 > 0 THEN ln(n3::DOUBLE) - ln(before2::DOUBLE)
      WHEN n2 > 0 THEN ln(n2::DOUBLE) - ln(before1::DOUBLE) + CASE WHEN g3 IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END
      ELSE ln(coalesce(n1, 1)::DOUBLE) - ln(greatest(total, 1)::DOUBLE)
        + CASE WHEN g3 IS NOT NULL THEN 2 * ln(0.4::DOUBLE) WHEN g2 IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END END AS s
  FROM known
)
SELECT d.{key}, len(d.ws) AS n_words, round(coalesce(sum(s), 0), 5) AS log_score, count_if(backed)::BIGINT AS n_backed_off
FROM docs d LEFT JOIN scored USING (r) GROUP BY d.r, d.{key}, len(d.ws)
"""


OP4_SQL = _backoff_sql("documents", "documents", "doc_id")
OP4_BENCHMARK_SQL = _backoff_sql("documents", "benchmark", "item_id")

OP7_SQL = """
WITH ok AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
flat AS (SELECT vec_id, len(v) AS dims, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM ok),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM flat q JOIN flat c USING (dims, d) WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10
"""

_CANONICAL = r"""
  regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/$', '')
  || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END
"""

OP1_SQL = rf"""
WITH bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare FROM pages
),
split AS (
  SELECT *, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)')) AS params FROM bare
),
keyed AS (SELECT page_id, html, md5(html) AS digest, 'day ' || (page_id % 365) AS date, {_CANONICAL} AS url_key FROM split),
found AS (
  SELECT r.page_id, r.url_key, r.digest AS own, r.date, f.page_id AS response, f.digest, f.date AS old_date, strlen(f.html) AS size
  FROM keyed r ASOF LEFT JOIN keyed f ON r.url_key = f.url_key AND r.page_id + 50 > f.page_id
),
judged AS (
  SELECT *, CASE WHEN response IS NULL THEN 'missing' WHEN page_id % 4 = 3 THEN 'unchecked' WHEN page_id % 4 = 2 THEN 'mismatch'
    WHEN page_id % 4 = 0 AND own = digest OR page_id % 4 = 1 AND date = old_date THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found
)
SELECT page_id * 2 + 1 AS record_id, url_key, response * 2 AS response_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN digest END AS digest,
  CASE WHEN outcome IN ('resolved', 'unchecked')
    THEN 'content-length: ' || size || '; date: later ' || date || '; etag: x; server: a' END AS headers
FROM judged
"""

# CRC-32 of the bytes of a string, byte by byte and bit by bit.
def crc32_sql(text: str) -> str:
    hexes = f"hex(encode({text}))"
    data = f"[('0x' || substr({hexes}, 2 * k - 1, 2))::BIGINT FOR k IN range(1, strlen({text}) + 1)]"
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda c, b: {bits}), 4294967295)"


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


# The tree of each source and the tree of the subroots, a level at a time; siblings per node, then folds.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, leaf, forged, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM (SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
          CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS forged
        FROM documents)
),
up AS (
  SELECT 0 AS level, source, i, leaf AS d, n FROM leaves
  UNION ALL SELECT level + 1, source, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1
  GROUP BY level, source, i // 3, n
),
subroots AS (
  SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
),
top AS (
  SELECT 0 AS level, i, subroot AS d, n FROM subroots
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, i // 3, n
),
below AS (SELECT source, count(DISTINCT level) - 1 AS depth FROM up GROUP BY source),
beside AS (
  SELECT a.source, a.level, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL
),
top_beside AS (
  SELECT a.level, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL
),
path AS (
  SELECT rank, level, l, r FROM (SELECT rank, source, i, unnest(range(0, depth)) AS level FROM leaves JOIN below USING (source)) x
  JOIN beside b USING (source, level) WHERE b.i = x.i // CAST(pow(3, level) AS BIGINT)
  UNION ALL
  SELECT rank, depth + level, l, r FROM (
    SELECT rank, depth, s.i, unnest(range(0, (SELECT max(level) FROM top))) AS level
    FROM leaves JOIN below USING (source) JOIN subroots s USING (source)) x
  JOIN top_beside b USING (level) WHERE b.i = x.i // CAST(pow(3, level) AS BIGINT)
),
fold AS (
  SELECT rank, 0 AS level, forged AS d FROM leaves
  UNION ALL SELECT rank, fold.level + 1, sha256(l || d || r) FROM fold JOIN path USING (rank, level)
),
root AS (SELECT d AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified, source, rank AS leaf_rank
FROM leaves JOIN subroots USING (source) CROSS JOIN root
JOIN (SELECT rank, max_by(d, level) AS folded FROM fold GROUP BY rank) USING (rank)
JOIN (SELECT rank, sha256(coalesce(string_agg(l || r, '' ORDER BY level), '')) AS proof_sha256 FROM leaves LEFT JOIN path USING (rank) GROUP BY rank) USING (rank)
"""

_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w FROM docs),
goal AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
hashed AS (SELECT w, {crc32_sql('w')} % 10000 AS bucket FROM (SELECT w FROM words UNION SELECT w FROM goal)),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM words JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM goal JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM words)::DOUBLE + 10000)
    / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM goal)::DOUBLE + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
),
sums AS (SELECT r, sum(gain)::BIGINT AS g FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / len(ws)), 0)::BIGINT AS weight,
    coalesce(floor(g::DOUBLE / len(ws)), 0)::BIGINT + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN sums USING (r)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""

ORACLES = {
    "op11_importance_resampling": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
    "op1_revisit_resolution": OP1_SQL,
    "op4_backoff_scores": OP4_SQL,
    "op4_benchmark_scores": OP4_BENCHMARK_SQL,
    "op7_bit_sliced_top_k": OP7_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op2_substring_dedup": OP2_SQL,
}
