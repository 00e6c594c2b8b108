"""Queries of this subpackage: thin calls of the operators on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, fill_in_middle, language, licenses, packing, product_quantisation, quality, ranked_search, shards, simhash, token_counts, token_file, topk
from .scratch import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def sql(name: str, text: str) -> None:
    """DuckDB SQL for the rows of a query."""
    ORACLES[name] = text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_file.write_tokens(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return token_file.read_documents(spark, folder)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


sql("op10_decontamination", """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, text, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT item_id, text, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k)),
n AS (SELECT item_id, text, count(*) AS shingles FROM bs GROUP BY ALL),
hits AS (SELECT doc_id, item_id, text, count(*) AS shared FROM ds JOIN bs USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, shared / shingles AS containment, shared, shingles
FROM hits JOIN n USING (item_id, text) WHERE shared >= 0.8 * shingles - 1e-9
""")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", F.col("quality_score").alias("score"), F.col("quality_posterior").alias("posterior"), F.col("quality_keep").alias("keep"))


@query
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.assign(table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


sql("op3_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no paths: a path is made of source and doc_id, and every 16th file is named LICENSE, at one of three depths."""
    docs = table(spark, sf_dir, "documents")
    place = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", "source", F.expr("doc_id div 4096"))).otherwise(F.concat_ws("/", "source", F.expr("doc_id div 4096"), F.expr("doc_id div 256")))
    path = F.when(F.expr("doc_id div 20 % 16 = 0"), F.concat(place, F.lit("/LICENSE-"), "doc_id")).otherwise(F.concat_ws("/", "source", F.expr("doc_id div 4096"), F.expr("doc_id div 256"), F.concat("doc_id", F.lit(".txt"))))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


_quoted = lambda text: "'" + text.replace("'", "''") + "'"  # noqa: E731
sql("op7_licenses", r"""
WITH tpl(template, license, text) AS (VALUES """ + ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(licenses.TEMPLATES)) + r"""),
f AS (SELECT doc_id, text, CASE WHEN doc_id // 20 % 16 = 0
        THEN CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || '/' || doc_id // 4096 ELSE source || '/' || doc_id // 4096 || '/' || doc_id // 256 END || '/LICENSE-' || doc_id
        ELSE source || '/' || doc_id // 4096 || '/' || doc_id // 256 || '/' || doc_id || '.txt' END AS path FROM documents),
files AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, path LIKE '%/LICENSE-%' AS named FROM f),
tt AS (SELECT template, license, term, count(*) AS tf
       FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.+-][a-z0-9]+)*')) AS term FROM tpl) x GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.+-][a-z0-9]+)*'))) AS term FROM files) x GROUP BY term),
idf AS (SELECT term, round(ln((1 + (SELECT count(text) FROM files))::DOUBLE / (1 + coalesce(n, 0))) + 1, 9) AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term)),
tn AS (SELECT template, sqrt(sum((tf * idf) ** 2)) AS norm FROM tt JOIN idf USING (term) GROUP BY template),
w AS (SELECT template, license, term, tf * idf / norm AS w FROM tt JOIN idf USING (term) JOIN tn USING (template)),
u AS (SELECT doc_id, unnest(units) AS text, unnest(range(len(units))) AS unit
      FROM (SELECT doc_id, string_split(text, chr(10)) || list_filter(regexp_split_to_array(text, '\n[^\S\n]*\n'), lambda p: contains(p, chr(10))) || CASE WHEN named THEN [text] ELSE [] END AS units FROM files) x),
ut AS (SELECT doc_id, unit, term, count(*) * coalesce(any_value(idf), 1) AS v
       FROM (SELECT doc_id, unit, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.+-][a-z0-9]+)*')) AS term FROM u) x LEFT JOIN idf USING (term) GROUP BY ALL),
un AS (SELECT doc_id, unit, sqrt(sum(v * v)) AS norm FROM ut GROUP BY ALL),
s AS (SELECT doc_id, license, round(sum(v * w) / any_value(norm), 6) AS score FROM ut JOIN w USING (term) JOIN un USING (doc_id, unit) GROUP BY doc_id, unit, template, license),
own AS (SELECT doc_id, first(license ORDER BY score DESC, license) AS license, max(score) AS score FROM s WHERE score >= 0.75 GROUP BY doc_id),
k AS (SELECT * FROM files LEFT JOIN own USING (doc_id)),
given AS (SELECT dir AS above, first(license ORDER BY score DESC, license) AS given, max(score) AS given_score FROM k WHERE named AND license IS NOT NULL GROUP BY dir),
heir AS (SELECT doc_id, first(above ORDER BY length(above) DESC) AS above, first(given ORDER BY length(above) DESC) AS given, first(given_score ORDER BY length(above) DESC) AS given_score
         FROM k JOIN given ON above = '' OR dir = above OR starts_with(dir, above || '/') WHERE license IS NULL GROUP BY doc_id)
SELECT doc_id, path, coalesce(license, given) AS license, coalesce(score, given_score) AS score,
       CASE WHEN license IS NULL THEN CASE WHEN given IS NULL THEN 'none' ELSE 'inherited' END WHEN named THEN 'file' ELSE 'header' END AS basis, above AS licensed_by
FROM k LEFT JOIN heir USING (doc_id)
""")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
sql("op11_ranked_search", f"""
WITH d AS (SELECT doc_id, len(w) AS n, w FROM (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM d),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_number = lambda i: f"('0x' || substr(sha256('42:' || doc_id), {8 * i + 1}, 8))::UBIGINT::BIGINT"  # noqa: E731
sql("op12_fill_in_middle", rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {", ".join(f"{_number(i)} AS h{i + 1}" for i in range(4))},
             regexp_extract_all(coalesce(text, ''), '[ 	-]*[^ 	-]+|[ 	-]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")


@query
def op13_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_quantisation.near_duplicates(table(spark, sf_dir, "embeddings"))


sql("op13_product_quantisation", """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
""")
