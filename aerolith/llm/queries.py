"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from pyspark.sql import functions as F

from aerolith.llm import (
    bitsliced, exact, language, mixing, packing, passages, resample, secretscan, sharding, simhash, toxicity, vectors, warc,
)
from aerolith.session import prepare, scratch, store

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(run):
        QUERIES[name] = lambda spark, sf_dir: run(prepare(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def exact_dedup(spark, sf_dir):
    """Per document: the row of its group that stays, and whether it is this one."""
    found = exact.groups(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


@query("op10_warc", """
SELECT page_id, strlen(p) AS payload_bytes, sha1(p) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN winner END AS refers_to
FROM (SELECT *, strlen(p) >= 1000 AND page_id <> winner AS again
      FROM (SELECT page_id, coalesce(html, '') AS p, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner
            FROM pages))
""")
def warc_round_trip(spark, sf_dir):
    """Per page: what the archives say of it after writing and reading them."""
    path = warc.write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return warc.read(spark, path).select(
        F.expr("nullif(record_id, 'null')").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op5_toxicity")
def toxicity_scores(spark, sf_dir):
    """Per document: a score learned from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


#: Exponents that temper today's token shares of sources, languages and topics towards even ones.
TEMPER = (0.7, 0.7, 0.7)


@query("op9_mixing", mixing.oracle("documents", TEMPER) + """
SELECT doc_id, mix_source AS source, mix_lang AS lang, mix_topic AS topic, mix_tokens AS tokens,
       round(mix_weight, 6) AS weight, round(mix_probability, 6) AS probability, round(mix_repeats, 6) AS repeats, mix_kept AS kept
FROM drawn
""")
def mixing_weights(spark, sf_dir):
    """Per document: its cell, raked weight, probability, repeats and whether it is drawn."""
    measured = store(mixing.measure(table(spark, sf_dir, "documents")).select(
        "doc_id", "mix_id", "mix_tokens", *mixing.DIMS), "measured")
    cells = mixing.rake(measured, dict(zip(mixing.DIMS, TEMPER)))
    return mixing.draw(measured, cells, mixing.DIMS).select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 6).alias("weight"),
        F.round("mix_probability", 6).alias("probability"), F.round("mix_repeats", 6).alias("repeats"), F.col("mix_kept").alias("kept"))


@query("op7_simhash")
def simhash_classes(spark, sf_dir):
    """Per document: the fingerprint of its three-word shingles and the class of fingerprints within two bits."""
    found = simhash.classes(table(spark, sf_dir, "documents"), shingle=3, most=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_vectors", """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v)
    AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM classes LEFT JOIN counts USING (vec_id)
""")
def vector_classes(spark, sf_dir):
    """Per vector: the vectors it links with, its class, and whether it stays."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op4_passages", r"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
windows AS (
  SELECT *, string_agg(word, ' ') OVER ahead AS content, count(*) OVER ahead AS size
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
twice AS (SELECT content FROM windows WHERE size = 35 GROUP BY content HAVING count(*) > 1),
starts AS (SELECT doc_id, i, word, size = 35 AND content IN (SELECT content FROM twice) AS repeats FROM windows),
marked AS (
  SELECT *, bool_or(repeats) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM starts),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS rest
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
""")
def passage_cuts(spark, sf_dir):
    """Per document: its words, the words cut as repeated passages, and a digest of the rest."""
    cut = passages.cut(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_secrets")
def secret_spans(spark, sf_dir):
    """Per document: the spans of secrets, by pattern and by randomness."""
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


@query("op2_packing")
def packed_pieces(spark, sf_dir):
    """Per piece of a document: its place there, its ids' digest and its place in a sequence."""
    return packing.pieces(table(spark, sf_dir, "documents"))


@query("op6_language")
def page_languages(spark, sf_dir):
    """Per page: the language that text, markup, address and host make likeliest."""
    model = language.learn(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model).drop("posterior").withColumnRenamed("id", "page_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_search", f"""
WITH found AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY 1),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, docs),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length)))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN held USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
""")
def ranked_search(spark, sf_dir):
    """Per benchmark item: its fifty best documents of all."""
    index = bitsliced.Index(table(spark, sf_dir, "documents"))
    return bitsliced.search(index, table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query("op12_sharding", sharding.oracle(40))
def shard_places(spark, sf_dir):
    """Per document: its shard of 40, its position there, and its shard if there were one more."""
    found = sharding.assign(table(spark, sf_dir, "documents"), sharding.grid(40), sharding.grid(41))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = f"""list_concat(ws, list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2]))"""


@query("op13_resample", f"""
WITH own AS (SELECT doc_id, len(ws) AS n_words, {_RUNS} AS fs FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
each AS (SELECT doc_id, unnest(fs) AS f FROM own),
target AS (SELECT unnest({_RUNS}) AS f FROM (SELECT {_WORDS} AS ws FROM benchmark)),
sums AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'),
      lambda x: ('0x' || x)::BIGINT)), lambda v, b: {sharding.nibble_steps('v', 'b')}), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM each UNION SELECT f FROM target)),
s AS (SELECT bucket, count(*) AS s FROM each JOIN sums USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM target JOIN sums USING (f) GROUP BY 1),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM each) + 10000)
      / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN sums USING (f) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, n_words, len(fs) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((
      ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM own LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20
""")
def importance_resample(spark, sf_dir):
    """Per document: how much likelier its features are in the benchmark, and its place in the draw."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
