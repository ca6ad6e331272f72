"""The queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxlens.catalog import Catalog
from ctxlens.llm import (
    chat,
    decontaminate,
    extract,
    knn,
    licenses,
    negatives,
    packing,
    private_data,
    simhash,
    spelling,
    substrings,
    toxicity,
    url_lists,
)
from ctxlens.llm.tables import table

CATALOG = Catalog()
VOCABULARY = "byte_bpe_50k.json"

# Control strings of the chat template; each one in a text, and each backslash, costs one more character.
_EXTRA = " + ".join(
    [r"length(text) - length(replace(text, '\', ''))"]
    + [f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in chat.CONTROLS]
)
_FRAME = "CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 20 + length(role) END"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@CATALOG.add("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op1_voronoi_knn(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), knn.quantized(F.col("embedding")).alias("v")
    )
    return knn.nearest(vectors, vectors.where(F.col("id") % 50 == 0))


@CATALOG.add(f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum({_FRAME} + length(text) + {_EXTRA}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""")
def op2_chat_format(spark, sf):
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], given.schema)
    return chat.digests(chat.format_conversations(chat.threads(given.union(extra))))


_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '')"


@CATALOG.add(f"""
WITH c AS (SELECT page_id AS capture_id, {_HOST} AS host,
                  DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS day FROM pages),
e AS (SELECT array_to_string(string_split({_HOST}, '.')[-2 - CAST(page_id % 2 AS INTEGER):], '.') AS domain,
             DATE '2024-01-01' + CAST(page_id * 17 % 365 AS INTEGER) AS day, bool_or(page_id % 5 <> 0) AS listed
      FROM pages WHERE page_id % 3 = 0 AND {_HOST} IS NOT NULL GROUP BY 1, 2),
m AS (SELECT capture_id, c.host, e.domain, e.day, e.listed,
             row_number() OVER (PARTITION BY capture_id, e.domain ORDER BY e.day DESC) AS n
      FROM c JOIN e ON e.day <= c.day AND (c.host = e.domain OR ends_with(c.host, '.' || e.domain))),
b AS (SELECT capture_id, domain FROM m WHERE n = 1 AND listed
      QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY length(domain) DESC) = 1),
x AS (SELECT c.*, b.domain FROM c LEFT JOIN b USING (capture_id)),
g AS (SELECT domain, day, listed,
             row_number() OVER (PARTITION BY domain ORDER BY day)
             - row_number() OVER (PARTITION BY domain, listed ORDER BY day) AS run FROM e),
i AS (SELECT domain, run, min(day) AS since, max(day) AS until FROM g WHERE listed GROUP BY 1, 2)
SELECT capture_id, host, x.domain IS NOT NULL AS listed, x.domain,
       (SELECT CAST(max(i.since) AS VARCHAR) FROM i WHERE i.domain = x.domain AND i.since <= x.day) AS since
FROM x""")
def op3_url_lists(spark, sf):
    """List entries come from the pages too: every third one lists or clears its domain on a day."""
    pages = table(spark, sf, "pages")
    start = F.lit("2024-01-01").cast("date")
    day = lambda step: F.date_add(start, (F.col("page_id") * step % 365).cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", day(37).alias("day"))
    names = F.split(url_lists.host(F.col("url")), r"\.")
    kept = F.least(F.size(names), F.lit(2) + (F.col("page_id") % 2).cast("int"))
    entries = pages.where(F.col("page_id") % 3 == 0).select(
        F.array_join(F.slice(names, F.size(names) - kept + 1, kept), ".").alias("domain"),
        day(17).alias("day"), (F.col("page_id") % 5 != 0).alias("listed"),
    )
    return url_lists.judged(captures, entries).withColumn("since", F.col("since").cast("string"))


@CATALOG.add()
def op4_license_scan(spark, sf):
    return licenses.scanned(table(spark, sf, "documents"))


_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@CATALOG.add(f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS x
        FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM n)),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS x
          FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes)),
h AS (SELECT doc_id, size, p, item_id FROM grams JOIN win USING (size, x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + size)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op5_decontaminate(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@CATALOG.add()
def op6_toxicity(spark, sf):
    return toxicity.scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@CATALOG.add(r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
f AS (SELECT x, min(doc_id) AS first FROM g GROUP BY 1),
r AS (SELECT doc_id, list(DISTINCT p) AS gone
      FROM (SELECT doc_id, unnest(range(p, p + 50)) AS p FROM g JOIN f USING (x) WHERE first < doc_id) GROUP BY 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) a
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS p FROM r) b
                        WHERE b.doc_id = a.doc_id AND b.p = a.p)
      GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op7_substrings(spark, sf):
    return substrings.removed_repeats(table(spark, sf, "documents"))


@CATALOG.add()
def op8_extract(spark, sf):
    return extract.extracted(table(spark, sf, "pages"))


@CATALOG.add()
def op9_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), vocabulary_path())


@CATALOG.add()
def op10_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@CATALOG.add("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, d.vec_id, d.label = a.label AS same,
             CAST(list_sum(list_transform(list_zip(a.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v d ON d.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op11_hard_negatives(spark, sf):
    number, label = F.col("vec_id").cast("long"), F.col("label")
    vectors = table(spark, sf, "embeddings").select(
        number.alias("id"), F.when(number % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        knn.quantized(F.col("embedding")).alias("v"),
    )
    return negatives.hard_negatives(vectors, vectors.where(F.col("id") % 100 == 0))


@CATALOG.add()
def op12_spelling_variants(spark, sf):
    return spelling.variants(spelling.vocabulary(table(spark, sf, "documents"), every=199))


@CATALOG.add()
def op13_private_data(spark, sf):
    """Counts and base_sha256 are of spans in the text as it is; spans and n_added tell the rest."""
    found = private_data.identifiers(table(spark, sf, "documents"))
    base = F.filter("found", lambda s: s["base"])
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(of_kind(k).alias(f"n_{k}") for k in private_data.KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("long").alias("n_added"),
    )


@CATALOG.add()
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
