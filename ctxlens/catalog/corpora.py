"""Corpus queries: summaries, relevance, recency, import graph and ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ctxlens import adapters as ad
from ctxlens import fixed_values as fv
from ctxlens.catalog import Catalog
from ctxlens.functions.text import embedding_text
from ctxlens.operators import active_files, imports, messages, ranking, relevance
from ctxlens.operators.ranking import Query
from ctxlens.runtime import ensure_checkpoint_dir
from ctxlens.sources.commit_log import read_commit_log
from ctxlens.sources.corpus import module_name, read_code, read_vectors
from ctxlens.sources.sinks import write_texts

CATALOG = Catalog()
AS_OF = "2024-03-01 00:00:00"
QUERIES = [
    Query(1, "the nation and of with."),
    Query(2, "le la des eau"),
    Query(3, "zzz qqq the"),
]


# --- recency ------------------------------------------------------------------------------

RECENCY = f"""
edits AS (SELECT 'pkg/u' || user_id || '.py' AS path, max(ts) AS last_edit FROM events GROUP BY 1),
rec AS (SELECT path, exp(-ln(2.0) / 30.0 * greatest(0.0, epoch_us(TIMESTAMP '{AS_OF}' - last_edit) / 86400e6)) AS score
        FROM (SELECT path, last_edit, last_edit AS l FROM edits))""".replace(
    "epoch_us(TIMESTAMP '" + AS_OF + "' - last_edit)",
    "(epoch_us(TIMESTAMP '" + AS_OF + "') - epoch_us(last_edit))",
)


def _recency(spark, sf):
    return ranking.recency(ad.event_commits(spark, sf), AS_OF)


@CATALOG.add(f"WITH {RECENCY} SELECT 'demo' AS repo, path, round(score, 6) AS score FROM rec")
def recency(spark, sf):
    return _recency(spark, sf).withColumn("score", F.round("score", 6))


@CATALOG.add(
    f"WITH {RECENCY} SELECT 'demo' AS repo, path, round(score, 6) AS score FROM rec ORDER BY rec.score DESC, path LIMIT 10"
)
def recency_top(spark, sf):
    return ranking.top_k(_recency(spark, sf), 10).withColumn("score", F.round("score", 6))


@CATALOG.add(
    """SELECT 'demo' AS repo, 'pkg/u' || user_id || '.py' AS path, CAST(count(*) AS BIGINT) AS commits,
    CAST(sum(epoch_us(ts) // 1000000) AS BIGINT) AS epochs FROM events GROUP BY 1, 2"""
)
def commit_log(spark, sf):
    """events written as a commit log and read back through the log reader."""
    where = f"{ensure_checkpoint_dir(spark)}/commit-log-{uuid.uuid4().hex}"
    commits = ad.event_commits(spark, sf)
    lines = F.concat(
        F.lit("COMMIT|"), F.unix_seconds("commit_ts"), F.lit("\n\n"), F.col("path")
    )
    commits.select(lines.alias("value")).write.text(where)
    return (
        read_commit_log(spark, where, "demo")
        .groupBy("repo", "path")
        .agg(
            F.count("*").alias("commits"),
            F.sum(F.unix_seconds("commit_ts")).alias("epochs"),
        )
    )


@CATALOG.add(
    """SELECT CASE WHEN doc_id % 3 = 0 THEN '_part=' ELSE 'part=' END || doc_id AS folder,
    CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, sha256(coalesce(text, '') || chr(10)) AS sha256 FROM documents"""
)
def code_corpus(spark, sf):
    """documents written as one text file each, a third below folders of hidden names, and read as a corpus."""
    where = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = ad.table(spark, sf, "documents").where(F.col("doc_id").isNotNull())
    name = F.when(F.col("doc_id") % 3 == 0, "_part=").otherwise("part=")
    write_texts(docs.select(F.concat(name, "doc_id").alias("folder"), F.col("text").alias("value")), where)
    files = read_code(spark, where, "demo", "part-*.txt")
    return files.select(
        F.substring_index("path", "/", 1).alias("folder"),
        F.octet_length("content").cast("bigint").alias("size"),
        F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
    )


# --- relevance ----------------------------------------------------------------------------

def _summaries_sql(lines: str) -> str:
    return f"""
docs AS (SELECT doc_id, source || '/d' || doc_id || '.py' AS path, 'd' || doc_id || '.py' AS name,
  list_aggregate(list_filter(list_transform({lines},
    lambda x: trim(x)), lambda x: x <> ''), 'string_agg', ' ') AS summary FROM documents),
summ AS (SELECT * FROM docs WHERE summary IS NOT NULL AND summary <> '')"""


BEGINNINGS = _summaries_sql(
    f"list_slice(string_split(substr(text, 1, {fv.SUMMARY_CHARS}), chr(10)), 1, {fv.SUMMARY_LINES})"
)
SUMMARIES = _summaries_sql("string_split(text, chr(10))")


@CATALOG.add(
    f"WITH {BEGINNINGS} SELECT path, summary, 'Filename: ' || name || '. Content: ' || summary AS embedded FROM summ"
)
def summaries(spark, sf):
    rows = ranking.summaries(
        ad.document_files(spark, sf), fv.SUMMARY_CHARS, fv.SUMMARY_LINES
    )
    return rows.select(
        "path", "summary", embedding_text(F.col("path"), F.col("summary")).alias("embedded")
    )


WORDS = "words(query_id, word) AS (VALUES " + ", ".join(
    f"(CAST({q.query_id} AS BIGINT), '{w}')"
    for q in QUERIES
    for w in sorted(set(q.text.lower().replace(".", " ").split()))
) + ")"
SCORES = f"""
{SUMMARIES}, {WORDS},
rel AS (SELECT query_id, path, sum(CASE WHEN contains(lower(name || ' ' || summary), word) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS score
        FROM summ, words GROUP BY 1, 2)"""


def _scores(spark, sf):
    return ranking.keyword_scores(ranking.summaries(ad.document_files(spark, sf)), QUERIES)


@CATALOG.add(f"WITH {SCORES} SELECT query_id, 'demo' AS repo, path, round(score, 6) AS score FROM rel")
def keyword_score(spark, sf):
    return _scores(spark, sf).withColumn("score", F.round("score", 6))


@CATALOG.add(
    f"""WITH {SCORES} SELECT query_id, 'demo' AS repo, path, round(score, 6) AS score, CAST(n AS INT) AS rank_no
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n FROM rel) WHERE n <= 5"""
)
def keyword_topk(spark, sf):
    return ranking.top_k(_scores(spark, sf), fv.RANK_TOP_K, "query_id").withColumn(
        "score", F.round("score", 6)
    )


@CATALOG.add(f"WITH {SCORES} SELECT DISTINCT query_id, lower(regexp_extract(path, '[^/]*$')) AS file_key FROM rel WHERE score >= 0.5")
def keyword_boost(spark, sf):
    return ranking.boosted_files(_scores(spark, sf))


# Questions of a table: the opening message of each conversation, or its last user message.
ASKED = f"""
{SUMMARIES},
hay AS (SELECT path, lower(name || ' ' || summary) AS hay FROM summ),
asked AS (SELECT query_id, unnest(words) AS word, len(words) AS n FROM (
  SELECT query_id, list_distinct(list_filter(regexp_split_to_array(replace(lower(text), '.', ' '), '\\s+'), lambda w: w <> '')) AS words FROM questions)),
hits AS (SELECT word, path FROM (SELECT DISTINCT word FROM asked) JOIN hay ON contains(hay, word)),
rel AS (SELECT query_id, path, count(*) / any_value(CAST(n AS DOUBLE)) AS score FROM asked JOIN hits USING (word) GROUP BY 1, 2)"""
OPENINGS = "questions AS (SELECT conv_id AS query_id, text FROM conversations WHERE turn = 0)"
LAST_ASKED = """questions AS (SELECT conv_id AS query_id, max_by(text, turn) AS text FROM conversations
  WHERE role = 'user' GROUP BY 1)"""


@CATALOG.add(
    f"""WITH {OPENINGS}, {ASKED} SELECT query_id, 'demo' AS repo, path, round(score, 6) AS score, CAST(n AS INT) AS rank_no
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n FROM rel) WHERE n <= 5"""
)
def question_topk(spark, sf):
    """Best files of every conversation's opening, questions as a table."""
    questions = ad.table(spark, sf, "conversations").where("turn = 0").select(
        F.col("conv_id").alias("query_id"), "text"
    )
    best = relevance.best_files(ranking.summaries(ad.document_files(spark, sf)), questions)
    return best.select("query_id", "repo", "path", F.round("score", 6).alias("score"), "rank_no")


@CATALOG.add(
    f"""WITH {LAST_ASKED}, {ASKED} SELECT query_id AS request_id, CAST(count(DISTINCT lower(regexp_extract(path, '[^/]*$'))) AS BIGINT) AS files
    FROM rel WHERE score >= 0.5 GROUP BY 1"""
)
def boosted_active_files(spark, sf):
    """Active files of each conversation: none is named, so all come from its last question."""
    msgs = ad.chat_messages(spark, sf)
    questions = messages.last_user_text(msgs).withColumnRenamed("request_id", "query_id")
    files = ranking.summaries(ad.document_files(spark, sf))
    boosted = ranking.boosted_files(relevance.files_above(files, questions, fv.BOOST_THRESHOLD, sets=True))
    return active_files.active_files(msgs, boosted).groupBy("request_id").agg(
        F.sum("files").alias("files")
    )


COSINE = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
cos AS (SELECT vec_id AS path, greatest(0.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q))) AS score FROM embeddings)"""


def _cosines(spark, sf, size=64):
    vectors = read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding")
    query = vectors.where("path = 0").select("embedding").scalar()
    return ranking.cosine_scores(vectors, query, size)


@CATALOG.add(f"WITH {COSINE} SELECT path, round(score, 6) AS score FROM cos")
def cosine(spark, sf):
    return _cosines(spark, sf).withColumn("score", F.round("score", 6))


@CATALOG.add(f"WITH {COSINE} SELECT path, round(score, 6) AS score FROM cos", name="cosine_columns")
def _cosine_columns(spark, sf):
    return _cosines(spark, sf, None).withColumn("score", F.round("score", 6))


@CATALOG.add(f"WITH {COSINE} SELECT path, round(score, 6) AS score FROM cos WHERE score >= 0.5")
def cosine_boost(spark, sf):
    return _cosines(spark, sf).where(F.col("score") >= fv.BOOST_THRESHOLD).withColumn(
        "score", F.round("score", 6)
    )


@CATALOG.add(f"WITH {COSINE} SELECT path, round(score, 6) AS score FROM cos ORDER BY cos.score DESC, path LIMIT 5")
def cosine_topk(spark, sf):
    return ranking.top_k(_cosines(spark, sf), fv.RANK_TOP_K).withColumn("score", F.round("score", 6))


# --- import graph ---------------------------------------------------------------------------

MODULES = """
files AS (SELECT doc_id AS d, CASE WHEN doc_id % 10 = 0 THEN 'p' || doc_id || '/__init__.py'
                 ELSE 'p' || (doc_id - doc_id % 10) || '/m' || doc_id || '.py' END AS path,
          CASE WHEN doc_id % 10 = 0 THEN 'p' || doc_id ELSE 'p' || (doc_id - doc_id % 10) || '.m' || doc_id END AS module,
          doc_id % 33 = 32 AS broken FROM documents),
imp AS (SELECT path AS src, 'os' AS wanted FROM files WHERE NOT broken
  UNION SELECT path, 'p' || (d - d % 10) || '.m' || ((d * 7 + 1) % 50) || '.deep' FROM files WHERE NOT broken
  UNION SELECT path, 'p' || ((d % 20) * 10) FROM files WHERE NOT broken
  UNION SELECT path, 'p' || (d - d % 10) || '.m' || (d - d % 10 + (d + 1) % 10) FROM files WHERE NOT broken),
exact AS (SELECT src, wanted, files.path AS dst FROM imp JOIN files ON module = wanted),
pre AS (SELECT src, files.path AS dst FROM imp JOIN files ON starts_with(wanted, module || '.')
        WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.src = imp.src AND e.wanted = imp.wanted))"""


@CATALOG.add(f"WITH {MODULES} SELECT path, module FROM files")
def module_names(spark, sf):
    return ad.document_modules(spark, sf).select(
        "path", module_name(F.col("path")).alias("module")
    )


def _modules(spark, sf):
    return ad.document_modules(spark, sf).withColumn("module", module_name(F.col("path")))


@CATALOG.add(f"WITH {MODULES} SELECT 'demo' AS repo, src, wanted AS module FROM imp")
def import_statements(spark, sf):
    return imports.imports(_modules(spark, sf))


@CATALOG.add(
    f"""WITH {MODULES} SELECT DISTINCT 'demo' AS repo, src, dst FROM
    (SELECT src, dst FROM exact UNION ALL SELECT src, dst FROM pre) WHERE src <> dst"""
)
def import_edges(spark, sf):
    return imports.import_graph(_modules(spark, sf))


@CATALOG.add(f"WITH {MODULES} SELECT DISTINCT src, dst FROM pre WHERE src <> dst")
def import_prefix_edges(spark, sf):
    files = _modules(spark, sf)
    rows = imports.imports(files)
    exact = rows.join(files.select("repo", "module"), ["repo", "module"], "left_semi")
    misses = rows.join(exact, ["repo", "src", "module"], "left_anti")
    return imports.edges(misses, files).select("src", "dst")


EDGES = """
edges AS (SELECT DISTINCT 'd' || doc_id AS src, 'd' || unnest([(doc_id * 7 + 1) % 200, (doc_id * 3 + 2) % 150]) AS dst FROM documents),
links AS (SELECT * FROM edges WHERE src <> dst)"""


def _bfs_sql(src: str, dst: str) -> str:
    return f"""WITH RECURSIVE {EDGES},
    walk(start, node, steps) AS (
      SELECT 'd' || doc_id, 'd' || doc_id, 0 FROM documents
      UNION SELECT start, {dst}, steps + 1 FROM walk JOIN links ON {src} = node WHERE steps < 3)
    SELECT 'demo' AS repo, start, node, CAST(min(steps) AS INT) AS steps FROM walk GROUP BY start, node HAVING min(steps) > 0"""


def _starts(spark, sf):
    return ad.table(spark, sf, "documents").select(
        F.lit("demo").alias("repo"), F.concat(F.lit("d"), F.col("doc_id")).alias("start")
    )


@CATALOG.add(_bfs_sql("src", "dst"))
def deps_bfs(spark, sf):
    return imports.reachable(_starts(spark, sf), ad.document_edges(spark, sf), depth=3)


@CATALOG.add(_bfs_sql("dst", "src"))
def dependents_bfs(spark, sf):
    back = imports.reversed_edges(ad.document_edges(spark, sf))
    return imports.reachable(_starts(spark, sf), back, depth=3)


# --- ranking --------------------------------------------------------------------------------

def _rank_sql(scores: str, target: str) -> str:
    """`target` is the target of the question `query_id`, whose best guess is `guess.target`."""
    return f"""WITH {scores},
src AS (SELECT doc_id, source || '/d' || doc_id || '.py' AS path FROM documents),
{EDGES.strip()},
named AS (SELECT a.path AS src, b.path AS dst FROM links JOIN src a ON 'd' || a.doc_id = links.src JOIN src b ON 'd' || b.doc_id = links.dst),
edits AS (SELECT path, max(ts) AS last_edit FROM events JOIN src ON src.doc_id = events.user_id GROUP BY 1),
rec AS (SELECT path, exp(-ln(2.0) / 30.0 * greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_edit)) / 86400e6)) AS score FROM edits),
guess AS (SELECT query_id, path AS target FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n FROM rel) WHERE n = 1),
target AS (SELECT query_id, {target} AS target FROM guess),
near AS (SELECT query_id, dst AS path, 0.8 AS s FROM target JOIN named ON named.src = target WHERE dst <> target
  UNION ALL SELECT query_id, src, 0.5 FROM target JOIN named ON named.dst = target WHERE src <> target
  UNION ALL SELECT query_id, target, 1.0 FROM target),
struct_scores AS (SELECT query_id, path, min(s) AS s FROM near GROUP BY 1, 2),
allf AS (SELECT query_id, path FROM rel UNION SELECT query_id, path FROM struct_scores
         UNION SELECT query_id, path FROM rec, (SELECT DISTINCT query_id FROM words)),
fused AS (SELECT allf.query_id, allf.path, coalesce(rel.score, 0.0) AS semantic, coalesce(CAST(s AS DOUBLE), 0.0) AS structural, coalesce(rec.score, 0.0) AS temporal
  FROM allf LEFT JOIN rel USING (query_id, path) LEFT JOIN struct_scores USING (query_id, path) LEFT JOIN rec ON rec.path = allf.path),
total AS (SELECT *, 0.4 * semantic + 0.4 * structural + 0.2 * temporal AS score FROM fused),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n FROM total)
SELECT query_id, 'demo' AS repo, path, round(semantic, 6) AS semantic, round(structural, 6) AS structural,
round(temporal, 6) AS temporal, round(score, 6) AS score, CAST(n AS INT) AS rank_no FROM ranked WHERE n <= 5"""


RANK = _rank_sql(SCORES, "CASE WHEN query_id = 2 THEN (SELECT path FROM src WHERE doc_id = 5) ELSE target END")
OPENING_SCORES = f"""
{SUMMARIES}, {OPENINGS},
words AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(replace(lower(text), '.', ' '), '\\s+'), lambda w: w <> '')) AS word FROM questions),
rel AS (SELECT query_id, path, sum(CASE WHEN contains(lower(name || ' ' || summary), word) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS score
        FROM summ, words GROUP BY 1, 2)"""


def _ranked_corpus(spark, sf):
    """Files, import edges and recency of the documents as a corpus."""
    files = ad.document_files(spark, sf)
    names = files.select("repo", "path", F.concat(F.lit("d"), F.col("doc_id")).alias("node"))
    edges = (
        ad.document_edges(spark, sf)
        .join(names.select("repo", F.col("node").alias("src"), F.col("path").alias("from")), ["repo", "src"])
        .join(names.select("repo", F.col("node").alias("dst"), F.col("path").alias("to")), ["repo", "dst"])
        .select("repo", F.col("from").alias("src"), F.col("to").alias("dst"))
    )
    commits = (
        ad.table(spark, sf, "events")
        .select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("commit_ts"))
        .join(files.select("repo", "path", "doc_id"), "doc_id")
    )
    return files, edges, ranking.recency(commits, AS_OF)


def _rounded(ranked):
    return ranked.withColumns({c: F.round(c, 6) for c in ("semantic", "structural", "temporal", "score")})


@CATALOG.add(RANK)
def context_rank(spark, sf):
    files, edges, recent = _ranked_corpus(spark, sf)
    target = files.where("doc_id = 5").select("path").first()["path"]
    queries = [Query(q.query_id, q.text, target if q.query_id == 2 else None) for q in QUERIES]
    return _rounded(ranking.assemble_context(files, edges, recent, queries))


@CATALOG.add(
    _rank_sql(OPENING_SCORES, "CASE WHEN query_id % 3 = 0 THEN coalesce((SELECT path FROM src WHERE doc_id = query_id % 50), target) ELSE target END")
)
def context_rank_table(spark, sf):
    """Best files for every conversation's opening; a third of them names a file."""
    files, edges, recent = _ranked_corpus(spark, sf)
    asked = ad.table(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), "text")
    named = files.select(F.col("doc_id").alias("_doc"), F.col("path").alias("target"))
    about = F.when(F.col("query_id") % 3 == 0, F.col("query_id") % 50)
    questions = asked.join(named, about == F.col("_doc"), "left").select("query_id", "text", "target")
    return _rounded(relevance.assemble_contexts(files, ranking.summaries(files), edges, recent, questions))
