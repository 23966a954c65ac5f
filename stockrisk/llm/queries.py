"""Named queries of the text operators, each over its whole table, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockrisk.llm import context_mixing, decontamination, embedding_dedup, language_ppm, lexical_search, line_dedup, minhash_dedup, periodic_runs, piece_lattice, quality, substring_dedup, token_records, toxicity
from stockrisk.llm.blocks import table

ROOT = str(Path(__file__).resolve().parents[2])
Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).select("doc_id", "junk_label", "score", "kept")


def op2_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return context_mixing.score_documents(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return token_records.encode_documents(table(spark, folder, "documents"))


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op6_piece_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return piece_lattice.encode_digests(table(spark, folder, "documents")).select(
        "doc_id", "best", F.col("decoded").alias("round_trip")
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "spans")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


def op9_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), shingle=4)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.remove_lines(table(spark, folder, "documents")).selectExpr(
        "doc_id", "n_lines", "n_removed", "sha2(text, 256) AS kept_sha256"
    )


def op11_language_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return language_ppm.predict(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(table(spark, folder, "documents"), periodic_runs.repeated_tail))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def importable(query: Query) -> Query:
    """Lets Python workers on this machine import the package whatever the current folder; a cluster gets it with the
    job (``--py-files``)."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
        return query(spark, folder)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_quality": op1_quality,
        "op2_context_mixing": op2_context_mixing,
        "op3_decontamination": op3_decontamination,
        "op4_token_records": op4_token_records,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_piece_lattice": op6_piece_lattice,
        "op7_toxicity": op7_toxicity,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_line_dedup": op10_line_dedup,
        "op11_language_ppm": op11_language_ppm,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_lexical_search": op13_lexical_search,
    }
    return {name: importable(query) for name, query in found.items()}


# The same results by plain counting and joins, for small tables.
SQL = {
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id
), c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT vec_id, cast((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, component_id,
  vec_id = component_id AS kept
FROM embeddings JOIN c ON id = vec_id
""",
    "op8_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50)
), first_of AS (SELECT h, min(doc_id) AS m FROM starts GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM starts JOIN first_of USING (h) WHERE m < doc_id
), kept AS (
  SELECT doc_id, p, word FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w)
  ANTI JOIN gone USING (doc_id, p)
), text_of AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT w.doc_id, cast(len(words) AS BIGINT) AS n_words, cast(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN text_of USING (doc_id)
""",
    "op9_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.size + q.size - c)
), reach(id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id
), comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, cast(coalesce(size, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents AS d JOIN comp ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, line, regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents)
), full_line AS (SELECT doc_id, i, len(w) AS n, array_to_string(w, ' ') AS k FROM l WHERE len(w) > 0),
part AS (
  SELECT doc_id, i, len(w) AS n, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') AS k
  FROM (SELECT doc_id, i, w, unnest(range(1, len(w) + 1)) AS p FROM l WHERE len(w) >= 8)
), pairs AS (
  SELECT doc_id, i FROM full_line QUALIFY (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY k)
  UNION SELECT doc_id, i FROM part QUALIFY (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY n, p, k)
  UNION SELECT a.doc_id, a.i FROM part AS a JOIN full_line AS b ON a.k = b.k AND b.n >= 8 WHERE (a.doc_id, a.i) > (b.doc_id, b.i)
  UNION SELECT b.doc_id, b.i FROM part AS a JOIN full_line AS b ON a.k = b.k AND b.n >= 8 WHERE (b.doc_id, b.i) > (a.doc_id, a.i)
), text_of AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM l ANTI JOIN pairs USING (doc_id, i) GROUP BY doc_id
), total AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT total.doc_id, cast(total.n AS BIGINT) AS n_lines, cast(total.n - coalesce(text_of.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM total LEFT JOIN text_of USING (doc_id)
""",
    "op13_lexical_search": r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
total AS (SELECT count(*) AS docs, cast(sum(n) AS BIGINT) AS terms FROM size),
factor AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM size, total),
weight AS (
  SELECT term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term
), scored AS (
  SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM item_terms JOIN weight USING (term) JOIN tf USING (term) JOIN factor USING (doc_id) GROUP BY ALL
)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
""",
}
