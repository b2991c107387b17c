"""Registered queries of the operators, over whole tables with production parameters, and their plain-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.llm.cross_entropy import cross_entropy_difference, marked
from bankspark.llm.decontamination import contaminated
from bankspark.llm.divergence import source_divergence
from bankspark.llm.line_dedup import without_repeated_lines
from bankspark.llm.merkle import leaf, manifest
from bankspark.llm.mixture import mixture
from bankspark.llm.near_duplicates import near_duplicates
from bankspark.llm.secrets import BASE, find_secrets, written
from bankspark.llm.store import new_folder, reach_package
from bankspark.llm.token_counts import token_counts, write_flat
from bankspark.llm.token_files import read_tokens, token_rows, write_tokens
from bankspark.llm.topk import top_k, whole_vectors
from bankspark.llm.toxicity import toxicity
from bankspark.llm.warc import read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of good quality, by the labels, are the target."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy_difference(marked(documents, good, "good"), F.col("good"))


def op2_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return find_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def op5_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op6_seekable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), folder)
    return token_rows(read_tokens(spark, folder))


def op7_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "flat")
    write_flat(_table(spark, sf_dir, "documents"), folder)
    return token_counts(spark, folder, new_folder(spark, "scan")).select("doc_id", "n_tokens")


def op9_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document, and of these in each shard."""
    def words(draws):
        return F.aggregate(draws, F.lit(0).cast("bigint"), lambda total, draw: total + draw["n_words"])

    used = F.array_sort(F.array_distinct(F.transform("draws", lambda draw: draw["shard"])))
    of_shard = F.transform(used, lambda s: F.concat(
        s.cast("string"), F.lit(":"), words(F.filter("draws", lambda draw: draw["shard"] == s)).cast("string")))
    return mixture(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", words("draws").alias("taken"), F.array_join(of_shard, ",").alias("shard_words"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_line_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(documents).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose number has an even checksum are folded without the line feeds of their text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(_table(spark, sf_dir, "documents"), F.when(even, leaf(F.replace("text", F.lit("\n"), F.lit("")))))


def op13_quadtree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_cross_entropy_difference": op1_cross_entropy_difference,
    "op2_pu_toxicity": op2_pu_toxicity,
    "op3_simhash_decontamination": op3_simhash_decontamination,
    "op4_secret_automaton": op4_secret_automaton,
    "op5_nra_topk": op5_nra_topk,
    "op6_seekable_tokens": op6_seekable_tokens,
    "op7_zip_warc": op7_zip_warc,
    "op8_separator_scan": op8_separator_scan,
    "op9_splitting_tree_mix": op9_splitting_tree_mix,
    "op10_lsh_forest": op10_lsh_forest,
    "op11_line_perfect_hash": op11_line_perfect_hash,
    "op12_midstate_manifest": op12_midstate_manifest,
    "op13_quadtree_divergence": op13_quadtree_divergence,
}

ORACLES: dict[str, str] = {
    "op10_lsh_forest": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS node, doc_id AS other FROM sets
            UNION
            SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
        )
        SELECT s.doc_id, any_value(CAST(len(s.s) AS BIGINT)) AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
        FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id
    """,
    "op11_line_perfect_hash": """
        WITH texts AS (
            SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), placed AS (
            SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM texts
        ), keyed AS (
            SELECT row, doc_id, line, place,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM placed
        ), repeated AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10
        ), marked AS (
            SELECT k.*, r.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY row, doc_id
    """,
    "op12_midstate_manifest": """
        WITH RECURSIVE checks AS (
            SELECT doc_id, ~list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                   lambda crc, c: list_reduce(list_prepend(xor(crc, c), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                          lambda x, turn: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) & 1 = 0 AS even
            FROM documents
        ), fields AS (
            SELECT d.doc_id, source, even,
                   coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || CAST(d.doc_id AS VARCHAR), '-')
                   || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS start,
                   coalesce(strlen(text) || ':' || text, '-') AS whole,
                   coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS cut
            FROM documents d JOIN checks c ON d.doc_id = c.doc_id
        ), sources AS (
            SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS part FROM (SELECT DISTINCT source FROM fields)
        ), leaves AS (
            SELECT doc_id, part, sha256(start || whole) AS leaf, CASE WHEN even THEN sha256(start || cut) ELSE sha256(start || whole) END AS now,
                   row_number() OVER (PARTITION BY part ORDER BY doc_id) - 1 AS place
            FROM fields f JOIN sources s ON f.source IS NOT DISTINCT FROM s.source
        ), tree AS (
            SELECT 0 AS level, part, place, leaf AS digest, count(*) OVER (PARTITION BY part) AS total FROM leaves
            UNION ALL
            SELECT level + 1, part, place // 3, sha256(string_agg(digest, '' ORDER BY place)), any_value((total + 2) // 3)
            FROM tree WHERE total > 1 GROUP BY level, part, place // 3
        ), subroots AS (
            SELECT part, digest FROM tree WHERE total = 1
        ), top AS (
            SELECT 0 AS level, part AS place, digest, count(*) OVER () AS total FROM subroots
            UNION ALL
            SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), any_value((total + 2) // 3)
            FROM top WHERE total > 1 GROUP BY level, place // 3
        ), inner_fold AS (
            SELECT doc_id, part, 0 AS level, place, now AS value, '' AS siblings FROM leaves
            UNION ALL
            SELECT f.doc_id, any_value(f.part), any_value(f.level) + 1, any_value(f.place) // 3,
                   sha256(string_agg(CASE WHEN t.place = f.place THEN f.value ELSE t.digest END, '' ORDER BY t.place)),
                   any_value(f.siblings) || coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (WHERE t.place <> f.place), '')
            FROM inner_fold f JOIN tree t ON t.level = f.level AND t.part = f.part AND t.place // 3 = f.place // 3 AND t.total > 1
            GROUP BY f.doc_id
        ), at_subroot AS (
            SELECT * FROM inner_fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1
        ), outer_fold AS (
            SELECT doc_id, 0 AS level, part AS place, value, siblings FROM at_subroot
            UNION ALL
            SELECT f.doc_id, any_value(f.level) + 1, any_value(f.place) // 3,
                   sha256(string_agg(CASE WHEN t.place = f.place THEN f.value ELSE t.digest END, '' ORDER BY t.place)),
                   any_value(f.siblings) || coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (WHERE t.place <> f.place), '')
            FROM outer_fold f JOIN top t ON t.level = f.level AND t.place // 3 = f.place // 3 AND t.total > 1
            GROUP BY f.doc_id
        ), at_root AS (
            SELECT * FROM outer_fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1
        )
        SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(f.siblings) AS proof_sha256,
               f.value AS folded_root, f.value = r.digest AS verified
        FROM leaves l JOIN subroots s ON l.part = s.part JOIN at_root f ON l.doc_id = f.doc_id
        CROSS JOIN (SELECT digest FROM top WHERE total = 1) r
    """,
    "op13_quadtree_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
        ), groups AS (
            SELECT DISTINCT lang, source FROM docs
        ), words AS (
            SELECT row, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM docs)
        ), kept AS (
            SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3
        ), langs AS (
            SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY lang
        ), counts AS (
            SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term
            GROUP BY ALL
        ), totals AS (
            SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n
            FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
        ), prices AS (
            SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (t.n + l.v) AS p,
                   1 + (1000000000 * (k.n + 1)) // (l.n + l.v) AS q
            FROM totals t JOIN langs l ON t.lang = l.lang JOIN kept k ON t.lang = k.lang
            LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
            FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
            UNION ALL
            SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            WHERE a.lang NOT IN (SELECT lang FROM langs)
        ), found AS (
            SELECT * FROM pairs
            UNION ALL
            SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM prices WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op5_nra_topk": """
        WITH vectors AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op7_zip_warc": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), named AS (
            SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
                   max(page_id) OVER (PARTITION BY payload) AS first_page
            FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_page THEN first_page END AS refers_to
        FROM named
    """,
}
