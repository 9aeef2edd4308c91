"""One query per operator over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensortwin.llm import bpe, centroids, collocations, decontam, fingerprints, html_text, ngram_join, quality_rules, secrets, suffix_dedup, token_counts, toxicity, warc
from sensortwin.llm.common import stored, table
from sensortwin.session import scratch_path


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by its nearest labelled examples (block-max TF-IDF index)."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: pattern rules and sliding-window entropy."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 100-byte string with an earlier start, removed."""
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash fingerprint of every document, of its edited text, and their likeness."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids and decoded text of every document, as digests (segment tree over pair ranks)."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the documents to flat token files and count each document's tokens by its end ids."""
    folder = scratch_path(spark, "llm-tokens")
    order = token_counts.write_tokens(table(spark, sf_dir, "documents"), folder)
    counts = token_counts.scan(spark, order, folder)
    return order.join(counts, ["file", "n"]).select(F.col("id").alias("doc_id"), "n_tokens")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more
    (parity-sketch join)."""
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, similarity=0.9)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, index the archive and look every URL key up in the index."""
    folder = scratch_path(spark, "llm-warc")
    locations = warc.write_archive(table(spark, sf_dir, "pages"), folder, least=0)
    master = warc.write_index(locations, folder)
    return warc.lookup(spark, folder, master, locations).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, with the item and the word edit distance."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics of every document and the verdict of the base rules and the learned decision list."""
    measured = stored(quality_rules.features(table(spark, sf_dir, "documents")), "quality-measures")
    return quality_rules.verdicts(measured, quality_rules.learn(measured, table(spark, sf_dir, "labels")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by the score of their lowest cut (SETM)."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds from sixteen hashed starts (PCA-rotated filter)."""
    return centroids.digest(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_html_text, op4_suffix_dedup, op5_fingerprints, op6_bpe, op7_token_counts, op8_ngram_join, op9_warc, op10_decontamination,
                                   op11_quality_rules, op12_collocations, op13_centroids)}


_OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sized AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n_shingles FROM sets),
flat AS (SELECT doc_id, n_shingles, unnest(s) AS g FROM sized),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= 90 * (a.n_shingles + b.n_shingles - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = sized.doc_id), doc_id)) AS component_id FROM sized"""

_OP9 = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM payloads),
owners AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS owner FROM digests)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM owners"""


_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size.k AS k, unnest(list_transform(range(1, len(w) - size.k + 2), lambda i: array_to_string(w[i : i + size.k - 1], ' '))) AS phrase
  FROM words JOIN range(1, 6) size(k) ON len(w) >= size.k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 100),
cuts AS (
  SELECT lang, phrase, k, a, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 : k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, t.n, c.cut, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(w[s : s + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))),
held AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY lang, phrase),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS place
  FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < 100 * b.a)
SELECT lang, place AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= 2000"""

_OP13_STEP = """
d{i} AS (
  SELECT v.vec_id, v.x, c.no, list_sum(list_transform(range(1, 65), lambda j: CAST((v.x[j] - c.x[j]) AS HUGEINT) * (v.x[j] - c.x[j]))) AS d
  FROM vectors v JOIN c{i} c ON c.no >= 0),
n{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, no) = 1),"""

_OP13_MOVE = """
s{i} AS (SELECT no, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT no, x, unnest(range(1, 65)) AS j FROM n{i}) GROUP BY no, j),
m{i} AS (SELECT no, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{i} GROUP BY no),
c{next} AS (SELECT c.no, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.no = c.no),"""

_OP13 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY hash) - 1 AS no, x
  FROM (SELECT x, sha256('1:' || vec_id) AS hash FROM vectors ORDER BY hash LIMIT 16)),""" + "".join(
    _OP13_STEP.format(i=i) + (_OP13_MOVE.format(i=i, next=i + 1) if i < 3 else "") for i in range(4)) + """
digests AS (SELECT no, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM c3)
SELECT n3.vec_id, CAST(n3.no AS INTEGER) AS cluster, CAST(n3.d AS BIGINT) AS distance,
  CAST(sum(n3.d) OVER (PARTITION BY n3.no) AS BIGINT) AS cluster_inertia, CAST(sum(n3.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM n3 JOIN digests ON digests.no = n3.no"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the other queries are tested against brute force."""
    return {"op8_ngram_join": _OP8, "op9_warc": _OP9, "op12_collocations": _OP12, "op13_centroids": _OP13}
