"""Registered queries of the training-data operators, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from platter.llm import exact_dedup, language, licenses, line_dedup, merkle, packing, perplexity, piece_bpe, ranked_search, simhash, token_file, toxicity, weighted_sampling
from platter.llm.common import table
from platter.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = scratch_path(spark, "token-ids"), table(spark, sf_dir, "documents")
    token_file.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_file.token_digests(token_file.read_tokens(spark, path))


@query
def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"), radius=2, shingle=3)


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# Every run of 50 words and more; any line of a longer run of lines is in one of at most 50 lines.
SQL["op6_line_dedup"] = """WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents),
worded AS (
  SELECT doc_id, place, line, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS seq,
    len(regexp_extract_all(line, '[^ \\t-\\r]+')) AS words
  FROM lines WHERE regexp_matches(line, '[^ \\t-\\r]')),
spans AS (
  SELECT a.doc_id, a.seq, b.seq AS last,
    sum(b.words) OVER w AS words, md5(string_agg(b.line, chr(10)) OVER w) AS content
  FROM worded a JOIN worded b ON b.doc_id = a.doc_id AND b.seq BETWEEN a.seq AND a.seq + 49
  WINDOW w AS (PARTITION BY a.doc_id, a.seq ORDER BY b.seq)),
copies AS (
  SELECT doc_id, seq, last, row_number() OVER (PARTITION BY content ORDER BY doc_id, seq) AS n FROM spans WHERE words >= 50),
gone AS (
  SELECT DISTINCT w.doc_id, w.place FROM copies c JOIN worded w ON w.doc_id = c.doc_id AND w.seq BETWEEN c.seq AND c.last
  WHERE c.n > 1),
counted AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.place) AS n_deleted,
    string_agg(CASE WHEN g.place IS NULL THEN l.line END, chr(10) ORDER BY l.place) AS cleaned
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, sha256(coalesce(cleaned, '')) AS text_sha256
FROM documents d LEFT JOIN counted USING (doc_id)"""


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def _canonical_sql(text: str) -> str:
    """The canonical form in DuckDB, from the fixed values of the operator."""
    out = f"lower({text})"
    out = f"regexp_replace({out}, '{licenses.COPYRIGHT_LINE}', '', 'g')"
    out = f"replace({out}, '{licenses.SECURE_LINK}', '{licenses.PLAIN_LINK}')"
    out = f"trim(regexp_replace({out}, '{licenses.NO_LETTER}', ' ', 'g'))"
    for other, usual in licenses.EQUIVALENT:
        out = f"regexp_replace({out}, '\\b{other}\\b', '{usual}', 'g')"
    return out


_KNOWN_ROWS = ", ".join("('{}', '{}', {})".format(i, t.replace("'", "''"), licenses.titled(t)) for i, t in licenses.KNOWN)
SQL["op7_license_scan"] = f"""WITH known AS (
  SELECT min(id) AS license_id, sha256({_canonical_sql('t')}) AS digest, bool_and(titled) AS titled
  FROM (VALUES {_KNOWN_ROWS}) v(id, t, titled) GROUP BY 2),
texts AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(t, chr(10)) AS lines,
    string_split_regex(t, '{licenses.PARAGRAPH_BREAK}') AS paragraphs FROM documents),
worded AS (
  SELECT doc_id, place, part, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS seq
  FROM (SELECT doc_id, generate_subscripts(paragraphs, 1) - 1 AS place, unnest(paragraphs) AS part FROM texts
    WHERE sha256({_canonical_sql('t')}) NOT IN (SELECT digest FROM known))
  WHERE regexp_matches(regexp_replace(lower(part), '{licenses.COPYRIGHT_LINE}', '', 'g'), '[a-z0-9]')),
units AS (
  SELECT doc_id, 'text' AS unit, 0 AS place, t AS part FROM texts
  UNION ALL
  SELECT doc_id, 'line', generate_subscripts(lines, 1) - 1, unnest(lines) FROM texts WHERE len(lines) > 1
  UNION ALL
  SELECT * FROM (SELECT doc_id, 'paragraph', generate_subscripts(paragraphs, 1) - 1, unnest(paragraphs) AS part FROM texts
    WHERE len(paragraphs) > 1) WHERE contains(part, chr(10))
  UNION ALL
  SELECT a.doc_id, 'passage', a.place, string_agg(b.part, chr(10) || chr(10) ORDER BY b.seq)
  FROM worded a CROSS JOIN range(2, {licenses.PASSAGE + 1}) n(n) JOIN worded b ON b.doc_id = a.doc_id AND b.seq BETWEEN a.seq AND a.seq + n - 1
  GROUP BY a.doc_id, a.place, n HAVING count(*) = n),
formed AS (SELECT doc_id, unit, place, {_canonical_sql('part')} AS form FROM units)
SELECT doc_id, unit, CAST(place AS BIGINT) AS place, license_id, digest
FROM formed JOIN known ON digest = sha256(form) WHERE form <> '' AND (unit <> 'passage' OR NOT titled)"""


@query
def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out("doc_id"))
    model = language.learn(docs.filter("NOT held_out"))
    return language.identify(docs.drop("lang"), model).drop("text")


SQL["op9_exact_dedup"] = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def _value_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(*values: str) -> str:
    return f"sha256({' || '.join(map(_value_sql, values))})"


SQL["op11_merkle"] = f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, {_leaf_sql("doc_id", "source", "lang", "n_chars", "text")} AS leaf, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
    {_leaf_sql("doc_id", "source", "lang", "(n_chars + 1)", "text")} AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
crc(i, c) AS (
  SELECT i, i FROM range(256) t(i)),
steps(i, c, k) AS (
  SELECT i, c, 0 FROM crc UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT i, c FROM steps WHERE k = 8),
checksum(doc_id, rest, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 4294967295 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT s.doc_id, s.rest[2:], xor(s.c // 256, t.c) FROM checksum s JOIN crc_table t ON t.i = xor(s.c % 256, ascii(s.rest)) WHERE s.rest <> ''),
chosen AS (SELECT doc_id FROM checksum WHERE rest = '' AND xor(c, 4294967295) % 7 = 0),
nodes(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM nodes WHERE n > 1
  GROUP BY tree, level, pos // 2),
tops(level, pos, h, n) AS (
  SELECT 0, tree - 1, h, count(*) OVER () FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, pos // 2),
folded(row_tree, row_pos, level, pos, h, siblings) AS (
  SELECT tree, pos, 0, pos, CASE WHEN c.doc_id IS NULL THEN leaf ELSE changed END, '' FROM leaves LEFT JOIN chosen c USING (doc_id)
  UNION ALL
  SELECT f.row_tree, f.row_pos, f.level + 1, f.pos // 2, sha256(CASE WHEN f.pos % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END),
    f.siblings || coalesce(s.h, '')
  FROM folded f JOIN nodes o ON o.tree = f.row_tree AND o.level = f.level AND o.pos = f.pos AND o.n > 1
    LEFT JOIN nodes s ON s.tree = f.row_tree AND s.level = f.level AND s.pos = xor(f.pos, 1)),
upper(row_tree, row_pos, level, pos, h, siblings) AS (
  SELECT f.row_tree, f.row_pos, 0, f.row_tree - 1, f.h, f.siblings
  FROM folded f JOIN nodes r ON r.tree = f.row_tree AND r.level = f.level AND r.n = 1
  UNION ALL
  SELECT f.row_tree, f.row_pos, f.level + 1, f.pos // 2, sha256(CASE WHEN f.pos % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END),
    f.siblings || coalesce(s.h, '')
  FROM upper f JOIN tops o ON o.level = f.level AND o.pos = f.pos AND o.n > 1
    LEFT JOIN tops s ON s.level = f.level AND s.pos = xor(f.pos, 1))
SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root, sha256(f.siblings) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN nodes r ON r.tree = l.tree AND r.n = 1 JOIN tops t ON t.n = 1
JOIN upper f ON f.row_tree = l.tree AND f.row_pos = l.pos AND f.level = t.level"""


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", toxicity.held_out("doc_id"))
    model = toxicity.learn(toxicity.labelled_texts(docs.filter("NOT held_out"), table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).drop("text")


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"


SQL["op13_ranked_search"] = f"""WITH split AS (
  SELECT doc_id, row_number() OVER () AS row_id, {_terms_sql("text")} AS terms FROM documents),
counted AS (SELECT * FROM split WHERE len(terms) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM counted),
measured AS (
  SELECT row_id, doc_id, 100 - 50 + (50 * CAST(len(terms) AS BIGINT) * docs) // words AS m FROM counted, total),
postings AS (
  SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM counted) GROUP BY row_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings, total GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, text, term FROM (SELECT item_id, text, unnest({_terms_sql("text")}) AS term FROM benchmark)),
scored AS (
  SELECT q.item_id, q.text, p.row_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted q JOIN weights USING (term) JOIN postings p USING (term) JOIN measured USING (row_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, s.text ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored s JOIN measured USING (row_id) WHERE score > 0) WHERE rank <= 50"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
