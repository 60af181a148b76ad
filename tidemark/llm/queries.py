"""The registered queries over whole tables: thin contracts over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest
from tidemark.llm.bpe import encode_decode
from tidemark.llm.cap_filters import near_duplicates
from tidemark.llm.collocations import collocations
from tidemark.llm.html_extract import extract_main_text
from tidemark.llm.language_id import fit_text_model, identify_pages
from tidemark.llm.lexical_search import search
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.pii import pseudonymise
from tidemark.llm.quality_rules import quality_verdicts
from tidemark.llm.token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document; the cache starts cold, so every distinct text is encoded."""
    return token_counts(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated chunks removed and what was removed counted."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "chunks", "removed_chunks", "removed_lines")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with the text model fitted on a sample of the labelled documents."""
    return identify_pages(table(spark, sf_dir, "pages"), fit_text_model(table(spark, sf_dir, "documents")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of its personal data. A deployment passes its own secret as the key."""
    out = pseudonymise(table(spark, sf_dir, "documents"), "public demonstration key")
    return out.select("doc_id", "text", "n_entities", "kinds")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two thousand phrases of every language."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and whether it stays."""
    out = quality_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_ngram_join": op4_ngram_join,
    "op5_language_id": op5_language_id,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_html_extraction": op8_html_extraction,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_source_mixing": op10_source_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_quality_rules": op13_quality_rules,
}

OP2_SQL = """
WITH lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
hashed AS (SELECT *, CAST('0x' || md5(line)[1:8] AS BIGINT) AS h, length(line) - length(replace(line, ' ', '')) >= 49 AS long FROM lines),
cuts AS (SELECT *, lead(i) OVER w IS NULL OR long OR lead(long) OVER w OR (coalesce(lag(h) OVER w, 0) * 31 + h) % 3 = 0 AS cut FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM cuts),
chunks AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS lines, count(*) > 1 OR bool_or(long) AS removable FROM numbered GROUP BY 1, 2),
again AS (SELECT chunk, min(doc_id) AS first_id FROM chunks WHERE removable AND trim(chunk, ' ') <> '' GROUP BY 1 HAVING count(*) > 1),
marked AS (SELECT k.*, first_id IS NOT NULL AND (first_id <> doc_id OR row_number() OVER (PARTITION BY doc_id, k.chunk ORDER BY c) > 1) AS gone
  FROM chunks k LEFT JOIN again a ON a.chunk = k.chunk AND k.removable),
done AS (SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY c) FILTER (NOT gone), '') AS t, count(*) AS chunks, count(*) FILTER (gone) AS removed_chunks, coalesce(sum(lines) FILTER (gone), 0) AS removed_lines FROM marked GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN t END AS text, CAST(length(t) AS BIGINT) AS n_chars, CAST(chunks AS INT) AS chunks, CAST(removed_chunks AS INT) AS removed_chunks, CAST(removed_lines AS INT) AS removed_lines
FROM documents d JOIN done USING (doc_id)"""
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.m FROM reach r JOIN links l ON l.a = r.n AND r.m < l.b),
comp AS (SELECT n, min(m) AS m FROM reach GROUP BY 1), degree AS (SELECT a, count(*) AS k FROM links GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings JOIN comp ON n = vec_id LEFT JOIN degree ON a = vec_id"""
OP11_SQL = r"""
WITH terms(k, doc_id, term) AS (SELECT k, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))
  FROM (SELECT row_number() OVER () AS k, * FROM documents)),
docs AS (SELECT k, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY 1), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (SELECT k, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, totals GROUP BY term, docs),
each AS (SELECT k, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)) AS s FROM held JOIN docs USING (k), totals),
met AS (SELECT item_id, k, doc_id, CAST(sum(w * s) AS BIGINT) AS score FROM each JOIN asked USING (term) JOIN weights USING (term) GROUP BY 1, 2, 3),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, k) AS INT) AS rank, doc_id, score FROM met WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""
OP12_SQL = r"""
WITH pieces AS (SELECT lang, k, row_number() OVER () AS p, piece FROM (SELECT coalesce(lang, 'und') AS lang, k, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT row_number() OVER () AS k, * FROM documents))),
words AS (SELECT lang, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 5) r(m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30), sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1),
cuts AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f, range(1, 4) r(k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (l.f + r.f) AS BIGINT) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, f, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT lang, f, n, string_split(phrase, ' ') AS w, unnest(range(1, m - n + 2)) AS i FROM f, range(2, 4) r(n) WHERE n < m)),
longer AS (SELECT lang, phrase, max(f) AS most FROM spans GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best LEFT JOIN longer USING (lang, phrase) JOIN sizes USING (lang) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT * FROM ranked WHERE rank <= 2000"""
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (SELECT k, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(3) r(j) GROUP BY 1),
counts AS (SELECT k, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper FROM d LEFT JOIN covered USING (k)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
rates AS (SELECT k, lang, source, base_failed, unnest(['word', 'symbol', 'dup', 'repeat', 'upper']) AS measure, unnest([500, 50, 200, 100, 50]) AS least, coalesce(unnest([1000 * word_chars // n_words, 1000 * n_symbols // n_words,
  1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words, 1000 * n_upper // word_chars]), 0) AS v FROM m),
bits AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS e FROM rates),
cells AS (SELECT measure, least, lang, source, e * 32 + (v >> e) AS b, count(*) AS n FROM bits WHERE NOT base_failed GROUP BY ALL),
levels AS (SELECT 0 AS level, * FROM cells UNION ALL SELECT 1, measure, least, lang, NULL, b, sum(n) FROM cells GROUP BY ALL UNION ALL SELECT 2, measure, least, NULL, NULL, b, sum(n) FROM cells GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM levels),
quart AS (SELECT level, lang, source, measure, least, max(total) AS n, min(b) FILTER (4 * upto >= total) AS b1, min(b) FILTER (4 * upto >= 3 * total) + 1 AS b3 FROM run GROUP BY ALL),
ends AS (SELECT *, greatest(b1 // 32 - 1, 0) AS e1, greatest(b3 // 32 - 1, 0) AS e3 FROM quart),
q AS (SELECT *, (b1 - e1 * 32) * CAST(pow(2, e1) AS BIGINT) AS q1, (b3 - e3 * 32) * CAST(pow(2, e3) AS BIGINT) - 1 AS q3 FROM ends),
cuts AS (SELECT level, lang, source, measure, n, q1 - 3 * greatest(q3 - q1, least) AS low, q3 + 3 * greatest(q3 - q1, least) AS high FROM q),
near AS (SELECT r.k, r.v, r.measure, CASE WHEN o.n >= 100 THEN o.low WHEN l.n >= 100 THEN l.low ELSE a.low END AS low, CASE WHEN o.n >= 100 THEN o.high WHEN l.n >= 100 THEN l.high ELSE a.high END AS high
  FROM rates r JOIN cuts a ON a.level = 2 AND a.measure = r.measure
  LEFT JOIN cuts o ON o.level = 0 AND o.measure = r.measure AND o.lang IS NOT DISTINCT FROM r.lang AND o.source IS NOT DISTINCT FROM r.source
  LEFT JOIN cuts l ON l.level = 1 AND l.measure = r.measure AND l.lang IS NOT DISTINCT FROM r.lang),
verdict AS (SELECT k, bool_and(v <= high AND (measure <> 'word' OR v >= low)) AS fits FROM near GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND fits AS kept FROM m LEFT JOIN verdict USING (k)"""
#: The others hash with functions that SQL engines do not share, sample, or call a tokenizer.
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op6_embedding_near_dedup": OP6_SQL, "op11_lexical_search": OP11_SQL, "op12_collocations": OP12_SQL, "op13_quality_rules": OP13_SQL}
