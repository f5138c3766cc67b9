"""Text search queries over the documents table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from shelfmark.operators import relevance as rv
from shelfmark.plans.search import text_search
from shelfmark.plans.side_tables import read_text_index, write_text_index
from shelfmark.runtime import spread, work_path
from shelfmark.schema import CatalogSchema
from shelfmark.sources.star import table
from shelfmark.suite import query

TOKENS = r"""WITH tok AS (
  SELECT doc_id AS id, 'text' AS field, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS terms FROM documents
  UNION ALL
  SELECT doc_id, 'source', list_filter(string_split_regex(lower(source), '[^\p{L}\p{N}]+'), lambda t: t <> '') FROM documents),
occ AS (SELECT id, field, len(terms) AS length, unnest(terms) AS term FROM tok WHERE len(terms) > 0),
stats AS (SELECT field, count(*) AS docs, avg(len(terms)) AS mean_length FROM tok WHERE len(terms) > 0 GROUP BY field),
tf AS (SELECT id, field, length, term, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL)"""

ONE_FIELD = re.sub(r"UNION ALL\s+SELECT doc_id, 'source'.*?FROM documents\)", ")", TOKENS, flags=re.S)

SCORED = """, scored AS (
  SELECT id, field, sum(weight * boost * ln(1 + (docs - df + 0.5) / (df + 0.5))
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM tf JOIN asked USING (term) JOIN df USING (field, term) JOIN stats USING (field) GROUP BY ALL),
best AS (SELECT id, max(score) AS score FROM scored GROUP BY id)"""


def asked(*terms):
    rows = ", ".join(f"('{t}', 1, CAST(1.0 AS DOUBLE))" for t in terms)
    return f", asked AS (SELECT * FROM (VALUES {rows}) v(term, weight, boost))"


FUZZY = """, words AS (SELECT * FROM (VALUES ('thinat', 2), ('reon', 1), ('of', 0)) v(word, k)),
asked AS (SELECT term, 1 AS weight, 1.0 - d / least(length(word), length(term)) AS boost, d, word FROM (
  SELECT term, word, k, CAST(damerau_levenshtein(regexp_replace(term, '[^a-z0-9]', 'X', 'g'), word) AS DOUBLE) AS d
  FROM (SELECT DISTINCT term FROM tf) JOIN words
    ON abs(length(term) - length(word)) <= k) WHERE d <= k)"""


def documents(spark, sf):
    return spread(table(spark, sf, "documents")).withColumnRenamed("doc_id", "id")


def index(spark, sf):
    return rv.TextIndex.of(documents(spark, sf), ["text", "source"])


@query(f"{TOKENS} SELECT field, term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM tf GROUP BY ALL")
def tokens(spark, sf):
    """The whole vocabulary of both fields."""
    return rv.vocabulary(index(spark, sf))


@query(f"{TOKENS} {asked('the', 'nation', 'inoran')} {SCORED} SELECT id, field, round(score, 6) AS score FROM scored")
def bm25(spark, sf):
    """Score of each document and field, any term of the query."""
    ix = index(spark, sf)
    terms = rv.exact_terms(spark, ix, "The nation, inoran!")
    scores = rv.bm25(rv.matched_terms(ix, terms), terms, ix.stats)
    return scores.select("id", "field", F.round("score", 6).alias("score"))


@query(f"""{TOKENS} {asked('src7', 'hehely', 'the')} {SCORED}
SELECT d.doc_id AS id, d.lang, round(score, 6) AS score, (SELECT count(*) FROM best) AS total,
  (SELECT round(max(score), 6) FROM best) AS max_score
FROM best JOIN documents d ON d.doc_id = best.id ORDER BY round(best.score, 9) DESC, d.doc_id LIMIT 20 OFFSET 10""")
def best_fields(spark, sf):
    """A page of the ranked search over two fields, with total and best score."""
    found = text_search(
        documents(spark, sf), "src7 hehely the", ["text", "source"], limit=20, offset=10, fuzziness=0
    )
    summary = found.summary.select(F.struct("total", "max_score")).scalar()
    return found.hits.select(
        "id",
        "lang",
        F.round("_score", 6).alias("score"),
        summary["total"].alias("total"),
        F.round(summary["max_score"], 6).alias("max_score"),
    )


@query(f"{TOKENS} {FUZZY} SELECT word AS asked, term, CAST(d AS INTEGER) AS edits FROM asked")
def fuzzy_terms(spark, sf):
    """Vocabulary within the allowed edits, a swap counting once."""
    ix = rv.TextIndex.of(documents(spark, sf), ["text"])
    found = rv.near_terms(ix, "thinat reon of")
    return found.select("asked", "term", "edits")


@query(f"{ONE_FIELD}{FUZZY}{SCORED} SELECT id, round(score, 6) AS score FROM best")
def fuzzy(spark, sf):
    """Ranked search with fuzzy terms; every matching document."""
    found = text_search(documents(spark, sf).select("id", "text"), "thinat reon of", ["text"])
    return found.matches.select("id", F.round("_score", 6).alias("score"))


@query(rf"""{TOKENS} {asked('src7', 'hehely', 'that')} {SCORED}, pg AS (
  SELECT d.doc_id AS id, d.text, d.source FROM best JOIN documents d ON d.doc_id = best.id
  ORDER BY round(best.score, 9) DESC, d.doc_id LIMIT 20),
m AS (SELECT id, list_contains(list(field), 'text') AS t, list_contains(list(field), 'source') AS s
  FROM scored WHERE id IN (SELECT id FROM pg) GROUP BY id),
w AS (SELECT id, source, t, s, regexp_replace(text, '(?i)(^|[^\p{{L}}\p{{N}}])(src7|hehely|that)($|[^\p{{L}}\p{{N}}])', '\1ꙮ\2ꙮ\3', 'g') AS one
  FROM pg JOIN m USING (id))
SELECT id, CASE WHEN t THEN regexp_replace(regexp_replace(one, '(?i)(^|[^\p{{L}}\p{{N}}])(src7|hehely|that)($|[^\p{{L}}\p{{N}}])', '\1ꙮ\2ꙮ\3', 'g'),
    'ꙮ([^ꙮ]*)ꙮ', '<em>\1</em>', 'g') END AS text, CASE WHEN s THEN '<em>' || source || '</em>' END AS source FROM w""")
def highlight(spark, sf):
    """Marked fields of one page."""
    found = text_search(
        documents(spark, sf), "src7 hehely that", ["text", "source"], highlight=True, fuzziness=0
    )
    shown = F.col("_highlight")
    return found.hits.select("id", shown["text"].alias("text"), shown["source"].alias("source"))


@query(f"""{TOKENS} {asked('orantion', 'src3', 'and')} {SCORED} SELECT id, round(score, 6) AS score FROM best""")
def indexed_search(spark, sf):
    """The same ranking from the term-sorted side table written at publish time."""
    df = documents(spark, sf)
    path = work_path(spark, "text-index")
    write_text_index(df, path, ["text", "source"])
    stored = read_text_index(spark, path, CatalogSchema.of(df), ["text", "source"])
    found = text_search(df, "orantion src3 and", index=stored, fuzziness=0)
    return found.matches.select("id", F.round("_score", 6).alias("score"))


@query(rf"""WITH d AS (SELECT doc_id AS id, text FROM documents), x AS (SELECT id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS terms FROM d)
SELECT id, list_contains(terms, 'nation') AS found FROM x WHERE list_contains(terms, 'nation') OR id % 50 = 7""")
def search_all_fields(spark, sf):
    """A search without a field list covers undeclared text as well."""
    docs = documents(spark, sf)
    deep = F.parse_json(F.to_json(F.struct(F.array(F.struct("text")).alias("Parts"))))
    special = F.col("id") % 50 == 7
    text = F.when(special, F.concat(F.lit("crimson "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    docs = docs.withColumn("text", text).select("id", deep.alias("_extra"))
    found = text_search(docs, "crimson nation", fuzziness=0).matches.select("id")
    words = F.split(F.lower(F.try_variant_get("_extra", "$.Parts[0].text", "string")), r"[^\p{L}\p{N}]+")
    return found.join(docs, "id").select("id", F.array_contains(words, "nation").alias("found"))


@query(f"{TOKENS}{FUZZY}{SCORED} SELECT id, round(score, 6) AS score FROM best")
def indexed_fuzzy(spark, sf):
    """Fuzzy ranking from the stored index, its terms found by what deletions leave of them."""
    df = documents(spark, sf)
    path = work_path(spark, "fuzzy-index")
    write_text_index(df, path, ["text", "source"])
    stored = read_text_index(spark, path, CatalogSchema.of(df), ["text", "source"])
    found = text_search(df, "thinat reon of", index=stored)
    return found.matches.select("id", F.round("_score", 6).alias("score"))
