"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from shelfmark.llm.url_filter import RULES, SOFT, STRICT

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Classes over links ``l(a, b)`` between the nodes of ``n(id)``.
CLASSES = """reach(id, root) AS (
  SELECT id, id FROM n UNION SELECT p.a, r.root FROM reach r JOIN (SELECT a, b FROM l UNION SELECT b, a FROM l) p ON p.b = r.id),
classes AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

BYTE_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, CAST(2 * s + 1 AS BIGINT), 200)) AS m
  FROM (SELECT doc_id, h, unnest(range(CAST(length(h) // 2 - 99 AS BIGINT))) AS s FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER o + 100 THEN 0 ELSE 1 END AS new FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM marked),
gone AS (SELECT doc_id, min(s) AS b, max(s) + 100 AS e FROM numbered GROUP BY doc_id, island),
pieces AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS kept_from FROM gone),
cut AS (SELECT p.doc_id, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(e - b) AS BIGINT) AS n_removed, max(e) AS tail,
    string_agg(substr(h, CAST(2 * kept_from + 1 AS BIGINT), CAST(2 * (b - kept_from) AS BIGINT)), '' ORDER BY b) AS head
  FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

PHRASES = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, i, list_slice(words, i, i + 12) AS run FROM (SELECT doc_id, words, unnest(range(1, CAST(len(words) - 11 AS BIGINT))) AS i FROM d WHERE len(words) >= 13)),
first AS (SELECT run, min(doc_id) AS least FROM w GROUP BY run),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM w JOIN first USING (run) WHERE least < doc_id),
all_words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM all_words a WHERE NOT EXISTS (FROM gone g WHERE g.doc_id = a.doc_id AND g.i = a.i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

NEAR_DUPS = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(words, i, i + 4) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, CAST(greatest(len(words) - 3, 2) AS BIGINT))) AS i FROM d WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM met JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
n AS (SELECT doc_id AS id FROM documents),
{CLASSES}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM classes LEFT JOIN size ON size.doc_id = id"""

_RULE = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN struct_pack(rule := '{r.name}', verdict := '{r.verdict}')"
    for r in sorted(RULES, key=lambda r: -len(r.name))
)
_HIT = r"CAST(regexp_matches(low, '(^|[^a-z0-9]){}($|[^a-z0-9])') AS INTEGER)"
_STRICT = " + ".join(_HIT.format(t) for t in STRICT)
_SOFT = " + ".join(f"{w} * {_HIT.format(t)}" for t, w in SOFT.items())

URLS = rf"""WITH u AS (SELECT page_id, {LOWER.format("coalesce(url, '')")} AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, low, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {_RULE} END AS found FROM h)
SELECT page_id, host, path, found.rule AS rule,
  coalesce(found.verdict, CASE WHEN {_STRICT} > 0 OR {_SOFT} >= 2 THEN 'block' ELSE 'allow' END) AS verdict FROM r"""

ARCHIVE = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first, sha1(body) AS h FROM p GROUP BY body),
b AS (SELECT body, first, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS digest FROM f)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN b USING (body)"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
n AS (SELECT vec_id AS id FROM embeddings),
{CLASSES},
degree AS (SELECT a AS id, count(*) AS k FROM (SELECT a FROM l UNION ALL SELECT b FROM l) GROUP BY a)
SELECT classes.id AS vec_id, coalesce(k, 0) AS n_links, component_id, classes.id = component_id AS kept FROM classes LEFT JOIN degree ON degree.id = classes.id"""

LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = "unnest(regexp_extract_all(" + LOWER.format("coalesce(text, '')") + f", '{LOWER_WORD}'))"
_H = "CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)"

RESAMPLE = f"""WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
d AS (SELECT doc_id, {_WORDS} AS word FROM documents),
b AS (SELECT {_WORDS} AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM d UNION SELECT word FROM b)),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(CAST(strlen(word) AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
  lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295)) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM d) + 10000 AS s_all, (SELECT count(*) FROM b) + 10000 AS t_all),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * s_all::DOUBLE / ((s + 1)::DOUBLE * t_all::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM d JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_H} + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents LEFT JOIN w USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * fit // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)"""

_TERMS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
size AS (SELECT doc_id, CAST(count(*) AS HUGEINT) AS n FROM d GROUP BY doc_id),
sums AS (SELECT CAST(count(*) AS HUGEINT) AS docs, CAST(sum(n) AS HUGEINT) AS words FROM size),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, sums GROUP BY term),
m AS (SELECT doc_id, CAST(10 + (90 * n * docs) // words AS BIGINT) AS m FROM size, sums),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

ORACLE = {
    "op2_suffix_dedup": BYTE_REPEATS,
    "op3_url_filter": URLS,
    "op4_near_dups": NEAR_DUPS,
    "op6_phrase_dedup": PHRASES,
    "op7_archive": ARCHIVE,
    "op9_near_vectors": VECTORS,
    "op11_importance_resample": RESAMPLE,
    "op12_lexical_search": LEXICAL,
}
