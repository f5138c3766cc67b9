"""Criteria search, paging, facets, lookup and schema queries over the derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import criteria as cr
from shelfmark.operators import facets as fc
from shelfmark.operators import lookup as lk
from shelfmark.operators import paging as pg
from shelfmark.plans.search import criteria_search
from shelfmark.sources.star import CATALOG_SQL, catalog, table
from shelfmark.suite import query

CATALOG = f"WITH catalog AS ({CATALOG_SQL})"
HIT = "id, record_id, search_name, price"


def hit(df, *extra):
    return df.select(
        "id",
        F.col("RecordId").alias("record_id"),
        F.col("SearchName").alias("search_name"),
        F.col("Price").alias("price"),
        *extra,
    )


@query(f"{CATALOG} SELECT {HIT} FROM catalog WHERE locale = 'de-DE' AND search_name = 'Red Widget'")
def criteria_term(spark, sf):
    """Equality on a keyword and on the exact view of a text field."""
    df = catalog(spark, sf, categories=False)
    return hit(cr.criteria_filter(df, {"Locale": "de-DE", "SearchName.keyword": "Red Widget"}))


@query(f"""{CATALOG} SELECT {HIT} FROM catalog
WHERE list_contains(string_split(lower(search_name), ' '), 'widget') AND list_contains(categories, 3)""")
def criteria_term_multivalued(spark, sf):
    """Equality with one token of a text, and with one element of an array."""
    return hit(cr.criteria_filter(catalog(spark, sf), {"SearchName": "widget", "CategoryIds": 3}))


@query(f"""{CATALOG} SELECT {HIT} FROM catalog
WHERE (list_contains(categories, 1) OR list_contains(categories, 5)) AND channel_id IN (0, 2, 4)
  AND item_id IN ('90011', '90012', '90013', '90110')""")
def criteria_terms(spark, sf):
    """Membership on an array, a nested number and a keyword."""
    wanted = {
        "CategoryIds": [1, "5", "05"],
        "RetailContext.ChannelId": [0, 2, 4],
        "ItemId": ["90011", "90012", "90013", "90110"],
    }
    return hit(cr.criteria_filter(catalog(spark, sf), wanted))


@query(f"{CATALOG} SELECT {HIT} FROM catalog WHERE price >= 950 AND price < 975.5 AND record_id > 100")
def criteria_range(spark, sf):
    """Bounds reach the scan as pushed filters."""
    wanted = {"Price": {"range": {"gte": 950, "lt": 975.5}}, "RecordId": {"range": {"gt": 100}}}
    return hit(cr.criteria_filter(catalog(spark, sf, categories=False), wanted))


@query(rf"""{CATALOG} SELECT {HIT} FROM catalog
WHERE search_name LIKE '%d Wi_get' AND EXISTS (
  SELECT 1 FROM (SELECT unnest(string_split(lower(search_name), ' ')) AS w) WHERE w LIKE 'wi%')""")
def criteria_wildcard(spark, sf):
    """Wildcards on the exact view and on the tokens of a text."""
    df = catalog(spark, sf, categories=False)
    return hit(cr.criteria_filter(df, {"SearchName.keyword": "*d Wi?get", "SearchName": "wi*"}))


@query(f"""{CATALOG} SELECT id, record_id, search_name FROM catalog
WHERE price IS NULL AND record_id % 5 = 0""")
def criteria_missing(spark, sf):
    """No value: a null number and an absent map entry."""
    wanted = {"Price": None, "DefaultProductProperties.Brand.KeyName": None}
    return hit(cr.criteria_filter(catalog(spark, sf, categories=False), wanted)).drop("price")


@query(f"{CATALOG} SELECT {HIT} FROM catalog WHERE lower(locale) = 'de-de' AND lower(search_name) = 'red gear'")
def criteria_case_insensitive(spark, sf):
    wanted = {
        "Locale": {"value": "DE-de", "case_insensitive": True},
        "SearchName.keyword": {"value": "RED GEAR", "case_insensitive": True},
    }
    return hit(cr.criteria_filter(catalog(spark, sf, categories=False), wanted))


@query(f"""{CATALOG} SELECT {HIT}, CAST(3.0 AS DOUBLE) AS score FROM catalog
WHERE list_contains(categories, 2) AND price BETWEEN 920 AND 990 AND search_name LIKE 'S%' AND record_id % 5 = 0""")
def criteria_all(spark, sf):
    """Conjunction; three clauses score, the missing-value clause does not."""
    wanted = {
        "CategoryIds": 2,
        "Price": {"range": {"gte": 920, "lte": 990}},
        "SearchName.keyword": "S*",
        "DefaultProductProperties.Brand.KeyName": None,
    }
    return hit(cr.with_score(catalog(spark, sf), wanted), F.col("_score").alias("score"))


@query(f"""{CATALOG}, n AS (SELECT count(*) AS n, count(*) FILTER (locale = 'de-DE') AS a,
    count(*) FILTER (search_name = 'Old Gear') AS b FROM catalog)
SELECT {HIT}, round(1.0 + ln(1 + (n - a + 0.5) / (a + 0.5)) + ln(1 + (n - b + 0.5) / (b + 0.5)), 6) AS score
FROM catalog, n WHERE locale = 'de-DE' AND search_name = 'Old Gear' AND record_id >= 10""")
def criteria_idf_score(spark, sf):
    """Keyword equality weighed by the rarity of its value."""
    wanted = {
        "Locale": "de-DE",
        "SearchName.keyword": "Old Gear",
        "RecordId": {"range": {"gte": 10}},
    }
    df = cr.with_score(catalog(spark, sf, categories=False), wanted, idf=True)
    return hit(df, F.round("_score", 6).alias("score"))


@query(f"""{CATALOG}, x AS (SELECT *, list_filter(string_split_regex(lower(search_name), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS tokens FROM catalog),
n AS (SELECT count(*) FILTER (search_name IS NOT NULL) AS n, count(*) FILTER (list_contains(tokens, 'gear')) AS d,
  count(*) FILTER (locale = 'de-DE') AS a, count(locale) AS m, avg(len(tokens)) FILTER (search_name IS NOT NULL) AS mean FROM x)
SELECT {HIT}, round(ln(1 + (m - a + 0.5) / (a + 0.5)) + ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2
  / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / mean)), 6) AS score
FROM (SELECT *, len(list_filter(tokens, lambda t: t = 'gear')) AS tf FROM x), n WHERE tf > 0 AND locale = 'de-DE'""")
def criteria_text_score(spark, sf):
    """Equality on text scores by rarity, frequency and length; asked for through the whole search."""
    df = catalog(spark, sf, categories=False)
    found = criteria_search(df, {"SearchName": "gear", "Locale": "de-DE"}, idf=True)
    return hit(found.matches, F.round("_score", 6).alias("score"))


@query(f"""{CATALOG} SELECT 'equal' AS form, CAST(count(*) FILTER (false) AS BIGINT) AS hits FROM catalog
UNION ALL SELECT 'missing', count(*) FROM catalog
UNION ALL SELECT 'plain', count(*) FILTER (is_active) FROM catalog""")
def criteria_disabled_field(spark, sf):
    """A disabled field matches nothing and is always missing, unless kinds are set aside."""
    df = catalog(spark, sf, categories=False)
    active = {"Rules.IsActiveInSalesProcess": True}
    forms = {
        "equal": cr.criteria_filter(df, active),
        "missing": cr.criteria_filter(df, {"Rules.IsActiveInSalesProcess": None}),
        "plain": cr.criteria_filter(df, active, honor_field_kinds=False),
    }
    out = None
    for name, rows in forms.items():
        one = rows.agg(F.count(F.lit(1)).alias("hits")).select(F.lit(name).alias("form"), "hits")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{CATALOG} SELECT id, record_id FROM catalog WHERE EXISTS (
  SELECT 1 FROM (SELECT unnest(categories) AS c) WHERE CAST(c AS VARCHAR) > '4' AND CAST(c AS VARCHAR) <= '6')
  AND item_id >= '905'""")
def criteria_keyword_range(spark, sf):
    """A keyword compares as text; one element of the array must lie within both bounds."""
    wanted = {"CategoryIds": {"range": {"gt": 4, "lte": 6}}, "ItemId": {"range": {"gte": "905"}}}
    return hit(cr.criteria_filter(catalog(spark, sf), wanted)).select("id", "record_id")


@query(f"""{CATALOG} SELECT id, record_id, p_brand AS brand, p_size AS size FROM catalog
WHERE channel_id = 1 AND record_id % 5 <> 0 AND p_brand = 'Brand#12' AND p_size >= 10 AND record_id % 7 <> 0""")
def criteria_nested_path(spark, sf):
    """Struct leaf, map entry leaf, and the leaves projected for a hit."""
    wanted = {
        "RetailContext.ChannelId": 1,
        "DefaultProductProperties.Brand.Translation": "Brand#12",
        "DefaultProductProperties.Size.Distance": {"range": {"gte": 10}},
    }
    df = cr.criteria_filter(catalog(spark, sf, categories=False), wanted)
    return df.select(
        "id",
        F.col("RecordId").alias("record_id"),
        F.col("DefaultProductProperties")["Brand"]["Translation"].alias("brand"),
        F.col("DefaultProductProperties")["Size"]["Distance"].alias("size"),
    )


@query(f"""{CATALOG} SELECT id, record_id FROM catalog
WHERE record_id % 5 <> 0 AND (p_brand || '/' || p_type = 'Brand#3/PROMO')""")
def criteria_any_entry(spark, sf):
    """A leaf named without its entry matches any entry, as in the list form."""
    wanted = {
        "DefaultProductProperties.KeyName": "Brand#3/PROMO",
        "DefaultProductProperties.Brand.KeyName": "Brand",
    }
    return hit(cr.criteria_filter(catalog(spark, sf, categories=False), wanted)).select("id", "record_id")


@query(f"{CATALOG} SELECT {HIT} FROM catalog WHERE price > base_price * 0.9 AND is_master")
def criteria_predicate(spark, sf):
    """A caller's own predicate."""
    df = catalog(spark, sf, categories=False)
    return hit(cr.caller_filter(df, lambda d: (d["Price"] > d["BasePrice"] * 0.9) & d["IsMasterProduct"]))


@query(f"""{CATALOG} SELECT {HIT}, CAST(NULL AS DOUBLE) AS score FROM catalog
WHERE list_contains(categories, 1) OR list_contains(categories, 3)
ORDER BY search_name DESC NULLS LAST, price ASC NULLS LAST, id LIMIT 15 OFFSET 5""")
def page_sorted(spark, sf):
    found = criteria_search(
        catalog(spark, sf),
        {"CategoryIds": [1, 3]},
        sort=[{"field": "SearchName.keyword", "order": "desc"}, {"field": "Price", "order": "asc"}],
        limit=15,
        offset=5,
    )
    return hit(found.hits, F.col("_score").alias("score"))


@query(f"""{CATALOG} (SELECT 'asc' AS direction, id, record_id, list_min(categories) AS edge FROM catalog
  ORDER BY list_min(categories) ASC NULLS LAST, price ASC NULLS LAST, id LIMIT 100)
UNION ALL (SELECT 'desc', id, record_id, list_max(categories) FROM catalog
  ORDER BY list_max(categories) DESC NULLS LAST, price DESC NULLS LAST, id LIMIT 100)""")
def page_missing_last(spark, sf):
    """Missing values come last both ways; an array sorts by its edge."""
    df = catalog(spark, sf)
    out = None
    for way, edge in (("asc", F.array_min("CategoryIds")), ("desc", F.array_max("CategoryIds"))):
        rows = pg.page(df, [("CategoryIds", way), ("Price", way)], limit=100).select(
            F.lit(way).alias("direction"), "id", F.col("RecordId").alias("record_id"), edge.alias("edge")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 5")
def first_n(spark, sf):
    errors = table(spark, sf, "events").filter("event_type = 'error'").select("event_id", "ts", "user_id")
    return pg.first_n(errors, 5, "ts", "event_id")


FACET_ROWS = """facet_rows AS (
  SELECT id, 'Brand' AS facet, 'Brand' AS key_name, p_brand AS translation, 'Brand name' AS friendly FROM hits WHERE record_id % 5 <> 0
  UNION ALL SELECT id, 'Type', 'Type', upper(p_type[1]) || lower(p_type[2:]), 'Product type' FROM hits
  UNION ALL SELECT id, 'Size', 'Size', CAST(p_size AS VARCHAR), 'Size' FROM hits WHERE record_id % 7 <> 0
  UNION ALL SELECT id, 'Maker', p_brand || '/' || p_type, p_brand, 'Made as ' || p_type FROM hits)"""


def top_buckets(by):
    return f"""SELECT facet, CAST(rank AS BIGINT) AS rank, key, hits FROM (
  SELECT *, row_number() OVER (PARTITION BY facet ORDER BY hits DESC, key) AS rank FROM (
    SELECT facet, {by} AS key, count(*) AS hits FROM facet_rows WHERE {by} IS NOT NULL GROUP BY ALL))
WHERE rank <= 50"""


@query(f"{CATALOG}, hits AS (SELECT * FROM catalog WHERE price >= 910), {FACET_ROWS} {top_buckets('key_name')}")
def facets(spark, sf):
    """Top buckets per facet over all matches."""
    found = criteria_search(
        catalog(spark, sf, categories=False),
        {"Price": {"range": {"gte": 910}}},
        aggs=["Brand", "Type", "Size", "Maker"],
    )
    return found.facets.select(
        "facet", F.col("rank").cast("bigint").alias("rank"), "key", F.col("count").alias("hits")
    )


@query(f"{CATALOG}, hits AS (SELECT * FROM catalog), {FACET_ROWS} {top_buckets('translation')}")
def facet_values(spark, sf):
    """Facets by shown value instead of key, from the long side table."""
    rows = fc.facet_rows(catalog(spark, sf, categories=False))
    return fc.count_facets(rows, by="Translation").select(
        "facet", F.col("rank").cast("bigint").alias("rank"), "key", F.col("count").alias("hits")
    )


@query(f"""{CATALOG}, hits AS (SELECT * FROM catalog WHERE locale = 'en-US'), {FACET_ROWS}
SELECT facet, key_name AS key, min(id) AS id, arg_min(translation, id) AS translation,
       arg_min(friendly, id) AS friendly
FROM facet_rows WHERE facet IN ('Brand', 'Maker') GROUP BY facet, key_name
QUALIFY row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, key_name) <= 50""")
def facet_top_hit(spark, sf):
    """The representative hit of each bucket."""
    found = criteria_search(
        catalog(spark, sf, categories=False), {"Locale": "en-US"}, aggs=["Brand", "Maker"]
    )
    return found.facets.select(
        "facet",
        "key",
        "top.id",
        F.col("top.Translation").alias("translation"),
        F.col("top.FriendlyName").alias("friendly"),
    )


@query("""SELECT count(*) AS total, least(count(*), 10000) AS total_capped, CAST(1.0 AS DOUBLE) AS max_score
FROM orders WHERE o_totalprice >= 1000""")
def totals(spark, sf):
    """Exact total, capped total and best score."""
    df = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    found = criteria_search(df, {"o_totalprice": {"range": {"gte": 1000}}})
    return found.summary


@query(f"""{CATALOG} SELECT category, count(*) AS products FROM (SELECT unnest(categories) AS category FROM catalog)
GROUP BY category""")
def category_counts(spark, sf):
    return fc.category_counts(catalog(spark, sf))


KEYS_SQL = """keys AS (
  SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'P' || l_partkey WHEN 1 THEN CAST(l_partkey AS VARCHAR)
    WHEN 2 THEN l_partkey || '.0' ELSE 'x' || l_partkey END AS key FROM lineitem)"""


@query(f"""{CATALOG}, {KEYS_SQL}, m AS (
  SELECT key, 0 AS pass, id, record_id FROM keys JOIN catalog ON id = key
  UNION ALL SELECT key, 1, id, record_id FROM keys JOIN catalog
    ON record_id = CASE WHEN floor(TRY_CAST(key AS DOUBLE)) = TRY_CAST(key AS DOUBLE) THEN CAST(TRY_CAST(key AS DOUBLE) AS BIGINT) END)
SELECT key, id, record_id FROM keys LEFT JOIN (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY pass, id) = 1) USING (key)""")
def lookup(spark, sf):
    """Many keys at once: by id, else by record number."""
    n, part = F.col("l_linenumber") % 4, F.col("l_partkey").cast("string")
    keys = table(spark, sf, "lineitem").select(
        F.when(n == 0, F.concat(F.lit("P"), part))
        .when(n == 1, part)
        .when(n == 2, F.concat(part, F.lit(".0")))
        .otherwise(F.concat(F.lit("x"), part))
        .alias("key")
    )
    found = lk.lookup(catalog(spark, sf, categories=False).select("id", "RecordId"), keys)
    return found.select("key", "product.id", F.col("product.RecordId").alias("record_id"))
