"""Whole searches: matches, one page of hits, totals and facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import criteria as cr
from shelfmark.operators import facets as fc
from shelfmark.operators import paging as pg
from shelfmark.operators import relevance as rv
from shelfmark.plans import side_tables as st
from shelfmark.runtime import cut_lineage
from shelfmark.schema import CatalogSchema


@dataclass(frozen=True)
class SearchResult:
    """``matches`` is every matching row; hits, summary and facets derive from it."""

    matches: DataFrame
    hits: DataFrame
    summary: DataFrame
    facets: DataFrame | None = None


def criteria_search(
    catalog: DataFrame,
    criteria: Mapping[str, Any],
    sort: Sequence[Any] | None = None,
    limit: int = pg.DEFAULT_LIMIT,
    offset: int = 0,
    aggs: Sequence[str] | None = None,
    honor_field_kinds: bool = True,
    schema: CatalogSchema | None = None,
    facet_table: DataFrame | None = None,
    idf: bool = False,
) -> SearchResult:
    """Structured search. Facets come from ``facet_table``, the published side table, if given.

    With ``idf`` equalities score by rarity (and on text by frequency), and unsorted
    hits come best first; without, each clause is one point.
    """
    schema = schema or CatalogSchema.of(catalog)
    cr.validate_criteria(criteria)
    pg.validate_limit(limit)
    matches = cr.with_score(catalog, criteria, schema, honor_field_kinds, idf)
    buckets = None
    if aggs and facet_table is not None:
        stored = facet_table.filter(F.col("facet").isin(list(aggs)))
        buckets = st.facets_of(matches, stored, score="_score")
    elif aggs:
        buckets = fc.facets(matches, list(aggs), score="_score")
    return SearchResult(
        matches,
        pg.hit_projection(pg.page(matches, sort, limit, offset, schema)),
        pg.totals(matches),
        buckets,
    )


def text_search(
    catalog: DataFrame,
    query: str,
    fields: Sequence[str] | None = None,
    limit: int = pg.DEFAULT_LIMIT,
    offset: int = 0,
    highlight: bool = False,
    fuzziness: str | int = "AUTO",
    schema: CatalogSchema | None = None,
    index: rv.TextIndex | None = None,
    id_col: str = "id",
) -> SearchResult:
    """Ranked search. ``index`` is the published side table; without it the catalog is tokenised.

    Scores are made from ids, terms and lengths alone; whole rows are fetched for
    the one page that is shown. The occurrences found are written down once, since
    frequencies, scores, totals and highlights all start from them.
    """
    tx.normalise_query(query)
    pg.validate_limit(limit)
    schema = schema or CatalogSchema.of(catalog)
    index = index or rv.TextIndex.of(catalog, fields, schema, id_col)
    if fuzziness in (0, "0", None):
        expansion = rv.exact_terms(catalog.sparkSession, index, query)
    else:
        expansion = rv.expand(index, query, fuzziness)
    matched = cut_lineage(rv.matched_terms(index, expansion))
    matches = rv.best_fields(rv.bm25(matched, expansion, index.stats))
    top = pg.page(matches, limit=limit, offset=offset)
    # a page holds at most 100 ids: as literals they reach the scan, which skips files of other ids
    page = top.collect()
    shown = catalog.sparkSession.createDataFrame(page, top.schema).withColumnRenamed("id", "_hit")
    rows = catalog.filter(F.col(id_col).isin([r["id"] for r in page]))
    hits = rows.join(F.broadcast(shown), rows[id_col] == F.col("_hit")).drop("_hit")
    if highlight:
        hits = rv.highlight(hits, matched, schema, [name for name, _ in index.fields], id_col)
    ordered = hits.orderBy(F.col("_score").desc(), F.col(id_col).asc())
    return SearchResult(matches, pg.hit_projection(ordered, id_col=id_col), pg.totals(matches))
