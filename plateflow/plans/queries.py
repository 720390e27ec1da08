"""All queries of print data, and their SQL."""

from __future__ import annotations

from . import blend_queries, codec_queries, color_queries, ink_queries, page_queries, raster_queries, structure_queries

MODULES = (ink_queries, color_queries, blend_queries, raster_queries, page_queries, codec_queries, structure_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
