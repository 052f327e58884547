"""DuckDB oracle: an independent SQL formulation of every registered query.

The driver registers the input parquet tables as views; each oracle query is
one ``WITH`` chain: the raw-table adapter (FIXTURES.md §3, DuckDB dialect),
the warehouse layers as CTEs, then the report.
"""

from . import evaluation  # noqa: F401  (adds its queries)
from .sql import oracle_queries  # noqa: F401
