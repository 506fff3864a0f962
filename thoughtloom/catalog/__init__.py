"""Registered queries over the driver tables and the SQL that checks them."""

from thoughtloom.catalog import (  # noqa: F401
    graph_queries,
    memory_queries,
    quality_queries,
    source_queries,
    text_queries,
)
from thoughtloom.catalog.common import ORACLES, QUERIES  # noqa: F401
