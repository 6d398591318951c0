"""Queries over the driver's tables, by subject; importing this registers all of them."""

from . import catalog_queries, service_queries, store_queries, text_queries  # noqa: F401
from .catalog_queries import FLAGSHIP, ORACLE_SQL, QUERIES  # noqa: F401
