"""All registered queries."""

from . import catalog_assess, catalog_findings, catalog_io, catalog_traffic  # noqa: F401
from .registry import QUERIES, SQL, full_sql  # noqa: F401
