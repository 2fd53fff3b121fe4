"""Every registered query with the SQL it is checked against."""
from .base import REGISTRY, as_queries, as_oracle  # noqa: F401
from . import (sources, expressions, counts, detection, clusters, vectors,  # noqa: F401
               live, reports)
