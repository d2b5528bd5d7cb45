"""All registered core queries with their SQL."""

from __future__ import annotations

from claimlake.plans import metric_queries as _metrics  # noqa: F401
from claimlake.plans import prepare, registry
from claimlake.plans import distill_queries as _distill  # noqa: F401 - registers its queries
from claimlake.plans import eval_queries as _eval  # noqa: F401 - registers its queries
from claimlake.plans import io_queries as _io  # noqa: F401 - registers its queries
from claimlake.plans import kg_queries as _kg  # noqa: F401 - registers its queries
from claimlake.plans import pipeline_queries as _pipelines  # noqa: F401 - registers its queries
from claimlake.plans import retrieval_queries as _retrieval  # noqa: F401 - registers its queries
from claimlake.plans import text_queries as _text  # noqa: F401

QUERIES: dict = {**registry.QUERIES, **prepare.QUERIES}
SQL: dict = {**registry.SQL, **prepare.SQL}
