"""Query catalogue: importing this package registers every query."""

from ordlab.plans import catalog  # noqa: F401
from ordlab.plans import holdout  # noqa: F401
from ordlab.plans import cleaning  # noqa: F401
from ordlab.plans import encoding  # noqa: F401
from ordlab.plans import decoding  # noqa: F401
from ordlab.plans import ensembles  # noqa: F401
from ordlab.plans import selection  # noqa: F401
from ordlab.plans import online  # noqa: F401
from ordlab.plans import files  # noqa: F401
from ordlab.plans import learners  # noqa: F401
from ordlab.plans import boosting  # noqa: F401
from ordlab.plans import closed_forms  # noqa: F401
from ordlab.plans import relational  # noqa: F401

REGISTRY = catalog.REGISTRY


def queries():
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql():
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
