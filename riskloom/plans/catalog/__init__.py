"""The registered queries, each with its SQL twin where one exists."""

from riskloom.plans.catalog import (behavior, casework, clusters, contracts, evaluation, features,  # noqa: F401
                                    rules, scores, sources, texts)
from riskloom.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
