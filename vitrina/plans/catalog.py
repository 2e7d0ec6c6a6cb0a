"""All registered queries; importing this module fills the registry."""

from vitrina.plans import (  # noqa: F401
    matching_queries,
    model_queries,
    price_queries,
    scalar_queries,
    source_queries,
)
from vitrina.plans.registry import ORACLES, QUERIES  # noqa: F401
