"""All named queries; importing this package registers them."""

from ticketlake.plans import columns, profiling, retrieval, streams, text  # noqa: F401
from ticketlake.plans.registry import ORACLES, QUERIES  # noqa: F401
