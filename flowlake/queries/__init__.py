"""Named queries over the given tables and their SQL."""

from flowlake.queries import features, ingest, labels, scores, traffic, training  # noqa: F401
from flowlake.queries.base import ORACLES, QUERIES  # noqa: F401
