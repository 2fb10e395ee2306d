"""Every registered query: importing this module registers them."""

from assaykit.plans import evaluation, logs, more, operations, reports, streams, texts  # noqa: F401
from assaykit.plans.registry import FLAGSHIP, QUERIES, SQL  # noqa: F401
