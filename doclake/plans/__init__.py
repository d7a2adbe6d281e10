"""Every registered query; importing this package fills the registry."""

from doclake.plans import detect_queries, html_queries, listing_queries, markdown_queries, media_queries, office_queries, source_queries  # noqa: F401
from doclake.plans.registry import ORACLES, QUERIES  # noqa: F401
