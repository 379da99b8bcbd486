"""Registered queries of the engine's operators. Importing a module here registers its queries."""

from factlake.queries import analytics, bitemporal, episodes, governance, joins, names, recall, retrieval, sources, streams, text  # noqa: F401
