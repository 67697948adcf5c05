"""All query modules; importing this fills the registry."""

from riskloom.plans import aggregates, credit, joins, live, rowwise, scoring  # noqa: F401
