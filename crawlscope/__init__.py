"""Site-audit analytics as Spark jobs over ``site``-keyed tables."""

__version__ = "0.1.0"
