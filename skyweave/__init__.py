"""skyweave: view-graph and multi-view reconstruction analytics as PySpark plans."""

__version__ = "0.1.0"
