"""tabulara: a PySpark-native engine for auditable, hierarchical results data."""

__version__ = "0.1.0"
