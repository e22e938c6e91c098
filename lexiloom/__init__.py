"""lexiloom: a PySpark analytics engine for multilingual content quality."""

__version__ = "0.1.0"
