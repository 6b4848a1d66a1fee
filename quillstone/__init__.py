"""A PySpark analytics engine for versioned document corpora."""
