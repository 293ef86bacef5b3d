"""PySpark engine for file-synchronisation analytics."""
