"""A PySpark engine for periodicity searches in radio time series."""
