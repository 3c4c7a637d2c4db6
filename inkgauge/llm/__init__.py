"""Training-data operators: deduplication, scans, filters, packing.

Every operator is a DataFrame -> DataFrame function; nothing else in the
library imports this subpackage.
"""
