"""inkgauge: Spark-native evaluation of machine transcriptions.

Sub-packages: ``functions`` (Column expressions), ``operators``
(DataFrame operators), ``sources`` / ``sinks`` (readers and writers),
``plans`` (end-to-end plans and the registered query catalog) and
``streaming`` (incremental runs).  See README.md.
"""

__version__ = "0.1.0"
