"""Emberline: fire-hotspot analytics written for Apache Spark.

Sub-packages
------------
functions   Column -> Column building blocks (text, numbers, time, geometry)
operators   DataFrame -> DataFrame operators (spatial joins, roll-ups, reports)
sources     readers, writers, typed dimension load, compaction
plans       the jobs users run (dimensions, enrichment, fact, SQL surface)
streaming   Structured Streaming forms of the same plans
"""

__version__ = "0.1.0"
