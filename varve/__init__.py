"""varve: a versioned ordered key-value engine expressed as PySpark DataFrames.

A store is a change log of ``(user_key, seq, vtype, value)`` rows kept in
sorted Parquet runs plus a manifest; reads, compaction and recovery are
DataFrame plans over those two tables.
"""

__version__ = "0.1.0"
