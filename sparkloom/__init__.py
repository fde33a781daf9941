"""sparkloom: relational, search, time-series, graph and streaming operators for PySpark."""

__version__ = "0.1.0"
