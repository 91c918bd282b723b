"""linkstream: Spark-native analytics for short-link traffic.

Everything is expressed with the DataFrame / SQL / Structured Streaming
API; Catalyst picks the physical plan.  Sub-packages:

* ``sources``   – table loaders, stand-in fixtures, stream sources, sinks
* ``functions`` – Column -> Column helpers (time, text, short-code maths)
* ``operators`` – DataFrame -> DataFrame operators (rollup, joins, ...)
* ``plans``     – shared plan building blocks (bounded broadcast,
                  skew-safe ordered scans) and the query registry
* ``streaming`` – Structured Streaming jobs (ingest, alerts, feeds)
"""

from linkstream.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
