"""signalmart: entity-signal analytics as composable PySpark operators.

Layers, each a set of pure ``DataFrame -> DataFrame`` functions:

* ``functions``  column expressions (labels, normalisation, composite index);
* ``operators``  reusable table operators (dedupe, series, share of voice, landing);
* ``sources``    readers and writers for the bronze, silver and gold tables;
* ``plans``      the silver and gold tables, the reports and the batch jobs;
* ``streaming``  incremental landing with Structured Streaming.
"""

__version__ = "0.1.0"
