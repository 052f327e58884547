"""tidemark — customer-intelligence warehouse on Spark.

Layers (each a plain ``DataFrame -> DataFrame`` function, planned by Catalyst):

* ``sources``    raw-table schemas, CSV loading, the test-data adapter
* ``operators``  staging, intermediate, marts, RFM, churn, reports, data quality
* ``functions``  reusable column expressions (rounding, day arithmetic, rules,
                 exact distributed quantiles)
* ``plans``      the warehouse: which layer is lazy, which is materialized
* ``sinks``      overwrite / upsert / CSV export / model artifacts
* ``streaming``  incremental CSV-drop ingestion with Structured Streaming
"""

__version__ = "0.1.0"
