"""millgauge: shop-floor scheduling and machine-health analytics on Spark.

Every public function takes DataFrames and returns DataFrames (or Columns), so
the same code serves streamed tables, stored snapshots and ad-hoc frames.
"""
