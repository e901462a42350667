"""marketlens: retail order-line analytics expressed as Spark DataFrame jobs.

Layers:
  sources/    table loading, the order-line master (joins), file sources and sinks
  functions/  reusable column expressions (dates, text, quantiles, broadcast guard)
  operators/  the analytics: enrichment, KPIs, drill-downs, customers, sentiment,
              profiling, forecasting, recommendation, retrieval, insights, classifiers
  plans/      the named query catalogue and the SQL oracle text used to check it
"""

__version__ = "0.1.0"
