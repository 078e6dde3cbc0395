"""bizlens: business-analytics operators as Spark DataFrame functions.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects (or
``Column`` expressions for the scalar helpers in :mod:`bizlens.functions`), so
Catalyst sees one declarative plan per report: filters reach the parquet scan,
unused columns are pruned and aggregation is partial before every shuffle.

Sub-packages
------------
sources     table and CSV readers, sampling, sinks, and the order-mart adapter
functions   column expressions: periods, bands, exact ratios, text cleaning
operators   reusable DataFrame -> DataFrame building blocks (ranking, profiling,
            distributions, features, clustering, classification)
plans       the whole reports (cohorts, shares, leaders, bands, profiles, models)
            and the query catalogue used by ``__spark_entry__``
streaming   incremental (Structured Streaming) maintenance of count reports
"""

from bizlens.session import checkpoint_dir, configure_for_scale, get_spark, reliable

__all__ = ["get_spark", "checkpoint_dir", "configure_for_scale", "reliable"]
