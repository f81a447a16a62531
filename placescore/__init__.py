"""placescore: compare units (places, customers, any keyed entity) on Spark.

Operators are plain functions ``f(df, ...spec...) -> DataFrame`` that only build
Spark plans.  Subpackages:

* ``functions`` -- Column-expression helpers (clip, guarded division, transforms,
  formatting, text normalisation).
* ``sources``   -- readers and writers for the landed input shapes.
* ``operators`` -- cleaning, filters, joins, geo joins, aggregations, windows,
  imputation, scoring, recommendation, clustering, presentation tables, text.
* ``plans``     -- the driver-table unit panel, registered queries, their SQL
  oracles and the end-to-end pipeline.
* ``streaming`` -- the batch recommendation operator applied to a stream of
  user-preference rows.
"""

from placescore.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
