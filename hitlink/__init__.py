"""hitlink: record linkage and hit-versus-non-hit analytics as Spark DataFrame plans.

Layout
  functions/  Column expressions (text normalisation, casts, derived columns)
  sources/    readers, writers, schemas, nested-record flattening, HTML tables
  operators/  DataFrame -> DataFrame operators (dedup, linkage, sampling, stats, ranking, ML)
  plans/      test-table fixtures, composite pipelines and the registered query set
  streaming/  incremental (resumable, idempotent) runs on Structured Streaming
"""

from .session import get_session, checkpoint_dir  # noqa: F401
