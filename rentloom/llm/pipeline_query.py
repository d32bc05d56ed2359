"""The pipeline at the top of the repository as a query."""

from __future__ import annotations

import corpus_pipeline

QUERIES = {"pipeline": lambda spark, sf_dir: corpus_pipeline.run(spark, sf_dir).drop("ids")}
ORACLE = {"pipeline": corpus_pipeline.ORACLE_SQL}
