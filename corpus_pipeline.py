"""The training-data pipeline of ``tamis.llm.pipeline``: STAGES, ORACLE_SQL and run(spark, sf_dir)."""

from tamis.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
