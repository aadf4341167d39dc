"""The corpus pipeline; its stages are in ``catalume.llm.pipeline``."""

from catalume.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
