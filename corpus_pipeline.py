"""The corpus pipeline; its stages are in aquabill.llm.pipeline."""

from aquabill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
