"""A corpus pipeline of five stages, each on all that the one before has kept; see instqc.llm.pipeline."""

from instqc.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
