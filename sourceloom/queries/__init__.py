"""The query catalogue: Spark plans and, where SQL can state it, their oracle."""
from sourceloom.queries import curation, facts, knowledge, serving, verification  # noqa: F401
from sourceloom.queries.registry import ORACLES, PLANS  # noqa: F401
