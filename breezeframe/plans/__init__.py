"""All queries of the engine and the SQL that must agree with them."""

from . import briefings, evaluation, evidence, features, feeds, hourly, models, records, repairs, streams, trials
from .hourly import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "briefings", "evaluation", "evidence", "features", "feeds", "hourly", "models", "records", "repairs", "streams", "trials"]
