"""All registered queries."""

from . import capacity, evidence_queries, log_queries, payouts, remaining_queries, rule_queries, stream_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "capacity", "evidence_queries", "log_queries", "payouts", "remaining_queries", "rule_queries", "stream_queries"]
