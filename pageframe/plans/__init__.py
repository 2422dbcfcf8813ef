"""Registered plans: one query per operator with its SQL twin where SQL can say it."""

from pageframe.plans.registry import ORACLES, QUERIES, plan

__all__ = ["ORACLES", "QUERIES", "plan"]
