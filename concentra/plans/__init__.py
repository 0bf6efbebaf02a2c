"""Registered queries (one or more per operator of the survey)."""

from . import q_corpus, q_effects, q_maint_stream, q_metric, q_sources, q_tests, q_vocab  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
