"""A training-corpus pipeline over `documents`: quality rules, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from siltstone.llm import pipeline

STAGES = pipeline.STAGES
#: SQL can't express suffix-array removal, alignment or packing; the pipeline is tested against brute force.
ORACLE_SQL = None
run = pipeline.run
