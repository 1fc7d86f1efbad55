"""The corpus pipeline: its stages in order, each (name, function of (spark, docs, sf_dir)).

ORACLE_SQL is None: a learned toxicity model has no SQL form. tests/llm holds the stages against brute force.
"""

from __future__ import annotations

from tonearm.llm import stages

STAGES = stages.STAGES
ORACLE_SQL = None
run = stages.run
