"""All queries of the engine proper, gathered from the operator modules."""

from __future__ import annotations

from corpusloom.operators.dedupe import DEDUPE
from corpusloom.operators.ledger import LEDGER
from corpusloom.operators.matching import MATCHING
from corpusloom.operators.planning import PLANNING
from corpusloom.operators.merging import MERGING
from corpusloom.operators.registry import REGISTRY
from corpusloom.operators.signals import SIGNALS
from corpusloom.operators.transcript import TRANSCRIPT
from corpusloom.operators.vocabulary import VOCABULARY
from corpusloom.operators.voices import VOICES
from corpusloom.streaming.standing import STREAMING

QUERIES = {}
ORACLE_SQL = {}
for part in (DEDUPE, VOCABULARY, LEDGER, MATCHING, TRANSCRIPT, VOICES, PLANNING, SIGNALS, REGISTRY, MERGING, STREAMING):
    QUERIES |= part.queries
    ORACLE_SQL |= part.sql
