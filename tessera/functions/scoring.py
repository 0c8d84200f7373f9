"""Relevance scores and predicates as SQL expressions over a hit's columns.

Columns: semantic, keyword, core_matches, n_core, phrase, stem, score.  The expressions are plain SQL, so that a plan and
its check can share them.
"""

from __future__ import annotations

#: Weights and limits, fixed values.
SEMANTIC_WEIGHT = 0.45
SEMANTIC_MIN = 0.42
MIN_SCORE = 0.12
RRF_K = 60


def combined(weight: float = SEMANTIC_WEIGHT) -> str:
    """Semantic, keyword and phrase evidence in one score of 0 to 1; which weights apply depends on how many core words match."""
    w = max(0.15, min(0.65, weight))
    ratio = "least(core_matches / CAST(n_core AS DOUBLE), 1.0)"
    boost = "(least(phrase / 80.0, 1.0) * 0.4)"
    words = f"({(1.0 - w) * 0.55} * least(keyword / 18.0, 1.0))"
    near = f"{w} * semantic"
    return (
        f"least(1.0, CASE WHEN {boost} >= 0.35 THEN {boost} + {near} + {words} * 0.35 + {ratio} * 0.12"
        f" WHEN {ratio} >= 1.0 THEN {near} + {words} + {ratio} * 0.22 + {boost}"
        f" WHEN {ratio} >= 0.66 THEN {near} + {words} + {ratio} * 0.35 + {boost}"
        f" WHEN keyword / 18.0 >= 0.2 OR {ratio} >= 0.5 THEN {near} + {words} + {ratio} * 0.25 + {boost}"
        f" ELSE {near} * 1.15 + {words} * 0.5 + {ratio} * 0.15 + {boost} END)"
    )


#: Core words that a hit has to match, by how many there are.
NEED_CORE = "CASE WHEN n_core <= 1 THEN n_core WHEN n_core <= 3 THEN 2 ELSE greatest(2, CAST(floor((n_core * 2 + 2) / 3.0) AS INT)) END"

RELEVANT = (
    f"(semantic >= {SEMANTIC_MIN} OR (semantic >= 0.38 AND score >= {MIN_SCORE} * 0.45) OR stem >= 28 OR phrase >= 20"
    f" OR (n_core > 0 AND core_matches >= n_core AND stem >= 15) OR (core_matches >= {NEED_CORE} AND (score >= {MIN_SCORE} OR keyword >= 4.0))"
    f" OR (n_core >= 2 AND core_matches >= 2 AND keyword >= 3.0) OR (core_matches >= 1 AND keyword >= 6.0)"
    f" OR (n_core = 0 AND (score >= 0.28 OR semantic >= 0.52)) OR (score >= {MIN_SCORE} AND semantic >= 0.42 AND core_matches >= 1))"
)

SEMANTIC_FLOOR = max(0.35, SEMANTIC_MIN * 0.85)
POOLED = (
    f"(core_matches >= {NEED_CORE} OR stem >= 25 OR semantic >= {SEMANTIC_FLOOR}"
    f" OR (score >= {MIN_SCORE} AND (core_matches >= 1 OR keyword >= 3.0 OR semantic >= 0.38)))"
)

PHRASE_BONUS = "CASE WHEN n_core < 2 THEN 0.0 WHEN core_matches = n_core THEN 12.0 WHEN core_matches >= n_core - 1 AND core_matches >= 2 THEN 5.0 WHEN core_matches >= 1 THEN 1.5 ELSE 0.0 END"

#: The order of hits: eight keys, then the chunk.
RANK_ORDER = "semantic DESC, phrase DESC, stem DESC, (CASE WHEN core_matches >= n_core THEN 1 ELSE 0 END) DESC, core_matches DESC, score DESC, rrf DESC, id"
