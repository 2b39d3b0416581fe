"""All registered queries by name."""

from __future__ import annotations

from compassframe.plans import acquiring, evaluating, flowing, governing, learning, profiling, ranking, verifying

_MODULES = [profiling, ranking, evaluating, acquiring, governing, learning, verifying, flowing]
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
