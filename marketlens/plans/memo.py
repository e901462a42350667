"""Per-session memo for expensive, deterministic intermediate results
(fitted models, written training tables) shared by several queries."""
from __future__ import annotations

import threading

_lock = threading.RLock()       # a build may need another memo
_memo: dict[tuple, object] = {}


def memo(spark, sf_dir: str, name: str, build):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    with _lock:
        if key not in _memo:
            _memo[key] = build()
        return _memo[key]
