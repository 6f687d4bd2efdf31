"""Every query of the library against its SQL, or for rows alone."""

from __future__ import annotations

import pytest
from conftest import SF, same_rows

from lodestone.registry import ORACLES, QUERIES

#: Empty on the smallest tables.
MAY_BE_EMPTY = {"exclusive_contributors", "circuit_breaker", "playlist_overlap", "bad_actor_songwriter_overlap", "suspicious_entities", "artists_by_verdict", "new_ai_artists", "burst_months", "threshold_queue", "review_decision", "similar_corpus_overlap", "network_proximity", "should_scan", "alias_blocklist", "revised_weights"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF).toPandas()
    assert len(result) or name in MAY_BE_EMPTY
    if name in ORACLES:
        same_rows(result, duck.execute(ORACLES[name]).df())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
