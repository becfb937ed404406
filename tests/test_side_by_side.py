"""Work whose small jobs wait for each other goes on side by side."""

import threading
from dataclasses import replace

import pytest
from ledgerflow import queries
from ledgerflow.functions import tables


def test_methods_are_clustered_at_once(spark, sf_dir, monkeypatch):
    """Each method waits until all have begun, which they never do one after the other."""
    met, kept = threading.Barrier(len(queries._METHODS), timeout=60), queries.detection.detect_communities

    def labels(matrix, cfg, keys):
        met.wait()
        return kept(matrix, replace(cfg, method="trivial"), keys)

    monkeypatch.setattr(queries.detection, "detect_communities", labels)
    rows = queries.queries()["detect_invariants"](spark, sf_dir).collect()
    assert {r.method for r in rows} == set(queries._METHODS) and all(r.repeated == 0 for r in rows)


def test_an_error_is_raised():
    with pytest.raises(ZeroDivisionError):
        tables.side_by_side(lambda x: 1 // x, (1, 0, 2))
    assert tables.side_by_side(lambda x: x, ()) == [] and tables.side_by_side(str, (2, 1)) == ["2", "1"]
