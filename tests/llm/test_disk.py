"""What the corpus operators hold on disk at a time."""

import os

import numpy as np
from ledgerflow.llm import sketch, store, suffix_dedup


def copies(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(words[k] for k in rng.integers(0, 400, n))
    passages = [text(30) for _ in range(6)]
    return spark.createDataFrame([(i, f"{text(25)} {passages[i % 6]} {text(9)} {passages[i % 5]}") for i in range(40)], "doc_id long, text string").repartition(4)


def rows(df):
    return sorted(map(tuple, suffix_dedup.suffix_dedup(df, keep_bytes=False).collect()))


def test_suffixes_are_sorted_a_share_at_a_time(spark, monkeypatch):
    """Equal suffixes are in one share, so shares give what one sort of all gives, also for digits that very many tasks have."""
    df, sizes = copies(spark), []
    whole = rows(df)
    kept = suffix_dedup._sorted_suffixes
    monkeypatch.setattr(suffix_dedup, "_sorted_suffixes", lambda pieces, rules: sizes.append(pieces.count()) or kept(pieces, rules))
    for hot in (sketch.HOT, 1):
        monkeypatch.setattr(sketch, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "TOGETHER", 10**9)
        sizes.clear()
        assert rows(df) == whole and len(sizes) == 1
        most = sizes[0]
        monkeypatch.setattr(suffix_dedup, "TOGETHER", max(1, most * 27 // 2 // 3))
        sizes.clear()
        assert rows(df) == whole and len(sizes) >= 3 and sum(sizes) == most and max(sizes) < most


def test_tables_of_finished_passes_go(spark):
    folder = store.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert suffix_dedup.suffix_dedup(copies(spark), keep_bytes=False).count() == 40
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} == {"removed-runs"}
