import random

import pytest

import __spark_entry__
from tessitura.operators import aggregates, lineage, store, subsequences


def test_rows_are_numbered_without_gaps_in_order(spark):
    rows = [(random.Random(i).random(), i) for i in range(2000)]
    found = lineage.numbered(spark.createDataFrame(rows, "x double, i int").repartition(7), "k", "x", "i").collect()
    assert [r.i for r in sorted(found, key=lambda r: r.k)] == [i for _, i in sorted(rows)]
    assert sorted(r.k for r in found) == list(range(2000))


def test_windows_in_phrases_keep_to_their_phrase(spark):
    rows = [(1, i, float(i), float(i), i // 10) for i in range(25)]
    found = subsequences.windows_in_phrases(spark.createDataFrame(rows, "rec_id int, idx int, t double, value double, phrase int"), 4, 3).collect()
    assert sorted((r.sub_id, r.data) for r in found) == [(i, [float(i + k) for k in range(4)]) for i in (0, 3, 6, 10, 13, 16, 20)]


def test_counts_and_store(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), (None,)], "v string")
    assert [tuple(r) for r in sorted(aggregates.most_common(rows, "v").collect(), key=lambda r: r["rank"])] == [("b", 2, 1), ("c", 2, 2), (None, 1, 3), ("a", 1, 4)]
    pairs = spark.createDataFrame([(r, k, 0.0, 1.0, 2.0, 3.0, 0.5) for r in (2, 1) for k in (2, 1)], "rec int, rank int, s1 double, e1 double, s2 double, e2 double, dist double")
    patterns, matches = store.load_discovery(pairs)
    assert sorted((p.id, p.file_id, p.pair_id) for p in patterns.collect()) == [(i, 1 if i < 5 else 2, i + 1 if i % 2 else i - 1) for i in range(1, 9)]
    assert matches.count() == 8
    assert store.load_network(store.empty(spark, store.NETWORK), spark.createDataFrame([(1, 2, 3.0)], "a int, b int, weight double")).count() == 1


def test_training_data_operators_are_optional(monkeypatch):
    """Without what they need the entry still has the library's queries."""

    def missing(name):
        raise ImportError(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing)
    found = __spark_entry__.queries()
    assert "motif_discovery" in found and not any(n.startswith("op") and n[2:3].isdigit() for n in found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("hit", [0.5, 1.0])
def test_flat_windows_and_their_removal(spark, hit):
    flags = [i % 3 != 0 for i in range(30)]
    rows = spark.createDataFrame([(1, i, float(i), 0.0, f) for i, f in enumerate(flags)], "rec_id int, idx int, t double, value double, flat boolean")
    want = [i for i in range(23) if sum(flags[i : i + 8]) >= hit * 8]
    listed = subsequences.flat_windows(rows, 8, hit)
    assert sorted(r.sub_id for r in listed.collect()) == want
    left = subsequences.without_listed(subsequences.sliding_windows(rows, 8), listed)
    assert sorted(r.sub_id for r in left.collect()) == [i for i in range(23) if i not in want]
