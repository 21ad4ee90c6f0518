import random

import pytest

from tessitura.llm import mixing


def targets_by_hand(sizes, weights, share, cap):
    """Share, cut off, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def rows_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, size string")


def test_targets_and_words(spark):
    rng = random.Random(5)
    docs = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "Z", "é", None])
        docs.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice((1, 3, 9, 40, 120)))), source, "clash"))
    found = mixing.mix(rows_of(spark, docs)).collect()
    sizes = {}
    for _, text, source, _ in docs:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    wanted = targets_by_hand(sizes, (3, 1, 2), 1.5, 2.0)
    taken = {}
    for r in found:
        assert r.target == pytest.approx(wanted[r.source])
        assert r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(found) == len(docs)
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= max(4, 0.01 * t)
    assert sorted(found, key=lambda r: r.doc_id) == sorted(mixing.mix(rows_of(spark, docs)).collect(), key=lambda r: r.doc_id)


def test_nulls_empty_and_repeated_rows(spark):
    docs = [(1, None, None, None), (2, "", "a", "x"), (3, "one two", "a", "x"), (3, "one two", "a", "x"), (None, "three", None, "x")]
    found = mixing.mix(rows_of(spark, docs)).collect()
    assert len(found) == 5
    assert {(r.size, r.taken) for r in found if r.size == 0} == {(0, 0)}
    assert mixing.mix(rows_of(spark, [])).collect() == []


def test_rows_of_the_mix_keep_their_columns(spark):
    docs = rows_of(spark, [(i, "x " * 10, "ab"[i % 2], "c") for i in range(40)])
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    per = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert per == {"a": 40, "b": 20}  # 150 % of 400 words at 3:1, at most twice what there is


def test_rows_of_the_mix_with_repeated_rows(spark):
    """9 equal rows, rows that share doc_id and source but not the text, and null ids: as many words come out as planned."""
    docs = [(1, "one two three four five six seven eight nine", "a", "x")] * 9 + [(2, "u v w", "b", "x"), (2, "u v w x y z", "b", "x"), (None, "p q", None, "x"), (None, None, None, "x"), (None, None, None, "x")]
    frame = rows_of(spark, docs)
    plan, out = mixing.mix(frame).collect(), mixing.mixed_rows(frame).collect()
    assert sum(len((r.text or "").split()) for r in out) == sum(r.taken for r in plan)
    assert len(out) == sum(r.copies for r in plan)
    assert {tuple(r) for r in out} <= set(docs)
    assert mixing.mixed_rows(rows_of(spark, [])).collect() == []


def test_newton_rounds_meet_the_targets(spark):
    words = spark.createDataFrame([("a", c, 10.0 * c) for c in range(1, 9)] + [("b", 1, 5e9), (None, 1, 3.0), ("d", 1, 7.0)], "source string, cell int, words double")
    want = {"a": 500.0, "b": 4.0, None: 0.5, "d": -3.0, "e": 9.0}
    targets = spark.createDataFrame(list(want.items()), "source string, target double")
    found = {r.source: r for r in mixing.rates(mixing.newton(words, targets), 2.0).collect()}
    mass = {"a": 360.0, "b": 5e9, None: 3.0}
    for s, m in mass.items():
        assert found[s].rate == pytest.approx(want[s] / m, rel=1e-12)
    assert found["d"].rate == found["e"].rate == 0.0
