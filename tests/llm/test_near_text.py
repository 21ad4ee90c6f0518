import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tessitura.llm import near_text
from tests.llm.test_operators import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components_by_hand(rows, words=5, least=0.8):
    sets = {}
    for i, text in rows:
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[b] < root[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                    root[a], changed = root[b], True
    return root


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def texts():
    """Near copies at all distances, chains of them, two groups that share a line, short and odd texts."""
    rng = random.Random(12)
    make = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    line, out = make(12), []
    for _ in range(12):
        base = make(rng.randint(40, 150))
        out += [base, edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 4), base.upper() + "  "]
    for _ in range(2):
        text = line + " " + make(14)
        for _ in range(20):
            out.append(text := text + " " + make(1))
    out += ["One two", "one TWO", "one two three", "", None, " \t", line, line + " x", "a b c d e", "a b c d e f"]
    rng.shuffle(out)
    return list(enumerate(out))


def test_components_against_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = components_by_hand(rows)
    assert len(set(want.values())) < len(rows) - 40
    for block in (near_text.BLOCK, 3):  # with 3, keys are compared in blocks
        found = {r.doc_id: r.component_id for r in near_text.similar_documents(docs, block=block).collect()}
        assert found == want
    assert near_text.similar_documents(docs.limit(0)).collect() == []


def test_one_row_of_repeated_and_null_ids_stays(spark):
    same, other, third = "one two three four five six", "a b c d e f g", "x y z"
    rows = [(5, same, "a"), (5, same, "b"), (5, same, "b"), (None, same, "c"), (None, other, "d"), (None, other, "d"), (None, third, "e"), (None, None, "f"), (None, "", "g"), (7, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = near_text.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, [(5, same), (None, other), (None, third), (7, "")]))
    assert near_text.drop_near_duplicates(docs.limit(0)).collect() == []


def test_fingerprints_against_plain_votes():
    rng = np.random.default_rng(2)
    row = np.repeat([0, 2, 3], [5, 1, 40])
    found = rng.integers(0, 2**63, len(row)).astype(np.uint64)
    got = near_text.fingerprints(row, found, 5)
    for r in range(5):
        mine = [int(x) for x in found[row == r]]
        assert int(got[r]) % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mine) > len(mine))


def test_stage_drops_all_similar_texts(spark, tmp_path):
    rows = [(i, text, "en", "a", 0) for i, text in texts()]
    docs = spark.createDataFrame(rows, DOCS)
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    root = components_by_hand([r[:2] for r in rows])
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, r in root.items() if i == r)


def test_bitmaps_leave_out_no_pair_that_can_be_linked():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [base, base[:330], base[60:], base[:200], rng.integers(0, 2**63, 400).astype(np.uint64), base[:3], base[:3].copy(), base[5:6]]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    size = np.array([len(x) for x in sets])
    bits = near_text._bitmaps(row, np.concatenate(sets), size)
    assert [8 * len(x.as_py()) for x in bits] == [1024, 1024, 1024, 512, 1024, 64, 64, 64]
    n = len(sets)
    known = {"task": [7] * n, "same": [True] * n, "side": [0] * n, "low": [1] * n, "sig": list(range(n)), "root": list(range(n))}
    batch = pa.record_batch({**{c: pa.array(v) for c, v in known.items()}, "n": pa.array(size.astype(np.int32)), "bits": bits})
    hit = {i for out in near_text._possible(Fraction("0.8"))(iter([batch])) for i in out.column("sig").to_pylist()}
    exact = [set(x.tolist()) for x in sets]
    linked = {i for i in range(n) for j in range(n) if i != j and len(exact[i] & exact[j]) >= 0.8 * len(exact[i] | exact[j])}
    assert linked == {0, 1, 2, 5, 6}
    assert hit == linked


def test_sketch_is_added_up_in_small_rows():
    """Every task sends a row a piece; 10,000 of them, a batch, stay small, and their sums are the counts of all texts."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(400)) for _ in range(6)]
    pieces, total = [], np.zeros(near_text.BUCKETS, np.int64)
    for task in range(3):
        mine = texts[task : task + 4]
        batch = pa.record_batch({"key": pa.array(map(str, range(4))), "doc_id": pa.array(range(4), pa.int64()), "text": pa.array(mine)})
        sent = list(near_text._signed(5)(iter([batch])))[-1]
        pieces.append(pa.record_batch({c: sent.column(c) for c in ("piece", "counts")}))
        data = " ".join(mine).encode()
        ends = np.cumsum([len(t.encode()) + 1 for t in mine])
        _, found = near_text.shingles(np.frombuffer(data + b" ", np.uint8), np.r_[0, ends], near_text.SpanHasher())
        np.add.at(total, (found >> np.uint64(44)).astype(np.int64), 1)
    assert max(len(x.as_py()) for p in pieces for x in p.column("counts")) * 10_000 <= 100 << 20
    (levels,) = near_text._levels(iter(pieces))
    joined = {k: v.as_py() for k, v in zip(levels.column("piece").to_pylist(), levels.column("levels"), strict=True)}
    assert b"".join(joined[k] for k in range(near_text.PIECES)) == (2 * np.log2(1 + total)).astype(np.uint8).tobytes()
