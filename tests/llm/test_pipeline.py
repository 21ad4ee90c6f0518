import gc
import hashlib
import random
from pathlib import Path
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tessitura.llm import bpe, mixing
from tests.llm.test_mixing import targets_by_hand
from tests.llm.test_near_text import components_by_hand


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("th", "an", "er", "ou", "st") for b in ("ing", "ed", "ly", "or", "e")]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=rng.randint(40, 120)))
        if i % 6 == 0:
            text = "An exact copy of one text that many rows hold."
        elif i % 10 == 3:
            text = rows[-1][1] + " " + rng.choice(words)  # a near copy
        elif i % 25 == 4:
            text = "12345 !!! 678 ..."
        rows.append((i, text, "en", rng.choice(["a", "b", "c"]), len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r[0]: r for r in rows if any(c.isalpha() for c in r[1] or "")}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k == 4:
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        found = sorted(tuple(r) for r in frame.collect())
        if k == 1:
            last = {}
            for i in sorted(kept):
                last[kept[i][1]] = i
            kept = {i: kept[i] for i in last.values()}
        elif k == 2:
            root = components_by_hand([(i, r[1]) for i, r in kept.items()])  # five words, 0.8
            assert any(i != r for i, r in root.items())
            kept = {i: r for i, r in kept.items() if root[i] == i}
        if k < 3:
            assert found == sorted(kept.values())
        else:
            sizes, taken = {}, {}
            for _, text, _, source, _ in kept.values():
                sizes[source] = sizes.get(source, 0) + len(text.split())
            for _, text, _, source, _ in found:
                taken[source] = taken.get(source, 0) + len(text.split())
            for source, target in targets_by_hand(sizes, (3, 1, 2), 1.5, 2.0).items():
                assert abs(taken[source] - target) <= 80  # within one document
            assert set(found) <= set(kept.values()) and all(found.count(r) <= 2 for r in found)
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = sorted((r.doc_id, r.ids, r.ids_sha256) for r in out.collect())
    ids = [(r[0], reference.encode(r[1], add_special_tokens=False).ids) for r in found]
    assert encoded == sorted((i, x, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(found)
    assert mixing.CLASSES[-1] == 0 and [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]


def test_stages_of_nothing_and_of_repeated_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the same words again and again in one text that several rows hold"
    rows = [(5, text, "en", "a", 1)] * 3 + [(None, text + " more", "en", None, 1)] * 2 + [(None, "other words altogether", "en", "a", 1), (9, None, None, None, None)]
    for k, docs in enumerate((spark.createDataFrame([], schema), spark.createDataFrame(rows, schema))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{name}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            found = sorted(str((r.doc_id, r.text)) for r in docs.collect())
            if name == "exact_dedup" and k:
                assert found == sorted(map(str, [(5, text), (None, text + " more"), (None, "other words altogether")]))
            if name == "simhash_near_dedup" and k:
                assert found == sorted(map(str, [(5, text), (None, "other words altogether")]))
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(found)
        assert k or not found


def test_encoding_leaves_nothing_in_the_worker():
    """Workers live on for other stages: vocabulary and table of words go with the task, and long batches are cut in small pieces."""
    content = SimpleNamespace(value=Path(public_tokenizers.path(corpus_pipeline.VOCABULARY)).read_text(encoding="utf-8"))
    texts = ["".join(f" word{k * 7 + n}" for k in range(20_000)) for n in range(8)]
    rows = pa.record_batch({"doc_id": pa.array(range(8), pa.int64()), "text": pa.array(texts)})
    sizes = [len(out) for out in bpe._encoded(content, True)(iter([rows]))]
    gc.collect()
    assert sum(sizes) == 8 and max(sizes) < 8 and not [x for x in gc.get_objects() if isinstance(x, bpe.ByteBPE)]
