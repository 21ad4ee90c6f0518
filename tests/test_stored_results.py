"""Discovery against stored results: a folder named by STORED_RESULTS with x.pitch, x.tonic, x.motif and perhaps segments."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessitura.plans import discovery
from tessitura.sources import files

FOLDER = os.environ.get("STORED_RESULTS", "")
BASES = sorted(p.removesuffix(".pitch") for p in glob.glob(f"{FOLDER}/*.pitch")) if FOLDER else []


@pytest.mark.parametrize("base", BASES)
def test_stored_discovery(spark, base):
    read = lambda kind, ext: files.read_fields(spark, base + ext, kind).withColumn("rec_id", F.lit(1).cast("long"))
    samples = read("pitch", ".pitch").select("rec_id", F.col("line").alias("idx"), "t", "value")
    segments = next((read("segments", base_ext) for base_ext in (os.path.splitext(p)[1] for p in glob.glob(glob.escape(base) + ".*")) if "seg" in base_ext.lower()), None)
    hop = round(samples.where("idx = 1").first().t - samples.where("idx = 0").first().t, 6)
    stored = read("motifs", ".motif").where(F.col("dist") < files.EMPTY).orderBy("line").collect()
    found = discovery.discover(samples, read("tonic", ".tonic"), segments, hop, bound=5e6).orderBy("rank").collect()
    assert [(r.l_sub, r.r_sub) for r in found][: len(stored)] == [(r.ind1, r.ind2) for r in stored]
    for r, s in zip(found, stored, strict=False):
        assert r.dist == pytest.approx(s.dist, rel=1e-4)
        assert (r.l_s, r.l_e, r.r_s, r.r_e) == pytest.approx((s.s1, s.e1, s.s2, s.e2), abs=1e-4)


def test_discovery_from_samples(spark):
    """Two recordings that play a tune twice: the pair found is the two times."""
    import math
    import random

    rng = random.Random(4)
    rows = []
    for rec in (1, 2):
        tune = [200 + 40 * math.sin(i / 9 + rec) + 15 * math.sin(i / 3.1) for i in range(120)]
        noise = lambda n: [150 + 100 * rng.random() for _ in range(n)]
        values = noise(60) + tune + noise(80) + tune + noise(60)
        rows += [(rec, i, i * 0.02, v) for i, v in enumerate(values)]
    samples = spark.createDataFrame(rows, "rec_id long, idx long, t double, value double")
    tonics = spark.createDataFrame([(1, 100.0), (2, 100.0)], "rec_id long, tonic double")
    params = discovery.DiscoveryParams(duration=1.0, rate_ms=20.0, std_threshold=5.0, flat_share=0.5, scales=1, pairs=1)
    found = discovery.discover(samples, tonics, None, 0.02, params).collect()
    assert {r.l_rec for r in found} == {1, 2}
    assert all(abs((r.r_s - r.l_s) - 4.0) < 0.021 and r.dist < 1e-6 for r in found)
