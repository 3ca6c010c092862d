"""Per-file aggregates: each file is read once, totals follow added, changed and dropped files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import drift
from vigil.session import scratch_path
from vigil.sources import io
from vigil.sources.commits import CommitLog
from vigil.sources.per_file import Manifest, Moments

EMB = "vec_id long, embedding array<double>, grp string"


def vectors(spark, ids):
    rng = np.random.default_rng(7)
    table = rng.normal(1e3, 1, (200, 3))
    rows = [(i, table[i].tolist(), "ref" if i % 3 else "new") for i in ids]
    return spark.createDataFrame(rows, EMB)


def moments_of(df):
    return {(r.grp, r.pos): (r.n, round(r["mean"], 8), round(r.std, 8)) for r in df.collect()}


def test_merged_moments_equal_the_full_pass_and_old_files_stay_unread(spark):
    folder, read = scratch_path(spark, "emb"), []

    def embed(rows):
        read.append([r.vec_id for r in rows.select("vec_id").collect()])
        return rows.select("path", "grp", "embedding")

    store = Moments(CommitLog(spark, scratch_path(spark, "log"), {}), embed)
    odd = spark.createDataFrame([(900, None, "ref"), (901, [], "new"), (902, [1.0, None, 2.0], "ref")], EMB)
    for part in (vectors(spark, range(60)), vectors(spark, range(60, 61)), vectors(spark, range(61, 200)).unionByName(odd)):
        part.coalesce(1).write.mode("append").parquet(folder)
        assert store.update(folder) == 1
    assert sorted(map(len, read)) == [1, 60, 142] and store.update(folder) == 0
    full = moments_of(drift.dimension_moments(spark.read.parquet(folder)))
    assert moments_of(store.merged(folder)) == full and len(full) == 6
    again = Moments(CommitLog(spark, store.log.root, {}), lambda rows: pytest.fail("nothing is new"))
    assert moments_of(again.merged(folder)) == full


def test_manifest_follows_replaced_files(spark):
    folder = scratch_path(spark, "data")
    cols = ["vec_id", "grp"]
    manifest = Manifest(CommitLog(spark, scratch_path(spark, "log"), {}), cols, "grp")
    for k, ids in enumerate((range(50), range(50, 80))):
        vectors(spark, ids).coalesce(1).write.parquet(f"{folder}/part={k}")
    assert manifest.update(folder) == 2
    vectors(spark, range(80, 95)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part=1")
    assert manifest.update(folder) == 1
    row = manifest.row(folder, "vectors", "grp").first()
    whole = io.fingerprint(spark.read.parquet(folder), cols, "grp").first()
    assert (row.source, row.name, row.target, row.n_files, row.n_rows) == (folder, "vectors", "grp", 2, 65)
    assert (row.total_chars, row.digest_sum, row.digest_xor) == (whole.total_chars, whole.digest_sum, whole.digest_xor)
    assert row.bytes > 0


def test_drift_counts_vectors_that_are_null_or_empty(spark):
    rows = [(1, [1.0, 0.0], "ref"), (2, None, "ref"), (3, [], "new"), (4, [11.0, 0.0], "new")]
    out = drift.embedding_drift(spark.createDataFrame(rows, EMB)).first()
    assert (out.n_ref, out.n_new, out.centroid_distance) == (2, 2, 10.0)


@pytest.mark.parametrize("name,build", [
    ("ks", lambda df: __import__("vigil.operators.ks", fromlist=["x"]).ks_by_flag(df, "p1", F.col("y") == 1)),
    ("roc", lambda df: __import__("vigil.operators.evaluation", fromlist=["x"]).roc_curve(df)),
    ("auc", lambda df: __import__("vigil.operators.evaluation", fromlist=["x"]).roc_auc(df)),
])
def test_the_source_is_read_once(spark, name, build):
    reads = spark.sparkContext.accumulator(0)
    path = scratch_path(spark, f"scores-{name}")
    spark.range(500).select((F.col("id") % 2).alias("y"), (F.col("id") % 97 / 97.0).alias("p1")).write.parquet(path)

    def counted(rows):
        for batch in rows:
            reads.add(batch.num_rows)
            yield batch

    source = spark.read.parquet(path).mapInArrow(counted, "y long, p1 double")
    build(source).collect()
    assert reads.value == 500


def test_a_file_in_parts_counts_once_and_is_read_part_by_part(spark):
    folder = scratch_path(spark, "data.parquet")
    cols = ["vec_id", "grp"]
    manifest = Manifest(CommitLog(spark, scratch_path(spark, "log"), {}), cols, "grp")
    vectors(spark, range(90)).repartition(3).write.parquet(f"{folder}/part=0/rows.parquet")
    vectors(spark, range(90, 95)).coalesce(1).write.parquet(f"{folder}/part=1")
    vectors(spark, range(95, 99)).coalesce(1).write.mode("append").parquet(folder)
    assert manifest.update(folder) == 5
    row = manifest.row(folder, "vectors", "grp").first()
    assert (row.n_files, row.n_rows) == (3, 99)


def test_dataset_manifest_is_written_by_more_tasks_than_files(spark, monkeypatch):
    from datasets import SF_SMALL
    from vigil.plans import source_queries

    made = []
    row = Manifest.row
    monkeypatch.setattr(Manifest, "row", lambda self, folder, *a: made.append(folder) or row(self, folder, *a))
    assert source_queries.q_dataset_manifest(spark, SF_SMALL).first().n_files == 2
    assert len(spark.read.parquet(made[0]).inputFiles()) > 2
