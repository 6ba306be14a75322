"""Storage, metadata, example data, streams, fragments and archives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import paths
from kinetrail.operators import fragment
from kinetrail.plans.trajectories import Trajectories
from kinetrail.sources import archive, examples, store
from kinetrail.streaming.counts import transition_stream


def test_path_names(spark):
    same = ["PROJ1/RUN0/a.xtc", " proj1\\run0\\a.xtc ", "file:///data/PROJ1/RUN0/./a.xtc", "./PROJ1//RUN0/A.XTC", " PROJ1/RUN0/a.xtc"]
    df = spark.createDataFrame([(x,) for x in same], "p string")
    assert {r[0] for r in df.select(paths.project_path(F.col("p"))).collect()} == {"proj1/run0/a.xtc"}
    tops = ["sys1/min.pdb", "/mnt/x/topologies/SYS1/MIN.PDB", "Sys1/./min.pdb", "sys1//min.pdb "]
    df = spark.createDataFrame([(x,) for x in tops], "p string")
    assert {r[0] for r in df.select(paths.topology_path(F.col("p"))).collect()} == {"sys1/min.pdb"}
    none = spark.createDataFrame([(None,), ("",), ("  ",)], "p string")
    assert [r[0] for r in none.select(paths.project_path(F.col("p"))).collect()] == [None] * 3
    assert spark.createDataFrame([("a/B.dcd ",)], "p string").select(paths.base_name(F.col("p"))).first()[0] == "b.dcd"


def test_dataset_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([(i, j, [float(i), float(j)]) for i in range(12) for j in range(5)], "traj_id bigint, frame bigint, features array<double>")
    a = store.Dataset.create(df, str(tmp_path / "a"), command="made")
    assert a.frames().count() == 60 and a[3].count() == 5 and a[99].count() == 0
    assert [r[0] for r in a.keys().collect()][:3] == [0, 1, 2]

    class Double:
        def fit(self, df):
            return self

        def transform(self, df):
            return df.withColumn("features", F.transform("features", lambda v: v * 2))

    b = a.fit_transform_with(Double(), str(tmp_path / "b"))
    assert b.provenance()["parents"][0]["command"] == "made"
    with pytest.raises(Exception, match="(?i)exist"):
        store.Dataset.create(df, str(tmp_path / "a"))
    store.Dataset.create(df.limit(5), str(tmp_path / "a"), mode="backup")
    assert store.exists(spark, str(tmp_path / "a.bak.0"))


def test_numpy_directories(spark, tmp_path):
    df = spark.createDataFrame([(i, j, [float(i), float(j)]) for i in range(3) for j in range(4)], "traj_id bigint, frame bigint, features array<double>")
    assert store.write_npy(df, str(tmp_path)) == [f"{i:08d}.npy" for i in range(3)]
    assert np.load(tmp_path / "00000002.npy").tolist() == [[2.0, j] for j in range(4)]
    back = store.read_npy(spark, str(tmp_path))
    assert back.count() == 12 and back.where("path like '%00000001.npy' and frame = 3").first()["features"] == [1.0, 3.0]
    assert store.open_dataset(spark, str(tmp_path)).count() == 12
    with pytest.raises(ValueError):
        store.open_dataset(spark, str(tmp_path), "hdf5-union")
    with pytest.raises(Exception, match="fit file name"):
        store.write_npy(df, str(tmp_path), name=lambda k: f"../{k}.npy")


def test_metadata(spark, tmp_path):
    df = spark.createDataFrame([("trajectory-12.dcd",), ("other.txt",), (None,)], "f string")
    assert [r["run"] for r in store.numbered_runs(df, "f").collect()] == [12, None, None]
    deep = store.hierarchy(spark.createDataFrame([("a/b/c.xtc",), ("a/c.xtc",)], "f string"), "f", ["x", "y", "z"]).collect()
    assert deep[0]["z"] == "c.xtc" and deep[1]["x"] is None
    names = spark.createDataFrame([("t10",), ("t9",), ("t1",)], "f string")
    assert [r[0] for r in store.natural_order(names, "f").collect()] == ["t1", "t9", "t10"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x10.dat").write_text("abc")
    (tmp_path / "m" / "x9.dat").write_text("a")
    assert [r["length"] for r in store.gather_metadata(spark, str(tmp_path / "m")).collect()] == [1, 3]
    store.save_meta(names, str(tmp_path / "meta"))
    assert store.load_meta(spark, str(tmp_path / "meta")).count() == 3 and "<table" in store.render_meta(names)


def test_chunks_numbered_through(spark):
    rows = [("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("a", 1, 1), ("a", 1, 2)]
    out = store.join_chunks(spark.createDataFrame(rows, "t string, c int, f bigint"), "t", "c", "f")
    assert sorted(r["f"] for r in out.collect()) == [0, 1, 2, 3]


def test_models_on_disk(spark, tmp_path):
    from kinetrail.operators.counting import CountMatrix
    from kinetrail.operators.msm import MarkovStateModel

    m = MarkovStateModel().fit_counts(CountMatrix(np.array([[5.0, 1], [2, 3]]), ["a", "b"]))
    store.save_model(spark, m, str(tmp_path / "m.json"))
    back = store.load_model(spark, MarkovStateModel, str(tmp_path / "m.json"))
    assert np.allclose(back.transmat_, m.transmat_) and back.mapping_ == m.mapping_ and np.allclose(back.timescales_, m.timescales_)


def test_example_data(spark):
    w, v = examples.doublewell_eigs(100, 1, 3)
    assert w[0] == pytest.approx(1) and 0.9 < w[1] < 1 and v.shape == (100, 3)
    a = examples.double_well(spark, 2, 500).collect()
    assert len(a) == 1000 and all(abs(r["features"][0]) <= np.pi for r in a)
    assert examples.double_well(spark, 2, 500).orderBy("traj_id", "frame").collect() == sorted(a, key=lambda r: (r["traj_id"], r["frame"]))
    assert examples.quad_well(spark, 3, 50).count() == 150 and examples.muller(spark, 2, 1000, 100).count() == 20
    x = np.linspace(-1, 1, 9)
    assert np.allclose(examples.quad_force(x), -(examples.quad_potential(x + 1e-6) - examples.quad_potential(x - 1e-6)) / 2e-6, atol=1e-4)


def test_stream_in_batches(spark, tmp_path):
    schema = "u bigint, ts timestamp, s string"
    source = str(tmp_path / "in")
    q = transition_stream(spark.readStream.schema(schema).parquet(source + "*"), "u", "ts", "s").writeStream.format("memory").queryName("pairs").start()
    try:
        make = lambda rows: spark.sql("select * from values " + ", ".join(f"({u}L, timestamp'2030-01-01 00:00:{t:02d}', '{s}')" for u, t, s in rows) + " as t(u, ts, s)")
        make([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")]).coalesce(1).write.parquet(source)
        q.processAllAvailable()
        make([(1, 2, "b"), (2, 5, "c"), (1, 0, "z")]).coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
        rows = spark.table("pairs").collect()
    finally:
        q.stop()
    assert sorted((r["src"], r["dst"], r["n"]) for r in rows if r["src"]) == [("a", "b", 1), ("a", "c", 1), ("b", "b", 1)]
    assert sum(r["late"] for r in rows) == 1


# --- fragment and replicate ---


def test_hot_key_is_spread(spark):
    rows = [("hot", i) for i in range(6000)] + [(f"k{i % 300}", i) for i in range(3000)] + [(None, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    plan = fragment.plan_fragments(df, "k", 8)
    assert len(plan.shards["hot"]) >= 5 and plan.imbalance < 1.3
    sizes = [r["count"] for r in fragment.fragmented(df, plan).where("k = 'hot'").groupBy(fragment.SALT).count().collect()]
    assert max(sizes) < 2 * min(sizes)
    got = {r["k"]: (r["n"], r["s"]) for r in fragment.fragment_aggregate(df, "k", {"n": F.count(F.lit(1)), "s": F.sum("v")}, plan=plan).collect()}
    assert got["hot"] == (6000, sum(range(6000))) and got[None][0] == 1000 and len(got) == 302


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_replicated_join_equals_the_plain_one(spark, how):
    left = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 1), ("c", 2), (None, 3)], "k string, v bigint")
    right = spark.createDataFrame([("a", 10), ("a", 11), ("b", 12), (None, 13)], "k string, v bigint")
    got = fragment.fragment_replicate_join(left, right, "k", how, plan=fragment.plan_fragments(left, "k", 4))
    want = left.join(right.withColumnRenamed("v", "v_right"), "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        fragment.fragment_replicate_join(left, right, "k", "full")


def test_fragments_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert fragment.fragment_aggregate(df, "k", {"n": F.count(F.lit(1))}).count() == 0
    meta = spark.createDataFrame([], "traj_id bigint, i0 string, nframes int, step_ps double, gathered_at timestamp_ntz")
    assert fragment.project_totals(meta).count() == 0


def test_project_totals(spark):
    rows = [(1, "P1", 10, 2.0, 1), (1, "P1", 20, 2.0, 2), (2, None, 5, 1.0, 1), (3, "P1", None, 1.0, 1), (4, "P2", 7, float("nan"), 1), (4, None, 7, float("nan"), 3), (None, "P9", 1, 1.0, 1)]
    meta = spark.createDataFrame([(a, b, c, d, "x") for a, b, c, d, _ in rows], "traj_id bigint, i0 string, nframes int, step_ps double, share string")
    meta = meta.withColumn("gathered_at", F.lit("2030-01-01").cast("timestamp_ntz"))
    stamped = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in rows], "traj_id bigint, i0 string, nframes int, step_ps double, h int")
    stamped = stamped.withColumn("gathered_at", F.expr("timestamp_ntz'2030-01-01 00:00:00' + make_interval(0,0,0,0,h)")).withColumn("share", F.lit("clash"))
    got = {r["i0"]: (r["n_traj"], r["nframes"], r["sim_ps"], r["share"]) for r in fragment.project_totals(stamped).collect()}
    assert got == {"P1": (2, 20, 40.0, 0.5), "P2": (1, 7, 0.0, 0.25)}
    assert fragment.trajectory_shares(stamped).count() == 2


# --- archives ---


def tables(spark):
    files = [
        (1, "PROJ1/a0.xtc", [0, 1, 2], [0.5, 1.5, 2.5]), (1, "./proj1//A0.XTC", [0, 1, 2], [0.5, 1.5, 2.5]), (2, "PROJ1/a1.xtc", [2, 3], [2.5, 3.5]),
        (3, "PROJ1/a2.xtc", [3], [9.5]), (4, "PROJ1/lost.xtc", [0, 1], [0.5, 1.5]), (5, "PROJ1/none.xtc", None, None), (6, "PROJ1/empty.xtc", [], []),
        (7, "PROJ2/b.xtc", [0, None], [None, 1.0]), (None, "PROJ2/c.xtc", [0], [1.0]),
    ]
    lines = [("T.dcd", ["PROJ1/a0.xtc", "proj1\\a1.xtc", None]), (" dir/t.DCD ", ["PROJ1/a2.xtc", "PROJ1/absent.xtc"]), ("u.dcd", None), ("v.dcd", [])]
    return (
        spark.createDataFrame([(*f, 10) for f in files], "chunk_id bigint, chunk_fn string, frames array<bigint>, potential array<double>, path int"),
        spark.createDataFrame(lines, "filename string, chunks array<string>"),
    )


def test_surplus_and_round_trip(spark):
    files, lines = tables(spark)
    gone = archive.surplus_records(archive.chunk_table(files), archive.chunk_owners(lines)).collect()
    assert {(r["chunk_id"], r["frame"]) for r in gone} == {(2, 2)}
    place = archive.pack_chunks(files, lines, block_bytes=100)
    index = archive.archive_index(spark, place).collect()
    assert sorted(r["key"] for r in index) == [1, 2, 3, 4, 5, 6, 7] and len({r["block"] for r in index}) > 1
    records = archive.decode_records(archive.archive_files(spark, place), ["key"]).collect()
    assert sorted(str(tuple(r)) for r in records) == sorted(map(str, [(1, 0, 0.5), (1, 1, 1.5), (1, 2, 2.5), (2, 3, 3.5), (3, 3, 9.5), (4, 0, 0.5), (4, 1, 1.5), (7, 0, None), (7, None, 1.0)]))
    one = archive.archive_files(spark, place, spark.createDataFrame([(3,)], "key bigint")).collect()
    assert len(one) == 1 and one[0]["path"] == "proj1/a2.xtc"
    wanted = archive.archive_files(spark, place, spark.createDataFrame([(3,)], "key bigint"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(block), " in wanted and "block" in wanted.split("PushedFilters")[1].split("ReadSchema")[0]
    assert {(r["chunk_id"], r["frame"]) for r in archive.surplus_of(archive.archive_index(spark, place)).collect()} == {(2, 2)}


def test_surplus_comes_through_the_archive(spark, monkeypatch):
    monkeypatch.setattr(archive, "pack_blocks", lambda *a, **k: spark.createDataFrame([], archive.BLOCK))
    assert archive.packed_surplus(*tables(spark)).count() == 0


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "a", bytearray(b"abcdef")), (2, "b", None), (3, "c", bytearray(b""))], "id bigint, p string, c binary")
    blocks = archive.pack_blocks(df, "id", "p", "c", ["id"])
    assert [(e["offset"], e["length"]) for e in blocks.first()["entries"]] == [(0, 6), (6, 0), (6, 0)]
    import uuid

    from kinetrail.session import scratch_dir

    at = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    archive.write_archive(blocks.withColumn("payload", F.encode(F.lit("abcdeX"), "utf-8")), at)
    with pytest.raises(Exception, match="checksum differs"):
        archive.archive_files(spark, at).collect()
    assert archive.pack_blocks(df.limit(0), "id", "p", "c", ["id"]).count() == 0


PDB = """ATOM      1  N   ALA A   1       1.000   2.000   3.000  1.00  0.00           N
ATOM      2  CA  ALA A   1       2.000   2.000   3.000  1.00  0.00           C
HETATM    3  H1  LIG B   2       4.000   2.000   3.000  1.00  0.00           H
ENDMDL
ATOM      1  N   ALA A   1       0.000   0.000   0.000  1.00  0.00           N
ATOM      2  CA  ALA A   1       0.000   3.000   4.000  1.00  0.00           C
HETATM    3  H1  LIG B   2       4.000   2.000   3.000  1.00  0.00           H
ENDMDL
CONECT    1    2
"""


def test_coordinates(spark, tmp_path):
    from kinetrail.operators.featurizers import AtomPairsFeaturizer
    from kinetrail.sources import coordinates

    (tmp_path / "a.pdb").write_text(PDB)
    (tmp_path / "b.xyz").write_text("2\nx\nC 0 0 0\nC 10 0 0\n2\ny\nC 0 0 0\nC 0 20 0\n")
    top = coordinates.pdb_topology(PDB)
    assert top.bonds == ((0, 1),) and [a.chain for a in top.atoms] == [0, 0, 1]
    assert coordinates.atom_indices(top, "alpha").tolist() == [1] and coordinates.atom_indices(top, "heavy").tolist() == [0, 1]
    pdb = coordinates.read_coordinates(spark, str(tmp_path), "pdb")
    got = coordinates.featurize_all(pdb, AtomPairsFeaturizer([(0, 1)])).orderBy("indices").collect()
    assert [r["indices"] for r in got] == [0, 1] and np.allclose([r["data"][0] for r in got], [0.1, 0.5])
    xyz = coordinates.read_coordinates(spark, str(tmp_path), "xyz", stride=2, atom_indices=[1]).collect()
    assert len(xyz) == 1 and np.allclose(xyz[0]["xyz"], [[1, 0, 0]])
    with pytest.raises(ValueError):
        coordinates.read_coordinates(spark, str(tmp_path), "dcd")


def test_pipeline_and_folds(spark):
    from kinetrail.operators.cluster import KMeans
    from kinetrail.operators.decomposition import tICA
    from kinetrail.operators.msm import MarkovStateModel
    from kinetrail.operators.preprocessing import StandardScaler
    from kinetrail.plans.pipeline import Pipeline, cross_validate

    rng = np.random.default_rng(0)
    rows = []
    for i in range(8):
        wells = np.repeat(rng.integers(0, 2, 10), 20)
        rows += [(i, j, [float(5 * w + rng.normal()), float(rng.normal())]) for j, w in enumerate(wells)]
    t = Trajectories(spark.createDataFrame(rows, "traj_id int, frame int, features array<double>"), "traj_id", ("frame",), None, "features")
    p = Pipeline([("scale", StandardScaler()), ("tica", tICA(1)), ("cluster", KMeans(2)), ("msm", MarkovStateModel())]).fit(t)
    assert p.named_steps["msm"].n_states_ == 2 and p.named_steps["msm"].transmat_.diagonal().min() > 0.9
    scores = cross_validate(p.transform(t), MarkovStateModel(), 3)
    assert len(scores) == 3 and np.nanmin(scores) > 1.5


def test_archive_of_nothing(spark):
    files, lines = tables(spark)
    assert archive.packed_index(files.limit(0), lines).count() == 0
    assert archive.packed_records(files.limit(0), lines.limit(0)).count() == 0
    assert archive.packed_index(files, lines.limit(0)).count() == 7


def test_one_trajectory_with_most_records(spark):
    files = spark.range(3000).select(
        F.col("id").alias("chunk_id"), F.concat(F.lit("PROJ1/c"), F.col("id").cast("string")).alias("chunk_fn"),
        F.array(F.lit(0), F.col("id")).cast("array<bigint>").alias("frames"), F.array(F.lit(1.0), F.lit(2.0)).alias("potential"),
    )
    lines = files.groupBy(F.lit("big.dcd").alias("filename")).agg(F.collect_list("chunk_fn").alias("chunks"))
    gone = archive.surplus_records(archive.chunk_table(files), archive.chunk_owners(lines))
    assert gone.count() == 2999 and gone.where("frame <> 0").count() == 0
    assert archive.packed_records(files, lines).count() == 3001
