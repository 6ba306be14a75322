"""Grouped splits and mixing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import mixing, splits


def components(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    return {r["node"]: r["component"] for r in splits.connected_components(df, "a", "b").collect()}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 120, (90, 2))] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("x", "x"), ("y", None), ("n001", "n002")] * 2
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            u, v = sorted((top(a), top(b)))
            parent[v] = u
    assert components(spark, edges) == {n: top(n) for n in parent}
    assert components(spark, []) == {}


def tables(spark):
    tops = [(5, "sys1/a.pdb", None), (3, "sys1/b.pdb", "/x/Topologies/SYS1/A.PDB"), (9, "sys2/c.pdb", "sys9/gone.pdb"), (8, "sys2/d.pdb", "sys9\\gone.pdb"), (7, "sys3/e.pdb", "")]
    meta = [("PROJ1/a.xtc", "sys1/b.pdb", None), ("PROJ1/a.xtc", None, None), ("/data/PROJ2/b.xtc", "", "/m/topologies/SYS9/gone.pdb"), ("PROJ3/c.xtc", None, None), ("PROJ4/d.xtc", "sys77/x.pdb", None), (None, "sys1/a.pdb", None)]
    vecs = [(1, "proj1\\A.xtc"), (1, " PROJ1/a.xtc"), (2, "PROJ2/b.xtc"), (3, "PROJ3/c.xtc"), (4, "PROJ4/d.xtc"), (5, None), (6, "PROJ9/unknown.xtc"), (None, "PROJ1/a.xtc")]
    return (
        spark.createDataFrame([(*v, "clash") for v in vecs], "vec_id bigint, fns string, split string"),
        spark.createDataFrame([(*m, 1) for m in meta], "traj_fn string, top_fn string, top_abs_fn string, file int"),
        spark.createDataFrame(tops, "top_id bigint, top_fn string, derived_from string"),
    )


def test_relation_by_descent(spark):
    got = {(r["vec_id"], r["group_id"]) for r in splits.frame_groups(splits.frame_splits(*tables(spark))).collect()}
    assert got == {(1, 3), (2, 8)}
    rows = {r["vec_id"]: r["component"] for r in splits.related_frames(*tables(spark)).collect()}
    assert len(rows) == 6 and rows[5] == "v:5" and rows[3] == "f:proj3/c.xtc" and rows[4] == "t:sys77/x.pdb"
    empty = [t.limit(0) for t in tables(spark)]
    assert splits.frame_groups(splits.frame_splits(*empty)).count() == 0 and splits.frame_splits(*empty).count() == 0


def test_split_keeps_groups_and_shares(spark):
    rng = np.random.default_rng(0)
    sizes = np.concatenate([[300, 200, 150], rng.integers(1, 40, 300)])
    rows = [(f"g{i}", f"s{i % 3}", "clash") for i, n in enumerate(sizes) for _ in range(n)] + [(None, "s0", "clash")] * 5
    df = spark.createDataFrame(rows, "grp string, s string, split0 string")
    out = splits.grouped_split(df, "grp", F.col("s"), {"train": 0.8, "validation": 0.1, "test": 0.1}, chains=4)
    assert out.count() == len(rows)
    assert out.groupBy("grp").agg(F.countDistinct("split").alias("k")).agg(F.max("k")).first()[0] == 1
    share = {r["split"]: r["n"] / len(rows) for r in out.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert share["train"] == pytest.approx(0.8, abs=0.01) and share["test"] == pytest.approx(0.1, abs=0.01)
    again = splits.grouped_split(df, "grp", F.col("s"), {"train": 0.8, "validation": 0.1, "test": 0.1}, chains=4)
    assert sorted(map(str, out.distinct().collect())) == sorted(map(str, again.distinct().collect()))


def units(rng, count, strata, k=3):
    rows = [(f"u{i:04d}", t, int(rng.integers(1, 40))) for i in range(count) for t in sorted(rng.choice(strata, 2, replace=False))]
    names, at, n = (np.array(c) for c in zip(*rows))
    total = np.bincount(at, weights=n, minlength=strata)
    shares = np.array([0.8, 0.1, 0.1])
    return splits.Units.of(names.tolist(), at, n, shares[:, None] * total), shares


def test_annealing_betters_its_start():
    u, shares = units(np.random.default_rng(0), 200, 12)
    cost, at = splits.anneal(u, shares, 0, 0, 12)
    assert cost == pytest.approx(u.deviation(at))
    assert cost < 0.3 * u.deviation(u.start(shares, 0))


def test_most_components_stay_when_one_comes():
    u, shares = units(np.random.default_rng(1), 400, 5)
    more = splits.Units.of([f"u{i // 2:04d}" for i in range(800)] + ["z"], np.append(u.at, 0), np.append(u.n, 3.0), u.want * (1 + 3 / u.n.sum()))
    assert (u.start(shares, 0) == more.start(shares, 0)[:-1]).all()


def test_small_components_are_searched_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(splits, "LARGE", 1 / 30)
    monkeypatch.setattr(splits, "BUCKET", 64)
    rng = np.random.default_rng(0)
    sizes = np.concatenate([[600, 300], rng.integers(1, 12, 500)])
    rows = [(f"g{i}", f"s{i % 7}") for i, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "grp string, s string")
    out = splits.grouped_split(df, "grp", F.col("s"), {"train": 0.8, "validation": 0.1, "test": 0.1}, chains=2)
    assert out.count() == len(rows)
    assert out.groupBy("grp").agg(F.countDistinct("split").alias("k")).agg(F.max("k")).first()[0] == 1
    for by in ([], ["s"]):
        total = out.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("split") == "train").cast("int")).alias("t")).collect()
        for r in total:  # a stratum of the large component has what that allows
            if not by or r["s"] not in ("s0", "s1"):
                assert r["t"] / r["n"] == pytest.approx(0.8, abs=0.03 if not by else 0.06)


# --- mixing ---


def corpus(spark):
    rng = np.random.default_rng(0)
    words = ["lag", "time", "frame", "state", "box"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(5, 60))), ["Run_Notes", " run notes", "RUN-NOTES"][i % 3]) for i in range(600)]
    rows += [(1000 + i, " ".join(rng.choice(words, 30)), "wiki") for i in range(200)] + [(2000 + i, "the same text again", "wiki") for i in range(50)]
    rows += [(3000 + i, "short", "rare") for i in range(5)] + [(4000, None, "wiki"), (4001, "", "wiki"), (4002, "other source", "blog"), (4003, "no source", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("run_notes", 0.3, 2), ("Wiki", 0.6, 5), ("rare", 0.05, 3), ("absent", 0.05, 2)], "source string, weight double, max_repeats int")
    return docs, targets


def test_mix_reaches_its_shares(spark):
    mix = mixing.Mix(*corpus(spark), share_reposts=True)
    assert {r["source"] for r in mix.short().collect()} == {"rare", "absent"}
    got = {r["source"]: r for r in mix.shares().collect()}
    for s in ("run_notes", "Wiki"):
        assert got[s]["mix_tokens"] == pytest.approx(got[s]["target_tokens"], rel=0.02)
    assert got["rare"]["mix_tokens"] == 3 * got["rare"]["tokens"] and got["absent"]["mix_tokens"] == 0
    copies = mix.copies().collect()
    assert len({r["doc_id"] for r in copies}) == len(copies) and {r["doc_id"] for r in copies} & {4000, 4001, 4002, 4003} == set()
    caps = {"run_notes": 2, "Wiki": 5, "rare": 3}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in copies)
    # a text that is posted fifty times stands in the mix less often, each, than one that is not
    by = {r["doc_id"]: r["copies"] for r in copies}
    single, posted = np.mean([by.get(1000 + i, 0) for i in range(200)]), np.mean([by.get(2000 + i, 0) for i in range(50)])
    assert posted < single / 4
    assert sorted(map(str, mix.copies().collect())) == sorted(map(str, copies))


def test_weights_hold_up_to_the_largest_total(spark):
    docs, targets = corpus(spark)
    targets = targets.where("source != 'absent'")
    first = mixing.Mix(docs, targets)
    assert first.largest_total < first.total
    mix = mixing.Mix(docs, targets, total=first.largest_total)
    assert mix.short().count() == 0
    rows = mix.shares().collect()
    weights = sum(r["weight"] for r in rows)
    assert all(r["share"] == pytest.approx(r["weight"] / weights, abs=0.1) for r in rows)
    assert {r["source"] for r in first.short().collect()} == {"rare"}


def test_expected_copies_fill_the_target():
    e = mixing.expected_copies({0: 100.0, 1: 100.0}, 150.0, 4.0)
    assert e[0] == 2 * e[1] and e[0] * 100 + e[1] * 100 == pytest.approx(150)
    capped = mixing.expected_copies({0: 100.0, 3: 100.0}, 500.0, 4.0)
    assert capped[0] == 4 and capped[3] == pytest.approx(1.0)
    assert mixing.expected_copies({0: 10.0}, 500.0, 4.0) == {0: 4.0} and mixing.expected_copies({}, 5.0, 1.0) == {}


def test_mix_of_nothing(spark):
    docs, targets = corpus(spark)
    mix = mixing.Mix(docs.limit(0), targets)
    assert mix.copies().count() == 0 and mix.short().count() == 0 and mix.shares().count() == 4
