"""Sinks, sources and the analysis of run tables."""

import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from seqstates.catalog.queries import ev_type
from seqstates.conditions import condition_grid
from seqstates.plans import analysis
from seqstates.plans.sweep import fit, fitted_edges, sweep_runs
from seqstates.sources.scratch import materialize
from seqstates.sources.tables import (
    RUN_COLUMNS,
    EDGE_MODEL,
    FOLDERS,
    RUN_SCHEMA,
    append_table,
    malformed_runs,
    not_stored,
    put_edges,
    put_runs,
    put_table,
    read_runs,
    read_stored,
    read_summary,
    save_edges,
    save_table,
)


@pytest.fixture(scope="module")
def runs(spark, sf_dir):
    grid = condition_grid([0.0, 0.2])
    return materialize(sweep_runs(ev_type(spark, sf_dir), [1, 2], grid, base_process="ev"), "runs")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_append_needs_the_same_columns(spark, runs, tmp_path, fmt):
    path = str(tmp_path / "runs")
    append_table(runs.where("k = 1"), path, fmt)
    append_table(runs.where("k = 2"), path, fmt)
    back = read_runs(spark, path, fmt)
    assert back.columns == RUN_COLUMNS
    assert sorted(map(str, back.collect())) == sorted(map(str, runs.collect()))
    with pytest.raises(ValueError, match="cannot be added"):
        append_table(runs.select(*reversed(RUN_COLUMNS)), path, fmt)


def test_append_needs_the_same_types(runs, tmp_path):
    path = str(tmp_path / "runs")
    append_table(runs, path)
    with pytest.raises(ValueError, match="cannot be added"):
        append_table(runs.withColumn("k", F.col("k").cast("string")), path)


def test_runs_keyed_by_seed(spark, runs, tmp_path):
    path = str(tmp_path / "runs")
    save_table(runs.withColumnRenamed("series_id", "seed"), path, "csv")
    assert sorted(map(str, read_runs(spark, path).select(*RUN_COLUMNS).collect())) == sorted(map(str, runs.collect()))


def test_overwrite_only_with_force(spark, runs, tmp_path):
    path = str(tmp_path / "runs")
    save_table(runs, path, "csv")
    with pytest.raises(AnalysisException):
        save_table(runs, path, "csv")
    save_table(runs.where("k = 1"), path, "csv", force=True)
    assert {r.k for r in read_runs(spark, path).collect()} == {1}


def test_missing_columns_and_files(spark, runs, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_runs(spark, str(tmp_path / "none"))
    path = str(tmp_path / "runs")
    save_table(runs.drop("logloss", "k"), path, "csv")
    with pytest.raises(ValueError, match="no column k, logloss"):
        read_runs(spark, path)
    with pytest.raises(ValueError, match="no column n_states"):
        analysis.summarise(runs.drop("eps", "n_states"))


def test_edges_are_written_by_condition_and_k(spark, sf_dir, tmp_path):
    edges = fitted_edges(fit(ev_type(spark, sf_dir), [1, 2]))
    path = str(tmp_path / "edges")
    save_edges(edges, path, representation="last_2")
    back = spark.read.json(path)
    assert {r.representation for r in back.collect()} == {"last_2"}
    assert back.count() == edges.where("k = 2").count()
    assert (tmp_path / "edges" / "condition_id=flip0_sub1" / "k=2").exists()


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def texts(df):
    return sorted(map(str, df.select(*RUN_COLUMNS).collect()))


def test_store_grows_and_keeps_other_folders(spark, sf_dir, runs, tmp_path):
    path = tmp_path / "store"
    put_runs(runs, str(path))
    assert texts(read_stored(spark, str(path), RUN_SCHEMA)) == texts(runs)
    before = files(path)
    changed = runs.where("k = 2 AND flip_p = 0.2 AND series_id < 'd'").withColumn("logloss", F.lit(9.0))
    put_runs(changed, str(path))
    other = {f: t for f, t in files(path).items() if "flip0.2_sub1/representation=last_2" not in f}
    assert other == {f: t for f, t in before.items() if "flip0.2_sub1/representation=last_2" not in f}
    kept = runs.where("NOT (k = 2 AND flip_p = 0.2 AND series_id < 'd')")
    assert texts(read_stored(spark, str(path), RUN_SCHEMA)) == texts(kept.unionByName(changed))
    put_runs(changed.limit(0), str(path))
    put_runs(changed.withColumn("eps", F.lit(0.5)), str(path))  # another setting of the same models stays beside them
    assert read_stored(spark, str(path), RUN_SCHEMA).count() == runs.count() + changed.count()
    missing = not_stored(runs.withColumn("k", F.col("k") + 1), str(path), ["series_id", "condition_id", "k"])
    assert {r.k for r in missing.collect()} == {3} and not_stored(runs, str(tmp_path / "none"), ["k"]).count() == runs.count()


def test_failed_write_leaves_the_old_state(spark, runs, tmp_path):
    path = tmp_path / "store"
    put_runs(runs, str(path))
    before = files(path)
    fails = F.when(F.col("series_id") < "d", F.lit(1.0)).otherwise(F.raise_error(F.lit("no score")).cast("double"))
    with pytest.raises(Exception, match="no score"):
        put_runs(runs.withColumn("logloss", fails), str(path))
    for other in (runs.withColumn("k", F.col("k").cast("string")), runs.withColumn("more", F.lit(1))):
        with pytest.raises(ValueError, match="cannot be added"):
            put_runs(other, str(path))
    with pytest.raises(ValueError, match="has to be text"):
        put_table(runs.withColumn("condition_id", F.lit(1)), str(path), EDGE_MODEL, FOLDERS)
    assert files(path) == before and texts(read_stored(spark, str(path), RUN_SCHEMA)) == texts(runs)


def test_edges_of_a_later_representation(spark, sf_dir, tmp_path):
    path = str(tmp_path / "edges")
    plain, noisy = fitted_edges(fit(ev_type(spark, sf_dir), [1, 2])), fitted_edges(fit(ev_type(spark, sf_dir), [2], noise_seed=3))
    put_edges(plain, path, "last_2")
    put_edges(noisy, path, noisy=True)
    put_edges(plain, path, "last_1")
    found = {r.representation: r["count"] for r in spark.read.parquet(path).groupBy("representation").count().collect()}
    assert found == {"last_1": plain.where("k = 1").count(), "last_2": plain.where("k = 2").count(), "last_2_noisy": noisy.count()}


def test_folder_names_stay_text(spark, tmp_path):
    """Names that look like numbers, are empty or NULL, or hold signs."""
    path = str(tmp_path / "store")
    rows = [(c, "1e3", i, float(i)) for i, c in enumerate(["01", '{"flip_p": 0.1}', "a/b=c", None])]
    df = spark.createDataFrame(rows, "condition_id string, representation string, k int, v double")
    put_table(df, path, ["k"])
    put_table(df.where("k IN (1, 3)").withColumn("v", F.col("v") * 10), path, ["k"])
    got = sorted(((r.condition_id, r.representation, r.k, r.v) for r in read_stored(spark, path, df.schema).collect()), key=lambda r: r[2])
    assert got == [("01", "1e3", 0, 0.0), (rows[1][0], "1e3", 1, 10.0), ("a/b=c", "1e3", 2, 2.0), (None, "1e3", 3, 30.0)]


def test_seeds_keep_draws_apart(spark, sf_dir, tmp_path):
    path = str(tmp_path / "runs")
    series, noisy = ev_type(spark, sf_dir), condition_grid([0.2])
    for seed in (0, 1):
        put_runs(sweep_runs(series, [1], noisy, base_process="ev", seed=seed, keep_seeds=True), path)
    back = spark.read.parquet(path)
    assert {(r.draw_seed, r.noise_seed) for r in back.collect()} == {(0, None), (1, None)}
    assert back.groupBy("series_id", "k").count().where("count != 2").count() == 0
    assert {r.n for r in analysis.summarise(back, ["draw_seed"]).collect()} == {5} and {r.n for r in analysis.summarise(back).collect()} == {10}


@pytest.mark.parametrize("cell", ["0.x7", "1,5", "ten"])
def test_malformed_cells_are_named(spark, runs, tmp_path, cell):
    path = tmp_path / "runs"
    path.mkdir()
    header = ",".join(RUN_COLUMNS)
    good = "a,100,0.8,p,p,0.02,0.1,1,flip=0.1,c,last_1,1,one_step,0.5,2,,1.0,0.0"
    (path / "one.csv").write_text(f"{header}\n{good}\n{good.replace('0.5', cell)}\n")
    (path / "two.csv").write_text(f"{header}\n{good}\n")
    for part in (read_runs(spark, str(path)), read_runs(spark, str(path)).select("series_id")):
        with pytest.raises(Exception, match="malformed row in .*one.csv: a,100"):
            part.collect()
    kept = read_runs(spark, str(path), bad="drop").collect()
    assert len(kept) == 2 and kept[0].C_mu_empirical is None and kept[0].logloss == 0.5
    bad = malformed_runs(spark, str(path)).collect()
    assert len(bad) == 1 and bad[0].file.endswith("one.csv") and cell in bad[0].line
    with pytest.raises(ValueError, match="unknown treatment"):
        read_runs(spark, str(path), bad="ignore")


def test_malformed_texts_in_typed_files(spark, runs, tmp_path):
    path = str(tmp_path / "runs")
    runs.withColumn("logloss", F.when(F.col("k") == 1, F.lit("0.x7")).otherwise("1")).write.parquet(path)
    with pytest.raises(Exception, match="malformed row in .*: 0.x7"):
        read_runs(spark, path, "parquet").collect()
    assert read_runs(spark, path, "parquet").where("k = 2").select("k").count() == runs.where("k = 2").count()


def test_summary_statistics(spark):
    columns = ["base_process", "condition_id", "flip_p", "subsample_step", "reconstructor", "representation", "k", "series_id"]
    key = ("p", "c", 0.1, 1, "r", "last_1", 1)
    rows = [(*key, "a", 1.0, 2, None, 0.5, 0.0), (*key, "b", 2.0, 4, None, None, 0.0)]
    rows.append(("p", "c", 0.0, 1, "r", "last_1", 1, "a", 3.0, 1, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(
        [*columns, *analysis.METRICS],
        ["string", "string", "double", "int", "string", "string", "int", "string", "double", "int", "double", "double", "double"])))
    single, pair = analysis.summarise(df).collect()
    assert (single.flip_p, single.n, single.logloss_std) == (0.0, 1, 0.0)
    assert pair.n == 2 and pair.logloss_mean == 1.5 and pair.n_states_std == pytest.approx(math.sqrt(2))
    assert math.isnan(pair.C_mu_empirical_mean) and pair.C_mu_empirical_std == 0.0
    assert (pair.unifilarity_score_mean, pair.unifilarity_score_std) == (0.5, 0.0)
    assert analysis.summarise(df, ["series_id"]).count() == 3


def test_summary_round_trip_and_report(spark, runs, tmp_path):
    report = analysis.closure_report(runs)
    path = str(tmp_path / "summary")
    save_table(report["summary"], path, "csv")
    back = read_summary(spark, path)
    assert back.count() == 4
    assert sorted(map(tuple, analysis.closure_mask(back).collect())) == sorted(map(tuple, report["phase"].collect()))
    assert report["metric_vs_k"].count() == 3 * 4
    assert set(analysis.closure_report(runs, phase=False)) == {"summary", "metric_vs_k"}
    wide = analysis.phase_grid_wide(back.where("NOT (k = 2 AND flip_p = 0.2)"), [1, 2]).orderBy("flip_p").collect()
    assert wide[0]["2"] is not None and wide[1]["2"] is None
    with pytest.raises(ValueError, match="no row"):
        analysis.metric_vs_k(analysis.filter_runs(back, subsample_step=9))
    with pytest.raises(ValueError, match="no column nope_mean"):
        analysis.metric_vs_k(back, ["nope"])


def test_closure_thresholds(spark):
    rows = [(0.0, 1, 1, 0.02, 0.98), (0.0, 1, 2, 0.0201, 1.0), (0.0, 1, 3, 0.0, 0.9799), (0.0, 1, 4, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "flip_p double, subsample_step int, k int, branch_entropy_mean double, unifilarity_score_mean double")
    assert [r.closed for r in analysis.closure_mask(df).orderBy("k").collect()] == [True, False, False, False]
    assert analysis.phase_grid(df, "branch").columns[-1] == "branch_entropy"
    assert analysis.phase_grid(df, "omu").columns[-1] == "one_minus_unifilarity"
