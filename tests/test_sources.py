"""Raw files to windowed features, and writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import features, fusion, mixed, physiology, windows
from tidewave.sources import recordings, sinks

GSR = "Shimmer_AD66_GSR_Skin_Conductance_CAL"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "participant_info.csv").write_text("﻿Participant ID , session01,session02, session03\n3101,L,M,H\n3208,H,-,M\n")
    gsr = root / "gsr"
    gsr.mkdir()
    rows = [f"{1 + 0.01 * i},2024/01/01 10:00:{i // 20:02d}.{i % 20 * 50:03d}" for i in range(160)]
    (gsr / "3101_session01.csv").write_text("\n".join([f"{GSR},Shimmer_AD66_Timestamp_FormattedUnix_CAL", *rows]))
    other = [f"{i / 20},{2.0 if i % 2 else 'x' if i == 40 else 4.0}" for i in range(80)]  # another header, a value that isn't a number
    (gsr / "3208_session03.csv").write_text("\n".join([f"elapsed_seconds,{GSR}", *other]))
    (gsr / "bad.csv").write_text(f"{GSR}\n1.0\n")
    (gsr / "3208_session01.csv").write_text("nothing,here\n1,2\n")
    ecg = root / "ecg"
    ecg.mkdir()
    (ecg / "3208_ecg_session01.csv").write_text("Time,EcgWaveform\n31/01/2024 09:00:00.004,5\n31/01/2024 09:00:00.008,\n")
    (ecg / "3208_summary_session01.csv").write_text("Time,HeartRate,Ext.Status,GSR\n31/01/2024 09:00:01.000,70,0,1\n")
    eye = root / "eye"
    eye.mkdir()
    head = "R Gaze X,R Gaze Y,L Gaze X,L Gaze Y,R Pupil Size,L Pupil Size,Time Stamp"
    (eye / "3101_session02.csv").write_text("\n".join([head, "100,200,110,210,3,3,0.0", "100,200,110,210,0,3,0.1", "100,200,110,210,0,0,0.2", "a,200,110,210,3,3,0.3"]))
    matb = root / "matb"
    matb.mkdir()
    (matb / "3101_session03.csv").write_text("scenario_time,type,module,address,value\n1.5,event,sysmon,lights-1-failure,1\n2.0,state,x,y,0\n3.0,performance,tracking,cursor_in_target,0\n")
    return root


def test_gsr_files_to_windowed_features(spark, raw):
    scanned = recordings.scan(spark, str(raw / "gsr"), "gsr")
    good, rejects = recordings.split_rejects(scanned, "gsr")
    assert [tuple(r) for r in rejects.collect()] == [("bad.csv", "name")]
    assert [r["file"] for r in recordings.files_without_rows(spark, str(raw / "gsr"), scanned).collect()] == ["3208_session01.csv"]
    samples = recordings.numeric(good, [GSR]).withColumnRenamed(GSR, "eda")
    frames = {(r["participant"], r["trial"], r["frame"]): r["eda"] for r in samples.collect()}
    assert len(frames) == 240 and frames["3101", 1, 159] == pytest.approx(2.59) and frames["3208", 3, 40] is None and frames["3208", 3, 1] == 2.0
    info = recordings.participant_info(spark, str(raw / "gsr"))  # lies in the folder above
    conditions = fusion.condition_map(info, "Participant ID", ["session01", "session02", "session03"])
    known, unknown = fusion.with_condition(samples, conditions)
    assert unknown.count() == 0
    dealt = windows.by_count(known.withColumns({"tonic": F.col("eda"), "peak": F.lit(False)}), ["participant", "condition"], ["frame"], 40, 20)
    found = {(r["participant"], r["condition"], r["window_index"]): r for r in physiology.eda(dealt, ["participant", "condition", "window_index"], ["frame"], "peak", "eda", "tonic", "eda").collect()}
    assert {k for k in found if k[0] == "3101"} == {("3101", "L", i) for i in range(7)}
    assert found["3101", "L", 0]["eda_tonic_sd"] == pytest.approx(np.std(0.01 * np.arange(40), ddof=1)) and found["3101", "L", 3]["eda_autocorrelation"] == pytest.approx(1)
    # the missing value lies in windows 1 and 2 of the other recording
    assert {k for k in found if k[0] == "3208"} == {("3208", "M", 0)} and found["3208", "M", 0]["eda_autocorrelation"] == pytest.approx(-1)
    times = recordings.timed(good.where("participant = '3101'"), "Shimmer_AD66_Timestamp_FormattedUnix_CAL", "gsr")
    assert times.where("frame = 21").first()["time_of_day"] == "10:00:01.050000"


def test_other_recordings(spark, raw):
    waves, summaries = recordings.ecg_pair(spark, str(raw / "ecg"))
    assert [(r["participant"], r["trial"], r["EcgWaveform"], r["time_of_day"]) for r in waves.orderBy("frame").collect()] == [("3208", 1, 5.0, "09:00:00.004000"), ("3208", 1, None, "09:00:00.008000")]
    assert "Ext.Status" not in summaries.columns and "GSR" not in summaries.columns and summaries.first()["HeartRate"] == "70"
    eye = recordings.numeric(recordings.scan(spark, str(raw / "eye"), "eye"), recordings.NEEDED["eye"])
    assert [r["R Gaze X"] for r in eye.orderBy("frame").collect()] == [100, 100, 100, None] and recordings.split_rejects(eye, "eye")[1].count() == 0
    log = recordings.matb_log(spark, str(raw / "matb"))
    assert sorted((r["scenario_time"], r["value"]) for r in log.collect()) == [(1.5, "1"), (3.0, "0")]
    orders = features.condition_orders(recordings.participant_info(spark, str(raw)), "Participant ID", ["session01", "session02", "session03"])
    assert [tuple(r) for r in orders.collect()] == [("3101", "LMH")]
    with pytest.raises(FileNotFoundError):
        recordings.participant_info(spark, str(raw), "nobody.csv")


def test_landmark_columns_are_found_whatever_their_case():
    columns = ["X37", "y37", "PROB37", "x46", "Y46", "prob46", "x3"]
    assert recordings.landmark_columns(columns, [37, 46]) == {"x37": "X37", "y37": "y37", "c37": "PROB37", "x46": "x46", "y46": "Y46", "c46": "prob46"}
    with pytest.raises(ValueError, match="x4"):
        recordings.landmark_columns(columns, [4])


def test_stages_are_resumed_and_widened(spark, tmp_path):
    path, made = str(tmp_path / "stage"), []

    def make():
        made.append(1)
        return spark.createDataFrame([("a", "L", 1.0)], "participant string, condition string, x double")

    for _ in range(2):
        assert sinks.stage(spark, path, ["participant", "condition"], make).count() == 1
    assert len(made) == 1
    sinks.append_widening(spark.createDataFrame([("b", "L", 2.0, 3.0)], "participant string, condition string, x double, y double"), path, ["participant", "condition"])
    (wide,) = recordings.feature_tables(spark, [path])
    assert sorted((r["participant"], r["y"]) for r in wide.collect()) == [("a", None), ("b", 3.0)]
    with pytest.raises(FileNotFoundError):
        recordings.feature_tables(spark, [str(tmp_path / "none")])
    assert [tuple(r)[:2] for r in recordings.stage_status(spark, {"one": path, "two": str(tmp_path / "two")}).collect()] == [("one", True), ("two", False)]
    sinks.export_sorted(wide, str(tmp_path / "csv"), ["participant"])
    (csv,) = (tmp_path / "csv").glob("*.csv")
    assert [line.split(",")[0] for line in csv.read_text().split()] == ["x", "1.0", "2.0"]


def test_results_and_runs_are_read_back(spark, tmp_path):
    (tmp_path / "pose_all.json").write_text(json.dumps({"experiment_name": "e", "accuracy": 0.5, "learning_curve": {"aggregated": [{"train_size": 2, "mean": 0.4}, {"train_size": 4, "mean": 0.6}]}}, indent=1))
    found = recordings.results(spark, str(tmp_path))
    assert found.first()["model"] == "pose_all"
    assert [tuple(r) for r in sinks.learning_curve_rows(found).select("experiment_name", "train_size", "mean").where("train_size >= 3").collect()] == [("e", 4, 0.6)]
    sinks.write_documents(found, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).first()["learning_curve"]["aggregated"][1]["mean"] == 0.6
    log = str(tmp_path / "log")
    for seeds in (5, 10):
        sinks.record_run(spark, log, {"pose": "global", "n_seeds": seeds, "use_pca": False, "order": None})
    assert sinks.matching_runs(spark, log, {"pose": "global", "use_pca": False, "order": None}).count() == 2
    assert sinks.matching_runs(spark, log, {"n_seeds": 5}).count() == 1 and sinks.matching_runs(spark, log, {"use_pca": True}).count() == 0


def test_long_table_has_its_frame(spark):
    wide = spark.createDataFrame([("a_b", 1.0, 0.5, 0.0001), ("c", 2.0, 0.25, 0.03)], "f string, m double, s double, p double")
    lines = sinks.latex_table(sinks.latex_rows(wide, "f", [("m", "s")], ["p"]), ["Feature", "L", "p"], "Means", "tab:m")
    assert lines[0] == r"\begin{longtable}{lcc}" and lines[3] == r"Feature & L & p \\" and lines[-1] == r"\end{longtable}"
    assert r"a\_b & 1.00 $\pm$ 0.50 & <.001*** \\" in lines


def test_mixed_model_equals_a_plain_fit(spark):
    rng = np.random.default_rng(4)
    rows = [(g, c, float(d), float(i + 0.3 * d + u + rng.normal())) for g in range(30) for u in [rng.normal() * 2] for i, c in enumerate("LMH") for d in range(4)]
    df = spark.createDataFrame(rows, "g long, c string, d double, y double")
    found = {r["condition"]: r for r in mixed.estimated_means(df, "g", ["y"], "c", ["L", "M", "H"], ["d"]).collect()}
    # by brute force: profile the restricted likelihood with the whole covariance matrix
    g, y = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    x = np.array([[r[1] == c for c in "LMH"] + [r[2]] for r in rows], float)

    def fit(ratio):
        v = np.eye(len(y)) + ratio * (g[:, None] == g[None, :])
        w = np.linalg.inv(v)
        xx = x.T @ w @ x
        beta = np.linalg.solve(xx, x.T @ w @ y)
        s2 = (y - x @ beta) @ w @ (y - x @ beta) / (len(y) - 4)
        return -0.5 * ((len(y) - 4) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1]), beta, s2 * np.linalg.inv(xx)

    _, beta, cov = max((fit(r) for r in np.geomspace(0.5, 12, 60)), key=lambda f: f[0])
    for i, c in enumerate("LMH"):
        at = np.array([*np.eye(3)[i], 1.5])
        assert found[c]["mean"] == pytest.approx(at @ beta, abs=0.01) and found[c]["se"] == pytest.approx(np.sqrt(at @ cov @ at), rel=0.05)
        assert found[c]["high"] - found[c]["low"] == pytest.approx(2 * mixed.t_quantile(0.05, found[c]["df"]) * found[c]["se"])
