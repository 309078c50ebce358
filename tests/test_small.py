"""Small cases of functions that no query shows."""

import json

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import values as V
from seriesloom.operators import audit, federated, metrics, roles, runlog, sampling, trajectories, windows
from seriesloom.sources import records


def test_evaluation_order_and_limits(spark):
    df = spark.createDataFrame([(d, b) for d in "ba" for b in (2, 0, 1)], "dataset string, batch int")
    order = lambda **most: [(r.dataset, r.batch) for r in sampling.evaluation_order(df, **most).collect()]
    assert order() == [(d, b) for d in "ab" for b in range(3)]
    assert order(per_dataset=2) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)] and order(per_dataset=2, most=3) == [("a", 0), ("a", 1), ("b", 0)]


def test_classes_and_labels(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "class int, label string")
    assert {r.label for r in metrics.absent_classes(spark.createDataFrame([(0, 0), (2, 1)], "y int, yhat int"), names).collect()} == {"b"}
    assert {r.label for r in metrics.unseen_labels(spark.createDataFrame([("a",), ("z",), (None,), ("z",)], "label string"), names).collect()} == {"z"}
    pairs = spark.createDataFrame([(0, 2), (1, 1)], "y int, yhat int")
    assert metrics.confusion(pairs).count() == 9 and metrics.confusion(pairs.limit(0)).collect() == [(0, 0, 0)]


def test_weights_of_clients(spark):
    m = spark.createDataFrame([("a", 10, 2), ("a", 5, 0), ("b", 3, 4)], "client string, steps int, effective_bc int")
    plan = spark.createDataFrame([("a", "x", 0.7), ("a", "y", 0.7)], "client string, dataset string, final_client_weight double")
    got = lambda policy: {r.client: r.w for r in federated.client_weights(m, plan, policy).collect()}
    assert got("final_client_weight") == {"a": 0.7, "b": 0.0} and got("uniform") == {"a": 1.0, "b": 1.0}
    assert set(federated.client_weights(m, plan, "work").columns) == {"client", "w"} and got("work") == {"a": 25.0, "b": 12.0}


def test_diagnosis(spark):
    trends = spark.createDataFrame([("train", 4), ("val", 5)], "split string, n_multi int")
    stats = spark.createDataFrame([("train", 0), ("val", 0)], "split string, n_negative int")
    assert tuple(runlog.diagnosis(trends, stats).first()) == (True, False)
    assert tuple(runlog.diagnosis(trends.where("n_multi < 5"), stats.withColumn("n_negative", F.lit(1))).first()) == (False, True)


def test_audits_are_compared(spark):
    schema = "dataset string, n_windows long, valid_patches long"
    before = spark.createDataFrame([("a", 2, 100), ("b", 5, 0), ("gone", 1, 1)], schema)
    now = spark.createDataFrame([("a", 3, 150), ("b", 4, 10), ("new", 1, 1)], schema)
    assert [(r.dataset, r.delta_windows, r.patch_change_pct) for r in audit.compare_audits(before, now).collect()] == [("a", 1, 50.0), ("b", -1, None)]


def test_directions_policies_and_rates(spark):
    results = spark.createDataFrame([("macro_f1",), ("rmse",), ("new",)], "metric string")
    directions = spark.createDataFrame([("macro_f1", "higher"), ("rmse", "lower")], "metric string, direction string")
    assert {r.metric: r.direction for r in roles.with_direction(results, directions).collect()} == {"macro_f1": "higher", "rmse": "lower", "new": "unknown"}
    df = spark.createDataFrame([("final_client_weight", "fallback"), ("final_client_weight", "file"), ("uniform", "fallback")], "p string, o string")
    assert [r[0] for r in df.select(roles.effective_policy(F.col("p"), F.col("o"))).collect()] == ["patch_share", "final_client_weight", "uniform"]
    rates = spark.createDataFrame([("b", 1.0, None), ("a", 2.0, 3.0), ("c", None, 5.0), ("d", None, None)], "dataset string, rate double, inferred_rate double")
    assert {r.state: (r.n, r.datasets) for r in roles.sampling_rates(rates).collect()} == {"known": (2, ["a", "b"]), "inferred": (1, ["c"]), "unknown": (1, ["d"])}


def test_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dataset,n\na,1\nb,\n")
    assert [tuple(r) for r in records.read_csv(spark, str(tmp_path / "a.csv"), "dataset string, n int").collect()] == [("a", 1), ("b", None)]
    (tmp_path / "a.json").write_text(json.dumps([{"dataset": "a"}, {"dataset": "b", "n": 2}], indent=1))
    assert sorted(tuple(r) for r in records.read_json(spark, str(tmp_path / "a.json"), "dataset string, n int").collect()) == [("a", None), ("b", 2)]
    for name, text in (("x", '{"dataset": "a", "status": "ok"}'), ("y", "{broken")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "result_row.json").write_text(text)
        (tmp_path / "runs" / name / "other.json").write_text('{"dataset": "no"}')
    got = records.read_results(spark, str(tmp_path / "runs"), "dataset string, status string").cache()
    assert sorted((r.dataset or "", r.broken is not None) for r in got.collect()) == [("", True), ("a", False)]
    (tmp_path / "bank.json").write_text(json.dumps({"included": [{"name": "c1", "path": "p1"}, {"name": "c2", "path": None}]}))
    assert [tuple(r) for r in records.bank_checkpoints(spark, str(tmp_path / "bank.json")).collect()] == [("c1", "p1")]


def test_values_against_expected_ones(spark):
    runs = spark.createDataFrame([("a", "m", 1, None), ("b", "m", 2, "x")], "dataset string, mode string, n int, s string")
    expected = spark.createDataFrame([("a", "m", "n", "1"), ("a", "m", "s", "y"), ("b", "m", "n", "3"), ("b", "m", "s", "x")], "dataset string, mode string, field string, value string")
    assert {(r.dataset, r.field, r.observed, r.value) for r in records.value_check(runs, expected).collect()} == {("a", "s", None, "y"), ("b", "n", "2", "3")}


def test_arrays_hashes_and_masks(spark):
    df = spark.createDataFrame([([1.0, float("nan"), None, float("inf")], [True, False])], "a array<double>, m array<boolean>")
    row = df.select(V.finite_array(F.col("a")).alias("a"), windows.repeat_mask(F.col("m"), 3).alias("m"), V.row_hash(F.lit(1), F.lit("x")).alias("h"), V.row_hash(F.lit(2), F.lit("x")).alias("g")).first()
    assert row.a == [1.0, None, None, None] and row.m == [[True, False]] * 3 and len(row.h) == 16 and row.h != row.g


def test_targets_of_samples(spark):
    df = spark.createDataFrame([("k1", '{"target_rul_physical": 7.5}', 1.0), ("k2", "{}", 2.0)], "key string, meta string, rul double")
    assert [r[0] for r in df.select(V.pick_target("rul_physical", F.col("meta"), F.col("rul"))).collect()] == [7.5, 2.0]
    with pytest.raises(ValueError, match="unknown target"):
        V.pick_target("rul", F.col("meta"))
    with pytest.raises(Exception, match="k2 has no target"):
        df.select(V.pick_target("rul_capped_125", F.col("meta"), sample=F.col("key")).alias("t")).where("key = 'k2'").collect()


def test_errors_by_reduction(spark):
    cells = spark.createDataFrame([("a", 1.0, 3.0, True, True), ("a", 1.0, 0.0, True, True), ("a", 1.0, 9.0, False, True), ("a", 1.0, 9.0, True, False)], "g string, target double, prediction double, masked boolean, valid boolean")
    mean, total = (windows.reconstruction_error(cells, "g", reduction=r).first() for r in ("mean", "sum"))
    assert (mean.mse, mean.mae, mean.n_elements, mean.padding_ignored) == (2.5, 1.5, 2, 1) and (total.mse, total.mae, total.n_elements) == (5.0, 3.0, 2)
    assert sorted(r.mse for r in windows.reconstruction_error(cells, reduction="none").collect()) == [1.0, 4.0]
    with pytest.raises(ValueError, match="reduction"):
        windows.reconstruction_error(cells, "g", reduction="median")


def test_notes_verdicts_and_decisions(spark):
    runs = [(d, m, f, b) for d, f1, b in (("PHM18", (0.5, 0.45, 0.39), None), ("PBCP16", (0.9074, 0.8, 0.50), 64), ("CWRU", (0.3, 0.3, 0.3), None)) for m, f in zip(("from_scratch", "linear_probing", "full_finetuning"), f1, strict=True)]
    df = spark.createDataFrame(runs, "dataset string, mode string, macro_f1 double, batch_size_effective int")
    channels = spark.createDataFrame([("PHM18", 22), ("PBCP16", 1), ("CWRU", 2)], "dataset string, n_channels int")
    notes = {(r.dataset, r.mode): r.notes for r in runlog.run_notes(df, channels).collect()}
    assert notes["PHM18", "full_finetuning"] == [runlog.UNCAPPED, runlog.FORGETTING] and notes["PHM18", "linear_probing"] == [runlog.UNCAPPED]
    assert notes["PBCP16", "full_finetuning"] == [runlog.FORGETTING] and notes["CWRU", "full_finetuning"] == []
    modes = ["linear_probing", "full_finetuning_lr1e-5"]
    rmse = [(d, m, x) for d, values in (("a", (44.0, 50.0, 43.0)), ("b", (44.0, 43.9, 43.9)), ("c", (44.0, 44.0, None)), ("d", (None, 1.0, 2.0)), ("e", (3.0, None, None))) for m, x in zip(("from_scratch", *modes), values, strict=True)]
    got = {r.dataset: (r.verdict, r.best_mode) for r in runlog.transfer_verdict(spark.createDataFrame(rmse, "dataset string, mode string, rmse double"), modes).collect()}
    assert got == {"a": ("CONFIRMADA", modes[1]), "b": ("DEBIL", modes[0]), "c": ("NO_CONFIRMADA", modes[0]), "d": ("PENDIENTE", modes[0]), "e": ("PENDIENTE", None)}

    def decide(hard, other, recall):
        new = spark.createDataFrame([(d, x, recall) for d, x in (("HSG18", hard), ("CWRU", other)) if x is not None], "dataset string, macro_f1 double, recall_0 double")
        old = spark.createDataFrame([("HSG18", 0.5), ("CWRU", 0.5)], "dataset string, macro_f1 double")
        return runlog.decision(new, old, "HSG18", "CWRU").first().verdict

    assert [decide(0.6, 0.46, None), decide(0.6, 0.44, 0.5), decide(0.6, 0.5, 0.29), decide(0.52, 0.5, 0.5), decide(0.5, 0.5, 0.5), decide(0.6, None, 0.5)] == ["GO", "CONDITIONAL", "NO-GO", "CONDITIONAL", "CONDITIONAL", "NO-GO"]


def test_plot_tables(spark):
    rows = [("a", "train", u, x, t) for u, n in (("u", 3), ("v", 5)) for t, x in ((float(i), [1.0, None]) for i in range(n))]
    df = spark.createDataFrame(rows, "dataset string, split string, unit string, x array<double>, target double")
    got = {(r.plot, r.key): (r.low, r.high, r.n) for r in runlog.plot_tables(df, 2).collect()}
    assert got == {("lengths", "0"): (3.0, 4.0, 1), ("lengths", "1"): (4.0, 5.0, 1), ("targets", "0"): (0.0, 2.0, 4), ("targets", "1"): (2.0, 4.0, 4), ("missing", "0"): (0.0, None, 8), ("missing", "1"): (8.0, None, 8)}
    classes = runlog.plot_tables(df.withColumn("target", F.when(F.col("target") > 0, "x").otherwise("1"))).where("plot = 'classes'").collect()
    assert {(r.key, r.n) for r in classes} == {("x", 6), ("1", 2)}


def test_datasets_without_val_get_one(spark):
    rows = [("a", "train", s, u, "") for s in ("x", "y") for u in range(5)] + [("a", "test", "x", 99, "")] + [("b", "train", "x", u, "") for u in range(3)] + [("b", "val", "x", 7, "")] + [("c", "test", "x", 1, "")] + [("d", "train", "x", 1, "")]
    df = spark.createDataFrame(rows, "dataset string, split string, subset string, unit int, trajectory_id string")
    got = trajectories.with_validation(df, 0.2, 3, "subset").collect()
    assert len(got) == len(rows)
    splits = lambda d: sorted(r.split for r in got if r.dataset == d)
    assert splits("a") == ["test", *["train"] * 8, "val", "val"] and splits("b") == ["train"] * 3 + ["val"] and splits("c") == ["test"] and splits("d") == ["val"]
    assert all(r.trajectory_id == f"{r.dataset}__subset-{r.subset}__split-{r.split}__unit-{r.unit}" for r in got)


def test_samples_say_what_they_are(spark):
    rows = [("d", "train", 3, 0, 0, p, [float(p), 1.0], t) for p, t in enumerate((1.0, 2.0, None))]
    df = spark.createDataFrame(rows, "dataset string, split string, unit int, w_idx int, w_start int, w_pos int, x array<double>, target double")
    row = windows.sample_rows(df, 4, 2, role="PRETRAIN_SOURCE", client="c", target_col="y").first()
    assert row.valid_patch_mask == [[True, True]] * 2 and row.valid_time_mask == [True, True, True, False]
    assert (row.target.target_window, row.target.target_col, row.target.target_policy) == (2.0, "y", "ultimo_valor_valido")
    assert (row.meta.dataset, row.meta.role, row.meta.client, row.meta.split, row.meta.trajectory_id, row.meta.window_size, row.meta.patch_size, row.meta.n_rows) == ("d", "PRETRAIN_SOURCE", "c", "train", "d__train__3", 4, 2, 3)


def test_patches_of_splits(spark):
    df = spark.createDataFrame([("d", "train", u, i) for u, n in ((1, 5), (2, 20)) for i in range(n)], "dataset string, split string, unit int, pos int")
    row = trajectories.split_patches(df, 8, 4, 2).first()
    assert (row.n_rows, row.n_units, row.n_windows, row.n_valid_patches) == (25, 2, 5, 3 + 4 * 4)
