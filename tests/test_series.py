"""Hand-computed cases of the series operators."""

import io
import json
import math
import tarfile
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import values as V
from seriesloom.operators import audit, federated, lifetime, metrics, roles, runlog, sampling, trajectories, windows
from seriesloom.sources import archives, records, samples, sensors, store
from seriesloom.streaming import follow


def lengths(spark, *ns):
    return spark.createDataFrame([(n,) for n in ns], "n int")


@pytest.mark.parametrize(("n", "pad", "drop", "last"), [(1, 1, 1, 1), (511, 1, 1, 511), (512, 1, 1, 512), (513, 2, 1, 1), (768, 2, 2, 512), (800, 3, 2, 32)])
def test_window_counts(spark, n, pad, drop, last):
    c = audit.window_counts(F.col("n"), 512, 256, 16)
    d = audit.window_counts(F.col("n"), 512, 256, 16, "drop")
    row = lengths(spark, n).select(c["n_windows"].alias("a"), d["n_windows"].alias("b"), c["valid_patches"].alias("v")).first()
    assert (row.a, row.b) == (pad, drop) and row.v == 32 * (pad - 1) + math.ceil(last / 16)


@pytest.mark.parametrize(
    ("n", "stride", "least", "keep", "places", "dropped", "added"),
    [
        (200, 5, 128, True, [*range(127, 200, 5), 199], 26, 1),
        (200, 5, None, True, [*range(0, 200, 5), 199], 0, 1),
        (128, 1, 128, True, [127], 127, 0),
        (50, 5, 128, True, [49], 0, 1),
        (50, 5, 128, False, [], 50, 0),
    ],
)
def test_emission(spark, n, stride, least, keep, places, dropped, added):
    d, a = windows.emission_counts(F.col("n"), stride, least, keep)
    row = lengths(spark, n).select(windows.emission_places(F.col("n"), stride, least, keep).alias("p"), d.alias("d"), a.alias("a")).first()
    assert (row.p, row.d, row.a) == (places, dropped, added)


def series(spark, n, values=None):
    rows = [("u", i, [float(i), 7.0] if values is None else [values[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "unit string, pos int, x array<double>")


@pytest.mark.parametrize("n", [5, 8, 9, 20, 21])
def test_tiles_equal_enumeration(spark, n):
    got = windows.tile(series(spark, n), ["unit"], 8, 4).groupBy("w_idx", "w_start").agg(F.sort_array(F.collect_list("pos")).alias("p")).orderBy("w_idx").collect()
    starts = [0] if n <= 8 else list(range(0, n - 8 + 1, 4))
    if n > 8 and starts[-1] + 8 < n:
        starts.append(starts[-1] + 8)
    assert [(r.w_start, r.p) for r in got] == [(s, list(range(s, min(s + 8, n)))) for s in starts]


@pytest.mark.parametrize("n", [3, 10, 23])
def test_rolling_equals_enumeration(spark, n):
    got = windows.roll(series(spark, n), ["unit"], 8, 3, 4).groupBy("w_end").agg(F.sort_array(F.collect_list("pos")).alias("p"), F.max("w_pos").alias("m")).collect()
    ends = sorted({*range(3, n, 3), n - 1})
    assert {r.w_end: r.p for r in got} == {e: list(range(max(0, e - 7), e + 1)) for e in ends} and all(r.m == 7 for r in got)


def test_normalization_policies(spark):
    rows = windows.tile(series(spark, 4), ["unit"], 8, 4)
    got = {(r.channel, r.w_pos): r for r in windows.normalize(rows, ["unit", "w_idx"]).collect()}
    assert got[0, 0].mean == 1.5 and abs(got[0, 0].z + 1.5 / math.sqrt(1.25)) < 1e-12
    assert got[1, 0].constant and got[1, 0].z == 0 and got[1, 0].std_used == 1
    rolled = {r.channel: r for r in windows.normalize(rows, ["unit", "w_idx"], "rolling").where("w_pos = 1").collect()}
    assert rolled[1].constant and rolled[1].z == 0 and rolled[1].std_used == 1e-6
    one = windows.normalize(windows.tile(series(spark, 1), ["unit"], 8, 4), ["unit", "w_idx"]).where("channel = 1").first()
    assert (one.mean, one.std_used, one.z, one.constant) == (0.0, 1.0, 7.0, False)


def test_patches_and_masks(spark):
    rows = windows.normalize(windows.tile(series(spark, 5), ["unit"], 8, 4), ["unit", "w_idx"])
    p = windows.patches(rows, ["unit", "w_idx"], 8, 4).first()
    assert [len(c) for c in p.patches] == [2, 2] and p.valid_time == [True] * 5 + [False] * 3 and p.valid_patch == [True, True]
    part = spark.createDataFrame([(p.valid_time,)], "m array<boolean>").select(windows.partial_patches(F.col("m"), 4, 2).alias("x")).first().x
    assert part == [False, True]
    with pytest.raises(ValueError):
        windows.patches(rows, ["unit"], 10, 4)


def test_interpolation_and_sparse(spark):
    rows = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0), ("a", 4, None), ("b", 0, None)], "unit string, pos int, v double")
    got = {(r.unit, r.pos): r.v_filled for r in trajectories.interpolate(rows, ["unit"], ["v"]).collect()}
    assert [got["a", i] for i in range(5)] == [2, 2, 3, 4, 4] and got["b", 0] is None
    kept = trajectories.drop_sparse(rows.withColumn("x", F.array("v")), ["unit"], 0.7)
    assert {r.unit for r in kept.collect()} == {"a"}


def test_lifetime(spark):
    rows = spark.createDataFrame([(1, c) for c in range(1, 6)], "unit long, cycle long")
    official = spark.createDataFrame([(1, 10), (2, 3)], "unit long, rul int")
    assert [r.rul for r in lifetime.train_life(rows, ["unit"]).orderBy("cycle").collect()] == [4, 3, 2, 1, 0]
    assert [r.rul for r in lifetime.test_life(rows, official, ["unit"]).orderBy("cycle").collect()] == [14, 13, 12, 11, 10]
    assert lifetime.unmatched(rows, official, ["unit"]).collect()[0].missing == "unit"


def test_hold_out_counts_and_is_stable(spark):
    units = spark.createDataFrame([(f"u{i}", i % 2) for i in range(12)] + [("z", 9)], "unit string, g int")
    held = lambda: {r.unit for r in trajectories.hold_out(units.repartition(3), ["unit"], 0.2, 42, ["g"]).where("held").collect()}
    assert held() == held() and len(held()) == 3


def test_kurtosis_correction(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 9)], "v double")
    assert abs(df.agg(audit.corrected_kurtosis("v")).first()[0] + 2.680) < 1e-3


def water(weights, caps):
    """The fixed point by iteration."""
    out, free = {}, dict(weights)
    left = 1.0
    while free:
        total = sum(free.values())
        over = [k for k, w in free.items() if w / total * left > caps[k] + 1e-15]
        if not over:
            return out | {k: w / total * left for k, w in free.items()}
        for k in over:
            out[k] = caps[k]
            left -= caps[k]
            del free[k]
    return out


def test_caps_equal_iteration(spark):
    w = {f"d{i}": x for i, x in enumerate((50.0, 20.0, 10.0, 8.0, 5.0, 3.0, 2.0, 1.0, 0.5, 0.5))}
    df = sampling.normalized(spark.createDataFrame(list(w.items()), "dataset string, patches double"), "patches", out="w")
    got = {r.dataset: r.capped for r in sampling.cap_weights(df, "w", F.lit(0.15), "dataset").collect()}
    want = water({k: x / 100 for k, x in w.items()}, dict.fromkeys(w, 0.15))
    assert all(abs(got[k] - want[k]) < 1e-12 for k in w)
    low = {r.dataset: r.capped for r in sampling.cap_weights(df, "w", F.lit(0.05), "dataset").collect()}
    assert all(abs(x - 0.1) < 1e-12 for x in low.values())
    lifted = {r.dataset: r.floored for r in sampling.floor_weights(df, "w", 0.02, "dataset").collect()}
    assert abs(sum(lifted.values()) - 1) < 1e-12 and min(lifted.values()) == 0.02


def test_plan_invariants(spark):
    rows = [(f"d{i}", f"c{i % 4}" if i < 20 else "big", float(2**i % 9973 + 1)) for i in range(36)]
    plan = sampling.sampling_plan(spark.createDataFrame(rows, "dataset string, client string, patches double"), min_dataset=0.001, steps=100)
    got = plan.collect()
    assert len(got) == 36 and abs(sum(r.final_dataset_weight for r in got) - 1) < 1e-9
    assert all(0.001 - 1e-12 <= r.final_dataset_weight <= 0.10 + 1e-9 for r in got)
    clients = {r.client: r.final_client_weight for r in got}
    assert all(0.005 <= w <= 0.26 for w in clients.values()) and abs(sum(clients.values()) - 1) < 1e-9


def test_classification(spark):
    y, yhat = [0, 1, 2, 3, 0, 1, 2, 3], [0, 1, 2, 3, 0, 1, 2, 0]
    m = metrics.confusion(spark.createDataFrame(list(zip(y, yhat, strict=True)), "y int, yhat int"), 4)
    row = metrics.classification(m).first()
    assert round(row.macro_f1, 4) == 0.8667 and row.accuracy == 7 / 8 and row.balanced_accuracy == 0.875
    empty = metrics.classification(metrics.confusion(spark.createDataFrame([], "y int, yhat int"), 3)).first()
    assert (empty.accuracy, empty.macro_f1) == (0, 0)
    with pytest.raises(Exception, match="class out of range"):
        metrics.confusion(spark.createDataFrame([(5, 0)], "y int, yhat int"), 3).collect()


def test_regression(spark):
    df = lambda rows: spark.createDataFrame(rows, "y double, yhat double")
    row = metrics.regression(df([(1.0, 2.0), (3.0, 2.0)])).first()
    assert (row.mae, row.rmse, row.r2) == (1, 1, 0) and abs(row.score - (math.exp(0.1) + math.exp(1 / 13) - 2)) < 1e-12
    assert metrics.regression(df([(2.0, 2.0)])).first().r2 == 1 and metrics.regression(df([(2.0, 3.0)])).first().r2 == 0
    none = metrics.regression(df([])).first()
    assert (none.mae, none.rmse, none.r2, none.score) == (0, 0, 0, 0)


def test_weighted_loss(spark):
    rows = [("a", "x", 1.0, 100, 1), ("a", "x", 2.0, 300, 1), ("b", "y", float("nan"), 50, 2), ("b", "y", 9.0, 0, 4)]
    got = metrics.weighted_losses(spark.createDataFrame(rows, "dataset string, client string, loss double, n_elements long, batch_cost long"))
    row = got.where("level = 'all'").first()
    assert (row.loss, row.n_batches, row.n_nonfinite, row.n_datasets) == (1.75, 4, 1, 2)


def test_values(spark):
    row = spark.createDataFrame([(1.0, -2.5, float("nan"), "Å-1 b", True, None)], "a double, b double, c double, d string, e boolean, f string").select(
        V.slug(F.col("a"), "double"), V.slug(F.col("b"), "double"), V.slug(F.col("c"), "double"), V.slug(F.col("d"), "string"), V.slug(F.col("e"), "boolean"), V.slug(F.col("f"), "string"),
        V.finite(F.col("c")), V.label_text(F.col("a"), "double"), V.label_text(F.col("e"), "boolean"), V.first_target(F.col("c"), F.col("b")),
    ).first()
    assert tuple(row) == ("1", "n2p5", "none", "Å_1_b", "true", "none", None, "1", "1", -2.5)
    assert V.config_hash({"b": 1, "a": 2}) == V.config_hash({"a": 2, "b": 1}) != V.config_hash({"a": 2, "b": 1}, compact=True)


def test_federated(spark):
    states = spark.createDataFrame([("a", "w", 0, 1.0), ("b", "w", 0, 4.0), ("a", "w", 1, 0.0), ("b", "w", 1, 3.0)], "client string, param string, idx int, value double")
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "client string, w double")
    mean = federated.mean_state(states, weights)
    assert {r.idx: r.value for r in mean.collect()} == {0: 2.0, 1: 1.0}
    assert federated.state_faults(states, weights).count() == 0
    short = states.where("not (client = 'b' and idx = 1)")
    assert {r.fault for r in federated.state_faults(short, weights).collect()} == {"shape"}
    assert {r.fault for r in federated.state_faults(states.where("client = 'a'"), weights.withColumn("w", -F.col("w"))).collect()} == {"missing", "negative weight", "zero sum"}
    zero = mean.withColumn("value", F.lit(0.0))
    once = federated.momentum(zero, None, mean, 0.5)
    twice = federated.momentum(once, once, mean, 0.5)
    assert {r.idx: r.value for r in twice.collect()} == {0: 5.0, 1: 2.5}
    assert abs(federated.drift(states, mean).where("client = 'b'").first().l2 - math.sqrt(8)) < 1e-12


def test_log_source_and_stream(spark, tmp_path):
    lines = ['{"step": 0, "dataset": "d", "loss": 1.0, "grad_norm": 1.0}', '{"step": 1, "dataset": "d", "loss": 1.0, "grad_norm": Infinity}', '{"step": 2, "dataset": "d", "loss": 2.0, "grad_norm": NaN}', '{"step": 3, "dataset": "d", "loss": 5000.0}', '{"kind": "distribution", "dataset": "d"}', "", "{broken"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "metrics.jsonl").write_text("\n".join(lines))
    log = records.read_log(spark, str(tmp_path / "in")).cache()
    row = records.log_overview(log).first()
    assert (row.n_lines, row.n_broken, row.n_steps, row.n_other) == (6, 1, 4, 1)
    assert {(r.kind, r.n) for r in runlog.nonfinite_counts(log, ["loss", "grad_norm"], "dataset").collect()} == {("inf", 1), ("nan", 1)}
    assert runlog.huge_losses(log).count() == 1
    query = follow.nonfinite_stream(follow.follow_log(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("nonfinite").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.kind, r.n) for r in spark.table("nonfinite").collect()} == {("inf", 1), ("nan", 1)}
    q = follow.bucket_statistics_stream(follow.follow_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), [(0, 2), (2, 10)], str(tmp_path / "ck"))
    q.awaitTermination(120)
    stats = {r.bucket: r for r in follow.bucket_statistics(follow.read_pages(spark, str(tmp_path / "out"))).collect()}
    assert stats["0-2"].n == 2 and stats["2-10"].high == 5000.0


def test_sensor_text(spark, tmp_path):
    good = ["{} {} {} ".format(u, c, " ".join(f"{x:.4f}" for x in range(24))) for u in (1, 2) for c in (1, 2, 3)]
    (tmp_path / "train_FD001.txt").write_text("\n".join([*good, "1 2 3", "x 1 " + "0 " * 24, "2 3 " + "0 " * 24]) + "\n")
    (tmp_path / "RUL_FD001.txt").write_text("10\n20\n")
    rows = sensors.read_sensor_text(spark, str(tmp_path / "train_FD001.txt"), "FD001", "test")
    assert {r.fault: r.n for r in rows.groupBy("fault").agg(F.count("*").alias("n")).collect()} == {None: 7, "columns": 1, "unit": 1}
    clean = rows.where("fault is null")
    assert sensors.order_faults(clean).count() == 1 and len(clean.first().sensors) == 21
    official = sensors.read_official_life(spark, str(tmp_path / "RUL_FD001.txt"), "FD001")
    assert [(r.unit_id, r.rul) for r in official.orderBy("unit_id").collect()] == [(1, 10), (2, 20)]
    assert sensors.life_faults(clean, official).count() == 0
    inventory = sensors.raw_inventory(spark, str(tmp_path)).where("fd = 'FD001'").first()
    assert (inventory.train, inventory.test, inventory.RUL) == (1, 0, 1)


def test_groups_in_three_shapes(spark):
    shapes = {"a": {"datasets": [{"dataset": "x", "n_windows": 3}]}, "b": {"datasets": {"y": {"n_windows": 4}}}, "c": {"datasets": ["z"]}}
    df = spark.createDataFrame([(json.dumps({"clients": shapes}),)], "json string")
    got = {(r.client, r.dataset, r.n_windows) for r in records.flatten_groups(df).collect()}
    assert got == {("a", "x", 3), ("b", "y", 4), ("c", "z", 0)}


def sample_rows(spark, c=2, n=4, p=8):
    rows = [("d", s, f"k.{s}{i}", f"u{i % 2}", float(i), [[[0.0] * p] * n] * c, [True] * (n * p)) for s in ("train", "val") for i in range(3)]
    return spark.createDataFrame(rows, "dataset string, split string, key string, unit string, target double, patches array<array<array<double>>>, valid_time_mask array<boolean>")


def test_store_of_versions(spark, tmp_path):
    path, df = str(tmp_path / "out"), sample_rows(spark)
    config, other = {"window": 32}, {"window": 64}
    publish = lambda rows, c, **more: store.publish(rows, path, c, V.config_hash(c), **more)
    with pytest.raises(ValueError, match="nothing"):
        store.history(spark, path)
    assert [publish(df, config), publish(df, config)] == [1, 0]
    back = store.read(spark, path, df.schema, "d", "val")
    assert back.count() == 3 and tuple(samples.check_shapes(back, 2, 4, 8).first()) == (3, 0, 0, 0) and samples.check_shapes(back, 3, 4, 8).first().n_shape == 3
    m = store.history(spark, path)
    assert samples.manifest_summary(m).first().n_units == 4 and samples.manifest_differences(m, m, ["n_samples"]).count() == 0
    wanted = spark.createDataFrame([("d", V.config_hash(config)), ("e", "x")], "dataset string, config_hash string")
    assert {r.dataset: r.action for r in samples.planned_actions(wanted, m).collect()} == {"d": "SKIP", "e": "PROCESS"}
    assert {r.dataset: (r.action, r.reason) for r in store.actions(spark, path, wanted).collect()} == {"d": ("SKIP", "up to date"), "e": ("PROCESS", "no manifest")}
    # a split that is dropped is gone, and this settles
    assert [publish(df.where("split = 'train'"), other) for _ in range(3)] == [1, 0, 0]
    assert {r.split for r in store.read(spark, path, df.schema).collect()} == {"train"} and store.read(spark, path, df.schema, version=1).count() == 6
    # a run that broke off shows nothing, and does no harm
    store.stage(df, path, "broken")
    assert store.read(spark, path, df.schema).count() == 3 and store.damaged_files(spark, path).count() == 0
    assert publish(df.where("split = 'train'"), other) == 0
    with pytest.raises(ValueError, match="another configuration"):
        publish(df, config, strict=True)
    assert publish(df, other, force=True) == 1 and store.read(spark, path, df.schema).count() == 6
    assert {(r.version, r.n_units, r.n_files, r.n_warnings) for r in store.summary(store.history(spark, path)).collect()} == {(3, 4, 2, 0)}
    assert store.expire(spark, path, keep=2, also_runs=["broken"]) == 2
    assert store.read(spark, path, df.schema, version=2).count() == 3


def test_store_names_lost_and_changed_files(spark, tmp_path):
    path, df = str(tmp_path / "out"), sample_rows(spark).withColumn("dataset", F.when(F.col("split") == "val", "a b/c").otherwise("d"))
    config = {"window": 32}
    metrics = lambda x: spark.createDataFrame([("d", {"n": x}), ("a b/c", {"other": 1.0})], "dataset string, metrics map<string, double>")
    publish = lambda **more: store.publish(df, path, config, V.config_hash(config), **more)
    assert [publish(metrics=metrics(7.0)), publish(metrics=metrics(7.0009)), publish(metrics=metrics(7.002)), publish(metrics=metrics(7.002))] == [2, 0, 1, 0]
    assert {r.dataset: r.version for r in store.current(store.history(spark, path)).collect()} == {"d": 2, "a b/c": 1}
    run = store.current(store.history(spark, path)).where("dataset = 'd'").first().run
    (file,) = (tmp_path / "out" / "data" / f"run={run}" / "dataset=d" / "split=train").glob("*.parquet")
    content = file.read_bytes()
    spark.createDataFrame(df.where("dataset = 'd'").drop("dataset", "split").withColumn("target", F.lit(9.0)).collect(), df.drop("dataset", "split").schema).coalesce(1).write.parquet(str(tmp_path / "x"))
    file.with_name(f".{file.name}.crc").unlink()
    file.write_bytes(next((tmp_path / "x").glob("*.parquet")).read_bytes())
    assert {(r.dataset, r.fault) for r in store.damaged_files(spark, path, True, df.schema).collect()} >= {("d", "content")}
    file.write_bytes(content[:-1])
    assert {(r.dataset, r.fault) for r in store.damaged_files(spark, path).collect()} == {("d", "size")}
    file.unlink()
    (file.parent / "more.parquet").write_bytes(content)
    assert sorted((r.dataset, r.split, r.fault) for r in store.damaged_files(spark, path).collect()) == [("d", "train", "missing"), ("d", "train", "not listed")]
    assert publish() == 1 and publish() == 0 and store.read(spark, path, df.schema).count() == 6
    assert samples.mixed_batches(df.withColumn("batch", F.lit(0))).count() == 0
    assert samples.inspect(df, 2).count() == 2


def npy(a):
    held = io.BytesIO()
    np.save(held, a)
    return held.getvalue()


def full_sample(key, c=2, n=4, p=8):
    """A sample as FIXTURES.md has it."""
    arrays = {
        "patches": np.zeros((c, n, p), np.float32),
        "valid_time_mask": np.ones(n * p, bool),
        "valid_patch_mask": np.ones((c, n), bool),
        "mean": np.zeros(c, np.float32),
        "std_used": np.ones(c, np.float32),
        "canales_constantes_mask": np.zeros(c, bool),
    }
    meta = {"dataset": "FAKE", "role": "PRETRAIN_SOURCE", "client": "misc"}
    return {f"{key}.{k}.npy": npy(a) for k, a in arrays.items()} | {f"{key}.target.json": b'{"target_window": 1.0}', f"{key}.meta.json": json.dumps(meta).encode()}


def write_tar(path, members, form=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=form) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_archived_sample_decodes(spark, tmp_path):
    write_tar(tmp_path / "ds-train-000000.tar", [*full_sample("unit.001_w000001").items(), ("note.txt", b"1")])
    for rows in (archives.read_archives(spark, str(tmp_path)), samples.import_archives(spark, str(tmp_path / "*.tar"))):
        got = archives.decode_samples(rows).first()
        assert got.key == "unit.001_w000001" and np.array(got.patches).shape == (2, 4, 8) and got.valid_patch_mask == [[True] * 4] * 2
        assert got.valid_time_mask == [True] * 32 and got.mean == [0.0, 0.0] and got.std_used == [1.0, 1.0] and got.constant == [False, False]
        assert json.loads(got.target) == {"target_window": 1.0} and json.loads(got.meta)["dataset"] == "FAKE" and got.rul_physical is None
    assert archives.read_archives(spark, str(tmp_path)).where("key is null").first().unknown == ["note.txt"]


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])
def test_archives_are_read_in_ranges(spark, tmp_path, form):
    keys = ["a.b.c_w000001", "x.y_w000002", "plain_key_w000003", *(f"k{i:03d}" for i in range(40))]
    keys += [f"{'long.' * 30}{i}" for i in range(3)] if form != tarfile.USTAR_FORMAT else []
    members = [m for k in keys for m in full_sample(k, n=1 + len(k) % 5).items()]
    late = full_sample("apart")  # a sample whose last member stands at the end
    members = [*list(late.items())[:-1], *members[:60], ("readme", b"x" * 5000), *members[60:200], list(late.items())[-1], *members[200:]]
    path = str(tmp_path / "a.tar")
    write_tar(path, members, form)
    ranges = archives.find_ranges(path, 20_000)
    assert len(ranges) > 3 and ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    write_tar(tmp_path / "b.tar", full_sample("other").items(), form)
    write_tar(tmp_path / "c.tar", [], form)
    df = archives.read_archives(spark, str(tmp_path / "*.tar"), range_bytes=20_000)
    assert df.rdd.getNumPartitions() == len(ranges) + 1
    want = {}
    for name, data in [*members, *full_sample("other").items()]:
        key, field = archives.split_member(name)
        if field:
            want.setdefault(key, {})[field] = data
    got = df.where("key is not null").collect()
    assert {r.key: {f: bytes(b) for f, b in r.fields.items()} for r in got} == want and len(got) == len(want)
    assert [r.unknown for r in df.where("key is null").collect()] == [["readme"]]
    assert archives.decode_samples(df).count() == len(want)


def test_archives_that_lack_fields(spark, tmp_path):
    members = dict(full_sample("k"))
    del members["k.valid_patch_mask.npy"], members["k.mean.npy"]
    members["k.rul_physical.npy"] = npy(np.array(7.5))
    write_tar(tmp_path / "a.tar", members.items())
    with pytest.raises(Exception, match="lacks"):
        archives.read_archives(spark, str(tmp_path / "a.tar")).collect()
    row = archives.decode_samples(archives.read_archives(spark, str(tmp_path / "a.tar"), strict=False)).first()
    assert row.valid_patch_mask is None and row.mean is None and row.rul_physical == 7.5 and row.std_used == [1.0, 1.0]
    with pytest.raises(Exception, match="no archive"):
        archives.read_archives(spark, str(tmp_path / "n*.tar")).collect()
    write_tar(tmp_path / "d.tar", (full_sample("k") | {"k.valid_patch_mask.npy": npy(np.ones(4, bool))}).items())
    with pytest.raises(Exception, match="dimensions"):
        archives.decode_samples(archives.read_archives(spark, str(tmp_path / "d.tar"))).collect()


def test_archives_are_written_and_read_back(spark, tmp_path):
    rows = [("d e", s, f"k.{s}{i}", [[[float(i), 2.0]] * 3] * 2, [True] * 6, [[True, False, True]] * 2, [0.5, 1.0], [1.0, 2.0], [False, True], (3.0,), ("m",)) for s in ("train", "val") for i in range(7)]
    df = spark.createDataFrame(
        rows,
        "dataset string, split string, key string, patches array<array<array<double>>>, valid_time_mask array<boolean>, valid_patch_mask array<array<boolean>>,"
        " mean array<double>, std_used array<double>, constant array<boolean>, target struct<target_window: double>, meta struct<client: string>",
    )
    written = archives.write_archives(df.repartition(3), str(tmp_path / "out"), per_archive=4).collect()
    assert sum(r.n_samples for r in written) == 14 and all(r.n_samples <= 4 and r.n_bytes > 0 for r in written)
    assert {r.archive.split("/")[-2] for r in written} == {"train", "val"} and {r.archive.split("/")[-3] for r in written} == {"d e"}
    back = archives.decode_samples(archives.read_archives(spark, str(tmp_path / "out"))).collect()
    assert sorted(r.key for r in back) == sorted(r[2] for r in rows)
    row = next(r for r in back if r.key == "k.val3")
    assert row.patches == [[[3.0, 2.0]] * 3] * 2 and row.valid_patch_mask == [[True, False, True]] * 2 and row.constant == [False, True]
    assert json.loads(row.target) == {"target_window": 3.0} and json.loads(row.meta) == {"client": "m"}


def sensor_lines(units, cycles):
    line = lambda u, c: " ".join([str(u), str(c), *(f"{0.1 * i + 0.001 * c:.4f}" for i in range(3)), *(f"{0.5 * (j + 1) + 0.01 * c:.4f}" for j in range(21))])
    return [line(u, c) for u in range(1, units + 1) for c in range(1, cycles + 1)]


def test_paired_archives(spark, tmp_path):
    def write(train, test, lives):
        with zipfile.ZipFile(tmp_path / "CMAPSS_train.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("CMAPSS/train/train_FD001.txt", "\n".join(train) + "\n")
        with zipfile.ZipFile(tmp_path / "CMAPSS_test.zip", "w") as z:
            z.writestr("CMAPSS/test/test_FD001.txt", "\n".join(test))
            z.writestr("CMAPSS/test/RUL_FD001.txt", "\n".join(lives) + "\n\n")
        return archives.read_paired_archives(spark, str(tmp_path), ["FD001"])

    faults = lambda pair: {(r.fd, r.fault) for r in archives.paired_faults(*pair).collect()}
    good = write(sensor_lines(6, 10), sensor_lines(3, 5), ["10", "20", "30"])
    assert good[0].groupBy("source_split").count().orderBy("source_split").collect() == [("test", 15), ("train", 60)]
    assert [(r.unit_id, r.rul) for r in good[1].orderBy("unit_id").collect()] == [(1, 10), (2, 20), (3, 30)] and faults(good) == set()
    assert faults(write(sensor_lines(6, 10), sensor_lines(3, 5), ["10", "20"])) == {("FD001", "lives and units differ")}
    swapped = sensor_lines(6, 10)
    swapped[3], swapped[4] = swapped[4], swapped[3]
    assert faults(write(swapped, sensor_lines(3, 5)[5:], ["10", "-2", "30"])) == {("FD001", "order"), ("FD001", "life"), ("FD001", "lives and units differ")}
    with pytest.raises(ValueError, match="FD002"):
        archives.read_paired_archives(spark, str(tmp_path), ["FD001", "FD002"])


def test_lines_keep_their_place_over_splits(spark, tmp_path):
    lines = sensor_lines(40, 60)
    lines[1000], lines[1001] = lines[1001], lines[1000]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "train_FD001.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "t" / "b.txt").write_text("\n\nx\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sensors.numbered_lines(spark, str(tmp_path / "t"))
        assert got.rdd.getNumPartitions() > 5
        assert [r.value for r in got.where("file like '%train%'").orderBy("line").collect()] == lines
        assert [(r.line, r.value) for r in got.where("file like '%b.txt'").orderBy("line").collect()] == [(0, ""), (1, ""), (2, "x")]
        rows = sensors.read_sensor_text(spark, str(tmp_path / "t" / "train_FD001.txt"), "FD001", "train")
        assert [(r.unit_id, r.line) for r in sensors.order_faults(rows).collect()] == [(17, 1001)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_results_and_inventory(spark, tmp_path):
    for d, m, best in (("A", "linear", "0.5"), ("A", "scratch", "none")):
        (tmp_path / "runs" / d / m).mkdir(parents=True)
        (tmp_path / "runs" / d / m / "run_info.json").write_text(json.dumps({"dataset": "?", "best_value": best, "test_metrics": {"macro_f1": 0.4}}))
    runs = records.read_runs(spark, str(tmp_path / "runs/*/*/run_info.json"))
    assert {(r.dataset, r.mode, r.status) for r in records.run_results(runs).collect()} == {("A", "linear", "ok"), ("A", "scratch", "partial")}
    assert records.comparison_rows(runs).first().macro_f1 == 0.4
    rows = spark.createDataFrame([("e", "A", "m", "ok", "f1", {"k": "v"})], "experiment_id string, dataset string, mode string, status string, primary_metric_name string, extra map<string,string>")
    records.write_results(rows, str(tmp_path / "res"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "res/csv")).first().extra__k == "v"
    with pytest.raises(ValueError, match="missing"):
        records.write_results(rows.withColumn("mode", F.lit(None).cast("string")), str(tmp_path / "bad"))
    assert records.unknown_categories(rows, "status", ["failed"]).count() == 1
    files = samples.file_inventory(spark, str(tmp_path / "runs"))
    assert {r.status for r in samples.copy_status(files.dropDuplicates(["name"]), files.where("false")).collect()} == {"to copy"}
    catalogue = spark.createDataFrame([("run_info.json", 1), ("no", 2)], "name string, size long")
    assert {r.name: r.status for r in samples.download_status(catalogue, files.dropDuplicates(["name"])).collect()} == {"run_info.json": "retry", "no": "pending"}


def test_pooling_falls_back_to_constant_channels(spark):
    rows = [(1, c, p, 0, v, ok, True) for c, p, v, ok in ((0, 0, 1.0, True), (0, 1, 9.0, False), (1, 0, 3.0, True))] + [(2, 0, 0, 0, 5.0, False, False)]
    got = windows.pool(spark.createDataFrame(rows, "id int, channel int, patch int, dim int, value double, valid boolean, constant boolean"), ["id"])
    assert {r.id: r.value for r in got.collect()} == {1: 2.0, 2: 0.0}


def test_roles_and_target_kinds(spark):
    df = spark.createDataFrame([(10.0, 0.0, 300, 500), (60.0, 0.0, 300, 500), (0.0, 0.9, 300, 500), (0.0, 0.0, 100, 500), (0.0, 0.0, 300, 5)], "m double, p double, l long, w long")
    role, _ = audit.decide_role(F.lit(False), F.col("m"), F.col("p"), F.lit(False), F.col("l"), F.col("w"))
    assert [r[0] for r in df.select(role).collect()] == ["source", "drop", "drop", "drop", "drop"]
    kind = lambda name, t, n, k, lo, hi, w: spark.range(1).select(V.target_kind(name, t, *map(F.lit, (n, k, lo, hi, w)))).first()[0]
    assert kind("RUL", "double", 5, 5, 0.0, 9.0, True) == "rul" and kind("y", "double", 9, 30, 0.0, 99.0, True) == "regression_or_rul"
    assert kind("y", "int", 9, 5, 0, 9, True) == "multiclass" and kind("y", "int", 0, 0, 0, 0, True) == "sin_etiqueta"


def test_column_roles(spark):
    df = spark.createDataFrame([(1, 5, 0.5, True, "a", 1), (1, 6, 0.6, False, "b", 0), (1, 7, 0.7, True, "c", 0)], "machine int, cycle int, s1 double, s2 boolean, name string, fault int")
    r = roles.detect_roles(df)
    assert (r.unit, r.time, r.target, r.signals) == ("machine", "cycle", "fault", ["s1", "s2"])
    assert roles.role_differences(r, "fault", None, 2) == [] and len(roles.role_differences(r, "y", None, 3)) == 2
    obs = roles.observations(df, r, "d", F.lit("train"), "cycle")
    assert obs.orderBy("pos").first().x == [0.5, 1.0] and audit.shape(obs).first().n_rows == 3


def test_lookups(spark):
    tasks = spark.createDataFrame([("a", "ready", "target", "rul"), ("b", "planned", "target", "cls")], "dataset string, status string, role string, task_type string")
    assert roles.runnable(tasks, "target").count() == 1
    m = spark.createDataFrame([("a", 40)], "dataset string, n_channels int")
    got = {r.dataset: (r.source, r.batch_size) for r in roles.batch_sizes(tasks.select("dataset"), m, m.where("false"), 8, 32, 128).collect()}
    assert got == {"a": ("manifest", 3), "b": ("fallback", 16)}
    named = roles.with_domain(tasks, spark.createDataFrame([("a", "bearing")], "dataset string, domain string"))
    assert {r.domain for r in named.collect()} == {"bearing", "misc"}
    assert roles.clients_of_round(spark.createDataFrame([("x",), ("y",)], "client string"), spark.createDataFrame([("y",), ("z",), ("x",)], "client string"), 1).first().client == "x"
    kinds = spark.createDataFrame([("RUL head",), ("classes",)], "t string").select(roles.task_kind(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["regression", "classification"]


def test_log_buckets_and_histograms_keep_all_rows(spark):
    log = spark.createDataFrame([(5,), (99,), (5000,), (10**6,)], "step long")
    got = {r.step: r.bucket for r in runlog.in_buckets(log, [(0, 100), (100, None)]).collect()}
    assert got == {5: "0-100", 99: "0-100", 5000: "100-", 10**6: "100-"}
    values = spark.createDataFrame([(-1.0,), (0.0,), (9.9,), (10.0,), (700.0,), (None,)], "v double")
    got = {r.bin: r.n for r in runlog.histogram(values, "v", 0.0, 10.0, 2, beyond=True).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}


def test_queries_of_logs_keep_all_events(spark):
    from seriesloom.plans import queries as Q
    from seriesloom.plans import tables as T

    d = "/root/testdata/sf0.01"
    e = T.read(spark, d, "events")
    finite = T.log_rows(spark, d).where("not isnan(loss) and loss < double('inf')").count()
    assert Q.log_buckets_all(spark, d).agg(F.sum("n")).first()[0] == finite
    assert Q.value_histogram_all(spark, d).agg(F.sum("n")).first()[0] == e.where("value is not null").count()


def test_window_and_federated_queries_use_all_channels_and_rows(spark, tmp_path):
    from seriesloom.plans import queries as Q

    d = "/root/testdata/sf0.001"
    for name in ("normalized_windows_all", "window_patches_all"):
        assert {r.channel for r in Q.QUERIES[name](spark, d).select("channel").distinct().collect()} == {0, 1}
    rows = [(i, 0, [float(i), 1.0]) for i in range(9)] + [(9, 1, [5.0, 3.0])]  # a label of one row
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.idx: r.value for r in Q.QUERIES["mean_parameters_all"](spark, str(tmp_path)).collect()}
    assert got == {0: round((4 + 2 * 5) / 3, 6), 1: round((1 + 2 * 3) / 3, 6)}


def test_window_queries_give_each_value_and_patch_of_all_channels(spark):
    from seriesloom.plans import queries as Q

    d = "/root/testdata/sf0.001"
    for name, place, least in (("normalized_windows", "w_pos", 64), ("window_patches", "patch", 8)):
        whole = Q.QUERIES[name + "_all"](spark, d)
        got = Q.QUERIES[name](spark, d)
        assert {r.channel for r in got.select("channel").distinct().collect()} == {0, 1}
        assert got.agg(F.max(place)).first()[0] == least - 1
        assert got.count() == whole.count() and got.select(*whole.columns).exceptAll(whole).count() == 0


def test_padding_statistics_and_caveats(spark):
    rows = [("a", "u", 0.5), ("a", "u", 0.0), ("a", "v", None), ("a", None, 1.0), ("a", None, 0.5), ("b", None, None)]
    got = {r.split: tuple(r)[1:] for r in runlog.padding_statistics(spark.createDataFrame(rows, "split string, unit string, padding double")).collect()}
    assert got == {"a": (0.5, 1.0, 0.5), "b": (None, None, 0.0)}
    runs = spark.createDataFrame([("s", "d", "few rows"), ("s", "d", "few rows"), ("s", "c", "old"), ("s", "c", ""), ("t", "c", None)], "suite string, dataset string, caveat string")
    assert {r.suite: r.caveats for r in runlog.suite_caveats(runs, "suite").collect()} == {"s": ["c: old", "d: few rows"], "t": []}


def test_weights_of_zero(spark):
    schema = "dataset string, client string, patches long"
    plan = sampling.sampling_plan(spark.createDataFrame([*((f"d{i}", f"c{i % 5}", 10 * i) for i in range(20))], schema)).collect()
    by = {r.dataset: r.final_dataset_weight for r in plan}
    assert by["d0"] == 0 and abs(sum(by.values()) - 1) < 1e-9
    rows = spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", 0.0), ("d", 0.0)], "dataset string, w double")
    capped = {r.dataset: round(r.capped, 9) for r in sampling.cap_weights(rows, "w", F.lit(0.3), "dataset").collect()}
    assert capped == {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.2}  # what is left goes to the others equally
    none = rows.withColumn("w", F.lit(0.0))
    assert {r.capped for r in sampling.cap_weights(none, "w", F.lit(0.3), "dataset").collect()} == {0.0}
    assert {r.floored for r in sampling.floor_weights(none, "w", 0.1, "dataset").collect()} == {0.0}
    assert {r.w_w for r in audit.shares(none, ["w"]).collect()} == {None}


def test_interpolation_of_a_long_unit(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit("u").alias("unit"), F.col("id").alias("pos"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).alias("v"))
    began = time.time()
    filled = trajectories.interpolate(rows, ["unit"], ["v"])
    off = filled.where((F.col("pos") < n - 10) & (F.abs(F.col("v_filled") - F.col("pos")) > 1e-6)).count()
    assert off == 0 and time.time() - began < 20
