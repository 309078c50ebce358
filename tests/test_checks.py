"""Rules, footers, nested values and draws against small cases and plain versions."""

import hashlib
import json
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import nested
from seriesloom.operators import rules, sampling
from seriesloom.sources import footers

DATASET = "dataset string, role string, n_windows long, n_units long, class_balance double, target_min double, target_kind string, padding_ratio double, tail_policy string, length_median double, window_size int, n_rows long, dropped_rows long, w_channel_patches double"
QUIET = ("TRANSFER_TARGET", 100, 5, 0.05, 0.0, "rul", 0.15, "pad", 512.0, 512, 100, 5, 0.2)
#: for each kind what a quiet row becomes when it fires
LOUD = {
    "tt_n_windows_bajo": {1: 99},
    "tt_n_units_bajo": {2: 4},
    "class_balance_bajo": {3: 0.049},
    "rul_negative_values": {4: -0.1},
    "negative_target_values": {4: -0.1, 5: "regression"},
    "padding_ratio_alto": {0: "PRETRAIN_SOURCE", 6: 0.16},
    "tt_padding_alto": {6: 0.51},
    "tail_policy_pad_padding_moderado": {6: 0.5},
    "tt_median_lt_window": {8: 511.0},
    "tail_drop_ratio_alto": {11: 6},
    "dataset_dominante": {12: 0.21},
}


def test_every_kind_of_warning_fires_and_stays_quiet(spark):
    rows = [("quiet", *QUIET), ("nulls", *[None] * 13), ("source", "PRETRAIN_SOURCE", 1, 1, 0.5, 5.0, "rul", 0.1, "pad", 1.0, 512, 100, 5, 0.0), ("none", "DROP", 1, 1, None, -1.0, "binary", 0.1, "drop", 1.0, 512, 0, 9, 0.0)]
    for kind, changes in LOUD.items():
        row = list(QUIET)
        for k, v in changes.items():
            row[k] = v
        rows.append((kind, *row))
    got = {}
    for r in rules.fired(spark.createDataFrame(rows, DATASET), rules.DATASET_WARNINGS, "dataset").collect():
        got.setdefault(r.dataset, set()).add(r.rule)
    assert set(got) == set(LOUD) and all(kind in found for kind, found in got.items())
    also = {"tt_padding_alto": {"padding_ratio_alto"}, "tail_policy_pad_padding_moderado": {"padding_ratio_alto"}}
    assert all(found == {kind} | also.get(kind, set()) for kind, found in got.items())
    clients = spark.createDataFrame([("a", 0.01, 0.0099), ("b", 0.0, 0.5)], "client string, w_temporal_patches double, w_channel_patches double")
    corpus = spark.createDataFrame([(2, 51, 53, 52)], "n_excluded int, n_audited int, n_downloaded int, n_listed int")
    everything = {(r.scope, r.name, r.rule) for r in rules.all_warnings(spark.createDataFrame(rows[:1], DATASET), clients, corpus).collect()}
    assert everything == {("client", "a", "cliente_pequeno_channel"), ("client", "b", "cliente_pequeno_temporal"), ("corpus", "corpus", "inconsistencia_csv")}
    counts = spark.createDataFrame([(2, 50, 53, 53)], corpus.schema)
    assert [(r.rule, r.observed, r.expected) for r in rules.fired(counts, rules.CORPUS_WARNINGS, "n_listed").collect()] == [("inconsistencia_conteos", "52", "<> 53")]
    assert len(rules.DATASET_WARNINGS) + len(rules.CLIENT_WARNINGS) + len(rules.CORPUS_WARNINGS) == 15


@pytest.mark.parametrize(
    ("row", "bad"),
    [
        (("train", 10, 0.0, 125.0, 10), set()),
        (("train", 10, 1.0, 125.0, 10), {"the last row has life 0"}),
        (("test", 10, 1.0, 125.0, None), set()),
        (("test", 10, -1.0, 125.1, 9), {"life is not negative", "lives are capped", "samples as in the preview"}),
        (("val", 10, None, 3.0, 10), {"life is not negative", "the last row has life 0"}),
    ],
)
def test_writer_rules(spark, row, bad):
    df = spark.createDataFrame([row], "split string, n_samples long, life_min double, capped_max double, n_preview long")
    assert {r["check"] for r in rules.failures(rules.checked(df, rules.writer_rules(125.0), "split")).collect()} == bad
    assert {r["check"] for r in rules.checked(df, rules.writer_rules(None, False), "split").collect()} <= {"life is not negative", "samples as in the preview"}


def test_corpus_rules(spark):
    schema = "dataset string, role string, status string, audit_version string, tail_policy string, padding_ratio double, n_windows long"
    good = [("a", "PRETRAIN_SOURCE", "ok", "v2", "pad", 0.1, 5), ("b", "TRANSFER_TARGET", "ok", "v2", "pad", None, 3), ("c", "DROP", "error", None, None, 0.99, None)]
    groups = spark.createDataFrame([("x", "a"), ("y", "a")], "client string, dataset string")
    wanted = {"PRETRAIN_SOURCE": 1, "TRANSFER_TARGET": 1, "DROP": 1}

    def bad(rows):
        facts = rules.corpus_facts(spark.createDataFrame(rows, schema), groups, list(wanted), ["n_windows"])
        return {r["check"] for r in rules.failures(rules.checked(facts, rules.corpus_rules(wanted, "v2", "pad", ["n_windows"]))).collect()}

    assert bad(good) == set()
    assert bad([*good[:2], ("c", "NEW", "ok", "v1", "pad", 0.0, 1)]) == {"datasets of role DROP", "no other role", "one audit version"}
    assert bad([*good, ("d", "PRETRAIN_SOURCE", "ok", "v2", "drop", 0.81, None)]) == {"datasets of role PRETRAIN_SOURCE", "one tail policy", "n_windows is there", "every source has a client", "no extreme padding"}


# footers


def test_footers_name_files_that_do_not_fit(spark, tmp_path):
    def write(dataset, name, table, **more):
        folder = tmp_path / "data" / f"dataset={dataset}"
        folder.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table(table), folder / name, **more)

    good = {"key": ["a", "b", None], "dataset_name": ["A"] * 3, "x": [[1.0, None], [], [2.0]]}
    write("A", "good.parquet", good, row_group_size=2)
    write("A", "type.parquet", good | {"key": [1, 2, 3]})
    write("A", "few.parquet", {k: v[:2] for k, v in good.items() if k != "x"})
    write("B", "good.parquet", good | {"target": [1.0, 2.0, 3.0]})
    (tmp_path / "data" / "dataset=A" / "broken.parquet").write_bytes(b"PAR1 no")
    found = footers.read_footers(spark, str(tmp_path / "data"), 3)
    row = found.where("path like '%=A/good%' and column = 'key'").first()
    assert (row.n_rows, row.type, row.n_null, row.low, row.high) == (3, "string", 1, "a", "b")
    files = spark.createDataFrame([("A", "good.parquet", 3), ("A", "few.parquet", 3), ("A", "type.parquet", 3), ("B", "good.parquet", 3), ("B", "gone.parquet", 3)], "dataset string, name string, rows long")
    types = {"key": "string", "dataset_name": "string", "x[]": "double"}
    faults = footers.footer_faults(found, types, files, {"dataset_name": "dataset"}, ["target"]).collect()
    assert {("/".join(r.path.split("/")[-2:]), r.fault) for r in faults} == {
        ("dataset=A/broken.parquet", "unreadable"),
        ("dataset=A/type.parquet", "type"),
        ("dataset=A/few.parquet", "missing column"),
        ("dataset=A/few.parquet", "rows"),
        ("dataset=B/good.parquet", "dataset_name"),
        ("dataset=B/good.parquet", "target among signals"),
        ("gone.parquet", "rows"),
    }


# nested values


def test_nested_values(spark):
    inf, nan = float("inf"), float("nan")
    schema = "r struct<z: double, a: struct<b: array<struct<x: float, s: string>>, m: map<string, array<double>>>, i: int, t: array<array<double>>>"
    rows = [
        ((1e300, ([(0.1, "é\"\n"), (inf, None), None], {"k": [nan, 1.5], "a": None}), 3, [[1.0, -inf], None]),),
        ((nan, None, None, []),),
        (None,),
        ((1e-7, ([], {}), -1, [[123456789.0, 1e16, 1e22, -0.0]]),),
    ]
    df = spark.createDataFrame(rows, schema)

    def plain(x):
        if isinstance(x, float):
            return x if math.isfinite(x) else None
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    want = [
        {"z": 1e300, "a": {"b": [{"x": 0.1, "s": "é\"\n"}, {"x": inf, "s": None}, None], "m": {"k": [nan, 1.5], "a": None}}, "i": 3, "t": [[1.0, -inf], None]},
        {"z": nan, "a": None, "i": None, "t": []},
        None,
        {"z": 1e-7, "a": {"b": [], "m": {}}, "i": -1, "t": [[123456789.0, 1e16, 1e22, -0.0]]},
    ]
    kind = df.schema["r"].dataType
    for form, encode in (("json", lambda x: json.dumps(x, sort_keys=True)), ("compact", lambda x: json.dumps(x, sort_keys=True, separators=(",", ":")))):
        got = df.select(nested.canonical_text(F.col("r"), kind, form).alias("t"), nested.canonical_hash(F.col("r"), kind, form).alias("h")).collect()
        texts = [None if x is None else encode(plain(x)) for x in want]
        assert [r.t for r in got] == texts
        assert [r.h for r in got] == [None if t is None else hashlib.sha256(t.encode()).hexdigest()[:16] for t in texts]
    clean = nested.finite_table(df).collect()
    assert clean[0].r.a.b[1].x is None and clean[0].r.a.m["k"] == [None, 1.5] and clean[0].r.t == [[1.0, None], None] and clean[1].r.z is None and clean[2].r is None
    assert [r.t for r in df.select(nested.canonical_text(F.col("r.z"), kind["z"].dataType).alias("t")).collect()] == ["1e+300", "null", None, "1e-07"]


def test_hashes_of_configurations():
    config = {"dataset": "é", "pipeline_version": "v0.5", "window": 512}
    whole, meant = nested.config_hashes(config)
    assert whole == hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    assert meant == nested.config_hashes(config | {"pipeline_version": "v0.4"})[1] and whole != meant
    assert nested.list_hash(["a", "é"]) != nested.list_hash(["é", "a"]) and nested.list_hash(["é"]) == hashlib.sha256('["é"]'.encode()).hexdigest()[:16]
    yaml = pytest.importorskip("yaml")
    assert nested.config_hashes(config, "yaml")[0] == hashlib.sha256(yaml.safe_dump(config, sort_keys=True, allow_unicode=True).encode()).hexdigest()[:16]
    with pytest.raises(ValueError, match="form"):
        nested.encode(config, "xml")


# draws


@pytest.mark.parametrize("strategy", ["weighted", "uniform", "round_robin"])
def test_batches_come_once_in_each_opening(spark, monkeypatch, strategy):
    plan = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.1), ("none", 0.1)], "dataset string, share double")
    batches = spark.createDataFrame([("a", 7), ("b", 3), ("c", 400), ("none", 0)], "dataset string, n_batches long")
    steps = spark.range(1000).select(F.col("id").alias("step"))
    got = sampling.draw_batches(plan, batches, steps, strategy=strategy, seed=3).orderBy("step").collect()
    assert [r.step for r in got] == list(range(1000))
    sizes, openings = {"a": 7, "b": 3, "c": 400}, {}
    for r in got:
        openings.setdefault((r.dataset, r.opening), []).append(r.batch)
    for (name, opening), drawn in openings.items():
        assert len(set(drawn)) == len(drawn) <= sizes[name] and set(drawn) <= set(range(sizes[name]))
        if (name, opening + 1) in openings:  # an opening ends before the next one begins
            assert len(drawn) == sizes[name]
    if strategy == "round_robin":
        assert [r.dataset for r in got[:6]] == ["a", "b", "c"] * 2
    orders = [tuple(openings["a", k]) for k in range(5)]
    assert len(set(orders)) > 1
    assert sampling.draw_batches(plan, batches.where("n_batches = 0"), steps, strategy=strategy).count() == 0


def test_counts_over_chunks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), k) for k in range(0, 3000, 3)]
    got = sampling.count_up(spark.createDataFrame(rows, "g string, step long"), "g", "step", chunk=100).collect()
    seen = {"a": 0, "b": 0}
    for r in sorted(got, key=lambda r: r.step):
        assert r.nth == seen[r.g]
        seen[r.g] += 1
    assert np.sum(list(seen.values())) == 1000
