"""The followed log against the whole one."""

import json
import math
import random

import numpy as np
import pytest

from seriesloom.sources import records
from seriesloom.streaming import follow

BUCKETS = [(0, 500), (500, 40_000), (40_000, None)]


def write_log(folder, rng, n=3000):
    """Lines in any order over several files, some of them repeated or broken."""
    steps = rng.sample(range(90_000), n)
    value = lambda s: rng.choice((s % 97 - 20.0, 0.0, 1e-12, -3e12, float("nan"), float("-inf"), 10.0 ** rng.uniform(-6, 6)))
    lines = [{"step": s, "dataset": "d", "loss": value(s), "optimizer_applied": rng.choice((None, True, False)), "amp_nonfinite_grad": rng.choice((None, True, False))} for s in steps]
    texts = [json.dumps(x) for x in lines] * 2 + ['{"kind": "distribution", "step": 3, "loss": 1e9}', "{broken", '{"loss": 5.0}']
    rng.shuffle(texts)
    folder.mkdir()
    for k in range(6):
        (folder / f"{k}.json").write_text("\n".join(texts[k::6]) + "\n")
    return lines


def test_stream_equals_batch(spark, tmp_path, monkeypatch):
    lines = write_log(tmp_path / "in", random.Random(1))
    q = follow.bucket_statistics_stream(follow.follow_log(spark, str(tmp_path / "in"), files_at_once=2), str(tmp_path / "out"), BUCKETS, str(tmp_path / "ck"))
    q.awaitTermination(300)
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    got = {r.bucket: r for r in follow.bucket_statistics(follow.read_pages(spark, str(tmp_path / "out"))).collect()}
    whole = {r.bucket: r for r in follow.bucket_statistics(follow.pages(records.read_log(spark, str(tmp_path / "in")), BUCKETS)).collect()}
    assert set(got) == set(whole) == {"0-500", "500-40000", "40000-"}
    for name, (low, high) in zip(("0-500", "500-40000", "40000-"), ((0, 500), (500, 40_000), (40_000, math.inf)), strict=True):
        inside = [x for x in lines if low <= x["step"] < high]
        values = np.sort([x["loss"] for x in inside if math.isfinite(x["loss"])])
        clean = [x["loss"] for x in inside if math.isfinite(x["loss"]) and x["optimizer_applied"] is not False and not x["amp_nonfinite_grad"]]
        a, b = got[name].asDict(), whole[name].asDict()
        assert {k: v for k, v in a.items() if "mean" not in k} == {k: v for k, v in b.items() if "mean" not in k}
        assert a["n"] == len(values) and a["n_nonfinite"] == len(inside) - len(values) and (a["low"], a["high"]) == (values[0], values[-1])
        for r in (a, b):
            assert r["mean"] == pytest.approx(values.mean(), rel=1e-9) and r["clean_mean"] == pytest.approx(np.mean(clean), rel=1e-9)
        for share in (0.1, 0.5, 0.9):
            exact = values[max(1, math.ceil(share * len(values))) - 1]
            if follow.LEAST < abs(exact) < follow.MOST:
                assert a[f"p{round(100 * share)}"] == pytest.approx(exact, rel=0.011)
            elif abs(exact) < follow.LEAST:
                assert a[f"p{round(100 * share)}"] == 0


def test_more_lines_do_not_enlarge_the_state(spark, tmp_path):
    write_log(tmp_path / "in", random.Random(2), 500)
    stats = lambda: sorted(map(str, follow.bucket_statistics(follow.read_pages(spark, str(tmp_path / "out"))).collect()))

    def follow_on():
        q = follow.bucket_statistics_stream(follow.follow_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), BUCKETS, str(tmp_path / "ck"))
        q.awaitTermination(300)
        return [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]][-1]

    first = follow_on()
    before = stats()
    for k in range(6):  # all lines come once more, under new names
        (tmp_path / "in" / f"again{k}.json").write_text((tmp_path / "in" / f"{k}.json").read_text())
    again = follow_on()
    assert stats() == before
    assert again["numRowsTotal"] == first["numRowsTotal"] <= 5
