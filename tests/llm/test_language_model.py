import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm.pitmanyor import pitman_yor_scores, seat
from seriesloom.llm.toxicity import held_out


def tokens(text):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(up)), None]


def test_counts_and_base_score(spark, table, odd):
    rows = [*odd, *((100 + i, f"the cat {i % 3} sat on the mat " * 3) for i in range(40))]
    df = table(rows)
    train = ~held_out("doc_id", 7, 2)
    got = pitman_yor_scores(df, train).collect()
    flags = [r.t for r in df.select(train.alias("t")).collect()]
    count = Counter(w for (_, t), f in zip(rows, flags, strict=True) if f for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_no_rows_and_no_training(spark, table):
    assert pitman_yor_scores(table([]), F.lit(True)).count() == 0
    one = pitman_yor_scores(table([(1, "a b")]), F.lit(False)).first()
    assert (one.train_tokens, one.n_known, one.base_score) == (0, 0, 0.0) and one.score <= 0


def test_model_beats_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pitman_yor_scores(docs, ~held_out("doc_id", 7, 2)).where("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_seating_has_at_least_one_table_and_at_most_one_a_customer():
    rng = np.random.default_rng(0)
    customers = np.array([1, 1, 2, 5, 1000, 10**6])
    tables = seat(customers, np.full(6, 1.0), np.full(6, 0.5), 0.7, rng)
    assert (tables >= 1).all() and (tables <= customers).all() and tables[0] == 1
    assert seat(customers, np.full(6, 1e9), np.full(6, 1.0), 0.7, rng)[3] == 5


def gibbs_by_customer(c, rest, parent, discount, rng, sweeps):
    """Table counts of one dish: customers removed and added one by one."""
    at, seen = [0] * c, []
    for _ in range(sweeps):
        for i in range(c):
            at[i] = None
            sizes = Counter(k for k in at if k is not None)
            options = [*sizes, max(sizes, default=0) + 1]
            weights = np.array([*(n - discount for n in sizes.values()), (rest + discount * len(sizes)) * parent])
            at[i] = options[rng.choice(len(options), p=weights / weights.sum())]
        seen.append(len(set(at)))
    return np.array(seen)


def test_seating_agrees_with_customers_seated_one_by_one():
    rng = np.random.default_rng(3)
    for c, rest, parent, discount in [(2, 1.0, 0.3, 0.7), (4, 3.0, 0.2, 0.5), (7, 10.0, 0.05, 0.8)]:
        plain = np.bincount(gibbs_by_customer(c, rest, parent, discount, rng, 5000), minlength=c + 1) / 5000
        drawn = seat(np.full(50_000, c), np.full(50_000, rest), np.full(50_000, parent), discount, rng).astype(int)
        assert np.abs(plain - np.bincount(drawn, minlength=c + 1) / 50_000).max() < 0.035


def test_equal_partitions_each_get_their_own_scores(spark, table):
    rows = [(i, f"the cat {i % 3} sat on the mat " * 3) for i in range(40)]
    df = table(rows).coalesce(1)
    got = pitman_yor_scores(df.union(df), ~held_out("doc_id", 7, 2)).collect()
    assert sorted(r.doc_id for r in got) == sorted([i for i, _ in rows] * 2)
    assert len({(r.doc_id, round(r.base_score, 9)) for r in got}) == 40
