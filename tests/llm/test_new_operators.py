import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import hardnegatives, queries, repeats, suffixsort
from seriesloom.llm.hardnegatives import mine_hard_negatives
from seriesloom.llm.repeats import remove_repeats
from seriesloom.llm.resampling import Head, feature_buckets, importance_resample, ranks, words
from seriesloom.llm.suffixsort import sorted_suffixes

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_hard_negatives", "op13_suffix_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.sql(queries.ORACLE_SQL[name]).select(*columns).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


# resampling


def plain_features(text, longest):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def plain_resample(rows, target, longest, buckets, percent, least):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, counts in ((rows, s), (target, t)):
        for _, text in texts:
            for x in plain_features(text, longest):
                counts[bucket(x)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        found = plain_features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in found)
        out.append([i, len(plain_features(text, 1)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough):
        r.append(k + 1 if k < len(enough) * percent // 100 else None)
    return sorted(map(str, ((*r, None)[:6] for r in out)))


@pytest.mark.parametrize(("longest", "head"), [(1, 1 << 16), (1, 0), (2, 50), (3, 7), (2, 0)])
def test_resampling_equals_brute_force_whatever_the_head(spark, table, odd, longest, head):
    rng = random.Random(longest)
    rows = [*odd, *((i, " ".join(rng.choice(("The", "cat", "sät", "x-1", "on", "ÄB", "99", "mat")) for _ in range(rng.randrange(40)))) for i in range(20, 60))]
    target = [(1, "the cat sät on the mat"), (2, None), (3, "x 1 99")]
    got = importance_resample(table(rows), table(target), 40, longest=longest, buckets=97, least_words=5, head_size=head).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in got if r.doc_id != 7) == [x for x in plain_resample(rows, target, longest, 97, 40, 5) if not x.startswith("(7,")]
    drawn = sorted(r["rank"] for r in got if r["rank"])
    assert drawn == list(range(1, len(drawn) + 1))


def test_resampling_of_empty_tables(spark, table):
    assert importance_resample(table([]), table([(1, "a")])).count() == 0
    row = importance_resample(table([(1, "a b a")]), table([]), least_words=1).first()
    assert (row.n_features, row["rank"]) == (3, None) and row.weight < 0


def test_head_and_tail_have_the_same_buckets():
    found = words(b"One two TWO three one two")
    full = Head({w: zlib.crc32(w) for w in found}), {b"one two": zlib.crc32(b"one two") % 50}
    for longest in (1, 2, 4):
        assert (feature_buckets(found, *full, longest, 50) == feature_buckets(found, Head(), {}, longest, 50)).all()


def test_ranks_are_the_whole_order(spark):
    df = spark.range(0, 3000, numPartitions=7).selectExpr("id", "hash(id) % 5 as k")
    got = ranks(df, [F.desc("k"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 3001))
    assert [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))


# hard negatives


def plain_negatives(rows, every):
    usable = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in usable:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, other) for i, other, v in usable if i != a)
        for p, pid, other in [x for x in scored if x[2] == label][:5]:
            inside = [(n, i) for n, i, k in scored if k != label and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(a, pid, k + 1, i, -p, -n) for k, (n, i) in enumerate(inside[:5])]
        del other
    return sorted(out)


@pytest.mark.parametrize("shape", ["spread", "ties", "huge", "lengths"])
def test_negatives_equal_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(hardnegatives, "BUCKET_ROWS", 16)
    monkeypatch.setattr(hardnegatives, "SAMPLE", 20)
    monkeypatch.setattr(hardnegatives, "BLOCK_BYTES", 600)
    rng = random.Random(shape)
    rows = []
    for i in range(240):
        v = [rng.gauss(0, 1) for _ in range(6)]
        if shape == "ties":
            v = [float(rng.randrange(2)) for _ in range(3)]
        if shape == "huge":
            v = [x * 2.0**20 for x in v]
        if shape == "lengths":
            v = [x * 10 ** rng.uniform(-2, 2) for x in v[: rng.randrange(7)]]
        rows.append((i, rng.randrange(3), v))
    rows += [(None, 1, [1.0]), (300, None, [1.0]), (301, 1, None), (302, 1, [1.0, None]), (303, 2, [float("nan")]), (305, 0, [float("inf")]), (306, 1, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, label int, embedding array<double>, slot string, score int")
    got = mine_hard_negatives(df, df.where("vec_id % 10 = 0")).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, 10)


def test_negatives_of_repeated_rows_and_empty_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (3, 1, [1.0]), (4, 2, [0.9]), (4, 2, [0.9])]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r)[:4] for r in mine_hard_negatives(df, df.where("vec_id = 0")).collect())
    assert got == sorted(2 * [(0, 3, 1, 4), (0, 3, 2, 4)])
    assert mine_hard_negatives(df.limit(0), df).count() == 0 and mine_hard_negatives(df, df.limit(0)).count() == 0


# repeats


def plain_suffixes(t, depth):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    common = [0] * len(t)
    for k in range(1, len(t)):
        a, b = order[k - 1], order[k]
        while common[k] < depth and max(a, b) + common[k] < len(t) and t[a + common[k]] == t[b + common[k]]:
            common[k] += 1
    return order, common


def test_suffixes_and_common_prefixes_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    for _ in range(300):
        t = [rng.randrange(rng.choice((1, 2, 3, 26, 256))) for _ in range(rng.choice((0, 1, 2, 3, 10, 60, 200)))]
        t = t + t + t[: len(t) // 2] if rng.random() < 0.4 else t
        depth = rng.choice((5, 50, 200))
        monkeypatch.setattr(suffixsort, "STEP", rng.choice((1, 2, 7, 1 << 18)))  # queues of many parts
        text = np.array(t, np.uint8)
        got = list(sorted_suffixes(text, depth, memory=rng.choice((1, 100, 1 << 20)), base=rng.choice((0, 3, 1 << 20))))  # on disk; recursion
        order, common = plain_suffixes(t, depth)
        assert [int(x) for _, c in got for x in c] == common
        found = [int(x) for p, _ in got for x in p]
        assert sorted(found) == sorted(order) and [t[x : x + depth] for x in found] == [t[x : x + depth] for x in order]


def plain_cut(rows, window=50):
    texts = [(2**63 if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for key, _, t in texts:
        for k in range(len(t) - window + 1):
            x = t[k : k + window]
            first[x] = min(first.get(x, key), key)
    out = []
    for key, i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if first[t[k : k + window]] < key:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(t), bytes(gone).count(1), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(map(str, out))


def cut(df, **named):
    got = remove_repeats(df, **named).collect()
    return sorted(str((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept))) for r in got)


def long_shared(rng):
    word = lambda: "".join(rng.choice("abcdefghijé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.choice((6, 12, 40))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice((text(rng.randrange(30)), rng.choice(shared), "a" * rng.randrange(200), "ab" * rng.randrange(60), "")) for _ in range(rng.randrange(5))]
        rows.append((i % 140, rng.choice(("", " ")).join(parts)))
    return [*rows, (None, shared[0] * 3), (None, shared[0] * 3), (200, None), (201, shared[1][:49]), (202, rows[5][1]), (-4, rows[5][1])]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_BYTES": 2000, "STEP": 300, "SHARD_BYTES": 3000, "BUCKET_BYTES": 4000}, {"HOT": 3, "BLOCK_BYTES": 900}, {"HOT": 1, "STEP": 64, "BLOCK_BYTES": 5000}])
def test_cuts_equal_brute_force(spark, table, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(repeats, name, value)
    rows = long_shared(random.Random(4))
    assert cut(table(rows).repartition(3)) == plain_cut(rows)


def test_cuts_of_odd_rows(spark, table, odd):
    assert cut(table(odd)) == plain_cut(odd)
    assert cut(table([])) == []


def shuffled_bytes(spark):
    """What each stage has written for shuffles, by its number."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = context.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_cuts_shuffle_less_than_the_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled_bytes(spark)
    assert remove_repeats(docs).agg(F.sum("n_bytes")).first()[0] == n_bytes
    written = [n for stage, n in shuffled_bytes(spark).items() if stage > max(before)]
    assert 0 < sum(written) < 0.8 * n_bytes


def shuffled_by_cuts(spark, docs, path):
    """Bytes of the texts, and those shuffled to cut them."""
    docs.write.parquet(str(path))
    docs = spark.read.parquet(str(path))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled_bytes(spark)
    assert remove_repeats(docs).agg(F.sum("n_bytes")).first()[0] == n_bytes
    return n_bytes, sum(n for stage, n in shuffled_bytes(spark).items() if stage > max(before))


def test_cuts_of_repeated_tables_shuffle_names_of_copies(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(4)
    once = shuffled_by_cuts(spark, docs, tmp_path / "once")[1]
    times = spark.range(5).select(F.col("id").alias("k"))
    repeated = docs.crossJoin(times).select((F.col("doc_id") + F.col("k") * 1_000_000).alias("doc_id"), "text").repartition(20)
    assert shuffled_by_cuts(spark, repeated, tmp_path / "repeated")[1] < 2 * once


def test_cuts_of_a_line_in_many_texts_shuffle_less_than_its_windows(spark, table, tmp_path):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, f"{word(60)} All rights reserved, see the licence for what it grants and forbids. {word(60)}") for i in range(9000)]
    n_bytes, shuffled = shuffled_by_cuts(spark, table(rows).repartition(4), tmp_path / "docs")
    assert shuffled < 2 * n_bytes


def test_cuts_of_copies_equal_brute_force(spark, table):
    rng = random.Random(7)
    rows = long_shared(rng)
    texts = [t for _, t in rows]
    rows += [(i, rng.choice(texts)) for i in range(300, 360)] + [(-i, rng.choice(texts)) for i in range(5, 25)]
    rows += [(500, "x" * 49), (501, "x" * 49), (502, "x" * 50), (502, "x" * 50), (503, "x" * 50), (None, "x" * 50), (2**63 - 1, texts[0])]
    rng.shuffle(rows)
    assert cut(table(rows).repartition(5)) == plain_cut(rows)


def test_texts_without_a_common_window_rarely_share_anchors():
    rng = random.Random(8)
    parts = ("the ", "tion", "ing ", "of ", "and ", "er", "st ", "on ")
    a, b = (np.frombuffer("".join(rng.choice(parts) for _ in range(60_000)).encode(), np.uint8) for _ in range(2))
    (_, _, own), (_, _, other) = (repeats.passages(x, np.array([len(x)]), 50) for x in (a, b))
    assert np.isin(own, other).mean() < 0.05


def test_shard_sorts_only_strings_that_share_a_key(monkeypatch):
    rng = random.Random(9)
    lone, x, y = (bytes(rng.randrange(97, 123) for _ in range(60)) for _ in range(3))
    pack = lambda docs: repeats._pack([np.diff(np.array([5, 9, 9]), prepend=0), np.array([60, 60, 60]), np.array(docs), np.zeros(3, np.int64)], lone + x + y)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([1, 2], pa.int64()), pa.array([pack([1, 1, 1]), pack([4, 4, 4])], pa.binary())], names=["shard", "block", "strings"])
    sorted_, real = [], repeats.first_documents
    monkeypatch.setattr(repeats, "first_documents", lambda text, *rest: sorted_.append(bytes(text)) or real(text, *rest))
    out = pa.Table.from_batches(repeats._sort_shard(50, 1)([batch]))
    assert len(sorted_) == 1 and sorted(sorted_[0][k : k + 60] for k in (0, 60)) == sorted([x, y]) and len(sorted_[0]) == 120
    key, _, first, size, doc = repeats._unpack(out.column("runs")[0].as_py(), 5)[0]
    assert out.column("block").to_pylist() == [2] and (np.cumsum(key).tolist(), first.tolist(), size.tolist(), doc.tolist()) == ([5, 9, 9], [0] * 3, [11] * 3, [1] * 3)


def test_cuts_of_small_packs_and_many_parts(spark, table, monkeypatch):
    for name, value in {"PACK_BYTES": 200, "PART_BYTES": 900, "SHARD_BYTES": 3000, "STEP": 7, "HOT": 3}.items():
        monkeypatch.setattr(repeats, name, value)
    rows = long_shared(random.Random(5))
    assert cut(table(rows).repartition(3)) == plain_cut(rows)


def test_packs_keep_keys_and_numbers_of_any_size():
    rng = np.random.default_rng(2)
    for n, by in [(0, 1), (1, 1), (1, 7), (1000, 1), (1000, 104), (5, 1 << 20)]:
        keys = np.sort(rng.integers(0, 1 << 48, n) // by * by + by // 2)
        numbers = rng.choice(np.array([0, 1, -4, repeats.LAST, -repeats.LAST - 1]), n)
        (differences, got), more = repeats._unpack(repeats._pack([repeats._differences(keys, by), numbers], b"ab\0"), 2)
        assert repeats._keys(differences, by, by // 2).tolist() == keys.tolist()
        assert got.tolist() == numbers.tolist() and more == b"ab\0"
