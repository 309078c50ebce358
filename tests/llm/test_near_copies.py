import itertools
import math
import random

from pyspark.sql import functions as F

from seriesloom.llm import nearcopies
from seriesloom.llm.components import connected_components
from seriesloom.llm.nearcopies import near_duplicates


def groups(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def edited(rng, base, most):
    w = list(base)
    for _ in range(rng.randrange(most + 1)):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def test_groups_equal_brute_force_at_any_leaf_size(spark, table, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, edited(rng, base, 3)) for i in range(180)]
    for i in range(200, 260):
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((2, 5, 40))))))
    want, sizes = groups(rows)
    for leaf, few in ((1024, 64), (16, 4)):
        monkeypatch.setattr(nearcopies, "LEAF", leaf)
        monkeypatch.setattr(nearcopies, "FEW", few)
        got = near_duplicates(table(rows)).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.n_shingles for r in got} == sizes
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark, table, odd):
    got = near_duplicates(table(odd)).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (2, 3, 4)] == [0, 0, 0] and all(by[i].kept for i in (2, 3, 4))
    assert {by[i].component_id for i in (5, 6, 7)} == {5}
    assert by[None].component_id == 1 and not by[None].kept
    assert near_duplicates(table([])).count() == 0
    assert near_duplicates(table([(1, None)])).first().kept


def test_doc_ids_with_several_texts_keep_all_links(spark, table):
    rng = random.Random(9)
    a, c = ([f"{k}{i}" for i in range(60)] for k in "ac")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(c)), (2, near(a)), (3, near(c)), (4, "alone " * 9)]
    rng.shuffle(rows)
    got = near_duplicates(table(rows + rows)).collect()
    assert len(got) == 10
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_rows_without_doc_id_are_linked(spark, table):
    w = [f"v{i}" for i in range(60)]
    got = near_duplicates(table([(None, " ".join(w)), (7, " ".join(w[:-1])), (None, "x y z " * 4), (None, "x y z " * 4)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (0, 7, False), (7, 7, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 40), (50, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[40] == got[41] == 40 and 50 not in got


def test_chance_to_miss_a_link(spark):
    """All that two documents agree in is frequent: a tree's root and each of the levels below
    keeps their link with the chance of an equal token, the last level compares all."""
    drawn = spark.range(2000).select(F.size(F.array_distinct(nearcopies._chosen(F.col("id")))).alias("n")).groupBy("n").count().collect()
    branches = {r.n: r["count"] / 2000 for r in drawn}
    missed, ruled_out = 0.0, 0.0
    for equal in range(nearcopies.SKETCH + 1):
        chance = math.comb(nearcopies.SKETCH, equal) * 0.75**equal * 0.25 ** (nearcopies.SKETCH - equal)
        share, lost = equal / nearcopies.SKETCH, 0.0
        for _ in range(nearcopies.MAX_DEPTH):
            one = 1 - share + share * lost
            lost = sum(p * one**n for n, p in branches.items())
        missed += chance * (0.25 + 0.75 * lost) ** nearcopies.TREES
        ruled_out += chance * (equal < nearcopies.least_agreement())
    assert missed < 1.1e-5
    assert ruled_out < 1e-6


def test_links_within_a_template_equal_brute_force(spark, table, monkeypatch):
    """Recall in nodes that branch over several levels."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, rows = fresh(100), []
    for i in range(0, 400, 2):  # 0.68 alike through the template, pairs just over 0.75
        both = fresh(8)
        rows += [(k, " ".join(template + both + fresh(14))) for k in (i, i + 1)]
    want, _ = groups(rows)
    assert len(set(want.values())) == 200
    monkeypatch.setattr(nearcopies, "LEAF", 32)
    monkeypatch.setattr(nearcopies, "FEW", 4)
    got = near_duplicates(table(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_a_large_group_of_near_copies_equals_brute_force(spark, table, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, base, 4)) for i in range(1200)]
    want, _ = groups(rows)
    monkeypatch.setattr(nearcopies, "LEAF", 256)
    got = near_duplicates(table(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_nodes_with_few_others_end_without_branches(spark, table, monkeypatch):
    """Documents that share a passage without being linked."""
    rng = random.Random(11)
    rows = [(i, " ".join(["one", "passage", "of", "five", "words", *(f"w{rng.randrange(10**9)}" for _ in range(3))])) for i in range(700)]
    rows += [(i + 1000, t) for i, t in rows[:40]]
    monkeypatch.setattr(nearcopies, "LEAF", 256)
    branch = nearcopies._branch

    def checked(state):
        assert state.isEmpty()
        return branch(state)

    monkeypatch.setattr(nearcopies, "_branch", checked)
    got = near_duplicates(table(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 1000 for i, _ in rows}


def test_stars_are_components_without_a_step(spark, monkeypatch):
    from seriesloom.llm import components

    written = []
    monkeypatch.setattr(components, "materialize", lambda df: written.append(df) or df.localCheckpoint())
    edges = spark.createDataFrame([(i, 100 * (i // 100)) for i in range(300)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 100 * (i // 100) for i in range(300)} and len(written) == 1
