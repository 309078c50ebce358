import random
import re

from seriesloom.llm.decontaminate import find_contamination, remove_contamination


def words(t):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(up))


def brute(docs, items, k=10):
    out = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, u in items:
            v = words(u)
            n = min(k, len(v))
            for a in range(len(v) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        names.add(str(name))
        out[i] = (len(w), len(hit), sorted(names))
    return out


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(spark, table):
    rng = random.Random(1)
    some = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice((0, 1, 4, 9, 10, 11, 25))))) for i in range(12)]
    some += [(20, "One, two; THREE four five six seven eight nine ten eleven é1"), (21, None)]
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(60)]
    docs += [(100, "zero one two three four. five six-seven eight nine ten zero"), (101, None), (102, "")]
    want = brute(docs, some)
    for blocks in (200_000, 20):  # one automaton, and several
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in find_contamination(table(docs), items(spark, some), block_words=blocks).collect()}
        assert got == want


def test_spans_are_removed(spark, table):
    passage = " ".join(f"bench{i}" for i in range(12))
    clean = " ".join(f"clean{i}" for i in range(30))
    docs = [(1, f"{clean} {passage.upper()}, {clean}"), (2, clean), (3, passage), (4, None), (2, clean)]
    got = sorted((r.doc_id, r.text) for r in remove_contamination(table(docs), items(spark, [(1, passage)])).collect() if r.text is not None)
    assert got == [(1, f"{clean} , {clean}"), (2, clean), (2, clean)]


def test_no_items_and_no_documents(spark, table, odd):
    assert find_contamination(table(odd), items(spark, [])).where("n_hit > 0").count() == 0
    assert find_contamination(table([]), items(spark, [(1, "a")])).count() == 0


def test_items_without_a_name_beside_named_ones(spark, table):
    items = spark.createDataFrame([(None, "one two three four"), ("b", "five six seven"), ("a", "eight nine ten")], "item_id string, text string")
    for words in (200_000, 1):
        got = find_contamination(table([(1, "x one two three four y eight nine ten five six seven")]), items, block_words=words).first()
        assert (got.n_hit, got.items) == (10, ["a", "b"])
