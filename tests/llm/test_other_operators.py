import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import maintext
from seriesloom.llm.langid import keep_identified, page_languages, train_text_model
from seriesloom.llm.linededup import dedup_lines
from seriesloom.llm.sharding import shard_documents
from seriesloom.llm.syncmers import K, S, anchors, marks, positional_matches, sketch, syncmer_fingerprints
from seriesloom.llm.toxicity import held_out, toxicity_scores

SMALL = "/root/testdata/sf0.001"


# lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


@pytest.mark.parametrize("least", [8, 20])
def test_line_dedup_equals_brute_force(spark, table, least):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé ") for _ in range(rng.choice((8, 9, 10, 20, 21, 40)))) for _ in range(25)]
    base += [f"user {i:05d} logged in from the office" for i in range(150)]  # a crowd with equal ends

    def near(line):
        i = rng.randrange(len(line))
        return rng.choice((line, line.upper(), line[:i] + line[i + 1 :], line[:i] + "z" + line[i:], line[:i] + "y" + line[i + 1 :]))

    docs = [(i, "\n".join(near(rng.choice(base)) for _ in range(rng.randrange(1, 6)))) for i in range(90)]
    seen, want = [], {}
    for i, t in docs:
        keep = []
        for line in t.split("\n"):
            n = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
            if len(n) < least or not any(n == m or one_edit(n, m) for m in seen):
                keep.append(line)
            if len(n) >= least:
                seen.append(n)
        want[i] = "\n".join(keep)
    got = {r.doc_id: r.text for r in dedup_lines(table(docs), least).collect()}
    assert got == want


def test_line_dedup_odd_rows(spark, table, odd):
    got = dedup_lines(table(odd)).collect()
    by = {r.doc_id: r for r in got if r.doc_id != 7}
    assert len(got) == len(odd) and by[2].text is None and by[3].text == "" and by[5].text and by[6].text == ""
    assert dedup_lines(table([])).count() == 0


# shards


def test_shards_are_whole_and_even(spark, table, odd):
    rng = random.Random(2)
    rows = [*odd, *((i, "copy of one text " * 9) for i in range(100, 500)), *((i, "v" * rng.randrange(300)) for i in range(500, 1200))]
    got = shard_documents(table(rows), 8).toPandas()
    assert len(got) == len(rows) and sorted(got["size"]) == sorted(len((t or "").encode()) + 16 for _, t in rows)
    sizes = got.groupby("shard")["size"].sum()
    rest = got[got["size"] < 1000]
    assert sizes.max() - sizes.min() <= got["size"].max() + 0.01 * sizes.sum() and rest.shard.max() <= 7
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    crc = {i: zlib.crc32((t or "").encode()) for i, t in rows}
    assert all(crc[int(i)] == c for i, c in zip(got.doc_id, got.text_crc32, strict=True) if i == i)


def test_shards_of_little(spark, table):
    assert shard_documents(table([]), 40).count() == 0
    assert shard_documents(table([(1, None)]), 40).count() == 1


# fingerprints


def brute_syncmers(text):
    import xxhash

    h = lambda x: np.array([xxhash.xxh64_intdigest(x.encode(), seed=42)], np.uint64).view(np.int64)[0]
    out = []
    for i in range(len(text) - K + 1):
        inner = [h(text[j : j + S]) for j in range(i, i + K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_fingerprints_grow_with_the_text(spark, table):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = fresh(60)
    rows = [(i, fresh(2500) + " " + passage + " " + fresh(2500)) for i in (1, 2)]
    got = {r.doc_id: r for r in syncmer_fingerprints(table(rows)).collect()}
    one, two = ({t[i : i + K] for i in brute_syncmers(t)} for _, t in rows)
    assert 0.05 < len(got[1].fingerprint) / 16 / len(one) < 0.25
    assert abs(got[2].near_next - len(one & two) / len(one | two)) < 0.004 and got[2].near_next > 0


def test_closed_syncmers_equal_brute_force(spark, table):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé \n🙂") for _ in range(n)) for n in (9, 10, 11, 63, 64, 65, 75, 200, 500)]
    got = anchors(table(list(enumerate(texts)))).groupBy("doc_id").agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
    found = {r.doc_id: r.p for r in got}
    for i, t in enumerate(texts):
        assert found.get(i, []) == brute_syncmers(t)


def test_edited_fingerprints(spark, table, odd):
    rows = [r for r in odd if r[0] not in (7, None)] + [(100 + i, "".join(random.Random(i).choice("abcdefgh ") for _ in range(i * 3))) for i in range(40)]
    got = {r.doc_id: r for r in syncmer_fingerprints(table(rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    edited = []
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        edited.append((i, t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]))
    direct = spark.createDataFrame(edited, "doc_id long, t string").select("doc_id", F.array_join(F.transform(sketch(marks(F.col("t"))), lambda h: F.lpad(F.hex(h), 16, "0")), "").alias("f"), F.sha2("t", 256).alias("s"))
    for r in direct.collect():
        assert got[r.doc_id].edited_fingerprint == r.f and got[r.doc_id].edited_sha256 == r.s
    assert got[5].fingerprint == got[6].fingerprint and got[2].fingerprint == got[3].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_fingerprints_of_repeated_rows_and_none(spark, table, odd):
    assert syncmer_fingerprints(table(odd)).count() == len(odd)
    assert syncmer_fingerprints(table([])).count() == 0
    assert syncmer_fingerprints(table([(1, "just one text of a row")])).first().near_next == 1.0


def test_positional_matches_show_the_shift(spark, table):
    passage = "".join(random.Random(4).choice("abcdefgh ") for _ in range(300))
    a = anchors(table([(1, passage)]))
    b = anchors(table([(2, "0123456789" * 3 + passage)]))
    best = positional_matches(a, b).orderBy(F.desc("anchors")).first()
    assert best["shift"] == 30 and best["anchors"] > 50


# pages


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def right_of(tree, pages):
    found = [maintext.decide(tree, features) == text.startswith("Main") for page in pages for text, features in maintext.blocks(page)]
    return sum(found), len(found)


def test_main_text_of_labelled_pages():
    right, total = right_of(maintext.train(), [page for layout in maintext.labelled_pages().values() for page in layout])
    assert total > 1000 and right / total > 0.99


def test_the_tree_splits_on_words_links_and_neighbours():
    def used(tree):
        return {maintext.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if len(tree) > 1 else set()

    tree = maintext.train()
    names = used(tree)
    assert {"words", "link_density"} <= names and names & {"words_before", "link_density_before", "words_after", "link_density_after"}
    assert maintext.FEATURES[tree[0]] not in ("article", "nested_article")


def test_main_text_of_layouts_left_out_of_the_training():
    """A layout is judged by a tree that has seen none of its pages."""
    layouts = maintext.labelled_pages()
    right = total = 0
    for name, pages in layouts.items():
        r, n = right_of(maintext.train([p for other, x in layouts.items() if other != name for p in x]), pages)
        assert r / n > 0.75
        right, total = right + r, total + n
    assert right / total > 0.93


def test_main_text_without_an_article():
    tree = maintext.train()
    words = lambda n, w="word": " ".join([w] * n)
    for n, size in ((8, 16), (6, 35), (3, 120)):
        page = "<body><h1>A title of it</h1>" + f"<p>{words(size)}</p>" * n
        assert maintext.main_text(page, tree) == "\n".join(["A title of it", *[words(size)] * n])
    body = f"<h1>A title of it</h1><p>{words(40)}</p><p>{words(30)}</p>"
    for odd in (f"<nav>{words(60)}</nav>", f"<footer>{words(60)}</footer>", f"<form>{words(55)}</form>", f"<aside><p>{words(50)}</p></aside>", f"<div><a href=x>{words(60)}</a></div>", f'<div id="cookie-notice"><p>{words(30)}</p></div>', f"<div role=navigation>{words(20)}</div>"):
        want = "\n".join(["A title of it", words(40), words(30)])
        assert maintext.main_text(f"<body>{odd}{body}", tree) == want == maintext.main_text(f"<body>{body}{odd}", tree)


def test_main_text_of_an_article_with_adverts_and_comments():
    tree = maintext.train()
    words = lambda n, w="word": " ".join([w] * n)
    page = f"<article><h1>Title</h1><p>{words(40)}</p><div class='ad-box'>{words(9, 'ad')}</div><p class=sponsored>{words(20, 'ad')}</p><p>{words(2)}</p><p>{words(20)} <a href=x>{words(10)}</a></p><section class=userComments><p>{words(30, 'reply')}</p></section><div class='lead header'><p>{words(5)}</p></div></article>"
    assert maintext.main_text(page, tree) == "\n".join(["Title", words(40), words(2), words(30), words(5)])


def test_features_equal_a_plain_count():
    page = "<body><a href='u'><div>one two</div><div>three</div></a><div>four <a href='v'>five</a></div><a name='x'>six</a><article><h2>seven</h2><p>eight nine<article><li>ten</article></article>"
    want = [("one two", 2, 1.0, -1, 0), ("three", 1, 1.0, -1, 0), ("four five", 2, 0.5, -1, 0), ("six", 1, 0.0, -1, 0), ("seven", 1, 0.0, 1, 0), ("eight nine", 2, 0.0, 1, 0), ("ten", 1, 0.0, 1, 1)]
    got = maintext.blocks(page)
    assert [(t, f[0], f[1], f[6], f[7]) for t, f in got] == want
    for i, (_, f) in enumerate(got):
        before, after = ([got[j][1][0], got[j][1][1]] if 0 <= j < len(got) else [0, 0] for j in (i - 1, i + 1))
        assert f[2:6] == [*before, *after]


def test_main_text_of_the_articles(spark):
    from seriesloom.llm.maintext import extract_main_text

    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(table).collect()}
    for r in table.collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        body = re.sub(r"<[^>]*$", "", body).replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        parts = [" ".join(__import__("html").unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_main_text_odd_pages(spark):
    from seriesloom.llm.maintext import extract_main_text

    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<", "x"), (4, "u", "<article><p>a &lt; b &amp;&nbsp;c<br>d<p>e</article", "x"), (5, "u", "<script>var a='<p>no</p>'", "x"), (None, "u", "<article>" + "<p>w</p>" * 5000, "x")]
    got = {r.page_id: r for r in extract_main_text(pages(spark, rows)).collect()}
    assert [got[i].text for i in (1, 2, 5)] == ["", "", ""] and got[4].text == "a < b & c d\ne" and got[None].n_chars == 9999
    assert extract_main_text(pages(spark, [])).count() == 0


# languages


def test_languages_are_found(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = train_text_model(docs.where("doc_id % 2 = 0").select("text", "lang"))
    found = page_languages(spark.read.parquet(f"{SMALL}/pages.parquet"), model)
    assert found.count() == 50 and found.where("language = declared").count() >= 48
    rest = docs.where("doc_id % 2 = 1").withColumn("lang", F.lit("xx"))
    kept = keep_identified(rest, model)
    assert kept.columns == docs.columns and kept.count() >= rest.count() - 3


def test_languages_odd_rows(spark, table, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = train_text_model(docs.select("text", "lang"))
    df = table(odd)
    kept = keep_identified(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {1, 5, 6, 7} and kept.where("doc_id in (2, 3, 4)").count() == 0
    assert keep_identified(table([]), model).count() == 0
    assert train_text_model(docs.where("false").select("text", "lang")).languages == ["und"]
    rows = [(1, None, None, "x"), (2, "not a url", "", "x"), (None, "http://a.example.de/", "<html lang='de'>", "x")]
    got = {r.page_id: r for r in page_languages(pages(spark, rows), model).collect()}
    assert got[1].language is None and got[None].language == "de"


# toxicity


def test_toxic_documents_are_found(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity_scores(docs, labels.where(~held_out("doc_id", 3, 1)).select("doc_id", F.col("toxic").alias("label")))
    got = scored.join(labels, "doc_id").where(held_out("doc_id", 3, 1)).toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.6 and clean.predicted.mean() < 0.01


def test_toxicity_odd_rows(spark, table, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (6, 1), (None, 1), (99, 1), (8, None)], "doc_id long, label int")
    got = toxicity_scores(table(odd), labels)
    assert got.count() == len(odd) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in toxicity_scores(table(odd), labels.where("false")).collect()} == {0.5}
    assert toxicity_scores(table([]), labels).count() == 0


def test_declared_language_after_a_long_comment(spark):
    model = train_text_model(spark.createDataFrame([("the cat sat on the mat", "en"), ("die Katze sitzt auf der Matte", "de")] * 20, "text string, lang string"))
    comment = '<!-- <html lang="en"> ' + "x" * 5000 + " -->"
    heads = {1: comment + '\n<!DOCTYPE html><html class="a" LANG="de">', 2: " " * 9000 + "<html lang='de'>", 3: '<html lang="de">', 4: '<html><p>said: <html lang="de">', 5: comment}
    pages = spark.createDataFrame([(i, "http://a.example/", h + "<body>1</body>") for i, h in heads.items()], "page_id long, url string, html string")
    got = {r.page_id: r.declared for r in page_languages(pages, model).collect()}
    assert got == {1: "de", 2: "de", 3: "de", 4: None, 5: None}


def test_declared_language_is_the_whole_primary_tag(spark):
    from seriesloom.llm.langid import TextModel, page_languages

    model = TextModel(["es", "fr"], np.full((2, 1 << 16), -1.0, np.float32))
    pages = [(i, None, f"<!-- {'x' * 5000} --><html lang={t}><p>a") for i, t in enumerate(("'est'", '"frp"', "es", "'fr-CA'", "ES_mx", '" fr"'))]
    got = page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()
    assert [r.declared for r in sorted(got, key=lambda r: r.page_id)] == [None, None, "es", "fr", "es", "fr"]


def test_many_hosts_get_the_verdicts_of_few(spark, monkeypatch):
    from seriesloom.llm import langid

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("source", F.concat(F.when(F.col("doc_id") % 3 == 0, "hot").otherwise((F.col("doc_id") % 40).cast("string")), F.lit(".example.com")))
    model = train_text_model(docs.select("text", "lang"))
    rows = docs.withColumns({"x_host": F.col("source"), "x_declared": F.col("lang")})
    found = lambda: sorted(map(tuple, langid.identify_languages(rows, model, "text", ["doc_id"]).collect()))
    want = found()
    monkeypatch.setattr(langid, "SENT_HOSTS", 10)
    assert found() == want and len(want) == docs.count()


def test_blocks_are_counts_of_cuts_below(spark):
    from seriesloom.llm.syncmers import blocked

    docs = spark.range(0, 3000, 7).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for blocks in (2, 3, 50):
        rows, cuts = blocked(docs, blocks)
        assert all(r.block == sum(c < r.doc_id for c in cuts) for r in rows.collect())
