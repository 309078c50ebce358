import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from seriesloom.llm.packing import WINDOW, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark, table, odd):
    spaced = [(20, "two  blanks"), (21, "\n\nlines\n\n"), (22, " lead"), (23, "tab\tand nbsp"), (24, "end <|endoftext|> x"), (25, "it's\nfine. no?\nyes"), (26, "a\r\nb")]
    rows = [r for r in odd if r[0] != 7] + spaced + [(100 + i, f"some words of text {i} " + "more " * (i * 7)) for i in range(60)]
    got = pack_documents(table(rows), PATH).toPandas()
    full = Tokenizer.from_file(PATH)
    for i, text in rows:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("start")
        assert own.doc_tokens.eq(len(ids)).all() and own.length.sum() == len(ids)
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= WINDOW
    assert got.length.sum() / (got.sequence_id.nunique() * WINDOW) > 0.98


def test_empty_table_and_repeated_rows(spark, table):
    assert pack_documents(table([]), PATH).count() == 0
    got = pack_documents(table([(1, "x y"), (1, "x y"), (1, None)]), PATH)
    assert got.count() == 3


def test_neighbours_share_a_window(spark, table):
    a, b = "alpha beta gamma " * 40, "quartz zebra violin " * 40
    rows = [(i, (a if i % 2 else b) + str(i)) for i in range(60)]
    got = pack_documents(table(rows), PATH).toPandas()
    pure = [len({int(i) % 2 for i in s.doc_id}) == 1 for _, s in got.groupby("sequence_id")]
    assert np.mean(pure) > 0.8


def test_neighbours_are_found_by_whole_documents(spark, table):
    heads = ["alpha beta gamma " * 300, "quartz zebra violin " * 230]
    full = Tokenizer.from_file(PATH)
    rows = []
    for i in range(60):
        head = full.decode(full.encode(heads[i % 2], add_special_tokens=False).ids[:900])
        rows.append((i, head + " and so on" * 100))  # the rest is the same in all
    got = pack_documents(table(rows), PATH).toPandas()
    assert (got.doc_tokens > WINDOW).all()
    rests = got[got.start >= WINDOW]
    pure = [len({int(i) % 2 for i in s.doc_id}) == 1 for _, s in rests.groupby("sequence_id")]
    assert np.mean(pure) > 0.8


def test_documents_with_a_rare_word_in_common_share_a_shard(spark, table, monkeypatch):
    full = Tokenizer.from_file(PATH)
    ids = [i for i in range(5000, 12000) if (t := full.decode([i])).startswith(" ") and t.strip().isalpha() and full.encode(t, add_special_tokens=False).ids == [i]]
    common = full.decode([max(i for i in range(40000, 50000) if full.decode([i]).strip().isalpha())])
    rows = [(i, (" plain text" + common) * 5 + full.decode([ids[7 * (i % 40)]]) * 3) for i in range(80)]
    monkeypatch.setattr("seriesloom.llm.packing.SHARD_TEXTS", 20)
    got = pack_documents(table(rows), PATH).toPandas()
    shard = {int(r.doc_id): r.sequence_id >> 40 for r in got.itertuples()}
    assert len(set(shard.values())) > 1
    assert np.mean([shard[i] == shard[i + 40] for i in range(40)]) > 0.8


def test_neighbours_equal_brute_force_bm25():
    import math

    import numpy as np

    from seriesloom.llm import packing

    rng = np.random.default_rng(4)
    docs = [np.minimum(rng.zipf(1.3, rng.integers(5, 80)), 500).astype(np.uint16) for _ in range(60)]
    bags = [np.unique(d, return_counts=True) for d in docs]
    df = np.bincount(np.concatenate([u for u, _ in bags]), minlength=packing.N_IDS)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    mean = sum(map(len, docs)) / len(docs)
    index = packing._Index(bags, idf, mean)
    for seed in range(0, 60, 7):
        want = []
        for d in docs:
            length, score = len(d), 0.0
            for t in set(docs[seed].tolist()):
                tf = (d == t).sum()
                score += math.log(1 + (60 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
            want.append(score)
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
        best = packing._best(index.scores(seed), np.arange(60) != seed, 5)[:5]
        assert np.allclose(np.sort([want[k] for k in best]), np.sort(np.delete(want, seed))[-5:], rtol=1e-4)


def test_ids_are_those_of_the_tokenizer_file():
    import random

    import numpy as np
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from seriesloom.llm.packing import encoder

    rng = random.Random(1)
    pieces = ["a", "B", "é", "  ", " ", "\n", "\n\n", "\t", "\r\n", "'s", "'", "1", "23", ".", "!!", "中", "́", "😀", "don't", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "<|endoftext|>", "<|", "᠎", ""]
    full, own = Tokenizer.from_file(path("byte_bpe_50k.json")), encoder(path("byte_bpe_50k.json"))
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert np.frombuffer(own.encode(text), np.uint16).tolist() == full.encode(text, add_special_tokens=False).ids
