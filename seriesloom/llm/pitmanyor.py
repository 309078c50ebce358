"""Bigram language model: a hierarchical Pitman-Yor process sampled by Gibbs.

Texts are packed into blocks; a block sends what it needs of each context restaurant
(its dishes and counts, once) to the bucket of the context's hash. A bucket merges its
blocks, seats the customers of its restaurants with a parent restaurant that they share,
and averages over the sweeps. Tables become customers of the root restaurant in the
bucket of the word's hash, and every block gets back one number per dish it asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, deltas, planes, undeltas, unplanes, word_hashes

END = np.uint64(1)  # the token that ends a text
START = np.uint64(0)  # the context of a text's first token
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
SWEEPS, BURN_IN = 8, 3
EXACT = 16  # customers of a dish whose tables are drawn exactly
STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 1.0, 0.6, 10.0

_PACK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("train", pa.binary()), ("lengths", pa.binary()), ("text", pa.binary())])
_MESSAGE = pa.schema([("kind", pa.int32()), ("dest", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
PACK, MESSAGE = "block long, ids binary, nulls binary, train binary, lengths binary, text binary", "kind int, dest long, block long, part int, a binary, b binary, c binary, d binary"
DISHES, WORDS, SEATED, TABLES, KNOWN, TOTALS = range(6)


def _coded(p: np.ndarray) -> bytes:
    """Probabilities in 16 bits: steps of 0.07 per cent down to 2^-63, and zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-np.log2(p) * 1024), 0, 65534), 65535).astype(np.uint16).tobytes()


def _decoded(data: bytes) -> np.ndarray:
    q = np.frombuffer(data, np.uint16)
    return np.where(q < 65535, np.exp2(q / -1024.0), 0.0)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, train) to blocks of some MB of compressed text, named by their
    partition, their number there and their content."""
    from pyspark import TaskContext

    partition, made = TaskContext.get().partitionId(), 0

    def block(ids, texts, train):
        text = b"".join(texts)
        lengths = np.array([len(x) for x in texts], np.int64)
        known = np.array([x is not None for x in ids], bool)
        numbers = np.array([x or 0 for x in ids], np.int64)
        flags = np.array(train, bool)
        nonlocal made
        name = xxhash.xxh3_64(np.array([partition, made], np.int64).tobytes() + numbers.tobytes())
        made += 1
        name.update(lengths.tobytes())
        name.update(text)
        key = np.array([name.intdigest()], np.uint64).view(np.int64)[0]
        head = np.int64(len(text)).tobytes()
        row = [key, numbers.tobytes(), known.tobytes(), flags.tobytes(), lengths.tobytes(), head + _codec().compress(text, asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PACK, strict=True)], schema=_PACK)

    ids, texts, train, size = [], [], [], 0
    for part in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
        for i, x, t in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
            ids.append(i)
            texts.append(x or b"")
            train.append(bool(t))
            size += len(texts[-1])
            if size >= BLOCK_BYTES or len(ids) >= 1 << 16:
                yield block(ids, texts, train)
                ids, texts, train, size = [], [], [], 0
    if ids:
        yield block(ids, texts, train)


class _Block:
    """The tokens of a block as indices into its sorted distinct words."""

    def __init__(self, row: dict):
        size = int(np.frombuffer(row["text"][:8], np.int64)[0])
        text = _codec().decompress(row["text"][8:], size, asbytes=True) if size else b""
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["nulls"], bool)
        self.train = np.frombuffer(row["train"], bool)
        ends = np.cumsum(np.frombuffer(row["lengths"], np.int64))
        tokens, contexts, self.lengths = [], [], np.zeros(len(ends), np.int64)
        last = 0
        for k, end in enumerate(ends):
            h = word_hashes(text[last:end].lower().split())
            last = end
            h[h < 2] += np.uint64(2)  # 0 and 1 are the start and the end
            tokens += [h, np.array([END], np.uint64)]
            contexts += [np.array([START], np.uint64), h]
            self.lengths[k] = len(h) + 1
        del text
        tokens = np.concatenate(tokens)
        self.words, at = np.unique(np.concatenate([tokens, np.array([START], np.uint64)]), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.token = at[:-1].astype(np.int64)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[first] = at[-1]
        self.pair = before * np.int64(len(self.words)) + self.token
        self.trained = np.repeat(self.train, self.lengths)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so sorted hashes fall into slices."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _MESSAGE]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE, strict=True)], schema=_MESSAGE)


def _send(buckets: int):
    """Rows to messages of their blocks, by bucket of the word: the words with their counts
    in training texts, and the dishes and counts of each word's restaurant as a context."""

    def run(batches):
        for batch in _pack(batches):
            for row in batch.to_pylist():
                block = _Block(row)
                n = np.int64(len(block.words))
                pairs = np.unique(block.pair)
                seen, count = np.unique(block.pair[block.trained], return_counts=True)
                counts = np.zeros(len(pairs), np.uint32)
                counts[np.searchsorted(pairs, seen)] = count
                lengths = np.bincount(pairs // n, minlength=int(n)).astype(np.uint32)
                words = block.words[pairs % n]
                total = np.bincount(block.token[block.trained], minlength=int(n)).astype(np.uint32)
                starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                cut = np.searchsorted(_bucket(block.words, buckets), np.arange(buckets + 1))
                rows = []
                for b in range(buckets):
                    i, j = cut[b], cut[b + 1]
                    if i < j:
                        s, e = starts[i], starts[j]
                        names, known = deltas(block.words[i:j]), planes(total[i:j])
                        rows.append((WORDS, b, row["block"], b, names, known, None, None))
                        rows.append((DISHES, b, row["block"], b, None, planes(lengths[i:j]), words[s:e].tobytes(), planes(counts[s:e])))
                del block, pairs, words
                yield from _table(rows).to_batches()
                del rows
                pa.default_memory_pool().release_unused()

    return run


def _seatings(most: int, discount: float) -> np.ndarray:
    """[c, t]: the weight of all ways to seat c customers at t tables, without what each
    new table brings: S(c + 1, t) = S(c, t - 1) + (c - discount * t) * S(c, t)."""
    ways = np.zeros((most + 1, most + 1))
    ways[0, 0] = 1.0
    t = np.arange(most + 1)
    for c in range(most):
        ways[c + 1] = (c - discount * t) * ways[c]
        ways[c + 1, 1:] += ways[c, :-1]
    return ways


def seat(customers: np.ndarray, rest: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn by Gibbs given the tables of the restaurant's others.

    rest: the restaurant's strength and discount times the other dishes' tables; parent:
    the parent's probability of the dish. Up to EXACT customers of a dish the number of
    tables is drawn from its exact conditional, P(t) in proportion to the ways to seat them
    at t tables times the product of (rest + discount * i) * parent for i < t; those beyond
    EXACT are seated after these, in groups.
    """
    tables = np.ones(len(customers))
    first = np.minimum(customers, EXACT)
    ways = _seatings(EXACT, discount)
    for c in range(2, EXACT + 1):
        at = np.flatnonzero(first == c)
        if len(at):
            opened = (rest[at, None] + discount * np.arange(c)) * np.asarray(parent)[at, None]
            weight = np.cumsum(np.cumprod(opened, axis=1) * ways[c, 1 : c + 1], axis=1)
            tables[at] = 1 + (weight < rng.random(len(at))[:, None] * weight[:, -1:]).sum(axis=1)
    live, seated = np.flatnonzero(customers > EXACT), EXACT
    while len(live):
        step = seated // 4
        left = np.minimum(customers[live] - seated, step)
        weight = (rest[live] + discount * tables[live]) * parent[live]
        chance = weight / (weight + np.maximum(seated + (left - 1) / 2 - discount * tables[live], 1e-9))
        tables[live] += rng.binomial(left, chance)
        seated += step
        live = live[customers[live] > seated]
    return tables


def _restaurants(buckets: int, seed: int):
    """Merge a bucket's dishes and seat them; answer blocks, and send tables to words."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["block"]))
        out = [(WORDS, r["dest"], r["block"], r["part"], r["a"], r["b"], None, None) for r in rows if r["kind"] == WORDS]
        names = [undeltas(r["a"]) for r in rows if r["kind"] == WORDS]
        rows = [r for r in rows if r["kind"] == DISHES]
        part, blocks = rows[0]["part"], [r["block"] for r in rows]
        n_contexts = [len(x) for x in names]
        contexts, at_context = np.unique(np.concatenate(names), return_inverse=True)
        lengths = np.concatenate([unplanes(r["b"], np.uint32) for r in rows])
        n_dishes = [len(r["c"]) // 8 for r in rows]
        words, at_word = np.unique(np.concatenate([np.frombuffer(r["c"], np.uint64) for r in rows]), return_inverse=True)
        key = np.repeat(at_context, lengths) * np.int64(len(words)) + at_word
        del at_word, names
        dishes, at_dish = np.unique(key, return_inverse=True)
        del key
        count = np.bincount(at_dish, np.concatenate([unplanes(r["d"], np.uint32) for r in rows]), len(dishes))
        del rows
        used = np.flatnonzero(count)
        c = count[used].astype(np.int64)
        u, w = dishes[used] // len(words), dishes[used] % len(words)
        rng = np.random.default_rng([seed, part])
        once, twice = int((c == 1).sum()), int((c == 2).sum())
        discount = float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5
        size = np.bincount(u, c, len(contexts))
        mean = np.zeros(len(c))
        if len(c):
            uniform = 1.0 / (buckets * max(1, len(np.unique(w))) + 1)
            tables = np.ones(len(c))
            root = np.ones(len(words))
            for sweep in range(SWEEPS):
                sent = np.bincount(w, tables, len(words)).astype(np.int64)
                rest = ROOT_STRENGTH + ROOT_DISCOUNT * (root.sum() - root)
                root = np.where(sent > 0, seat(sent, rest, np.full(len(words), uniform), ROOT_DISCOUNT, rng), 0)
                parent = (sent - ROOT_DISCOUNT * root + (ROOT_STRENGTH + ROOT_DISCOUNT * root.sum()) * uniform) / (ROOT_STRENGTH + sent.sum())
                others = np.bincount(u, tables, len(contexts))[u] - tables
                tables = seat(c, STRENGTH + discount * others, parent[w], discount, rng)
                if sweep >= BURN_IN:
                    mean += tables / (SWEEPS - BURN_IN)
            sent = np.bincount(w, tables, len(words)).astype(np.uint32)
        else:
            sent = np.zeros(len(words), np.uint32)
        own = np.zeros(len(dishes))
        own[used] = (c - discount * mean) / (STRENGTH + size[u])
        back = ((STRENGTH + discount * np.bincount(u, mean, len(contexts))) / (STRENGTH + size)).astype(np.float32)
        at_c = at_d = 0
        for block, nc, nd in zip(blocks, n_contexts, n_dishes, strict=True):
            out.append((SEATED, block, block, part, _coded(own[at_dish[at_d : at_d + nd]]), back[at_context[at_c : at_c + nc]].tobytes(), None, None))
            at_c, at_d = at_c + nc, at_d + nd
        some = np.flatnonzero(sent)
        words, sent = words[some], sent[some]
        cut = np.searchsorted(_bucket(words, buckets), np.arange(buckets + 1))
        for b in range(buckets):
            i, j = cut[b], cut[b + 1]
            if i < j:
                out.append((TABLES, b, part, b, deltas(words[i:j]), planes(sent[i:j]), None, None))
        return _table(out)

    return run


def _root(buckets: int, seed: int):
    """Count the words of a bucket and seat the root restaurant's customers."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["block"]))
        asked = [r for r in rows if r["kind"] == WORDS]
        tables = [r for r in rows if r["kind"] == TABLES]
        names = [undeltas(r["a"]) for r in asked]
        words, at = np.unique(np.concatenate(names), return_inverse=True)
        count = np.bincount(at, np.concatenate([unplanes(r["b"], np.uint32) for r in asked]), len(words)).astype(np.int64)
        sent = np.zeros(len(words), np.int64)
        for r in tables:
            sent[np.searchsorted(words, undeltas(r["a"]))] += unplanes(r["b"], np.uint32)
        root, mean = np.where(sent > 0, 1.0, 0.0), np.zeros(len(words))
        rng = np.random.default_rng([seed, 1, asked[0]["part"]])
        uniform = 1.0 / (buckets * max(1, int((count > 0).sum())) + 1)
        for sweep in range(SWEEPS):
            rest = ROOT_STRENGTH + ROOT_DISCOUNT * buckets * (root.sum() - root)
            root = np.where(sent > 0, seat(sent, rest, np.full(len(words), uniform), ROOT_DISCOUNT, rng), 0)
            if sweep >= BURN_IN:
                mean += root / (SWEEPS - BURN_IN)
        own = np.maximum(sent - ROOT_DISCOUNT * mean, 0).astype(np.float32)
        out, last = [], 0
        for r, name in zip(asked, names, strict=True):
            k = at[last : last + len(name)]
            last += len(k)
            out.append((KNOWN, r["block"], r["block"], r["part"], planes(count[k].astype(np.uint32)), planes(own[k]), None, None))
        totals = np.array([count.sum(), (count > 0).sum(), sent.sum(), mean.sum()], np.float64)
        out.append((TOTALS, 0, 0, asked[0]["part"], totals.tobytes(), None, None, None))
        return _table(out)

    return run


def _doubles(batches):
    """The four totals of each bucket as columns."""
    for batch in batches:
        rows = np.array([np.frombuffer(x, np.float64) for x in batch.column("a").to_pylist()]).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], names=["n_train", "n_words", "customers", "tables"])


def _score(packs: pa.Table, answers: pa.Table) -> pa.Table:
    """Per text: its tokens, the known ones, the score of the add-one model and its own."""
    out = {k: [] for k in ("doc_id", "train", "n_tokens", "n_known", "base_score", "score", "train_tokens")}
    rows = answers.to_pylist()
    seated = sorted((r for r in rows if r["kind"] == SEATED), key=lambda r: r["part"])
    known = sorted((r for r in rows if r["kind"] == KNOWN), key=lambda r: r["part"])
    if packs.num_rows and not known:
        raise ValueError("the blocks of the two passes differ: the input isn't deterministic")
    own = back = count = base = None
    if packs.num_rows:
        own = np.concatenate([_decoded(r["a"]) for r in seated])
        back = np.concatenate([np.frombuffer(r["b"], np.float32) for r in seated])
        count = np.concatenate([unplanes(r["a"], np.uint32) for r in known]).astype(np.float64)
        base = np.concatenate([unplanes(r["b"], np.float32) for r in known]).astype(np.float64)
    for row in packs.to_pylist():
        block = _Block(row)
        n_train, n_words, customers, tables = (row[k] for k in ("n_train", "n_words", "customers", "tables"))
        parent = (base + (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (n_words + 1)) / (ROOT_STRENGTH + customers)
        pairs, at = np.unique(block.pair, return_inverse=True)
        lengths = np.bincount(pairs // len(block.words), minlength=len(block.words))
        p = own + np.repeat(back, lengths) * parent[pairs % len(block.words)]
        first = np.concatenate([[0], np.cumsum(block.lengths)[:-1]])
        out["score"].append(np.add.reduceat(np.log10(p)[at], first))
        plain = np.log10((count + 1) / (n_train + n_words + 1))
        out["base_score"].append(np.add.reduceat(plain[block.token], first))
        out["n_known"].append(np.add.reduceat((count > 0)[block.token].astype(np.int64), first))
        out["n_tokens"].append(block.lengths)
        out["train"].append(block.train)
        out["doc_id"].append(pa.array(block.ids, pa.int64(), mask=~block.known))
        out["train_tokens"].append(np.full(len(block.ids), int(n_train)))
    arrays = {k: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in v]) if v else [] for k, v in out.items()}
    types = {"doc_id": pa.int64(), "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "train_tokens": pa.int64()}
    return pa.table({k: pa.array(v, types[k]) if isinstance(v, list) else v.cast(types[k]) for k, v in arrays.items()})


def pitman_yor_scores(docs: DataFrame, train: Column, seed: int = 1) -> DataFrame:
    """Score the texts of `docs` (doc_id, text) by a model of those where `train` holds.

    Returns doc_id, train, n_tokens, n_known, base_score, score and train_tokens; scores
    are log10 probabilities, base_score is that of the add-one unigram model. Tokens are
    the words (split at ASCII white space, A-Z lower-cased) and one end. A null text is
    an empty one (its only token is the end); null doc_ids, ties, repeated rows and extra
    columns do no harm, each row gets its own result; a text is scored whole, however long;
    an empty table gives an empty result. Without training texts every score is that of the uniform base.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-size // BUCKET_BYTES))
    packs = rows.mapInArrow(_pack, PACK)
    sent = rows.mapInArrow(_send(buckets), MESSAGE)
    seated = sent.groupBy("dest").applyInArrow(_restaurants(buckets, seed), MESSAGE)
    root = seated.where(F.col("kind").isin(WORDS, TABLES)).groupBy("dest").applyInArrow(_root(buckets, seed), MESSAGE)
    totals = root.where(F.col("kind") == TOTALS).mapInArrow(_doubles, "n_train double, n_words double, customers double, tables double")
    totals = totals.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in totals.columns))
    answers = seated.where(F.col("kind") == SEATED).unionByName(root.where(F.col("kind") == KNOWN))
    packs = packs.crossJoin(F.broadcast(totals))  # one row
    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long"
    return packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, schema)
