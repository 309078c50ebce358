"""Lexical retrieval packing: a sharded BM25 index names unused neighbours of each seed
text, and these fill its window of tokens."""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, planes, unplanes

WINDOW = 1024
END_ID = 0
SHARD_TEXTS = 4096  # texts in one index
K1, B = 1.2, 0.75
N_IDS = 1 << 16

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian 16-bit bytes, as the tokenizer file gives them."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path[: -len(".json")] + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = PATTERN.replace(r"\s+(?!\S)|\s+", r"\s+")
        self.runs, self.fast = (tiktoken.Encoding("byte_bpe_50k", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PATTERN, plain))

    def encode(self, text: str) -> bytes:
        words = text.split()
        spaces = sum(map(text.count, " \n\t\r"))
        # other white space and marks of special tokens need the tokenizer file's own code
        if len(text) - spaces != len("".join(words)) or "<|" in text or "\u180e" in text:
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:  # without white space next to white space no look ahead is needed
            between = len(words) - 1 + text[:1].isspace() + text[-1:].isspace()
            ids = (self.fast if spaces <= between else self.runs)(text)
        return array("H", ids).tobytes()


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_TOKENS = "row long, doc_id long, doc_tokens long, full array<long>, rest binary, terms binary, counts binary"
_DEALT = "row long, doc_id long, doc_tokens long, full array<long>, rest binary, terms binary, counts binary, rarest int, next int"


def _tokenize(path: str):
    """Per document: its tokens, checksums of its whole windows, the ids of the rest, and
    the distinct ids of all of it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)
        end = array("H", [END_ID]).tobytes()
        for batch in batches:
            totals, full, rest, terms, counts = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                ids = np.frombuffer(enc.encode(text or "") + end, np.uint16)
                whole = len(ids) - len(ids) % WINDOW
                totals.append(len(ids))
                full.append([_crc(ids[i : i + WINDOW]) for i in range(0, whole, WINDOW)])
                rest.append(ids[whole:].tobytes())
                some, n = np.unique(ids, return_counts=True)
                terms.append(some.tobytes())
                counts.append(planes(n.astype(np.uint32)))
            columns = [pa.array(totals, pa.int64()), pa.array(full, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in (rest, terms, counts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["row", "doc_id", "doc_tokens", "full", "rest", "terms", "counts"])

    return run


def _terms(batches):
    """Partial document frequencies of token ids."""
    count = np.zeros(N_IDS, np.int64)
    size = texts = 0
    for batch in batches:
        for terms in batch.column(1).to_pylist():
            count[np.frombuffer(terms, np.uint16)] += 1
        size += sum(batch.column(0).to_pylist())
        texts += batch.num_rows
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int64()), pa.array([*count[some].tolist(), texts, size], pa.int64())], names=["term", "n"])


def _rarest(shared):
    """The two rarest ids of each document among those that other documents have too."""

    def run(batches):
        idf, _, alone = shared.value
        rank = np.where(alone, -1.0, idf)
        for batch in batches:
            first, second = [], []
            for terms in batch.column("terms").to_pylist():
                ids = np.frombuffer(terms, np.uint16)
                best = ids[np.lexsort((ids, -rank[ids]))[:2]]
                first.append(int(best[0]))
                second.append(int(best[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=[*batch.schema.names, "rarest", "next"])

    return run


class _Index:
    """BM25 over the whole documents of a shard; the frequencies are those of all documents."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float):
        self.unique = [u for u, _ in bags]
        term = np.concatenate(self.unique).astype(np.int64)
        owner = np.repeat(np.arange(len(bags)), [len(u) for u in self.unique])
        tf = np.concatenate([c for _, c in bags]).astype(np.float64)
        length = np.array([c.sum() for _, c in bags], np.float64)[owner]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))
        # terms of a quarter of the shard's documents or more are rows of a matrix
        often = np.bincount(term, minlength=N_IDS) * 4 >= len(bags)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), len(bags)), np.float32)
        dense = often[term]
        self.rows[self.row[term[dense]], owner[dense]] = weight[dense]
        term, owner, weight = term[~dense], owner[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order].astype(np.int32), weight[order].astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(N_IDS + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all documents of the shard for all terms of the seed."""
        terms = self.unique[seed]
        row = self.row[terms]
        score = np.add.reduce(self.rows[row[row >= 0]], axis=0).astype(np.float64)
        rare = terms[row < 0]
        cuts = [slice(i, j) for i, j in zip(self.start[rare].tolist(), self.start[rare.astype(np.int64) + 1].tolist(), strict=True)]
        if cuts:
            owners = np.concatenate([self.owner[c] for c in cuts])
            score += np.bincount(owners, np.concatenate([self.weight[c] for c in cuts]), len(score))
        return score


def _best(score: np.ndarray, free: np.ndarray, most: int) -> np.ndarray:
    """Free texts by falling score, `most` at the most."""
    score = np.where(free, score, 0)
    if int((score > 0).sum()) > most:
        best = np.argpartition(-score, most)[:most]
    else:
        best = np.flatnonzero(score > 0)
    return best[np.lexsort((best, -score[best]))]


def _fill(rows: list, idf: np.ndarray, mean: float, first: int) -> tuple[list, int]:
    """Pack one shard: pieces (row number, start, length, crc, sequence, offset)."""
    out, sequence = [], first
    texts = []
    for k, r in enumerate(rows):
        for i, crc in enumerate(r["full"]):
            out.append((k, i * WINDOW, WINDOW, crc, sequence, 0))
            sequence += 1
        texts.append(np.frombuffer(r["rest"], np.uint16))
    begin = np.array([len(r["full"]) * WINDOW for r in rows])
    used = np.zeros(len(rows), np.int64)  # ids of the rest that have a place
    free = np.array([len(t) > 0 for t in texts], bool)
    index = _Index([(np.frombuffer(r["terms"], np.uint16), unplanes(r["counts"], np.uint32)) for r in rows], idf, mean)
    seed = 0

    def place(k: int, room: int, offset: int) -> int:
        ids = texts[k][used[k] : used[k] + room]
        out.append((k, int(begin[k] + used[k]), len(ids), _crc(ids), sequence, offset))
        used[k] += len(ids)
        free[k] = used[k] < len(texts[k])
        return len(ids)

    while True:
        while seed < len(rows) and not free[seed]:
            seed += 1
        if seed == len(rows):
            break
        offset = place(seed, WINDOW, 0)
        score = index.scores(seed) if offset < WINDOW else None
        while offset < WINDOW:
            near = _best(score, free, 32)
            if not len(near):  # nothing in common: the next free texts
                near = np.flatnonzero(free)[:32]
                if not len(near):
                    break
            for k in near.tolist():
                offset += place(k, WINDOW - offset, offset)
                if offset == WINDOW:
                    break
        sequence += 1
    return out, sequence


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(shared):
    def run(batches):
        from pyspark import TaskContext

        idf, mean, _ = shared.value
        sequence = TaskContext.get().partitionId() << 40
        rows: list = []

        def full() -> pa.RecordBatch:
            nonlocal sequence
            pieces, sequence = _fill(rows, idf, mean, sequence)
            k = [p[0] for p in pieces]
            columns = [[rows[i]["doc_id"] for i in k], *([p[j] for p in pieces] for j in (1, 2, 3)), [rows[i]["doc_tokens"] for i in k], *([p[j] for p in pieces] for j in (4, 5))]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_PIECES)

        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                if len(rows) == SHARD_TEXTS:
                    yield full()
        if rows:
            yield full()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for each
    piece. A document's ids are those of the tokenizer file, then id 0; its whole windows
    are sequences, and the rest of it is to be placed. Documents are indexed and looked up
    with all their ids (BM25 over token ids). They are dealt by range of (the two rarest
    ids that other documents have too, doc_id) into shards of at most SHARD_TEXTS; each
    seed takes its unused neighbours by falling score, the last is cut where the window
    ends and its remainder stays to be used, so only a shard's last sequence has room.

    Texts are read whole, however long. Null and empty texts are the one id 0; null doc_ids, ties and repeated rows are
    packed as any other row; extra columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialize(rows.mapInArrow(_tokenize(tokenizer_path), _TOKENS))
    count = dict(tokens.select("doc_tokens", "terms").mapInArrow(_terms, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # one row for an id
    n = count.pop(-1, 0)
    mean = count.pop(-2, 0) / max(n, 1)
    df = np.zeros(N_IDS)
    for term, k in count.items():
        df[term] = k
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((idf, mean, df < 2))
    n_shards = max(1, -(-n // SHARD_TEXTS))
    keys = ["rarest", "next", "doc_id", "row"]
    dealt = tokens.mapInArrow(_rarest(shared), _DEALT).repartitionByRange(n_shards, *keys).sortWithinPartitions(*keys)
    return dealt.select("doc_id", "doc_tokens", "full", "rest", "terms", "counts").mapInArrow(_pack(shared), PIECES)
