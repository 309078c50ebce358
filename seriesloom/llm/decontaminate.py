"""Benchmark decontamination by a generalised suffix automaton over words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 200_000  # words of the items in one automaton, which is broadcast

# ASCII letters to lower case, other ASCII but digits to a blank
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; it reports windows of the items.

    A state is a set of word strings with the same occurrences; `size` is the longest.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[list[int]] = []
        self.shortest = window
        for _, words in items:
            self.shortest = min(self.shortest, len(words))
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                path.append(last)
            ends.append(path)
        self._mark(items, ends)

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's strings continued by c, cut out of q where q is longer."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # another item began likewise
            return self._split(last, q, c)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def _mark(self, items, ends) -> None:
        """For each state the items of its window, and the short items that end in it."""
        n, k = len(self.size), self.window
        order = sorted(range(1, n), key=self.size.__getitem__)
        self.holder = [0] * n  # the state of the last `window` words
        for v in order:
            if self.size[v] >= k:
                up = self.link[v]
                self.holder[v] = v if self.size[up] < k else self.holder[up]
        self.items: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for i, (_, words) in enumerate(items):
            if len(words) < k:
                state = 0
                for w in words:
                    state = self.next[state][self.ids[w]]
                self.whole.setdefault(state, []).append((len(words), i))
                continue
            for m in range(k, len(words) + 1):
                state = ends[i][m - 1]
                # a later item may have split the state since
                while self.size[self.link[state]] >= m:
                    state = self.link[state]
                self.items.setdefault(self.holder[state], set()).add(i)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        for v in order:
            self.short[v] = self.short[self.link[v]] + tuple(self.whole.get(v, ()))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Word ranges inside windows (merged), their items, the longest match."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        longest = 0
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start < self.shortest:  # a word of no item resets the match
                continue
            state = length = 0
            for i, c in enumerate(ids[start:end].tolist(), start + 1):
                while (to := self.next[state].get(c)) is None and state:
                    state = self.link[state]
                    length = self.size[state]
                if to is not None:
                    state, length = to, length + 1
                if length > longest:
                    longest = length
                begin = i
                if length >= self.window:
                    begin = i - self.window
                    found |= self.items.get(self.holder[state], set())
                for size, item in self.short[state]:
                    if size <= length:
                        begin = min(begin, i - size)
                        found.add(item)
                if begin < i:
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i))
        return spans, found, longest


def _merge(a: list, b: list) -> list:
    out: list = []
    for s, e in sorted(map(tuple, [*a, *b])):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, text[last:]])


_FOUND = "doc_id long, text string, n_words long, n_hit long, longest long, spans array<array<int>>, items array<string>"


def _pass(automaton, first: bool, clean: bool):
    def run(batches):
        engine = automaton.value
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_hit", "longest", "spans", "items")}
            old = [None] * batch.num_rows if first else batch.to_pylist()
            for text, row in zip(as_bytes(batch.column("text")), old, strict=True):
                words = words_of(text)
                spans, found, longest = engine.hits(words)
                names = {engine.names[i] for i in found}
                if row:
                    spans, names, longest = _merge(spans, row["spans"]), names | set(row["items"]), max(longest, row["longest"])
                out["n_words"].append(len(words))
                out["n_hit"].append(sum(e - s for s, e in spans))
                out["longest"].append(longest)
                out["spans"].append([list(x) for x in spans])
                out["items"].append(sorted(x for x in names if x is not None))
            types = {"spans": pa.list_(pa.list_(pa.int32())), "items": pa.list_(pa.string())}
            text = batch.column("text") if clean else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string()), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", "text", *out])

    return run


def _clean(batches):
    for batch in batches:
        texts = []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            texts.append(cut(text, spans).decode("utf-8", "replace") if spans else None if text is None else text.decode("utf-8"))
        columns = [batch.column(i) for i in range(batch.num_columns)]
        columns[1] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, clean: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Windows of benchmark items in documents, one row per document.

    docs (doc_id, text), items (item_id, text). A window is `window` consecutive words of
    an item; a shorter item, but not none, is one window. Returns doc_id, text, n_words,
    n_hit (words inside a window), longest (the longest match in words), spans (word
    ranges) and items (names of items with a window here). text is null unless `clean`;
    then it is the text without the spans.

    Items are dealt into blocks of about `block_words` words; each has an automaton of its
    own, so what is broadcast has a bound. Null and empty texts have no words; null item
    ids are windows without a name; repeated rows and ties count once per document row;
    without items nothing is hit. Texts are read whole, however long; no documents give no
    rows; extra columns, of whatever names, are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    engines = list(_automata(items, window, block_words))
    for b, engine in enumerate(engines):
        last = b == len(engines) - 1
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(engine), b == 0, clean or not last), _FOUND)
    if clean:
        rows = rows.mapInArrow(_clean, _FOUND)
    return rows


def _automata(items: DataFrame, window: int, block_words: int):
    """The items' automata, each over a block of a bounded size."""
    named = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // (6 * block_words)))
    for b in range(n_blocks):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        listed = sorted(((r["item_id"], words_of(r["text"].encode())) for r in part), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        yield Automaton([x for x in listed if x[1]], window)


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents, with all their columns, of which `text` is without the spans that
    benchmark items hold (windows as in find_contamination); those of which the spans
    cover more than `max_coverage` of the words are left out. No row is shuffled. Null and
    empty texts stay, every row (also one without a doc_id, or repeated) is judged by itself,
    a text is read whole, and an empty table stays empty."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]  # any names, also clashing ones
    rows = docs.toDF(*names)
    rows = rows.withColumn(names[at], F.col(names[at]).cast("string")).withColumns({"spans": F.array().cast("array<array<int>>"), "n_words": F.lit(0)})
    schema = rows.schema
    for engine in _automata(items, window, block_words):
        rows = rows.mapInArrow(_mark(spark.sparkContext.broadcast(engine), names[at]), schema)
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0])
    rows = rows.where(covered <= F.col("n_words") * F.lit(max_coverage)).drop("n_words")
    return rows.mapInArrow(_cut_column(names[at]), rows.schema).select(*names).toDF(*docs.columns)


def _mark(automaton, text_column: str):
    def run(batches):
        engine = automaton.value
        for batch in batches:
            spans, counts = [], []
            for text, old in zip(as_bytes(batch.column(text_column)), batch.column("spans").to_pylist(), strict=True):
                words = words_of(text)
                spans.append([list(s) for s in _merge(engine.hits(words)[0], old)])
                counts.append(len(words))
            keep = [c for c in batch.schema.names if c not in ("spans", "n_words")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(counts, pa.int32())], names=[*keep, "spans", "n_words"])

    return run


def _cut_column(text_column: str):
    def run(batches):
        for batch in batches:
            text = batch.column(text_column)
            spans = batch.column("spans").to_pylist()
            if any(spans):
                text = pa.array([cut(t.encode(), s).decode("utf-8", "replace") if s else t for t, s in zip(text.to_pylist(), spans, strict=True)], pa.string())
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([text if c == text_column else batch.column(c) for c in names], names=names)

    return run
