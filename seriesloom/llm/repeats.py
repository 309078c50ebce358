"""Removal of long strings that stand in an earlier document, by sorted suffixes.

A text of WINDOW bytes or more that an earlier document has too is taken whole, and since
that document has all its windows, only the rest is compared.

Every window of WINDOW bytes has an anchor, the least hash of its K-byte strings, so equal
windows have equal anchors. Neighbouring windows of one anchor are a passage. Passages of
anchors that only one document has can't match and stay at home; the others are dealt to
shards by their anchor. A shard sorts the suffixes of its passages by external induction
(`suffixsort`); suffixes that have WINDOW bytes in common with the one before them are one
window, and the least document that has it is sent back to the passages' blocks.

What a block and a part of the anchors or a shard send one another is a row with all of it,
packed: sorted hashes as differences, numbers as byte planes, compressed.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, planes, shared_dir, unplanes, word_hashes
from .suffixsort import sorted_suffixes

WINDOW = 50
K = 32  # the longer, the fewer strings meet that have no window in common, however large the input
BLOCK_BYTES = 1 << 23  # texts of a block; a longer text is a block of its own
BUCKET_BYTES = 1 << 25
SHARD_BYTES = 1 << 23  # texts for each shard of passages
PART_BYTES = 1 << 25  # texts for each part of the anchors
PACK_BYTES = 1 << 22  # strings of a packed row; a longer string is a row of its own
HOT = 1 << 16  # an anchor that has more passages than this is dealt window by window
STEP = 1 << 16
LAST = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15


def _grams(text: np.ndarray, k: int) -> np.ndarray:
    """48-bit hash of each k-byte string; k is a power of two. Different strings of one hash
    only make passages meet that don't match."""
    h, size = text.astype(np.uint64), 1
    h += np.uint64(1)
    while size < k:
        longer = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64))
        longer += h[size:]
        h, size = longer, size * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(_BASE)
    h >>= np.uint64(16)
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def passages(text: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one behind the other, up to `ends`: the first and last window's place (the
    latter excluded) and the anchor of each passage."""
    starts, stops, anchors = [], [], []
    size = min(K, 1 << (window.bit_length() - 1))
    begins = np.concatenate([[0], ends[:-1]])
    for k in range(0, len(text) - window + 1, STEP):
        least = _least(_grams(text[k : k + STEP + window - 1], size), window - size + 1)
        valid = np.ones(len(least) + 2, bool)
        valid[[0, -1]] = False
        for i in range(int(np.searchsorted(ends, k, "right")), int(np.searchsorted(begins, k + len(least), "left"))):
            valid[max(begins[i], ends[i] - window + 1, k) - k + 1 : max(ends[i] - k + 1, 0)] = False  # too near the end
        valid[-1] = False
        change = np.concatenate([[True], least[1:] != least[:-1], [True]])
        first = np.flatnonzero(valid[1:-1] & (change[:-1] | ~valid[:-2]))
        last = np.flatnonzero(valid[1:-1] & (change[1:] | ~valid[2:]))
        starts.append(first + k)
        stops.append(last + 1 + k)
        anchors.append(least[first])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(stops), np.concatenate(anchors)


class Block:
    """A block's texts and passages."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = table.column("doc_id")
        self.doc = self.ids.fill_null(LAST).to_numpy()  # rows without an id come after all others
        self.texts = table.column("text").to_pylist()
        self.ends = np.cumsum([len(t) for t in self.texts]).astype(np.int64)
        self.raw = b"".join(self.texts)
        self.text = np.frombuffer(self.raw, np.uint8)
        self.first, self.stop, self.anchor = passages(self.text, self.ends, window)
        self.owner = np.searchsorted(self.ends, self.first, "right")
        self.window = window

    def items(self, anchors: np.ndarray, hot: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """What is dealt of the passages of these anchors: strings, their places, owners and
        keys (anchor or hash). A hot anchor's windows are single strings."""
        order = np.argsort(anchors)
        anchors, hot = anchors[order], hot[order]
        at = np.searchsorted(anchors, self.anchor)
        some = np.flatnonzero(at < len(anchors))
        some = some[anchors[at[some]] == self.anchor[some]]
        single = hot[at[some]]
        count = np.where(single, self.stop[some] - self.first[some], 1)
        row = np.repeat(some, count)
        single = np.repeat(single, count)
        place = self.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        stop = np.where(single, place + 1, self.stop[row]) - 1 + self.window
        raw = self.raw
        strings = [raw[a:b] for a, b in zip(place.tolist(), stop.tolist(), strict=True)]
        key = self.anchor[row]
        alone = np.flatnonzero(single)
        key[alone] = np.fromiter((xxhash.xxh3_64_intdigest(strings[i], 1) >> 16 for i in alone.tolist()), np.uint64, len(alone))
        return strings, place, self.owner[row], key


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _pack(columns: list[np.ndarray], more: bytes = b"") -> bytes:
    """Columns of 8-byte numbers, all of one length, and bytes as one string."""
    raw = b"".join([*map(planes, columns), more])
    return np.array([len(columns[0]), len(raw)]).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    raw = pa.decompress(data[16:], size, "zstd", asbytes=True)
    return [unplanes(raw[8 * n * k : 8 * n * (k + 1)], np.int64) for k in range(columns)], raw[8 * n * columns :]


def _turns(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before, and the end."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _differences(keys: np.ndarray, by: int) -> np.ndarray:
    """Of sorted keys that are alike modulo `by`."""
    return np.diff(keys // by, prepend=0)


def _keys(differences: np.ndarray, by: int, rest: int) -> np.ndarray:
    return np.cumsum(differences) * by + rest


def _deal_blocks(window):
    def run(batches):
        """Rows (doc_id, text) with the number of their block, alike in every run, and the
        name of a text that has windows."""
        number, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            blocks, names = [], []
            for text in batch.column(1):
                text = text.as_buffer()
                if size and size + text.size > BLOCK_BYTES:
                    number, size = number + 1, 0
                size += text.size
                blocks.append(number)
                names.append(hashlib.sha256(text).digest() if text.size >= window else None)
            columns = [pa.array(blocks, pa.int64()), batch.column(0), batch.column(1), pa.array(names, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "text", "name"])

    return run


def _copies(blocks: DataFrame) -> DataFrame:
    """block, name, first: texts of a block that an earlier document has too, and the least
    document that has them. A block sends a name once, so none is a large group."""
    doc = F.coalesce("doc_id", F.lit(LAST))
    named = blocks.where(F.col("name").isNotNull()).groupBy("block", "name").agg(F.min(doc).alias("least"), F.max(doc).alias("most"))
    return named.withColumn("first", F.min("least").over(Window.partitionBy("name"))).where("first < most").select("block", "name", "first")


def _apart(docs: pa.Table, rows: pa.Table) -> tuple[pa.Table, pa.Table, pa.Table]:
    """A block's documents that are compared, those that an earlier one takes whole (both as
    doc_id and text), and what else than `_copies` is among the rows."""
    named = pc.is_valid(rows.column("name"))
    copies = rows.filter(named)
    first = dict(zip(copies.column("name").to_pylist(), copies.column("first").to_pylist(), strict=True))
    ids, names = docs.column("doc_id").fill_null(LAST).to_pylist(), docs.column("name").to_pylist()
    whole = pa.array([i > first.get(name, LAST) for i, name in zip(ids, names, strict=True)], pa.bool_())
    docs = docs.select(["doc_id", "text"])
    return docs.filter(pc.invert(whole)), docs.filter(whole), rows.filter(pc.invert(named))


def _anchors(window, parts):
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("anchors", pa.binary())])

    def run(docs: pa.Table, copies: pa.Table) -> pa.Table:
        """A row for each part of a block's anchors: these and the passages of each, or 1 if
        one document has all."""
        compared, _, _ = _apart(docs, copies)
        if not compared.num_rows:
            return schema.empty_table()
        block = Block(compared, window)
        doc = block.doc[block.owner]
        order = np.argsort(block.anchor, kind="stable")
        anchor, doc = _signed(block.anchor[order]), doc[order]
        start = _turns(anchor)
        start, n = start[:-1], np.diff(start)
        if len(start):
            n = np.where(np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start), n, 1)
        anchor = anchor[start]
        order = np.argsort(anchor % parts, kind="stable")
        anchor, n = anchor[order], n[order]
        turns = _turns(anchor % parts)
        packed = [_pack([_differences(anchor[a:b], parts), n[a:b]]) for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True)]
        columns = [anchor[turns[:-1]] % parts, np.full(len(packed), docs.column("block")[0].as_py()), packed]
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _shared(most):
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("anchors", pa.binary()), ("hot", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        """Of a part, each block's anchors that other documents have too, and which of them
        have more than `most` passages."""
        columns = [_unpack(x, 2)[0] for x in table.column("anchors").to_pylist()]
        ends = np.cumsum([len(n) for _, n in columns])
        anchor = np.concatenate([np.cumsum(x) for x, _ in columns])  # a row for each block that has the anchor
        order = np.argsort(anchor, kind="stable")
        turns = _turns(anchor[order])
        total = np.empty_like(anchor)
        total[order] = np.repeat(np.add.reduceat(np.concatenate([n for _, n in columns])[order], turns[:-1]), np.diff(turns))
        parts, blocks = table.column("part").to_pylist(), table.column("block").to_pylist()
        out = []
        for part, block, a, b in zip(parts, blocks, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            some = np.flatnonzero(total[a:b] > 1) + a
            if len(some):
                hot = total[some] > most
                out.append((part, block, _pack([np.diff(anchor[some], prepend=0), hot.astype(np.int64)]), bool(hot.any())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else schema.empty_table()

    return run


def _asked(rows: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that `_shared` has packed, and which are hot."""
    found = [(_unpack(x, 2)[0], part) for x, part in zip(rows.column("anchors").to_pylist(), rows.column("part").to_pylist(), strict=True)]
    anchors = [np.zeros(0, np.int64), *(_keys(x, parts, part) for (x, _), part in found)]
    return np.concatenate(anchors).view(np.uint64), np.concatenate([np.zeros(0, bool), *(hot > 0 for (_, hot), _ in found)])


def _dealt(window, parts, shards):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("strings", pa.binary())])

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        """The distinct strings of a block whose anchors other documents have too, with the
        least and the greatest document that has them here."""
        compared, _, asked = _apart(docs, asked)
        if not compared.num_rows or not asked.num_rows:
            return schema.empty_table()
        block = Block(compared, window)
        strings, _, owner, key = block.items(*_asked(asked, parts))
        if not strings:
            return schema.empty_table()
        key, name = _signed(key), word_hashes(strings)
        order = np.lexsort((name, key))
        order = order[np.argsort(key[order] % shards, kind="stable")]
        key, name, doc = key[order], name[order], block.doc[owner[order]]
        start = _turns(key, name)[:-1]
        least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
        key, strings = key[start], [strings[i] for i in order[start].tolist()]
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        turns = _turns(key % shards, np.cumsum(sizes) // PACK_BYTES)
        packed = [_pack([_differences(key[a:b], shards), sizes[a:b], least[a:b], most[a:b] - least[a:b]], b"".join(strings[a:b])) for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True)]
        number = docs.column("block")[0].as_py()
        columns = [key[turns[:-1]] % shards, np.full(len(packed), number), packed]
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def first_documents(text: np.ndarray, ends: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """For each window of strings one behind the other (up to `ends`), the least document
    that has it; `docs` has the least one of each string."""
    sizes = np.diff(ends, prepend=0)
    out = np.repeat(docs, sizes)
    single = np.where(np.repeat(ends, sizes) - np.arange(len(text)) >= window, out, LAST)  # what begins too near the end is no window
    held = np.zeros(0, np.int64)
    fresh = np.zeros(0, bool)

    def settle(places: np.ndarray, new: np.ndarray) -> None:
        if len(places):
            start = np.flatnonzero(new)
            size = np.diff(start, append=len(places))
            least = np.minimum.reduceat(single[places], start)
            several = np.repeat(size > 1, size)
            out[places[several]] = np.repeat(least, size)[several]

    for places, common in sorted_suffixes(text, window):
        places, new = np.concatenate([held, places]), np.concatenate([fresh, common < window])
        new[0] = True
        cut = int(np.flatnonzero(new)[-1])
        settle(places[:cut], new[:cut])
        held, fresh = places[cut:], new[cut:]
    settle(held, fresh)
    return out


def _runs(strings: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one least document: string, first and last window (the latter
    excluded) and the document."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first = first_documents(np.frombuffer(b"".join(strings), np.uint8), ends, docs, window)
    windows = sizes - window + 1
    string = np.repeat(np.arange(len(strings)), windows)
    place = np.repeat(begins - np.cumsum(windows) + windows, windows) + np.arange(len(string))
    doc = first[place]
    turns = _turns(doc, string)
    start = turns[:-1]
    string = string[start]
    begin = place[start] - begins[string]
    return string, begin, begin + np.diff(turns), doc[start]


def _sort_shard(window, shards):
    names = ["part", "block", "runs"]

    def run(batches):
        """A shard's strings to the runs of windows that an earlier document has."""
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        shard = table.column("shard").to_numpy()
        columns, all_strings = [], []
        for x, number in zip(table.column("strings").to_pylist(), shard.tolist(), strict=True):
            (key, sizes, least, more), raw = _unpack(x, 4)
            columns.append((_keys(key, shards, number), least, least + more))
            stops = np.cumsum(sizes)
            all_strings += [raw[a:b] for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
        pack = np.repeat(np.arange(len(columns)), [len(c[0]) for c in columns])
        key, lowest, most = (np.concatenate(c) for c in zip(*columns, strict=True))
        keys = np.stack([key, _signed(word_hashes(all_strings))], axis=1)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.r_[True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1)]
        at, of = order[new], np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        strings = [all_strings[i] for i in at.tolist()]
        least = np.full(len(strings), LAST)
        np.minimum.at(least, of, lowest)
        # equal windows have equal keys: a string that is alone with its key meets no other
        same_key = np.diff(_turns(keys[at, 0]))
        met = np.repeat(same_key > 1, same_key)
        some, alone = np.flatnonzero(met), np.flatnonzero(~met)
        met_runs = _runs([strings[i] for i in some.tolist()], least[some], window)
        sizes = np.fromiter((len(strings[i]) for i in alone.tolist()), np.int64, len(alone))
        alone_runs = np.arange(len(alone)), np.zeros(len(alone), np.int64), sizes - window + 1, least[alone]
        run_string = np.concatenate([some[met_runs[0]], alone[alone_runs[0]]])
        order = np.argsort(run_string, kind="stable")
        run_string = run_string[order]
        run_first, run_stop, run_doc = (np.concatenate(c)[order] for c in zip(met_runs[1:], alone_runs[1:], strict=True))
        runs = np.searchsorted(run_string, np.arange(len(strings) + 1))
        count = (runs[1:] - runs[:-1])[of]
        row = np.repeat(np.arange(len(of)), count)
        which = np.repeat(runs[:-1][of] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(row))
        keep = run_doc[which] < most[row]
        row, which = row[keep], which[keep]
        # back to the blocks in the order in which they came: a pack's keys ascend
        turns = _turns(pack[row], np.arange(len(row)) // STEP)
        blocks, out, held = table.column("block").to_numpy(), [], 0
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
            r, w = row[a:b], which[a:b]
            packed = _pack([_differences(keys[r, 0], shards), keys[r, 1], run_first[w], run_stop[w] - run_first[w], run_doc[w]])
            out.append((shard[pack[r[0]]], blocks[pack[r[0]]], packed))
            held += len(packed)
            if held >= PACK_BYTES or b == len(row):
                numbers, of_blocks, runs = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(of_blocks, pa.int64()), pa.array(runs, pa.binary())], names=names)
                out, held = [], 0

    return run


def _ranges(pairs: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted pairs, where each asked one begins and ends."""
    low, high = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    start = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    stop = np.append(start[1:], len(pairs))
    # by name alone, which is a hash; of the few that share a name the anchor decides
    by = np.argsort(pairs["n"][start], kind="stable")
    names, anchors = pairs["n"][start][by], pairs["a"][start][by]
    first, last = np.searchsorted(names, asked["n"], "left"), np.searchsorted(names, asked["n"], "right")
    for step in range(int((last - first).max(initial=0))):
        at = first + step
        some = np.flatnonzero(at < last)
        some = some[anchors[at[some]] == asked["a"][some]]
        low[some], high[some] = start[by[at[some]]], stop[by[at[some]]]
    return low, high


def _cut_out(window, parts, shards):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", spans_type), ("kept", pa.binary())])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        compared, whole, found = _apart(docs, found)
        texts = compared.column("text").to_pylist()
        spans, kept = [[] for _ in texts], list(texts)
        if found.num_rows and texts:
            block = Block(compared, window)
            alone = pc.is_null(found.column("runs"))  # anchors, of which the hot ones are dealt window by window
            anchors, hot = _asked(found.filter(alone), parts)
            packed = found.filter(pc.invert(alone))
            columns = [np.zeros((5, 0), np.int64)]
            for x, number in zip(packed.column("runs").to_pylist(), packed.column("part").to_pylist(), strict=True):
                key, *more = _unpack(x, 5)[0]
                columns.append(np.stack([_keys(key, shards, number), *more]))
            runs = dict(zip(("anchor", "name", "first", "stop", "doc"), np.concatenate(columns, axis=1), strict=True))
            runs["stop"] = runs["first"] + runs["stop"]
            asked = np.unique(np.concatenate([runs["anchor"].view(np.uint64), anchors[hot]]))
            strings, place, owner, key = block.items(asked, np.isin(asked, anchors[hot]))
            # a string's runs lie together in the order of (anchor, name)
            order = np.lexsort((runs["name"], runs["anchor"]))
            runs = {c: x[order] for c, x in runs.items()}
            pair = np.stack([runs["anchor"], runs["name"]], axis=1).view([("a", np.int64), ("n", np.int64)])[:, 0]
            own = np.stack([_signed(key), _signed(word_hashes(strings))], axis=1).view([("a", np.int64), ("n", np.int64)])[:, 0]
            low, high = _ranges(pair, own)
            item = np.repeat(np.arange(len(own)), high - low)
            run = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(item))
            earlier = runs["doc"][run] < block.doc[owner[item]]
            item, run = item[earlier], run[earlier]
            edges = np.zeros(len(block.text) + 1, np.int64)
            np.add.at(edges, place[item] + runs["first"][run], 1)
            np.add.at(edges, place[item] + runs["stop"][run] - 1 + window, -1)
            gone = np.cumsum(edges)[:-1] > 0
            begins = np.concatenate([[0], block.ends[:-1]])
            for k, (a, b) in enumerate(zip(begins.tolist(), block.ends.tolist(), strict=True)):
                if gone[a:b].any():
                    turn = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                    spans[k] = [{"start": int(x), "stop": int(y)} for x, y in turn.reshape(-1, 2)]
                    kept[k] = block.text[a:b][~gone[a:b]].tobytes()
        sizes = [*map(len, texts), *pc.binary_length(whole.column("text")).to_pylist()]
        spans += [[{"start": 0, "stop": n}] for n in sizes[len(texts) :]]
        kept += [b""] * whole.num_rows
        ids = pa.concat_tables([compared, whole]).column("doc_id")
        return pa.table([ids, pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, spans and kept of every document: its UTF-8 bytes, the maximal runs
    of bytes (start, stop) that a string of `window` bytes covers which also starts in a
    document of a smaller doc_id, and the bytes without them.

    Strings are judged on the input and never cross documents. A null text is empty; texts
    under `window` bytes stay; long texts are read whole. Rows without a doc_id come after
    all others and take nothing from one another; nor do rows of one doc_id. Of equal texts
    that of the least doc_id stays. An empty table gives an empty result; extra columns are
    ignored, whatever their names.

    The texts are written once, in blocks, as a bucketed table of the session's catalog (its
    files lie in the shared folder); the result reads it, so it stays.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(min(max(1, -(-size // BUCKET_BYTES)), 50_000))
    blocks = rows.mapInArrow(_deal_blocks(window), "block long, doc_id long, text binary, name binary")
    # the table's buckets are its tasks' blocks: later steps meet them without a shuffle of texts
    blocks.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/tables/{name}").option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    parts, shards = (int(max(1, -(-size // n))) for n in (PART_BYTES, SHARD_BYTES))
    copies = materialize(_copies(blocks))
    anchors = blocks.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(_anchors(window, parts), "part long, block long, anchors binary")
    asked = materialize(anchors.groupBy("part").applyInArrow(_shared(HOT), "part long, block long, anchors binary, hot boolean"))
    dealt = asked.unionByName(copies, allowMissingColumns=True)
    strings = blocks.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(_dealt(window, parts, shards), "shard int, block long, strings binary")
    found = strings.repartitionById(shards, "shard").mapInArrow(_sort_shard(window, shards), "part long, block long, runs binary")
    found = found.unionByName(asked.where("hot").drop("hot"), allowMissingColumns=True).unionByName(copies, allowMissingColumns=True)
    out = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut_out(window, parts, shards), out)
