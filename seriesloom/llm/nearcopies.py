"""MinHash near-duplicates by a chosen-path similarity join over word shingles.

Every distinct shingle set is one document of the join. A tree's root deals documents by
a minwise token; nodes branch along further chosen tokens until they are small, and small
nodes are compared exhaustively: first by sketches of 128 minwise bytes, then on the full
sets of those that the sketches don't rule out. Documents that are known to be joined
carry one label, and no pair of one label is compared again, so a group of near copies
costs its members and not its pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, deltas, discard, document_key, materialize, mix, undeltas, word_hashes
from .components import connected_components

SHINGLE_WORDS = 5
PERCENT = 75
# trees; with two branches for each large node below, a link of the least similarity is
# lost with a chance of 1e-5 even if all that its documents agree in is frequent and all
# levels are needed (see the tests)
TREES = 16
SKETCH = 128  # minwise bytes of a sketch, along which nodes branch
LEAF = 4096  # nodes of at most so many documents are compared exhaustively
PIVOTS = 8  # documents of a large node, on average, that are compared with all of it
FEW = 4096  # documents outside of a node's largest group that are compared with all of it
MAX_DEPTH = 6
COLLAPSING = 2  # trees, run together, whose links are used to leave out pairs in the others
SENT = 500_000  # documents whose keys are sent to all executors at most


def shingle_set(text: bytes | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles of ASCII-lower-cased text.

    With fewer than k words the whole sequence is the one shingle; without words
    the set is empty.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    s = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def least_agreement(percent: int = PERCENT) -> int:
    """Equal bytes of two sketches under which a pair is ruled out: 5.3 standard deviations
    below the mean at the least similarity, a chance of 2e-7."""
    p = percent / 100
    return max(1, math.floor(SKETCH * p - 5.3 * math.sqrt(SKETCH * p * (1 - p))))


def _digest(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("roots", pa.list_(pa.int64())), ("sketch", pa.binary())])
SIGNED = "doc_id long, key long, n_shingles long, d1 long, d2 long, roots array<long>, sketch binary"


def _sign(batches):
    """Size, digest, root tokens and sketch of each text's shingle set."""
    wide = mix(np.arange(1, TREES + 1, dtype=np.uint64)) | np.uint64(1)
    narrow = (mix(np.arange(1000, 1000 + SKETCH, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    odd, add = narrow | np.uint32(1), narrow[::-1].copy()
    for batch in batches:
        sizes, first, second, roots, sketches = [], [], [], [], []
        for text in as_bytes(batch.column(2)):
            s = shingle_set(text)
            d = _digest(s)
            sizes.append(len(s))
            first.append(d[0])
            second.append(d[1])
            if not len(s):
                roots.append([])
                sketches.append(b"")
                continue
            top = np.full(TREES, np.uint64(2**64 - 1))
            low = np.full(SKETCH, np.uint32(2**32 - 1))
            half = (s >> np.uint64(32)).astype(np.uint32)
            for i in range(0, len(s), 1024):
                top = np.minimum(top, (s[i : i + 1024, None] * wide).min(axis=0))
                low = np.minimum(low, (half[i : i + 1024, None] * odd + add).min(axis=0))
            roots.append(top.view(np.int64))
            sketches.append((mix(low.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes())
        columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, first, second)), pa.array(roots, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_SIGNED)


def _sets(batches):
    """Sets of the texts (sid, d1, d2, text), each once for a partition."""
    seen = set()
    for batch in batches:
        found = []
        for sid, d1, d2, text in zip(*(batch.column(k).to_pylist() for k in range(3)), as_bytes(batch.column(3)), strict=True):
            if sid not in seen:
                s = shingle_set(text)
                if tuple(_digest(s)) == (d1, d2):
                    seen.add(sid)
                    found.append((sid, deltas(s)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["sid", "shingles"])


class _Group:
    """Documents of one part of a node, by size, and the pairs that may be linked."""

    def __init__(self, table: pa.Table, percent: int):
        sid = table.column("sid").to_numpy()
        size = table.column("size").to_numpy()
        _, once = np.unique(sid, return_index=True)
        order = once[np.lexsort((sid[once], size[once]))]
        self.table = table.take(pa.array(order))
        self.sid, self.size, self.label = sid[order], size[order], table.column("label").to_numpy()[order].copy()
        self.sketch = np.frombuffer(b"".join(self.table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        self.percent, self.agree = percent, least_agreement(percent)

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Smaller documents of other labels that a sketch doesn't rule out, and agreements."""
        low = np.searchsorted(100 * self.size[:i], self.percent * self.size[i])
        at = low + np.flatnonzero(self.label[low:i] != self.label[i])
        if not len(at):
            return at, at
        some = self.sketch[low:i] if len(at) == i - low else self.sketch[at]
        agreed = np.count_nonzero(some == self.sketch[i], axis=1)
        likely = agreed >= self.agree
        return at[likely], agreed[likely]


_MEMBER = pa.schema([("node", pa.int64()), ("part", pa.int64()), ("sid", pa.int64()), ("label", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary())])
MEMBER = "node long, part long, sid long, label long, size long, sketch binary"


def _likely(percent: int):
    """Documents of a group that may be linked to one of another label."""

    def run(table: pa.Table) -> pa.Table:
        group = _Group(table, percent)
        wanted = np.zeros(len(group.sid), bool)
        for i in range(1, len(group.sid)):
            at, _ = group.partners(i)
            wanted[at] = True
            wanted[i] |= len(at) > 0
        return group.table.filter(pa.array(wanted)).select(_MEMBER.names).cast(_MEMBER)

    return run


class _Sets:
    """Sets of a group as numbers of its distinct shingles, one after the other."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        words, self.number = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(words), bool)

    def linked(self, i: int, at: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets `at` reach the similarity with set i."""
        own = self.number[self.start[i] : self.start[i] + self.size[i]]
        self.mark[own] = True
        size = self.size[at]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(self.start[at] - first, size)
        both = np.add.reduceat(self.mark[self.number[place]], first, dtype=np.int64)
        self.mark[own] = False
        return 100 * both >= percent * (size + len(own) - both)


def _verified(percent: int):
    """Links (a, b) between labels that join what is linked in a group on full sets: of the
    labels that become one, each is linked with the least."""

    def run(table: pa.Table) -> pa.Table:
        group = _Group(table, percent)
        sets = _Sets([undeltas(x) for x in group.table.column("shingles").to_pylist()])
        label, before = group.label, group.label.copy()
        for i in range(1, len(label)):
            at, agreed = group.partners(i)
            at = at[np.argsort(-agreed, kind="stable")]
            step = 8  # the likeliest first: mostly one of them joins the rest
            while len(at):
                some, at = at[:step], at[step:]
                some = some[sets.linked(i, some, percent)]
                for j in some.tolist():
                    if label[j] != label[i]:
                        low, high = sorted((label[i], label[j]))
                        label[label == high] = low
                at = at[label[at] != label[i]]
                step = 1024
        a, first = np.unique(before, return_index=True)
        b = label[first]
        return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})

    return run


def _chosen(node):
    """The two places along which a node branches: at a similarity of 0.75 a link is in
    1.5 children on average, so it doesn't die out with the levels."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(SKETCH))
    step = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(SKETCH - 1)) + 1
    return F.array(first, F.pmod(first + step, F.lit(SKETCH)))


def _branch(state: DataFrame) -> DataFrame:
    """Children of nodes: documents that agree in a chosen byte of the sketch."""
    rows = state.select("node", "sid", "sketch", F.explode(_chosen(F.col("node"))).alias("at"))
    return rows.select(F.xxhash64("node", "at", F.substring("sketch", F.col("at").cast("int") + 1, F.lit(1))).alias("node"), "sid")


def _parts(state: DataFrame, pivot) -> DataFrame:
    """Nodes dealt into parts of LEAF documents, and their pivots sent to each part."""
    parts = F.ceil(F.col("n") / LEAF)
    columns = ["sid", "label", "size", "sketch"]
    rows = state.select("node", F.pmod(F.xxhash64("sid", F.lit(11)), parts).alias("part"), *columns)
    sent = state.where((F.col("n") > LEAF) & pivot).select("node", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), *columns)
    return rows.unionByName(sent)


def _pairs_of_parts(state: DataFrame) -> DataFrame:
    """Nodes dealt so that any two of their documents meet."""
    parts = F.ceil(2 * F.col("n") / LEAF)
    own = state.withColumn("own", F.pmod(F.xxhash64("sid", F.lit(11)), parts)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return own.select("node", (F.least("own", "with") * parts + F.greatest("own", "with")).alias("part"), "sid", "label", "size", "sketch")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class _Join:
    """The similarity join of the distinct sets `reps` of `docs`."""

    def __init__(self, docs: DataFrame, reps: DataFrame, percent: int):
        self.docs, self.reps, self.percent = docs, reps, percent
        self.links: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def labelled(self, members: DataFrame) -> DataFrame:
        if self.labels is None:
            return members.withColumn("label", F.col("sid"))
        return members.join(self.labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))

    def relabel(self) -> None:
        self.labels = materialize(connected_components(_union(self.links)).toDF("sid", "label"))
        self.links = [self.labels.toDF("a", "b")]

    def state(self, members: DataFrame) -> DataFrame:
        """Members (node, sid) of nodes with several labels, with all that is compared;
        small nodes that hold the same documents count once."""
        members = materialize(self.labelled(members))
        own = F.xxhash64("sid")
        sums = [F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(own).alias("x"), F.sum(F.xxhash64("sid", F.lit(7)).cast("decimal(20,0)")).alias("y")]
        nodes = members.groupBy("node").agg(*sums).where("low <> high")
        small = nodes.where(f"n <= {LEAF}").groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node", "n")
        rows = members.join(small.unionByName(nodes.where(f"n > {LEAF}").select("node", "n")), "node")
        full = materialize(rows.join(self.reps.select("sid", F.col("n_shingles").alias("size"), "sketch"), "sid").select("node", "n", "sid", "label", "size", "sketch"))
        discard(members)
        return full

    def collapse(self, members: DataFrame) -> DataFrame:
        """Join most of what is near in these nodes: small ones are compared exhaustively,
        large ones within their parts and with pivots. Returns the large ones' members."""
        state = self.state(members)
        drawn = (F.xxhash64("sid", "node") / F.lit(2.0**64) + 0.5) < F.lit(float(PIVOTS)) / F.col("n")
        self.verify(_parts(state, drawn))
        self.relabel()
        return state.where(f"n > {LEAF}").select("node", "sid")

    def descend(self, members: DataFrame) -> None:
        """Branch large nodes until they are small, then compare all nodes exhaustively."""
        groups = []
        for depth in range(MAX_DEPTH + 1):
            state = self.state(members)
            if state.isEmpty():
                break
            groups.append(_parts(state.where(f"n <= {LEAF}"), F.lit(False)))
            large = state.where(f"n > {LEAF}")
            if large.isEmpty():
                break
            sizes = large.groupBy("node", "label").count()
            sizes = sizes.groupBy("node").agg(F.max_by("label", F.struct("count", "label")).alias("top"), (F.sum("count") - F.max("count")).alias("others"))
            large = materialize(large.join(sizes, "node"))
            # a few documents outside of the largest group are compared with all, which ends the node
            groups.append(_parts(large.where(f"others <= {FEW}"), F.col("label") != F.col("top")))
            rest = large.where(f"others > {FEW}")
            if depth == MAX_DEPTH:
                groups.append(_pairs_of_parts(rest))
            members = _branch(rest)
        if groups:
            self.verify(_union(groups))

    def verify(self, groups: DataFrame) -> None:
        likely = materialize(groups.groupBy("node", "part").applyInArrow(_likely(self.percent), MEMBER))
        needed = materialize(likely.select("sid").distinct().join(self.reps, "sid").select("sid", "key", "d1", "d2"))
        few = needed.limit(SENT + 1).count() <= SENT
        texts = self.docs.join(F.broadcast(needed) if few else needed, "key").select("sid", "d1", "d2", "text")
        sets = texts.mapInArrow(_sets, "sid long, shingles binary")
        self.links.append(materialize(likely.join(sets, "sid").groupBy("node", "part").applyInArrow(_verified(self.percent), "a long, b long")))
        discard(likely, needed)


def near_duplicate_links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, reps, links): a row for each document, one for each distinct shingle set
    (sid), and links (a, b) between sids, enough to join all that is linked."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", document_key(F.col("doc_id"), F.col("text")))
    signed = materialize(docs.select("doc_id", "key", "text").mapInArrow(_sign, SIGNED))
    reps = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in ("n_shingles", "roots", "sketch")))
    reps = materialize(reps.withColumn("sid", F.monotonically_increasing_id()))
    join = _Join(docs, reps, percent)

    def roots(trees: range) -> DataFrame:
        rows = reps.select("sid", "roots", F.explode(F.array(*map(F.lit, trees))).alias("at"))
        return rows.select(F.xxhash64("at", F.get("roots", F.col("at"))).alias("node"), "sid")

    # the first trees join most of what is near, so that the others have little left
    large = join.collapse(roots(range(COLLAPSING)))
    join.descend(roots(range(COLLAPSING, TREES)).unionByName(large))
    return signed, reps, _union(join.links)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key: near-duplicate groups of documents.

    Documents whose sets of distinct 5-word shingles have a similarity of `percent` or
    more are linked; component_id is the least doc_id reachable and kept marks it.
    Equal sets are one document of the join, however many copies there are. Null, empty
    and wordless texts have no shingles and stay alone. A text is taken whole, however
    long. A doc_id with several texts is one document with the links of all of them, and
    gets a row for each. Rows with a null doc_id take part; where a group has no doc_id
    at all, its component_id is null and all its rows are kept. Repeated rows give repeated
    results; extra columns, of whatever names, are ignored; an empty table gives an empty
    result. text_key is the row's document_key, of doc_id and text.
    """
    signed, reps, links = near_duplicate_links(docs, percent)
    # texts of one doc_id belong together
    of = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", F.struct("d1", "d2").alias("s"))
    several = of.groupBy("doc_id").agg(F.min("s").alias("one"), F.max("s").alias("last")).where("one <> last").select("doc_id", "one")
    also = of.join(several, "doc_id").where("s <> one").select("s", "one").distinct()
    named = reps.select(F.struct("d1", "d2").alias("s"), "sid")
    also = also.join(named.withColumnRenamed("sid", "a"), "s").drop("s").join(named.toDF("one", "b"), "one").select("a", "b")
    component = connected_components(links.unionByName(also)).toDF("sid", "component")
    members = reps.join(component, "sid", "left").where("copies > 1 or component is not null")
    members = members.select("d1", "d2", "doc_id", F.coalesce("component", "sid").alias("component"))
    least = members.groupBy("component").agg(F.min("doc_id").alias("least"), F.lit(True).alias("grouped"))
    groups = members.join(least, "component").select("d1", "d2", "least", "grouped")
    out = signed.select("doc_id", "n_shingles", "key", "d1", "d2").join(groups, ["d1", "d2"], "left")
    own = F.when(F.col("grouped") & (F.col("n_shingles") > 0), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), F.col("key").alias("text_key"))
