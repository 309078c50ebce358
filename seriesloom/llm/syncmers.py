"""Document fingerprints from closed syncmers, with DataFrame functions only.

A k-mer of characters is a closed syncmer if the least hash among its s-mers is that of
the first or the last one. Whether it is depends on its own characters alone, so the
same passage gives the same anchors wherever it stands.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 10, 6
PIECE = 64  # k-mers in a piece; a substring is looked up within its piece
SKETCH = 64  # least hashes that a fingerprint has at least
LEAST = -(1 << 63) + (1 << 61)  # it has all hashes below, an eighth of a text's anchors
BLOCKS, BLOCK_BYTES = 256, 1 << 30  # blocks of neighbouring doc_ids: so many, and more for more text


def _chosen(piece: Column, k: int, s: int, make) -> Column:
    """make(place in the piece, hash) for the closed syncmers among a piece's k-mers."""
    n = F.char_length(piece)
    hashes_of = F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.xxhash64(F.substring(piece, i, F.lit(s))))
    last = k - s

    def chosen(hashes: Column) -> Column:
        def closed(i):
            h = [F.get(hashes, i + j if j else i) for j in range(last + 1)]
            return F.least(h[0], h[-1]) <= F.least(*h[1:-1]) if last > 2 else F.least(h[0], h[-1]) <= h[last // 2]

        found = F.filter(F.sequence(F.lit(0), n - k), closed)
        # the first and the last s-mer make up the k-mer, as k <= 2 * s
        return F.transform(found, lambda i: make(i, F.xxhash64(F.get(hashes, i), F.get(hashes, i + last))))

    return F.transform(F.array(hashes_of), chosen)[0]


def _pieces(text: Column, k: int) -> Column:
    """Pieces of PIECE + k - 1 characters, each a step of PIECE after the last."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k},{PIECE + k - 1}}})).{{1,{PIECE}}}"), F.lit(1))


def inner(text: Column, k: int = K, s: int = S) -> Column:
    """Hashes of all closed syncmers of a text in order; none for fewer than k characters."""
    return F.flatten(F.transform(_pieces(text, k), lambda p: _chosen(p, k, s, lambda i, h: h)))


def across(left: Column, right: Column, k: int = K) -> Column:
    """Hashes of the closed syncmers that begin in one text and end in the next."""
    return inner(F.concat(F.right(left, F.lit(k - 1)), F.left(right, F.lit(k - 1))), k)


def marks(text: Column, inside: Column | None = None, k: int = K, s: int = S) -> Column:
    """Anchor hashes of a text: those inside, or the text's own hash as the one anchor of
    a text of fewer than k characters; an empty text has none."""
    one = F.array(F.xxhash64(text))
    inside = inner(text, k, s) if inside is None else inside
    return F.when(F.char_length(text) >= k, inside).when(F.char_length(text) > 0, one).otherwise(F.slice(one, 1, 0))


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, place (from 0) and hash of every closed syncmer, for positional matching."""
    pieces = docs.select("doc_id", F.posexplode(_pieces(F.col("text"), k)).alias("piece", "chars"))
    found = pieces.select("doc_id", "piece", F.explode(_chosen(F.col("chars"), k, s, lambda i, h: F.struct(i.alias("place"), h.alias("hash")))).alias("a"))
    return found.select("doc_id", (F.col("piece") * PIECE + F.col("a.place")).cast("long").alias("place"), F.col("a.hash").alias("hash"))


def positional_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, other, shift and anchors: how many equal anchors lie at each shift."""
    b = b.select(F.col("doc_id").alias("other"), F.col("place").alias("at"), "hash")
    return a.join(b, "hash").groupBy("doc_id", "other", (F.col("at") - F.col("place")).alias("shift")).agg(F.count("*").alias("anchors"))


def _low(hashes: Column) -> Column:
    """All hashes below LEAST, or the SKETCH least if these are more, in order."""
    cut = lambda a: F.slice(a, F.lit(1), F.greatest(F.lit(SKETCH), F.size(F.filter(a, lambda h: h < LEAST))))
    return F.transform(F.array(F.sort_array(hashes)), cut)[0]


def sketch(hashes: Column) -> Column:
    """An eighth of the distinct hashes and SKETCH at least, so it grows with the text."""
    return _low(F.array_distinct(hashes))


def likeness(a: Column, b: Column) -> Column:
    """Share of the low hashes of both that both have; 1 if neither has any. As far as they
    go, both sketches are whole."""
    least = _low(F.array_union(a, b))
    both = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def _below(cuts: list, value: Column) -> Column:
    """How many of the sorted cuts are below the value: by every so many-th, then near it."""
    step = isqrt(len(cuts)) + 1
    under = lambda a: F.size(F.filter(a, lambda c: c < value))
    whole = under(F.lit(cuts[step - 1 :: step])) * step if len(cuts) >= step else F.lit(0)
    return whole + under(F.slice(F.lit(cuts), whole + 1, F.lit(step)))


def blocked(docs: DataFrame, blocks: int | None = None) -> tuple[DataFrame, list]:
    """Adds block: docs dealt into blocks of neighbouring doc_ids, null ids in block -1."""
    if blocks is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        blocks = max(BLOCKS, -(-size // BLOCK_BYTES))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 20 * blocks).alias("p")).first()["p"]
    cuts = sorted(set(cuts or []))
    number = _below(cuts, F.col("doc_id")) if cuts else F.lit(0)
    return docs.withColumn("block", F.when(F.col("doc_id").isNull(), -1).otherwise(number)), cuts


def syncmer_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses.

    The edited text has the text's last half replaced by as many first characters of the
    next document's (by falling doc_id; the first after the last). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. Null texts
    are empty ones: no anchors, an empty fingerprint; two of these have likeness 1. Rows
    with a null doc_id come last; ties and repeated rows follow one another in the order
    of their texts' hashes; a single row is its own next; texts are read whole, however long;
    an empty table gives an empty result; extra columns are ignored.

    Rows are dealt into blocks of neighbouring doc_ids; only a block's last row looks into
    the first row of the block below, so no task holds more than a block. Anchors are free
    of context, so those of the edited text are the text's own in the part that stays, the
    next text's in the part that came, and those across the seam.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, _ = blocked(rows)
    # the first row of each block (null ids: the least hash), then that of the block below
    top = F.struct("doc_id", (-F.xxhash64("text").cast("decimal(20,0)")).alias("h"))
    first = rows.groupBy("block").agg(F.max(top).alias("top"))
    heads = rows.join(first, "block").where(top.eqNullSafe(F.col("top"))).groupBy("block").agg(F.max("text").alias("head"))
    heads = heads.withColumn("head_marks", sketch(marks(F.col("head"))))
    down = Window.orderBy(F.col("block").desc())  # one row for each of the blocks
    heads = heads.select("block", *(F.coalesce(F.lead(c).over(down), F.first(c).over(down)).alias(f"below_{c}") for c in ("head", "head_marks")))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = rows.withColumn("after", F.lead("text").over(order)).join(heads, "block").withColumn("after", F.coalesce("after", "below_head"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    stay, rest, come = F.left("text", n - half), F.right("text", half), F.left("after", half)
    rows = rows.select("doc_id", "block", "text", stay.alias("stay"), rest.alias("rest"), come.alias("come"), "below_head_marks")
    rows = rows.withColumns({"a": inner(F.col("stay")), "b": inner(F.col("rest")), "c": inner(F.col("come"))})
    own = F.concat("a", across(F.col("stay"), F.col("rest")), "b")
    mixed = F.concat("a", across(F.col("stay"), F.col("come")), "c")
    edited = F.concat("stay", "come")
    rows = rows.select("doc_id", "block", n.cast("long").alias("n_chars"), F.xxhash64("text").alias("h"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"), sketch(marks(F.col("text"), own)).alias("marks"), sketch(marks(edited, mixed)).alias("edited_marks"), "below_head_marks")
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), "h")
    rows = rows.withColumn("next_marks", F.coalesce(F.lead("marks").over(order), "below_head_marks"))
    shown = lambda c: F.array_join(F.transform(F.col(c), lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("marks").alias("fingerprint"),
        shown("edited_marks").alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).cast("double").alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).cast("double").alias("near_next"),
    )
