"""Language identification: text likelihoods, the declared language, the address suffix
and the host are fused as evidence by Bayes' rule.

Host priors are smoothed hierarchically (host, domain, suffix, all) from counts that one
grouped aggregation takes over all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, materialize, mix

BITS = 16
SAMPLE_ROWS = 20_000  # labelled rows that the text model is fitted on, at most
TEMPER = 0.25  # trigrams overlap, so their evidence counts for less
STRENGTH = 5.0  # rows that a level of the hierarchy weighs against the level below
MIN_GRAMS = 3  # texts with fewer trigrams with letters say nothing
MIN_POSTERIOR = 0.5
SENT_HOSTS = 100_000  # hosts whose counts are sent to all executors, at most

_LETTERS = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARKUP = re.compile(rb"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1|$)|<[^>]*(?:>|$)|&#?\w+;", re.S | re.I)


@dataclass
class TextModel:
    """log P(trigram | language) by hashed byte trigram."""

    languages: list[str]
    log_p: np.ndarray

    def log_likelihoods(self, text: bytes | None) -> tuple[int, np.ndarray]:
        grams = trigrams(text)
        return len(grams), self.log_p[:, grams].sum(axis=1, dtype=np.float64)


def trigrams(text: bytes | None) -> np.ndarray:
    """Hashed byte trigrams of letters and blanks."""
    if not text:
        return np.zeros(0, np.int64)
    b = np.frombuffer((b" " + b" ".join(text.translate(_FOLD).split()) + b" "), np.uint8)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2].astype(np.uint64) << np.uint64(16)) | (b[1:-1].astype(np.uint64) << np.uint64(8)) | b[2:]
    return (mix(code) >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            total.setdefault(lang, np.zeros(1 << BITS, np.int64))
            np.add.at(total[lang], trigrams(text), 1)
    for lang, count in total.items():
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(count[some], pa.int64())], names=["lang", "gram", "n"])


def train_text_model(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Fit on (text, lang): at most `sample_rows` rows, drawn by hash of the text.

    Rows without a text or a language teach nothing; repeated texts are drawn together;
    without rows the model knows no language."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    drawn = F.xxhash64("text", "lang") / F.lit(2.0**64) + 0.5
    total = rows.count()
    sample = rows.where(drawn < F.lit(sample_rows / max(total, 1)))
    counts = sample.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for lang, gram, n in counts.collect():  # at most 2^16 for each language
        found.setdefault(lang, np.zeros(1 << BITS))[gram] = n
    languages = sorted(found)
    if not languages:
        return TextModel(["und"], np.zeros((1, 1 << BITS), np.float32))
    smooth = [np.log((found[k] + 0.1) / (found[k].sum() + 0.1 * (1 << BITS))) for k in languages]
    return TextModel(languages, np.array(smooth, np.float32))


def _score_text(shared, markup: bool, text_column: str, kept: list[str]):
    """Adds likelihood and said (the language of the text alone) to the kept columns."""

    def run(batches):
        model = shared.value
        for batch in batches:
            likelihoods, said = [], []
            for text in as_bytes(batch.column(text_column)):
                n, ll = model.log_likelihoods(_MARKUP.sub(b" ", text) if markup and text else text)
                ll = (ll - ll.max()) * TEMPER
                likelihoods.append(ll.tolist())
                said.append(int(ll.argmax()) if n >= MIN_GRAMS else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(likelihoods, pa.list_(pa.float64())), pa.array(said, pa.int32())], names=[*kept, "likelihood", "said"])

    return run


def _share(counts: str, parent: Column, languages: int) -> Column:
    """(count + STRENGTH * parent's share) / (sum of counts + STRENGTH), per language."""
    zero = F.lit([0] * languages)
    own = F.coalesce(F.col(counts), zero)
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.arrays_zip(own.alias("n"), parent.alias("p")), lambda x: (x["n"] + STRENGTH * x["p"]) / (total + STRENGTH))


def _beside_hosts(rows: DataFrame, levels: DataFrame, score) -> DataFrame:
    """score(rows), each row once, with its host's n_host and p_domain."""
    found = levels.agg(F.count("*").alias("hosts"), F.sum("n_rows").alias("rows")).first()
    common = F.col("n_rows") * SENT_HOSTS >= found["rows"]  # SENT_HOSTS at most
    priors = lambda some: some.select("x_host", "n_host", "p_domain")
    if found["hosts"] <= SENT_HOSTS:
        return score(rows).join(F.broadcast(priors(levels)), "x_host", "left")
    sent = F.broadcast(priors(levels.where(common)))
    near = score(rows.join(sent.select("x_host"), "x_host", "left_semi")).join(sent, "x_host")
    far = score(rows.join(sent.select("x_host"), "x_host", "left_anti")).join(priors(levels.where(~common)), "x_host", "left")
    return near.unionByName(far)


def identify_languages(rows: DataFrame, model: TextModel, text: str, kept: list[str], markup: bool = False) -> DataFrame:
    """The kept columns, and language, posterior, declared, text_language and host.

    rows: the text in the column `text`, x_host and x_declared. The text's own verdict is
    what the host levels and the declarations are counted by; a row's own verdict is
    taken out of its host's count. A language is null ("not identified") where nothing
    but the prior speaks: too few letters and no declared language of the model. Null
    hosts are one host ""; null texts are empty; ties go to the language first in
    alphabetical order; repeated rows count as often as they are there.

    Texts are scored twice rather than shuffled: for the counts, and beside the rows. Up
    to SENT_HOSTS hosts are sent to the rows; of more, those that hold one row in
    SENT_HOSTS or more, and only the rows of the others are shuffled, so no key is hot.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    k = len(model.languages)
    host = F.lower(F.coalesce(F.col("x_host").cast("string"), F.lit("")))
    # the whole primary tag: "est" isn't "es"
    tag = F.lower(F.regexp_extract(F.col("x_declared").cast("string"), r"^\s*([A-Za-z]+)", 1))
    rows = rows.withColumns({"x_host": host, "x_declared": F.when(tag.isin(model.languages), tag), text: F.col(text).cast("string")})
    shared = spark.sparkContext.broadcast(model)
    evidence = ", likelihood array<double>, said int"
    narrow = rows.select("x_host", "x_declared", text).mapInArrow(_score_text(shared, markup, text, ["x_host", "x_declared"]), "x_host string, x_declared string" + evidence)
    # one grouped aggregation counts the verdicts on all levels
    verdicts = F.array(*(F.count_if(F.col("said") == i) for i in range(k))).alias("n")
    counted = materialize(narrow.groupBy("x_host", "x_declared").agg(verdicts, F.count("*").alias("n_rows")))
    added = lambda c: F.array(*(F.sum(F.col(c)[i]) for i in range(k)))
    domain = F.regexp_extract("x_host", r"([^.]*\.[^.]*)$|^([^.]*)$", 0).alias("domain")
    by_host = counted.groupBy("x_host", domain, F.regexp_extract("x_host", r"[^.]*$", 0).alias("suffix")).agg(added("n").alias("n_host"), F.sum("n_rows").alias("n_rows"))
    by_domain = by_host.groupBy("suffix", "domain").agg(added("n_host").alias("n_domain"))
    by_suffix = by_domain.groupBy("suffix").agg(added("n_domain").alias("n_suffix"))
    everything = by_suffix.agg(*(F.coalesce(F.sum(F.col("n_suffix")[i]), F.lit(0)).alias(f"c{i}") for i in range(k))).first()
    top = np.array([everything[f"c{i}"] + 1.0 for i in range(k)])
    overall = F.lit((top / top.sum()).tolist())
    levels = by_host.join(by_domain, ["suffix", "domain"]).join(by_suffix, "suffix")
    levels = materialize(levels.select("x_host", "n_rows", "n_host", _share("n_domain", _share("n_suffix", overall, k), k).alias("p_domain")))
    # P(declared | language), also by the texts' verdicts
    told = counted.where("x_declared is not null").groupBy("x_declared").agg(added("n").alias("n")).collect()
    table = np.full((k, k), 0.5) + 4.5 * np.eye(k)
    for row in told:  # one row for a language
        table[model.languages.index(row["x_declared"])] += row["n"]
    says = np.log(table / table.sum(axis=0, keepdims=True))
    declared = F.lit([0.0] * k)
    for i, name in enumerate(model.languages):
        declared = F.when(F.col("x_declared") == name, F.lit(says[i].tolist())).otherwise(declared)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    scorer, schema = _score_text(shared, markup, text, [*kept, "x_host", "x_declared"]), f"{names}, x_host string, x_declared string" + evidence
    out = _beside_hosts(rows, levels, lambda some: some.mapInArrow(scorer, schema)).withColumn("p_domain", F.coalesce("p_domain", overall))
    own = F.transform(F.coalesce("n_host", F.lit([0] * k)), lambda n, i: n - F.when(F.col("said") == i, 1).otherwise(0))
    out = out.withColumn("n_own", own).withColumn("prior", _share("n_own", F.col("p_domain"), k))
    likelihood = F.when(F.col("said").isNotNull(), F.col("likelihood")).otherwise(F.lit([0.0] * k))
    parts = F.arrays_zip(F.col("prior"), likelihood.alias("t"), declared.alias("d"))
    out = out.withColumn("weight", F.transform(parts, lambda x: F.ln(x["prior"]) + x["t"] + x["d"]))
    out = out.withColumn("weight", F.transform("weight", lambda w: F.exp(w - F.array_max("weight"))))
    best = F.array_position("weight", F.array_max("weight")).cast("int")
    known = F.lit(model.languages)
    speaks = F.col("said").isNotNull() | F.col("x_declared").isNotNull()
    return out.select(
        *kept,
        F.when(speaks, F.get(known, best - 1)).alias("language"),
        F.round(F.array_max("weight") / F.aggregate("weight", F.lit(0.0), lambda a, x: a + x), 9).alias("posterior"),
        F.col("x_declared").alias("declared"),
        F.get(known, F.col("said")).alias("text_language"),
        F.col("x_host").alias("host"),
    )


def page_languages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, url and the evidence and verdict for web pages (page_id, url, html).

    The declared language is the lang of the first html tag outside comments, wherever it
    begins; the host is that of the url. Pages without both, null pages and null ids get
    what the other evidence says; ties go to the first language by name. Pages are read
    whole, however long; every repeated row gets its verdict; an empty table gives an empty
    result; extra columns, of whatever names, are ignored.
    """
    tag = F.regexp_extract(F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", ""), r"(?i)<html\b[^>]*", 0)
    declared = F.nullif(F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?\s*([a-z]+)", 1), F.lit(""))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("x_host"), declared.alias("x_declared"))
    return identify_languages(rows, model, "html", ["page_id", "url"], markup=True)


def keep_identified(docs: DataFrame, model: TextModel, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The documents (doc_id, text, lang, source) whose language is identified.

    The lang column is the declared language and the source stands for the host.
    Rejected are texts without enough letters, and those whose posterior is below
    `min_posterior`; so null and empty texts go. Null languages and sources are no evidence,
    ties go to the first language, repeated rows get one verdict, texts are read whole, an
    empty table stays empty. Columns are those of `docs`, whatever their names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # any names, also clashing ones
    at = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    rows = docs.toDF(*names).withColumns({"x_host": F.col(at["source"]), "x_declared": F.col(at["lang"])})
    found = identify_languages(rows, model, at["text"], names)
    return found.where(F.col("text_language").isNotNull() & (F.col("posterior") >= min_posterior)).select(*names).toDF(*docs.columns)
