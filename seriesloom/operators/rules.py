"""Checks as data: a rule names what it looks at, a relation and a limit.

All rules of a table are evaluated in one pass by expressions made from them; a result says
what was observed and what was expected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`name` fires (or fails, as a check) by `observed` `relation` `limit` in rows where
    `where` holds; observed and limit are SQL expressions over a row. Where one of them is
    null a rule doesn't fire and a check fails."""

    name: str
    observed: str
    relation: str
    limit: str
    where: str = "true"

    def columns(self) -> tuple[Column, Column, Column]:
        """(applies, observed, limit)"""
        return F.coalesce(F.expr(self.where).cast("boolean"), F.lit(False)), F.expr(self.observed), F.expr(self.limit)

    def holds(self) -> Column:
        return F.coalesce(F.expr(f"({self.observed}) {self.relation} ({self.limit})"), F.lit(False))


def fired(table: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """key, rule, observed and expected of each rule that fires."""
    found = []
    for r in rules:
        applies, observed, limit = r.columns()
        text = F.concat(F.lit(f"{r.relation} "), limit.cast("string"))
        found.append(F.when(applies & r.holds(), F.struct(F.lit(r.name).alias("rule"), observed.cast("string").alias("observed"), text.alias("expected"))))
    return table.select(F.col(key), F.inline(F.array_compact(F.array(*found))))


def checked(table: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """keep, check, observed, expected and passed for each row and check that applies."""
    found = []
    for r in rules:
        applies, observed, limit = r.columns()
        text = F.concat(F.lit(f"{r.relation} "), F.coalesce(limit.cast("string"), F.lit("null")))
        found.append(F.when(applies, F.struct(F.lit(r.name).alias("check"), observed.cast("string").alias("observed"), text.alias("expected"), r.holds().alias("passed"))))
    return table.select(*keep, F.inline(F.array_compact(F.array(*found))))


def failures(checks: DataFrame) -> DataFrame:
    return checks.where("not passed")


# The kinds of warnings and their limits.
_TARGET = "role = 'TRANSFER_TARGET'"
DATASET_WARNINGS = [
    Rule("tt_n_windows_bajo", "n_windows", "<", "100", _TARGET),
    Rule("tt_n_units_bajo", "n_units", "<", "5", _TARGET),
    Rule("class_balance_bajo", "class_balance", "<", "0.05D"),
    Rule("rul_negative_values", "target_min", "<", "0", "target_kind in ('rul', 'regression_or_rul')"),
    Rule("negative_target_values", "target_min", "<", "0", "target_kind = 'regression'"),
    Rule("padding_ratio_alto", "padding_ratio", ">", "0.15D"),
    Rule("tt_padding_alto", "padding_ratio", ">", "0.5D", _TARGET),
    Rule("tail_policy_pad_padding_moderado", "padding_ratio", ">", "0.15D", f"{_TARGET} and tail_policy = 'pad' and padding_ratio <= 0.5D"),
    Rule("tt_median_lt_window", "length_median", "<", "window_size", _TARGET),
    Rule("tail_drop_ratio_alto", "dropped_rows / nullif(n_rows, 0)", ">", "0.05D", "role in ('TRANSFER_TARGET', 'PRETRAIN_SOURCE')"),
    Rule("dataset_dominante", "w_channel_patches", ">", "0.20D"),
]
CLIENT_WARNINGS = [
    Rule("cliente_pequeno_temporal", "w_temporal_patches", "<", "0.01D"),
    Rule("cliente_pequeno_channel", "w_channel_patches", "<", "0.01D"),
]
CORPUS_WARNINGS = [
    Rule("inconsistencia_conteos", "n_excluded + n_audited", "<>", "n_downloaded"),
    Rule("inconsistencia_csv", "n_listed", "<>", "n_downloaded"),
]


def all_warnings(datasets: DataFrame, clients: DataFrame, corpus: DataFrame) -> DataFrame:
    """scope, name, rule, observed and expected of all kinds: of datasets, clients and the
    corpus (one row)."""
    parts = [
        fired(datasets, DATASET_WARNINGS, "dataset").select(F.lit("dataset").alias("scope"), F.col("dataset").alias("name"), "rule", "observed", "expected"),
        fired(clients, CLIENT_WARNINGS, "client").select(F.lit("client").alias("scope"), F.col("client").alias("name"), "rule", "observed", "expected"),
        fired(corpus.withColumn("_key", F.lit("corpus")), CORPUS_WARNINGS, "_key").select(F.lit("corpus").alias("scope"), F.col("_key").alias("name"), "rule", "observed", "expected"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def writer_rules(cap: float | None, last_kept: bool = True) -> list[Rule]:
    """What has to hold of each split that is written (split, n_samples, life_min,
    capped_max, and n_preview): lives from 0, 0 in the last row of train and val if it is
    kept, none over the cap, and as many samples as the preview says."""
    rules = [Rule("life is not negative", "life_min", ">=", "0.0D"), Rule("samples as in the preview", "n_samples", "=", "n_preview", "n_preview is not null")]
    if last_kept:
        rules.append(Rule("the last row has life 0", "life_min", "=", "0.0D", "split in ('train', 'val')"))
    if cap and cap > 0:
        rules.append(Rule("lives are capped", "capped_max", "<=", f"{float(cap) + 1e-6}D"))
    return rules


def corpus_rules(roles: dict[str, int], version: str, policy: str, metrics: list[str]) -> list[Rule]:
    """What has to hold of the corpus's row of `corpus_facts`."""
    rules = [Rule(f"datasets of role {r}", f"coalesce(roles['{r}'], 0)", "=", str(n)) for r, n in sorted(roles.items())]
    rules += [Rule("no other role", "n_other", "=", "0"), Rule("one audit version", "versions", "=", f"array('{version}')"), Rule("one tail policy", "policies", "=", f"array('{policy}')")]
    rules += [Rule(f"{m} is there", f"missing_{m}", "=", "0") for m in metrics]
    return [*rules, Rule("every source has a client", "n_homeless", "=", "0"), Rule("no extreme padding", "n_padded", "=", "0")]


def corpus_facts(audit: DataFrame, groups: DataFrame, roles: list[str], metrics: list[str], padding: float = 0.8) -> DataFrame:
    """One row over the audited datasets (dataset, role, status, audit_version, tail_policy,
    padding_ratio and metrics) and their clients (client, dataset)."""
    used = F.col("role").isin("PRETRAIN_SOURCE", "TRANSFER_TARGET")
    placed = audit.join(groups.select("dataset").distinct().withColumn("_placed", F.lit(True)), "dataset", "left")
    ok = F.col("status") == "ok"
    return placed.agg(
        F.create_map(*(x for r in roles for x in (F.lit(r), F.count_if(F.col("role") == r)))).alias("roles"),
        F.count_if(~F.coalesce(F.col("role").isin(*roles), F.lit(False))).alias("n_other"),
        F.sort_array(F.collect_set(F.when(ok, F.col("audit_version")))).alias("versions"),  # a handful
        F.sort_array(F.collect_set(F.when(ok, F.col("tail_policy")))).alias("policies"),
        *(F.count_if(used & F.col(m).isNull()).alias(f"missing_{m}") for m in metrics),
        F.count_if((F.col("role") == "PRETRAIN_SOURCE") & F.col("_placed").isNull()).alias("n_homeless"),
        F.count_if(used & (F.col("padding_ratio") > padding)).alias("n_padded"),
    )
