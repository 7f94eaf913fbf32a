"""Comparison of a candidate snapshot with the previous one, and the gates that may refuse it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from ..functions.registry import GateError


def snapshot_diff(previous: DataFrame, candidate: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, status (removed, added, changed, same) and changedFields in the given order.

    One full outer join on the keys serves missing keys, added keys and changed rows alike. Nulls are equal
    to nulls. Keys must be unique and not null on either side (`duplicate_keys`).
    """
    p = previous.select(*keys, F.struct(*[F.col(f) for f in fields]).alias("p"))
    c = candidate.select(*keys, F.struct(*[F.col(f) for f in fields]).alias("c"))
    both = p.join(c, keys, "full_outer")
    marks = F.array(*[F.when(~F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}")), f) for f in fields])
    changed = F.when(F.col("p").isNull() | F.col("c").isNull(), F.array().cast("array<string>")).otherwise(F.filter(marks, lambda x: x.isNotNull()))
    status = F.when(F.col("c").isNull(), "removed").when(F.col("p").isNull(), "added").when(F.size("changedFields") > 0, "changed").otherwise("same")
    return both.withColumn("changedFields", changed).withColumn("status", status)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def diff_counts(diff: DataFrame) -> DataFrame:
    """One row of counters of a diff."""
    identity = F.arrays_overlap("changedFields", F.array(*[F.lit(f) for f in R.IDENTITY]))
    return diff.agg(
        F.count_if(F.col("status") != "added").alias("previous_rows"), F.count_if(F.col("status") != "removed").alias("candidate_rows"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_rows") for s in ("removed", "added", "changed")], F.count_if(identity).alias("identity_changes"),
    )


def odd_id() -> Column:
    """Whether a record's id is another than the one that follows from its stage and key."""
    kind = F.when(F.col("stage") == R.STAGES["subsidy"], "subsidy").when(F.col("stage") == R.STAGES["procurement"], "procurement")
    return ~F.coalesce(F.col("id") == S.stable_id(kind, F.col("sourceKey")), F.lit(False))


def continuity_counts(previous: DataFrame, candidate: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: the counters of the diff, blank and repeated keys of either side, and records whose id kept but whose identity changed.

    One outer join and one aggregation on each side, all by key, so that snapshots stored by key (`snapshots`) don't move; blank keys take no part in the
    join. Ids follow from keys; only if some don't, the two sides are joined by id as well.
    """
    blank = F.trim(F.coalesce(F.col(keys[-1]).cast("string"), F.lit(""))) == ""
    out = diff_counts(snapshot_diff(previous.where(~blank), candidate.where(~blank), keys, fields))
    for name, df in (("previous", previous), ("candidate", candidate)):
        per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(blank).alias("blank"), F.count_if(odd_id()).alias("odd"))
        bad = per_key.agg(F.coalesce(F.sum(F.when(F.col("blank") | (F.col("n") > 1), F.col("n"))), F.lit(0)).alias(f"{name}_bad_keys"), F.coalesce(F.sum("odd"), F.lit(0)).alias(f"{name}_odd"))
        out = out.crossJoin(bad)  # one row with one row
    n = out.first().asDict()
    if n.pop("previous_odd") + n.pop("candidate_odd"):
        old = previous.select("id", F.struct(*R.IDENTITY).alias("old"))
        n["moved_ids"] = old.join(candidate.select("id", F.struct(*R.IDENTITY).alias("new")), "id").where(~F.col("old").eqNullSafe(F.col("new"))).count()
    else:
        n["moved_ids"] = n["identity_changes"]
    return previous.sparkSession.createDataFrame([tuple(n.values())], ", ".join(f"{k} long" for k in n))


def continuity_verdicts(counts: DataFrame, allow_corrections: bool = False) -> DataFrame:
    """(position, rule, failures) of `continuity_counts`, in the order in which a candidate is refused."""
    c = F.col
    limit = correction_limit(c("previous_rows"))
    rules = [("the previous snapshot is empty", (c("previous_rows") == 0).cast("long")), ("keys of the previous snapshot are blank or repeated", c("previous_bad_keys")), ("keys of the candidate snapshot are blank or repeated", c("candidate_bad_keys"))]
    if allow_corrections:
        rules.append(("an identity field of a record changed", c("moved_ids")))
    rules.append(("keys are missing", c("removed_rows")))
    if not allow_corrections:
        rules.append(("rows changed", c("changed_rows")))
    rules += [("an identity field of a row changed", c("identity_changes")), ("corrections beyond the limit", F.greatest(c("changed_rows") - limit, F.lit(0)))]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(rule).alias("rule"), n.cast("long").alias("failures")) for k, (rule, n) in enumerate(rules, 1)])))


def assert_continuity(previous: DataFrame, candidate: DataFrame, allow_corrections: bool = False) -> dict:
    """Counters of the comparison; the first rule that fails raises GateError, with three keys where it is about keys.

    Only the counters and the sample reach the driver, and the snapshots are compared once unless a rule fails.
    """
    keys = ["stage", "sourceKey"]
    fields = [f for f in R.SEMANTIC if f not in keys]
    row = continuity_counts(previous, candidate, keys, fields)
    n = row.first().asDict()
    for r in continuity_verdicts(row, allow_corrections).where("failures > 0").orderBy("position").limit(1).collect():
        status = {"keys are missing": "removed", "rows changed": "changed"}.get(r["rule"])
        found = snapshot_diff(previous, candidate, keys, fields).where(F.col("status") == status).select(*keys).orderBy(*keys).limit(3).collect() if status else []
        raise GateError(f"{r['rule']}: {r['failures']}" + f" {[tuple(x) for x in found]}" * bool(found))
    return n | {"correction_limit": row.select(correction_limit(F.col("previous_rows"))).first()[0]}


def import_totals(counts: DataFrame) -> DataFrame:
    """One row of totals of (kind, eligible, imported, dashboard): sums, the gap, the difference to the dashboard and how they compare."""
    known = F.count("dashboard") == F.count("*")
    board = F.when(known, F.sum("dashboard"))
    difference = board - F.sum("eligible")
    status = F.when(board.isNull(), "unavailable").when(difference == 0, "matched").otherwise("different")
    return counts.agg(F.sum("eligible").alias("eligible"), F.sum("imported").alias("imported"), (F.sum("eligible") - F.sum("imported")).alias("gap"), board.alias("dashboard"), difference.alias("difference"), status.alias("status"))


def import_audit(counts: DataFrame) -> DataFrame:
    """kind, gap, difference, status from eligible, imported and dashboard counts; unknown ones stay unknown."""
    difference = F.col("dashboard") - F.col("eligible")
    status = F.when(F.col("dashboard").isNull(), "unavailable").when(difference == 0, "matched").otherwise("different")
    return counts.select("kind", (F.col("eligible") - F.col("imported")).alias("gap"), difference.alias("difference"), status.alias("status"))


def growth_limit(previous: Column) -> Column:
    """How much a counter may grow without anyone looking."""
    return F.greatest(F.lit(R.GROWTH_FLOOR), F.ceil(previous * R.GROWTH_PERCENT / 100)).cast("long")


def correction_limit(previous: Column) -> Column:
    """How many rows may change without anyone looking."""
    return F.greatest(F.lit(1), F.least(F.lit(R.CORRECTIONS_MOST), F.ceil(previous * R.CORRECTIONS_PERMILLE / 1000))).cast("long")


def snapshot_verdicts(counters: DataFrame) -> DataFrame:
    """counter, growth, growth_limit and passed for rows of (counter, previous, candidate)."""
    limit = growth_limit(F.col("previous"))
    growth = F.col("candidate") - F.col("previous")
    passed = F.coalesce((growth >= 0) & (growth <= limit), F.lit(False))
    return counters.select("counter", growth.alias("growth"), limit.alias("growth_limit"), passed.alias("passed"))


def correction_table(changes: DataFrame) -> DataFrame:
    """One Markdown line per changed field of rows of (key, field, before, after)."""
    line = F.format_string("| %s | %s | %s | %s |", *[S.escape_table(F.col(c)) for c in ("key", "field", "before", "after")])
    return changes.select("key", "field", line.alias("line"))
