"""Mixing sources to target weights, without sorting records.

Every source gets a token budget: its share of the mix's size. Records are used whole times as long as
the budget allows, and once more where the hash of their id lies below the source's threshold. The
thresholds come from histograms: tokens are summed by source and hash bucket; running sums find the
bucket in which a budget ends; only rows of those boundary buckets are summed again, by finer buckets,
until a bucket can't be split. The same hash orders a source for every budget, so smaller mixes are
subsets of larger ones.

Defined cases: records without tokens, or whose source has no target, aren't used (such sources are
reported with share 0). Repeated rows are records of their own, with one hash: they are used together.
A source without records makes its target unreachable: its share is reported as 0 and the others keep
their proportions. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of the hash per histogram level, and levels.
BITS, LEVELS = 12, 5


def _prefix(level: int) -> Column:
    """The leading BITS * level bits of the hash, as an unsigned number."""
    return F.shiftrightunsigned(F.col("h"), 64 - BITS * level)


def _table(sized: DataFrame, rows: list[tuple], shape: str) -> DataFrame:
    """A row per source, to be joined: a query's size doesn't depend on the number of sources."""
    return sized.sparkSession.createDataFrame(rows, shape)


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> dict[str, dict]:
    """Per source: available tokens, target share, budget; ``total`` None is the largest mix that keeps the shares."""
    have = {r.source: r.tokens for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect() if r.tokens}
    wanted = {r.source: (r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r.source is not None and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    usable = {s: w for s, w in wanted.items() if have.get(s)}
    whole = sum(share for share, _ in usable.values())
    most = min((have[s] * times * whole / share for s, (share, times) in usable.items()), default=0)
    size = most if total is None else min(total, most)
    out = {}
    for s in sorted({*have, *wanted}):
        share, times = wanted.get(s, (0.0, 0))
        out[s] = {"available": have.get(s, 0), "share": share, "repeats": times, "budget": int(size * share / whole) if s in usable else 0}
    return out


def thresholds(sized: DataFrame, plan: dict[str, dict]) -> dict[str, tuple[int, int, int]]:
    """Per source (whole uses, level, prefix): records below the prefix at that level are used once more."""
    out, open_ = {}, {}
    for s, p in plan.items():
        if p["budget"] <= 0:
            continue
        whole, rest = divmod(p["budget"], p["available"])
        out[s] = (whole, 1, 0)
        if rest:
            open_[s] = (0, rest)  # (prefix of the boundary bucket one level up, tokens still to fill)
    for level in range(1, LEVELS + 1):
        if not open_:
            break
        wanted = _table(sized, [(s, prefix, rest) for s, (prefix, rest) in open_.items()], "source string, at bigint, room bigint")
        inside = sized.where("tokens > 0").join(wanted, "source").where(F.lit(True) if level == 1 else _prefix(level - 1) == F.col("at"))
        counts = inside.groupBy("source", "room", _prefix(level).alias("p")).agg(F.sum("tokens").alias("n"), F.count("*").alias("k"))
        run = counts.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("p")))
        over = run.where(F.col("upto") > F.col("room")).groupBy("source").agg(F.min(F.struct("p", "upto", "n", "k")).alias("x")).collect()
        for r in over:
            whole, rest = out[r.source][0], open_[r.source][1] - (r.x.upto - r.x.n)
            # a last record that ends nearer to the budget than its start is used too
            alone = r.x.k == 1 or level == LEVELS
            out[r.source] = (whole, level, r.x.p + (alone and r.x.n - rest < rest))
            open_[r.source] = (r.x.p, rest)
            if alone:
                del open_[r.source]
        for s in set(open_) - {r.source for r in over}:
            # everything left fits: the whole boundary bucket of the level above is used
            prefix = open_.pop(s)[0]
            out[s] = (out[s][0] + 1, 1, 0) if level == 1 else (out[s][0], level - 1, prefix + 1)
    return out


def mixed(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(id, source, tokens, uses): the records used, and how many times."""
    plan = [(s, *at) for s, at in thresholds(sized, budgets(sized, targets, total)).items()]
    used = sized.where("tokens > 0").join(_table(sized, plan, "source string, whole int, level int, prefix bigint"), "source")
    uses = F.col("whole") + F.expr(f"shiftrightunsigned(h, 64 - {BITS} * level) < prefix").cast("int")
    return used.select("id", "source", "tokens", uses.cast("int").alias("uses")).where(F.col("uses") > 0)


def report(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, available_tokens, budget_tokens, used_tokens, actual_share, records, most_uses)."""
    plan = budgets(sized, targets, total)
    rows = [(s, p["share"], p["available"], p["budget"]) for s, p in plan.items()]
    base = sized.sparkSession.createDataFrame(rows, "source string, target_share double, available_tokens bigint, budget_tokens bigint")
    used = mixed(sized, targets, total).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    all_used = F.sum("used_tokens").over(W.partitionBy())
    return (
        base.join(used, "source", "left")
        .withColumn("used_tokens", F.coalesce("used", F.lit(0)))
        .select("source", "target_share", "available_tokens", "budget_tokens", "used_tokens", F.when(all_used > 0, F.col("used_tokens") / all_used).otherwise(0.0).alias("actual_share"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    )
