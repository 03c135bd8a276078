"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SMALL_ROWS, broadcast_if_small, keep

LEVELS = ("domain", "lang", "source")


def words(text: Column) -> Column:
    """Tokens of a text: runs of anything but the ASCII blanks."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source here: its trailing number modulo 4 as d0 to d3, else `other`."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))


def whole(named: Mapping[str, float] | None) -> tuple[int, dict[str, int]]:
    """Weights as whole numbers in the same proportion: (that of nodes without a name, by name). Fractions count in millionths.

    A weight that is negative, not finite, over a million, or above 0 and below a millionth can't be kept to: ValueError.
    """
    named = dict(named or {})
    unit = 1 if all(float(w).is_integer() for w in named.values() if math.isfinite(w)) else 1_000_000
    out = {k: round(w * unit) if math.isfinite(w) else -1 for k, w in named.items()}
    if bad := [k for k, w in named.items() if not 0 <= out[k] <= unit * 1_000_000 or (w > 0) != (out[k] > 0)]:
        raise ValueError(f"weights of {', '.join(map(str, bad))} must be 0, or from a millionth to a million")
    return unit, out


def weight_of(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """A node's whole-number weight among its siblings, by its own name; that of 1 unless named."""
    unit, named = whole(weights.get(level))
    out = F.lit(unit).cast("long")
    for name, w in named.items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def share(nodes: DataFrame, parents: DataFrame | None, keys: Sequence[str], level: str, weights: Mapping[str, Mapping[str, float]], budget: Column | None) -> DataFrame:
    """Budgets of the nodes of one level: filled like vessels, each up to its capacity, the rest by weight.

    Children are taken by how soon they are full (capacity / weight). A full one gets its capacity and what it
    lacks goes to its siblings; only if all of them are full does the parent get less, which its own parent has
    seen already as capacity. Whole numbers throughout: running sums rounded down, so that none is lost.
    """
    at = nodes.join(parents.withColumnRenamed("budget", "given"), list(keys)) if keys else nodes.withColumn("given", budget)
    at = at.withColumn("w", weight_of(level, weights))
    at = at.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("capacity", "given", "w")})
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    # capacity / weight is compared exactly enough as a decimal; ties go by name.
    order = by.orderBy(F.col("capacity") / F.col("w").cast("decimal(18,0)"), F.col(level))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # Products of tokens and weights may pass 64 bits.
    d = lambda c: c.cast("decimal(19,0)")
    at = at.withColumn("caps", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    at = at.withColumn("full", d(F.col("capacity")) * d(F.col("ws")) <= d(F.col("given") - F.col("caps")) * d(F.col("w")))
    # Once one isn't full, none after it is.
    at = at.withColumn("full", F.min(F.col("full").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) == 1)
    at = at.withColumn("rest", F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0))).withColumn("rest", F.greatest("rest", F.lit(0)))
    at = at.withColumn("all_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(by)).withColumn("up_to", F.sum(F.when(~F.col("full"), F.col("w"))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    at = at.withColumns({c: d(F.col(c)) for c in ("rest", "up_to", "w", "all_w")})
    drawn = F.expr("(rest * up_to) div all_w - (rest * CAST(up_to - w AS decimal(19,0))) div all_w")
    return at.select(*keys, level, F.when(F.col("full"), F.col("capacity")).otherwise(drawn).cast("long").alias("budget"))


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, float]], levels: Sequence[str] = LEVELS) -> DataFrame:
    """leaves: the level columns and capacity (tokens that they can give). Returns the level columns and budget.

    What a weight of 0 excludes, at any level, is no capacity of its ancestors, and has no row in the result.
    """
    got = None
    for level in levels:
        leaves = leaves.where(weight_of(level, weights) > 0)
    for i, level in enumerate(levels):
        keys = list(levels[:i])
        nodes = leaves.groupBy(*levels[: i + 1]).agg(F.sum("capacity").alias("capacity"))
        got = share(nodes, got, keys, level, weights, total)
    return got


def order_key(doc_id: Column, seed: int, epoch: Column) -> Column:
    """Where a document stands in its leaf's epoch: a seeded hash, which differs by epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def mix(
    df: DataFrame, weights: Mapping[str, Mapping[str, float]] | None = None, part: tuple[int, int] = (1, 2), max_epochs: int = 2, seed: int = 17, domain: Column | None = None
) -> DataFrame:
    """Draw documents so that domains, languages and sources hold their target shares of the tokens.

    df has doc_id, text, lang, source. The total budget is part[0] / part[1] of df's tokens. A leaf (domain, lang,
    source) can give max_epochs times its tokens. Its budget is taken as a prefix of its epochs: whole epochs, then
    documents of the next in seeded order until the budget is reached; the last one stays whole, so a leaf gives at
    most one document more than its budget. Returns df's columns with `epoch` (from 0): a row for each time a
    document is drawn. `domain`: an expression over df, by default from the source's number.

    Null lang, source or text stand for empty ones in the budgets (the rows themselves stay as they are). Documents
    without words are never drawn in a last, partial epoch beyond the budget, but belong to whole epochs. Rows
    that share a doc_id are drawn together. Weights may be fractions (kept to millionths); a weight of 0 excludes a node,
    whose tokens still count in the total. An empty table gives an empty one.

    No row of the documents is shuffled: leaves, and hash ranges of leaves, are summed map-side first; only the range
    in which a leaf's prefix ends is sorted, 1/4096 of the leaf; the plan (a row per leaf) is broadcast if it has at
    most SMALL_ROWS rows, and else joined by shuffle.
    """
    weights = weights or {}
    own = {"domain": domain if domain is not None else domain_of(F.coalesce(F.col("source"), F.lit(""))), "lang": F.coalesce(F.col("lang"), F.lit("")), "source": F.coalesce(F.col("source"), F.lit(""))}
    slim = keep(df.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in own.items()), words(F.coalesce(F.col("text"), F.lit(""))).alias("n")), "tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n").alias("n"))
    total = leaves.agg((F.coalesce(F.sum("n"), F.lit(0))).alias("n")).first()["n"] * part[0] // part[1]
    given = budgets(leaves.withColumn("capacity", F.col("n") * max_epochs), F.lit(total).cast("long"), weights)
    given = given.join(leaves, list(LEVELS)).select(*LEVELS, F.expr("CASE WHEN n > 0 THEN budget div n ELSE 0 END").cast("int").alias("whole"), F.expr("CASE WHEN n > 0 THEN budget % n ELSE 0 END").alias("rest"))
    given = keep(given, "leaves")
    n_leaves = given.count()
    small = broadcast_if_small(given, n_leaves)

    keyed = slim.join(small.where("rest > 0"), list(LEVELS)).withColumn("key", order_key(F.col("doc_id"), seed, F.col("whole")))
    ranges = keyed.groupBy(*LEVELS, F.substring("key", 1, 3).alias("range")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    ordered = W.partitionBy(*LEVELS).orderBy("range")  # a leaf has 4096 ranges at most
    ends = ranges.withColumn("before", F.sum("n").over(ordered) - F.col("n")).where("before < rest AND before + n >= rest").select(*LEVELS, "range", "before")
    ends = broadcast_if_small(ends, n_leaves)
    inside = keyed.withColumn("range", F.substring("key", 1, 3)).join(ends, [*LEVELS, "range"])
    one = inside.groupBy(*LEVELS, "range", "key").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = one.withColumn("start", F.col("before") + F.sum("n").over(W.partitionBy(*LEVELS, "range").orderBy("key")) - F.col("n")).where("start < rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    names = {c: f"_{c}" for c in LEVELS}
    drawn = keep(given.join(upto, list(LEVELS), "left").select(*(F.col(c).alias(a) for c, a in names.items()), F.col("whole").alias("_whole"), F.coalesce(F.col("last"), F.lit("")).alias("_last")), "plan")

    cols = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("epoch", *names.values(), "_whole", "_last", "_taken")]
    met = df.select(*cols, *(own[c].alias(f"_own_{c}") for c in LEVELS)).join(broadcast_if_small(drawn, n_leaves, SMALL_ROWS), [F.col(f"_own_{c}") == F.col(f"_{c}") for c in LEVELS])
    taken = F.col("_whole") + (order_key(F.col("doc_id").cast("long"), seed, F.col("_whole")) <= F.col("_last")).cast("int")
    return met.withColumn("_taken", taken).where("_taken > 0").select(*cols, F.explode(F.sequence(F.lit(0), F.col("_taken") - 1)).alias("epoch"))


def mix_sql(weights: Mapping[str, Mapping[str, float]], part: tuple[int, int], max_epochs: int, seed: int, columns: str = "doc_id, lang, source, epoch", table: str = "documents") -> str:
    """The same draw in SQL, with plain windows: what mix() is held against."""

    def case(level: str) -> str:
        unit, by_name = whole(weights.get(level))
        named = "".join(f" WHEN {level} = '{k}' THEN {v}" for k, v in by_name.items())
        return f"CASE{named} ELSE {unit} END" if named else f"{unit}"

    steps, keys = [], []
    for i, level in enumerate(LEVELS):
        on = ", ".join(keys)
        by = f"PARTITION BY {on}" if keys else ""
        upto = ", ".join(LEVELS[: i + 1])
        source = f"n{i} JOIN b{i - 1} USING ({on})" if keys else "n0, total"
        order = f"{by} ORDER BY CAST(capacity AS DOUBLE) / w, {level}"
        steps.append(f"""
n{i} AS (SELECT {upto}, sum(n) * {max_epochs} AS capacity, {case(level)} AS w FROM used GROUP BY ALL),
s{i} AS (SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {source}),
f{i} AS (SELECT *, min(CASE WHEN capacity * ws <= (given - caps) * w THEN 1 ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM s{i}),
r{i} AS (SELECT *, greatest(given - coalesce(sum(CASE WHEN filled = 1 THEN capacity END) OVER ({by}), 0), 0) AS rest, sum(CASE WHEN filled = 0 THEN w END) OVER ({by}) AS all_w, sum(CASE WHEN filled = 0 THEN w END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to FROM f{i}),
b{i} AS (SELECT {upto}, CASE WHEN filled = 1 THEN capacity ELSE (rest * up_to) // all_w - (rest * (up_to - w)) // all_w END AS given FROM r{i})""")
        keys.append(level)
    lv = ", ".join(LEVELS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS HUGEINT) AS n FROM {table}),
docs AS (SELECT *, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain FROM d),
leaves AS (SELECT {lv}, sum(n) AS n FROM docs GROUP BY ALL),
total AS (SELECT coalesce(sum(n), 0) * {part[0]} // {part[1]} AS given FROM leaves),
used AS (SELECT * FROM leaves WHERE {' AND '.join(case(x) + ' > 0' for x in LEVELS)}),{','.join(steps)},
p AS (SELECT {lv}, CASE WHEN n > 0 THEN given // n ELSE 0 END AS whole, CASE WHEN n > 0 THEN given % n ELSE 0 END AS rest FROM b{len(LEVELS) - 1} JOIN leaves USING ({lv})),
k AS (SELECT docs.*, whole, rest, md5('{seed}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM docs JOIN p USING ({lv})),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {lv} ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(n) OVER (PARTITION BY {lv}, key) AS start FROM k),
t AS (SELECT *, whole + CASE WHEN start < rest THEN 1 ELSE 0 END AS taken FROM c)
SELECT {columns} FROM (SELECT *, CAST(unnest(range(0, CAST(taken AS BIGINT))) AS INTEGER) AS epoch FROM t)"""
