"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells of the given dimensions (source, language,
topic).  Raking multiplies the cells' token weights, one dimension after the
other, until every dimension has its target shares; a document is then drawn
with the probability its cell's weight asks for at a token budget.

Everything is a DataFrame operation.  Rows meet in one aggregation with
map-side combine (a hot source costs nothing there); the sweeps run over the
table of cells, whose size is bounded by the numbers of categories: up to
``GATHERED`` counted rows stay in one partition, so that no sweep shuffles them,
larger tables are dealt out by category; the cells' probabilities return to the
documents by a join that broadcasts within a checked size.

A probability cannot exceed 1.  ``mix`` with ``bounded`` keeps that bound inside
the raking: what a cell cannot give is asked of the other cells of its
categories, by windows of running sums.  ``hold`` also lowers the budget to the
largest at which all targets hold.  Marginals that are not met are logged, and
all of them can be written as a table.  Without both the raked weights are cut
at 1 afterwards and the mixture may miss its targets.

Targets: shares in proportion to a power of a category's own tokens (``power``
1 keeps the mixture, 0 makes it uniform), or given shares.

Defined cases: a null category is one of its own; a text without words has 0
tokens; cells without tokens have probability 0; given shares of categories
without tokens are spread over the others; rows that repeat an id are drawn
alike; extra columns pass through (the names of the added ones are parameters);
an empty table gives an empty result.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orchard.llm.common import broadcast_if_small
from orchard.session import cut_lineage

SEED = 20
#: 13 hex digits of an md5 give a uniform number of 52 bits.
_LOT_DIGITS, _LOT_RANGE = 13, float(1 << 52)
#: A marginal holds when its share is this close to its target.
TOLERANCE = 1e-4
#: Budgets tried at once in the search, and sweeps before the lineage is cut.
STEPS, SWEEPS_A_PLAN = 16, 3
#: Rows of cells (times budgets) that are kept in one partition: about 16 MB.
GATHERED = 1 << 17
_LOG = logging.getLogger(__name__)


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic: texts with licence lines, with addresses, with long
    numbers, and plain prose."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(F.contains(t, F.lit("icense")) | F.contains(t, F.lit("opyright")), "licence")
            .when(F.contains(t, F.lit("@")), "contact")
            .when(t.rlike("[0-9]{9}"), "records").otherwise("prose"))


def lot(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """A uniform number in [0, 1) fixed by id and seed."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _LOT_DIGITS), 16, 10).cast("double") / _LOT_RANGE


def _settled(cells: DataFrame) -> DataFrame:
    """``cells`` with its lineage cut; up to ``GATHERED`` rows come back in one
    partition, where windows and sums need no shuffle."""
    out = cut_lineage(cells)
    return out.coalesce(1) if out.limit(GATHERED + 1).count() <= GATHERED else out


def _with_targets(cells: DataFrame, dims: list[str], powers: dict[str, float],
                  shares: dict[str, DataFrame] | None) -> DataFrame:
    """Cells with ``w`` (token shares) and each dimension's target ``_t_<dim>``."""
    total = cells.agg(F.sum("n")).first()[0]
    out = cells.withColumn("w", F.col("n") / F.lit(float(total or 1)))
    for d in dims:
        if shares and d in shares:
            target = shares[d].select(F.col(d).alias("_key"), F.col("share").alias("_t"))
            out = out.join(broadcast_if_small(target, 128), F.col(d).eqNullSafe(F.col("_key")), "left").drop("_key")
        else:
            mass = cells.groupBy(d).agg(F.sum("n").alias("m")).select(
                F.col(d).alias("_key"), F.pow(F.col("m").cast("double"), F.lit(powers.get(d, 1.0))).alias("_t"))
            out = out.join(broadcast_if_small(mass, 128), F.col(d) == F.col("_key")).drop("_key")
        out = out.withColumnRenamed("_t", f"_t_{d}").fillna(0.0, [f"_t_{d}"])
    out = _settled(out)
    # shares of the categories that have tokens add up to 1
    for d in dims:
        sums = out.groupBy(d).agg(F.first(f"_t_{d}").alias("t")).agg(F.sum("t")).first()[0] or 1.0
        out = out.withColumn(f"_t_{d}", F.col(f"_t_{d}") / F.lit(float(sums)))
    return out


def rake(cells: DataFrame, dims: list[str], powers: dict[str, float],
         shares: dict[str, DataFrame] | None = None, sweeps: int = 10) -> DataFrame:
    """Cells with column ``w``: token shares raked to the targets.

    cells: dims and ``n`` (tokens, > 0).  shares: dimension -> (dim, share)
    for given targets; the other dimensions follow ``powers``.
    """
    out = _with_targets(cells, dims, powers, shares)
    for _ in range(sweeps):
        for d in dims:
            out = out.withColumn("w", F.col("w") * F.col(f"_t_{d}") / F.sum("w").over(Window.partitionBy(d)))
    return out.drop(*[f"_t_{d}" for d in dims])


def _fitted(cells: DataFrame, d: str, names: list[str]) -> DataFrame:
    """``x`` times one factor a category of ``d``, so that min(x, most) sums to
    the category's target, where its cells can give that much.

    Cells reach their bound in the order of most / x.  If the first i do, the
    factor is (target - their bounds) / (the other weights); the first i whose
    own next cell is still below its bound is the solution.  Two running sums.
    """
    part = Window.partitionBy("budget", d)
    up, down = part.orderBy("limit", *names), part.orderBy(F.desc("limit"), *[F.desc(n) for n in names])
    so_far = (Window.unboundedPreceding, -1)
    out = cells.withColumn("limit", F.col("most") / F.col("x")).withColumns({
        "place": F.row_number().over(up),
        "taken": F.coalesce(F.sum("most").over(up.rowsBetween(*so_far)), F.lit(0.0)),
        "rest": F.sum("x").over(down.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.withColumn("f", (F.col(f"_t_{d}") - F.col("taken")) / F.col("rest"))
    out = out.withColumns({
        "first": F.min(F.when(F.col("f") <= F.col("limit"), F.struct("place", "f"))).over(part),
        "last": F.max("limit").over(part)})
    return out.withColumn("x", F.greatest(F.col("x") * F.coalesce("first.f", "last"), F.lit(1e-300))).select(*cells.columns)


def rake_below(cells: DataFrame, dims: list[str], budgets: list[float], sweeps: int) -> DataFrame:
    """Cells once for every budget, with ``w``: shares raked to the targets
    ``_t_<dim>`` under the bound w <= ``most`` = share / budget, at which the
    probability is 1; a cell that cannot give its part leaves it to the others
    of its categories.

    cells: dims, ``n``, ``w`` (token share) and the targets.
    """
    usable = F.least(*[F.col(f"_t_{d}") for d in dims], F.lit(1.0)) > 0
    out = _settled(cells.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets]))).withColumns(
        {"x": F.col("w"), "most": F.col("w") / F.col("budget")}))
    bounded = out.where(usable)
    for sweep in range(sweeps):
        for d in dims:
            bounded = _fitted(bounded, d, dims)
        if sweep % SWEEPS_A_PLAN == SWEEPS_A_PLAN - 1:
            bounded = _settled(bounded)
    bounded = bounded.withColumn("w", F.least("x", "most"))
    return _settled(bounded.union(out.where(~usable).withColumn("w", F.lit(0.0))).drop("x", "most"))


def _gaps(weights: DataFrame, dims: list[str]) -> dict[float, float]:
    """Budget -> largest distance of a category's share from its target."""
    out: dict[float, float] = {}
    for d in dims:
        sums = weights.groupBy("budget", d).agg(F.abs(F.sum("w") - F.first(f"_t_{d}")).alias("gap"))
        for b, gap in sums.groupBy("budget").agg(F.max("gap")).collect():
            out[b] = max(out.get(b, 0.0), gap)
    return out


def rake_within(cells: DataFrame, dims: list[str], powers: dict[str, float], budget: float,
                shares: dict[str, DataFrame] | None = None, sweeps: int = 10) -> DataFrame:
    """Cells with ``w``, ``budget`` and ``_t_<dim>``: bounded raking at the
    largest budget up to ``budget`` at which the targets hold as well as they
    do without the bound.

    The search tries ``STEPS`` budgets at once, twice: between the largest one
    at which plain raking meets no bound and ``budget``, then between the last
    that held and the first that did not.
    """
    start = _with_targets(cells, dims, powers, shares)
    # a bound far above every share: plain raking
    free = rake_below(start, dims, [1e-9], sweeps)
    least = max(_gaps(free, dims).values(), default=0.0) + TOLERANCE
    total = float(start.agg(F.sum("n")).first()[0] or 1)
    room = free.where("w > 0").agg(F.min(F.col("n") / F.lit(total) / F.col("w"))).first()[0]
    low, high = min(budget, room or budget), budget
    weights, best = rake_below(start, dims, [low], sweeps), low
    for _ in range(2):
        if low >= high:
            break
        grid = [low * (high / low) ** (i / STEPS) for i in range(1, STEPS)] + [high]
        tried = rake_below(start, dims, grid, sweeps)
        gaps = _gaps(tried, dims)
        held = [b for b in grid if gaps.get(b, 0.0) <= least]
        if held:
            best = max(held)
            weights = tried.where(F.col("budget") == F.lit(best))
        low, high = best, min((b for b in grid if b > best), default=best)
    return weights


def marginals(weights: DataFrame, dims: list[str]) -> DataFrame:
    """dim, category, before, target, drawn: token shares of every category
    before the draw, asked for, and expected in the draw.

    weights: dims, ``n``, ``p`` (the cell's probability) and ``_t_<dim>``.
    """
    sums = weights.agg(F.sum("n"), F.sum(F.col("n") * F.col("p"))).first()
    out = None
    for d in dims:
        part = weights.groupBy(F.lit(d).alias("dim"), F.col(d).cast("string").alias("category")).agg(
            (F.sum("n") / F.lit(float(sums[0] or 1))).alias("before"), F.first(f"_t_{d}").alias("target"),
            (F.sum(F.col("n") * F.col("p")) / F.lit(float(sums[1] or 1))).alias("drawn"))
        out = part if out is None else out.union(part)
    return out


def _report(weights: DataFrame, names: list[str], dims: list[str], budget: float) -> None:
    """Log the budget in use when it was lowered, and the marginals that miss."""
    used = weights.agg(F.first("budget")).first()[0]
    if used is not None and used < budget:
        _LOG.warning("mixing: budget %.4f instead of %.4f, the largest at which the targets hold", used, budget)
    missed = marginals(weights, names).where(F.abs(F.col("drawn") - F.col("target")) > 2 * TOLERANCE)
    for r in missed.orderBy(F.abs(F.col("drawn") - F.col("target")).desc()).limit(20).collect():
        _LOG.warning("mixing: %s %s cannot reach its target share %.4f, drawn %.4f",
                     dims[names.index(r["dim"])], r["category"], r["target"], r["drawn"])


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix(docs: DataFrame, dims: list[str], powers: dict[str, float], budget: float = 0.5,
        shares: dict[str, DataFrame] | None = None, sweeps: int = 10, seed: int = SEED,
        hold: bool = False, bounded: bool = False, tokens: str = "n_tokens", probability: str = "probability",
        sampled: str = "sampled", report: str | None = None) -> DataFrame:
    """``docs`` (with dims and ``tokens``) plus ``probability`` and ``sampled``.

    budget: tokens asked for, as a share of all tokens.  ``bounded`` keeps
    probabilities up to 1 inside the raking; ``hold`` also lowers the budget to
    the largest at which the targets hold.  Without both, the raked weights are
    cut at 1: such a cell is taken whole and falls short of its weight.
    ``report``: a path for the table of ``marginals`` (Parquet): what every
    category had, was to have and is drawn with, and the budget in use.
    """
    names = [fresh(docs, f"_d{i}") for i in range(len(dims))]
    keyed = docs.withColumns({n: F.coalesce(F.col(d).cast("string"), F.lit("(null)")) for n, d in zip(names, dims)})
    cells = _settled(keyed.groupBy(*names).agg(F.sum(tokens).alias("n")).where("n > 0"))
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    given = {names[dims.index(d)]: s.select(F.col(d).alias(names[dims.index(d)]), "share")
             for d, s in (shares or {}).items()}
    powers = {n: powers.get(d, 1.0) for n, d in zip(names, dims)}
    if hold or bounded:
        weights = rake_within(cells, names, powers, budget, given, sweeps) if hold else rake_below(
            _with_targets(cells, names, powers, given), names, [budget], sweeps)
        weights = _settled(weights.withColumn(
            "p", F.least(F.lit(1.0), F.col("w") * F.col("budget") * F.lit(total) / F.col("n"))))
        _report(weights, names, dims, budget)
        if report:
            marginals(weights, names).withColumn("budget", weights.select(F.first("budget")).scalar()).withColumn(
                "dim", F.element_at(F.create_map(*[F.lit(x) for n, d in zip(names, dims) for x in (n, d)]), F.col(
                    "dim"))).write.parquet(report)
    else:
        weights = _settled(rake(cells, names, powers, given, sweeps)).withColumn(
            "p", F.least(F.lit(1.0), F.col("w") * F.lit(budget * total) / F.col("n")))
    chance = weights.select(*names, F.col("p").alias(probability))
    out = keyed.join(broadcast_if_small(chance, 256), names, "left").drop(*names)
    out = out.withColumn(probability, F.coalesce(probability, F.lit(0.0)))
    return out.withColumn(sampled, lot("doc_id", seed) < F.col(probability))
