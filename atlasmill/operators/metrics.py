"""Projection quality metrics as DataFrame jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import distances, logistic
from .arrays import matrix, vector
from .neighbors import distance_ranks, knn
from .ordering import one_row, position_in_group, with_position
from .sweep import group_blocks, sweep
from ..functions.cells import first_functional_keyword
from ..functions.scalars import is_valid_label
from .align import first_wins

DEFAULT_K = 15


def with_low_vec(df: DataFrame, dims: int = 2, out: str = "low") -> DataFrame:
    cols = ["x", "y", "z"][:dims]
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def trust_neighbors(n: int, k: int) -> int:
    return min(k, n // 2)


def neighborhoods(df: DataFrame, k: int, id_col: str = "identifier", high: str = "vec", low: str = "low") -> DataFrame:
    """Low-dimensional neighbour list with each neighbour's high-dimensional rank.

    ``(i, j, rank_lo, rank_hi)``: the one table trustworthiness is read from for
    every k up to the given one.
    """
    near = knn(df, k, id_col, low).select("i", "j", F.col("rank").alias("rank_lo"))
    return distance_ranks(near, df.select(id_col, high), id_col, high)


def trustworthiness(ranked: DataFrame, n: int, ks: list[int]) -> DataFrame:
    """Trustworthiness for several k from one rank pass: ``(k, trustworthiness)``."""
    table = ranked.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    penalty = F.when(
        (F.col("rank_lo") <= F.col("k")) & (F.col("rank_hi") > F.col("k")), F.col("rank_hi") - F.col("k")
    ).otherwise(F.lit(0))
    scale = F.lit(2.0) / (F.lit(float(n)) * F.col("k") * (2.0 * n - 3.0 * F.col("k") - 1.0))
    sums = ranked.select(
        F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"), "rank_lo", "rank_hi"
    ).groupBy("k").agg(F.sum(penalty).alias("penalty"))
    return table.join(sums, "k", "left").select(
        "k", (F.lit(1.0) - scale * F.coalesce("penalty", F.lit(0))).alias("trustworthiness")
    )


def preservation(
    high_knn: DataFrame, low_knn: DataFrame, ids: DataFrame, k: int, id_col: str = "identifier"
) -> DataFrame:
    """Share of each row's k nearest that both spaces agree on: ``(id, preservation)``."""
    shared = high_knn.select("i", "j").join(low_knn.select("i", "j"), ["i", "j"]).groupBy("i").agg(
        F.count("*").alias("hits")
    )
    return ids.select(F.col(id_col)).join(shared.withColumnRenamed("i", id_col), id_col, "left").select(
        id_col, (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("preservation")
    )


def labelled_neighbors(near: DataFrame, labels: DataFrame, id_col: str = "identifier", label_col: str = "label") -> DataFrame:
    """Neighbour pairs with both labels: ``(i, j, rank, li, lj)``."""
    li = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("li"))
    lj = labels.select(F.col(id_col).alias("j"), F.col(label_col).alias("lj"))
    return near.join(li, "i").join(lj, "j")


def knn_purity(near: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean share of same-label neighbours over rows of :func:`labelled_neighbors`."""
    per_row = near.groupBy(*by, "i").agg(F.avg((F.col("li") == F.col("lj")).cast("double")).alias("share"))
    return per_row.groupBy(*by).agg(F.avg("share").alias("purity"))


def loo_votes(near: DataFrame, by: list[str] = ()) -> DataFrame:
    """Majority label of the neighbours, ties to the smaller label: ``(i, li, predicted)``."""
    votes = near.groupBy(*by, "i", "li", "lj").agg(F.count("*").alias("votes"))
    # smallest (-votes, label) wins; an aggregate, so no per-row window sort
    return votes.groupBy(*by, "i", "li").agg(
        F.min(F.struct((-F.col("votes")).alias("v"), F.col("lj"))).getField("lj").alias("predicted")
    )


def loo_accuracy(near: DataFrame, by: list[str] = ()) -> DataFrame:
    hit = (F.col("li") == F.col("predicted")).cast("double")
    return loo_votes(near, by).groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def standard_scaled(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """z-scores with the population deviation; constant columns are only centred."""
    facts = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    fact = None if by else one_row(facts)
    out = df.join(facts, list(by)) if by else df
    get = lambda name: F.col(name) if by else fact[name]
    for c in columns:
        sd = F.when(get(f"_s_{c}") > 0, get(f"_s_{c}")).otherwise(F.lit(1.0))
        out = out.withColumn(c, (F.col(c) - get(f"_m_{c}")) / sd)
    return out.drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


class _Silhouette:
    """Mean distance to every class, streamed class by class; keeps only a and b."""

    def start(self, table: pa.Table) -> None:
        self.key = vector(table["gid"], np.int64)
        self.cls = vector(table["cls"], np.int64)
        self.w = vector(table["w"], np.int64)
        self.vec = matrix(table["vec"])
        m = len(self.key)
        self.own = np.full(m, np.nan)
        self.nearest = np.full(m, np.inf)
        self.current, self.sum, self.size = None, None, 0.0

    def _close(self) -> None:
        if self.current is None:
            return
        mine = self.cls == self.current
        if self.size > 1:
            self.own[mine] = self.sum[mine] / (self.size - 1)
        mean = self.sum[~mine] / self.size
        self.nearest[~mine] = np.minimum(self.nearest[~mine], mean)

    def step(self, batch: pa.RecordBatch) -> None:
        cls = vector(batch.column("cls"), np.int64)
        w = vector(batch.column("w"))
        vec = matrix(batch.column("vec"))
        cuts = np.flatnonzero(np.diff(cls)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cls)]):
            if cls[lo] != self.current:
                self._close()
                self.current, self.sum, self.size = cls[lo], np.zeros(len(self.key)), 0.0
            self.size += w[lo:hi].sum()
            for part in distances.tiles(len(self.key), hi - lo):
                self.sum[part] += distances.planar(self.vec[part], vec[lo:hi]) @ w[lo:hi]

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._close()
        top = np.maximum(self.own, self.nearest)
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where(np.isnan(self.own) | (top == 0), 0.0, (self.nearest - self.own) / top)
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.key), pa.array(self.w), pa.array(s)], names=["gid", "w", "silhouette"]
        )


def silhouette(
    df: DataFrame, label_col: str = "label", vec_col: str = "low", by: list[str] = (), block_rows: int = 4096
) -> DataFrame:
    """Mean silhouette over labelled rows, optionally per group of ``by`` columns.

    Equal points of one class are collapsed to a weighted point first. Groups
    with fewer than two classes give NULL.
    """
    by = list(by)
    if not by:
        whole = silhouette(df.withColumn("_all", F.lit(0)), label_col, vec_col, ["_all"], block_rows)
        return whole.agg(F.max("silhouette").alias("silhouette"))
    labelled = df.filter(is_valid_label(label_col)).select(
        *by, F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    counted = labelled.groupBy(*by, "label", "vec").agg(F.count("*").alias("w"))
    classes = cut_lineage(
        counted.groupBy(*by, "label").agg(F.sum("w").alias("_size")).withColumn("cls", F.monotonically_increasing_id())
    )
    groups = classes.groupBy(*by).agg(F.count("*").alias("_classes")).withColumn("grp", F.monotonically_increasing_id())
    groups = cut_lineage(groups.filter("_classes > 1"))
    coded = counted.join(classes.drop("_size"), [*by, "label"])
    coded = coded.join(groups.drop("_classes"), by)
    points = cut_lineage(coded.select(F.monotonically_increasing_id().alias("gid"), "w", "cls", "grp", "vec"))
    # every class of a group matters to every point of it: nothing to leave out within a group
    rows, n_blocks, visits = group_blocks(points, block_rows)
    scored = sweep(
        rows.drop("grp"), rows.drop("grp"), _Silhouette,
        "gid bigint, w bigint, silhouette double", n_blocks, visits, ["cls"],
    )
    mean = scored.join(points.select("gid", "grp"), "gid").groupBy("grp").agg(
        (F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("silhouette")
    )
    named = groups.join(mean, "grp").select(*by, "silhouette")
    return classes.select(*by).distinct().join(named, by, "left")


def stack_groups(df: DataFrame, by: str, id_col: str, vec_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Number the rows of all groups of ``by`` so that one neighbour search serves them.

    Returns ``stacked(sid, <by>, <vec_cols>)`` and ``names(sid, by, id)``. ``sid``
    sorts like the id within a group.
    """
    numbered = cut_lineage(with_position(df.select(by, id_col), [by, id_col], "sid"))
    stacked = df.join(numbered, [by, id_col]).select("sid", by, *[F.col(c).cast("array<double>").alias(c) for c in vec_cols])
    return cut_lineage(stacked), numbered.select("sid", by, id_col)


def grouped_knn(stacked: DataFrame, names: DataFrame, k: int, vec_col: str, by: str, id_col: str) -> DataFrame:
    """k nearest within the own group: (by, i, j, rank, distance)."""
    near = knn(stacked, k, "sid", vec_col, group_col=by)
    a = names.select(F.col("sid").alias("i"), by, F.col(id_col).alias("_i"))
    b = names.select(F.col("sid").alias("j"), F.col(id_col).alias("_j"))
    return near.join(a, "i").join(b, "j").select(by, F.col("_i").alias("i"), F.col("_j").alias("j"), "rank", "distance")


def grouped_ranks(stacked: DataFrame, names: DataFrame, k: int, high: str, low: str, by: str) -> DataFrame:
    """Neighbourhood table per group: (by, i, j, rank_lo, rank_hi), ids are sids."""
    near = knn(stacked, k, "sid", low, group_col=by).select("i", "j", F.col("rank").alias("rank_lo"))
    own = near.join(names.select(F.col("sid").alias("i"), by), "i").select(by, "i", "j", "rank_lo")
    return distance_ranks(cut_lineage(own), stacked.select("sid", by, high), "sid", high, group_col=by)


def grouped_trustworthiness(ranked: DataFrame, by: str, n: int, ks: list[int]) -> DataFrame:
    """Trustworthiness per group (all of size n) and k."""
    k = F.col("k")
    penalty = F.when((F.col("rank_lo") <= k) & (F.col("rank_hi") > k), F.col("rank_hi") - k).otherwise(F.lit(0))
    scale = F.lit(2.0) / (F.lit(float(n)) * k * (2.0 * n - 3.0 * k - 1.0))
    spread = ranked.withColumn("k", F.explode(F.array(*[F.lit(int(x)) for x in ks])))
    return spread.groupBy(by, "k").agg(F.sum(penalty).alias("p")).select(
        by, "k", (F.lit(1.0) - scale * F.col("p")).alias("trustworthiness")
    )


def two_predictor_r2(df: DataFrame, target: str, x: str = "x", y: str = "y", by: list[str] = ()) -> DataFrame:
    """R-squared of a least-squares fit of ``target`` on x and y, in one aggregation."""
    sxx, syy, stt = F.var_samp(x), F.var_samp(y), F.var_samp(target)
    sxy, sxt, syt = F.covar_samp(x, y), F.covar_samp(x, target), F.covar_samp(y, target)
    agg = df.groupBy(*by) if by else df.groupBy()
    m = agg.agg(
        sxx.alias("sxx"), syy.alias("syy"), stt.alias("stt"), sxy.alias("sxy"), sxt.alias("sxt"), syt.alias("syt")
    )
    c = {n: F.col(n) for n in ("sxx", "syy", "stt", "sxy", "sxt", "syt")}
    num = c["syy"] * c["sxt"] ** 2 - 2.0 * c["sxy"] * c["sxt"] * c["syt"] + c["sxx"] * c["syt"] ** 2
    den = (c["sxx"] * c["syy"] - c["sxy"] ** 2) * c["stt"]
    return m.select(*by, F.try_divide(num, den).alias("r2"))


def min_class_labels(df: DataFrame, label_col: str, min_size: int, drop_rows: bool = False) -> DataFrame:
    """Labels of classes below ``min_size`` become NULL (or their rows are dropped)."""
    sizes = df.groupBy(label_col).agg(F.count("*").alias("_n"))
    keep = sizes.filter((F.col("_n") >= min_size) & F.col(label_col).isNotNull()).select(label_col)
    if drop_rows:
        return df.join(keep, label_col, "left_semi").select(df.columns)
    # rows without a label would otherwise all meet in one task
    salt = F.when(F.col(label_col).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(4096))).otherwise(F.lit(0)).cast("int")
    marked = df.withColumn("_salt", salt).join(keep.withColumns({"_ok": F.lit(True), "_salt": F.lit(0)}), [label_col, "_salt"], "left")
    return marked.withColumn(label_col, F.when(F.col("_ok"), F.col(label_col))).select(df.columns)


def labels_from_annotations(
    annotations: DataFrame, headers: DataFrame, column: str = "keyword", filter_keywords: bool = True,
    min_class_size: int = 3, id_col: str | None = None,
) -> DataFrame:
    """One label per header from an annotation column (NULL where none).

    For keywords the first functional one is taken; classes below the minimum
    size lose their label. The id column is ``protein_id`` or ``identifier``.
    """
    if column not in annotations.columns:
        raise ValueError(f"Column '{column}' not found. Available: {sorted(annotations.columns)}")
    id_col = id_col or next((c for c in ("protein_id", "identifier") if c in annotations.columns), None)
    if id_col is None:
        raise ValueError("No identifier column found; expected 'protein_id' or 'identifier'.")
    raw = F.col(column)
    label = first_functional_keyword(raw) if filter_keywords and column == "keyword" else F.when(raw != "", raw)
    labelled = annotations.select(F.col(id_col).alias("identifier"), label.alias("label"))
    if min_class_size > 1:
        labelled = min_class_labels(labelled, "label", min_class_size)
    return headers.join(first_wins(labelled, "identifier", ["label"]), "identifier", "left")


def label_summary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """How many rows there are, how many have a label, and how many labels; :func:`class_sizes` has their sizes."""
    return df.agg(
        F.count("*").alias("n_total"),
        F.count(label_col).alias("n_labelled"),
        F.count_distinct(label_col).alias("n_classes"),
    )


def class_sizes(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n): rows of every class, the largest first."""
    return df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label_col)


def stratified_folds(df: DataFrame, id_col: str, label_col: str, folds: int | Column = 5, seed: int = 42, by: list[str] = ()) -> DataFrame:
    """Deterministic stratified folds: the rows of a class (within the group of ``by``), in an order by hash, take the folds in turn.

    Fold sizes of a class differ by one at most, so a class of ``folds`` rows is in every fold.
    """
    order = [F.xxhash64(F.lit(seed), F.col(label_col), F.col(id_col)), F.col(id_col)]
    placed = position_in_group(df, [*by, label_col], order, "_turn")
    return placed.withColumn("fold", (F.col("_turn") % folds).cast("int")).drop("_turn")


def macro_f1_from_pairs(pairs: DataFrame, truth: str = "label", predicted: str = "predicted", by: list[str] = (), n: Column | None = None) -> DataFrame:
    """Macro F1 over the classes of (truth, predicted) rows, or of cells that stand for ``n`` rows; per group of ``by``."""
    by = list(by)
    cells = pairs.groupBy(*by, truth, predicted).agg((F.count("*") if n is None else F.sum(n)).alias("n"))
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    by_truth = cells.groupBy(*by, F.col(truth).alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_guess = cells.groupBy(*by, F.col(predicted).alias("c")).agg(F.sum("n").alias("guessed"))
    joined = by_truth.join(by_guess, [*by, "c"], "full").na.fill(0, ["support", "tp", "guessed"])
    f1 = F.lit(2.0) * F.col("tp") / (F.col("support") + F.col("guessed"))
    return joined.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))


def macro_f1(
    df: DataFrame, id_col: str = "identifier", label_col: str = "label", folds: int = 5, seed: int = 42, by: list[str] = ()
) -> DataFrame:
    """Cross-validated macro F1 of a class-balanced logistic regression on scaled x, y; all groups of ``by`` in one job.

    Folds are stratified, at most as many as the smallest class has rows. Groups with fewer than two classes, or with
    a class of one row, get NULL. Rows without a label don't count.
    """
    by = list(by)
    labelled = df.select(*by, id_col, F.col(label_col).cast("string").alias("_label"), "x", "y").where("_label is not null")
    rows = standard_scaled(labelled, ["x", "y"], by)
    sizes = rows.groupBy(*by, "_label").agg(F.count("*").alias("_n"))
    facts = sizes.groupBy(*by).agg(F.min("_n").alias("_small"), F.count("*").alias("_classes"))
    facts = facts.withColumns({"grp": F.xxhash64(*by) if by else F.lit(0).cast("bigint"), "_folds": F.least(F.lit(folds), F.col("_small")).cast("int")})
    facts = cut_lineage(facts.withColumn("_fit", F.coalesce((F.col("_classes") > 1) & (F.col("_small") > 1), F.lit(False))))
    # classes by name; a group has one row a class here
    classes = sizes.withColumn("class", F.row_number().over(Window.partitionBy(*by).orderBy("_label")) - 1).drop("_n")
    usable = facts.where("_fit").select(*by, "grp", "_folds")
    if by:
        joined = rows.join(usable, by)
    else:
        one = usable.first()
        joined = rows.withColumns({"grp": F.lit(0).cast("bigint"), "_folds": F.lit(one["_folds"] if one else 1)}).where(F.lit(one is not None))
    placed = stratified_folds(joined.join(classes, [*by, "_label"]), id_col, "_label", F.col("_folds"), seed, by)
    placed = cut_lineage(placed.select("grp", F.xxhash64(id_col).alias("row"), "x", "y", F.col("class").cast("bigint").alias("class"), F.col("fold").cast("bigint").alias("fold")))
    counted = placed.groupBy("grp", "fold", "class").agg(F.count("*").alias("n"))
    cells = logistic.confusion(placed, counted)
    scores = macro_f1_from_pairs(cells, "truth", "guess", ["grp"], F.col("n"))
    return facts.join(scores, "grp", "left").select(*by, "macro_f1")


def percentile_ci(df: DataFrame, value_col: str, by: list[str]) -> DataFrame:
    """Mean with the 2.5 and 97.5 percentile (linear interpolation)."""
    q = F.percentile(value_col, F.array(F.lit(0.025), F.lit(0.975)))
    return df.groupBy(*by).agg(F.avg(value_col).alias("mean"), q.alias("_q")).select(
        *by, "mean", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high")
    )


def bootstrap_samples(df: DataFrame, id_col: str, rounds: int, share: float = 0.8) -> DataFrame:
    """``rounds`` subsamples without replacement, each of exactly ``int(n * share)`` rows.

    Membership follows the md5 order of (id, round). The cut-off of each round
    is found by counting hash prefixes, so no round is ever sorted in one task.
    """
    n = df.count()
    size = int(n * share)
    spread = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    ticket = F.md5(F.concat_ws("#", F.col(id_col).cast("string"), F.col("round").cast("string")).cast("binary"))
    tickets = spread.withColumn("_t", ticket).withColumn("_p", F.substring("_t", 1, 4))
    # prefix histogram: at most 65536 rows per round
    hist = tickets.groupBy("round", "_p").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("round").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_upto", F.sum("_n").over(run))
    edge = cum.filter((F.col("_upto") >= size) & (F.col("_upto") - F.col("_n") < size)).select(
        "round", F.col("_p").alias("_edge"), (F.lit(size) - (F.col("_upto") - F.col("_n"))).alias("_left")
    )
    marked = tickets.join(edge, "round")
    sure = marked.filter(F.col("_p") < F.col("_edge"))
    inside = marked.filter(F.col("_p") == F.col("_edge"))
    nth = F.row_number().over(Window.partitionBy("round").orderBy("_t", id_col))
    picked = inside.withColumn("_k", nth).filter(F.col("_k") <= F.col("_left")).drop("_k")
    return sure.unionByName(picked).drop("_t", "_p", "_edge", "_left")


def outliers(scores: DataFrame, value_col: str, share: float = 0.1) -> DataFrame:
    """Rows at or below the given percentile (linear interpolation) of the score, found by position after a range sort."""
    placed = with_position(scores.select(F.col(value_col).cast("double").alias("v")).filter("v is not null"), ["v"], "_at")
    at = max(placed.count() - 1, 0) * share
    low, high = math.floor(at), math.ceil(at)
    ends = {r["_at"]: r["v"] for r in placed.filter(F.col("_at").isin(low, high)).collect()}
    if not ends:
        return scores.limit(0)
    cut = ends[low] if low == high else (high - at) * ends[low] + (at - low) * ends[high]
    return scores.filter(F.col(value_col) <= cut)


def group_shares(df: DataFrame, group_col: str) -> DataFrame:
    counts = df.groupBy(group_col).agg(F.count("*").alias("n"))
    total = one_row(df.agg(F.count("*").alias("total")))["total"]
    return counts.select(group_col, "n", (F.col("n") / total).alias("share"))
