"""Next-month return forecasts: ARX features, walk-forward ridge, scorecard."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from tidemark.functions.numeric import change, ratio
from tidemark.operators.signals import ar_lags, momentum, monthly_returns

# The defaults of the model.
AR_ORDER = 3
L2 = 10.0
MIN_TRAIN = 36
MOMENTUM_MONTHS = 3
EXOG_LAG = 1


def exog_panel(current: DataFrame) -> DataFrame:
    """Every indicator's current values in long form: (series_id, date, value)."""
    return current.select("series_id", "date", "value")


def exog_features(exog: DataFrame, series_ids: list[str], *, lag: int = EXOG_LAG) -> DataFrame:
    """Monthly year-over-year change of each named series, `lag` months late, one column each.

    All series share the months from the first to the last date of any of them,
    so a series that ends early is carried on. One row per calendar month.
    """
    # Reduced to one row per month and series; a series is a key, not a column, until the pivot.
    month = F.trunc("date", "month")
    monthly = exog.groupBy("series_id", month.alias("_month")).agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("date"))).alias("value")
    )
    span = monthly.agg(F.min("_month").alias("_from"), F.max("_month").alias("_to"))
    by_series = Window.partitionBy("series_id").orderBy("_month")
    following = F.add_months(F.lead("_month").over(by_series), -1)
    upto = F.coalesce(following, span.select("_to").scalar())
    step = F.expr("interval 1 month")
    held = (
        monthly.filter(F.col("value").isNotNull())
        .select("series_id", "value", "_month", upto.alias("_upto"))
        .select("series_id", "value", F.explode(F.sequence("_month", "_upto", step)).alias("_month"))
    )
    late = change(F.lag("value", lag).over(by_series), F.lag("value", lag + 12).over(by_series))
    # A row for every month, whether a series has been seen by then or not.
    spine = span.select(F.explode(F.sequence("_from", "_to", step)).alias("_month"))
    wide = (
        held.select("series_id", "_month", late.alias("x"))
        .unionByName(spine, allowMissingColumns=True)
        .groupBy("_month")
        .pivot("series_id", series_ids)
        .agg(F.first("x", ignorenulls=True))
    )
    return wide.select(F.last_day("_month").alias("date"), *[F.col(f"`{sid}`").alias(f"exog_{sid}") for sid in series_ids])


def _months(columns: list[str]) -> Column:
    """Aggregate: one row per month as an array in order; a calendar bounds its length."""
    return F.array_sort(F.collect_list(F.struct("date", *columns)))


def _in_month(months: Column, date: Column) -> Column:
    """The element of the date's month: the last one after the end, NULL before the start.

    `months` holds consecutive months, so the place follows from the distance to the first.
    """
    first = F.get(months, F.lit(0))["date"]
    place = (F.year(date) - F.year(first)) * 12 + F.month(date) - F.month(first)
    return F.get(months, F.least(place, F.size(months) - 1))


def _with_row(rows: DataFrame, row: DataFrame) -> DataFrame:
    """rows with the columns of a one-row frame, whose size the months on a calendar bound.

    A join, not a scalar subquery: filters pushed below would repeat that for each
    column they read. The keys are 0 by the sign of a length: a literal, or what is
    folded to one, would make the join a product.
    """
    key = F.shiftright(F.length(F.coalesce("ticker", F.lit(""))), 31)
    other = F.shiftright(F.size(F.coalesce(row.columns[0], F.array())), 31)
    return rows.withColumn("_one", key).join(F.broadcast(row.withColumn("_one", other)), "_one", "left").drop("_one")


def _with_shared(rows: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of a frame with one row per month, the same for all tickers."""
    columns = [c for c in right.columns if c != "date"]
    rows = _with_row(rows, right.agg(_months(columns).alias("_months")))
    rows = rows.withColumn("_shared", _in_month(F.col("_months"), F.col("date")))
    return rows.withColumns({c: F.col("_shared").getField(c) for c in columns}).drop("_shared", "_months")


def _with_momentum(
    rows: DataFrame, trend: DataFrame, sectors: DataFrame | None, market_id: str | None
) -> DataFrame:
    """Momentum of each ticker's own sector and of the market; a constant where there is no such index.

    Indices are reduced to one row of months each, which the tickers' sectors and
    the market are looked up in: levels are built once.
    """
    indices = trend.groupBy("index_id").agg(_months(["momentum"]).alias("_track"))

    def momentum_of(track: Column) -> Column:
        found = F.when(F.size(track) > 0, _in_month(track, F.col("date"))["momentum"])
        return F.when(track.isNotNull(), found).otherwise(F.lit(0.0))

    if sectors is not None:
        rows = (
            rows.join(sectors.select("ticker", "index_id"), "ticker", "left")
            .join(indices, "index_id", "left")
            .withColumn("sector_mom", momentum_of(F.col("_track")))
            .drop("index_id", "_track")
        )
    if market_id is not None:
        # By an aggregate: a filter would be pushed down into whatever built the levels and run it again.
        mine = F.first(F.when(F.col("index_id") == market_id, F.col("_track")), ignorenulls=True)
        rows = _with_row(rows, indices.agg(mine.alias("_track"))).withColumn("market_mom", momentum_of(F.col("_track"))).drop("_track")
    return rows


def arx_features(
    prices: DataFrame,
    *,
    exog: DataFrame | None = None,
    exog_ids: list[str] | None = None,
    levels: DataFrame | None = None,
    sectors: DataFrame | None = None,
    market_id: str | None = None,
    ar_order: int = AR_ORDER,
    exog_lag: int = EXOG_LAG,
    momentum_window: int = MOMENTUM_MONTHS,
    ledger: Observation | None = None,
) -> DataFrame:
    """Monthly design matrix per ticker: (ticker, date, features, target), complete rows only.

    `prices` is (ticker, date, value), `exog` (series_id, date, value), `levels`
    (index_id, date, value), `sectors` (ticker, index_id). Every feature at a
    month end uses data up to it; the target is the next month's return. A
    ticker whose sector has no index gets a constant there, which the ridge
    ignores, and so do all tickers where the market has none. The names of the features are in `feature_names`.

    `ledger` observes, in the pass that builds the rows, how many months each ticker had
    in all and how many fell to each feature as the first one missing; see `dropped_rows`.
    """
    by_ticker = Window.partitionBy("ticker").orderBy("date")
    returns = monthly_returns(prices, keys=["ticker"])
    rows = ar_lags(returns, ar_order, keys=["ticker"]).withColumn("target", F.lead("ret_lag0").over(by_ticker))
    names = [f"ret_lag{i}" for i in range(ar_order)]
    if exog is not None and exog_ids:
        found = exog_features(exog, exog_ids, lag=exog_lag)
        rows = _with_shared(rows, found)
        names += [c for c in found.columns if c != "date"]
    if levels is not None:
        rows = _with_momentum(rows, momentum(levels, momentum_window, keys=["index_id"]), sectors, market_id)
        names += ["sector_mom"] * (sectors is not None) + ["market_mom"] * (market_id is not None)
    if ledger is not None:
        missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (*names, "target")])
        counts = [F.count(F.when(missing == c, True)).alias(c) for c in (*names, "target")]
        rows = rows.observe(ledger, F.count(F.lit(1)).alias(LEDGER_ROWS), *counts)
    return rows.dropna(subset=[*names, "target"]).select("ticker", "date", *names, "target")


LEDGER_ROWS = "_rows"


def dropped_rows(spark: SparkSession, ledger: Observation) -> DataFrame:
    """(feature, dropped, rows) of a ledger whose features have been computed: one row a feature, zeros included.

    A month is counted at the first feature it lacks, in the order of the columns, the
    target last. Metrics are those of the job that ran; parts of it that ran twice after
    a lost executor may count twice.
    """
    counts = dict(ledger.get)
    total = counts.pop(LEDGER_ROWS)
    return spark.createDataFrame([(name, n, total) for name, n in counts.items()], "feature string, dropped long, rows long")


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("ticker", "date", "target")]


class Gram:
    """Sums over a ticker's training rows: counts, sums and products of features and target in one square array.

    Row and column 0 stand for the constant, the last ones for the target. Values
    are taken relative to an origin, the first row, which keeps the sums free of
    cancellation. A row adds one outer product; sums of two parts of a history add
    up once they have one origin.
    """

    def __init__(self, origin: np.ndarray, sums: np.ndarray):
        self.origin, self.sums = origin, sums

    @classmethod
    def empty(cls, origin: np.ndarray) -> Gram:
        return cls(origin, np.zeros((len(origin) + 1,) * 2))

    def shifted(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(rows), 1)), rows - self.origin], axis=1)

    def before_each(self, rows: np.ndarray) -> np.ndarray:
        """The sums that stand before each of the rows; all rows are added."""
        z = self.shifted(rows)
        steps = np.cumsum(z[:, :, None] * z[:, None, :], axis=0)
        before = np.concatenate([self.sums[None], self.sums + steps[:-1]])[: len(rows)]
        self.sums = self.sums + steps[-1] if len(rows) else self.sums
        return before

    def moved(self, origin: np.ndarray) -> Gram:
        """The same rows relative to another origin."""
        turn = np.eye(len(self.sums))
        turn[1:, 0] = self.origin - origin
        return Gram(origin, turn @ self.sums @ turn.T)

    def merged(self, other: Gram) -> Gram:
        return Gram(self.origin, self.sums + other.moved(self.origin).sums)


def ridge_fits(sums: np.ndarray, x: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prediction, intercept, coefficients) for each row x from the sums that stand before it.

    One small system a row, all rows of a batch at once. Coefficients are per unit
    of each feature; a feature that was constant so far has 0.
    """
    count = sums[:, 0, 0][:, None]
    mean_x, mean_y = sums[:, 0, 1:-1] / count, sums[:, 0, -1][:, None] / count
    gram = sums[:, 1:-1, 1:-1]
    cov = gram - count[:, :, None] * mean_x[:, :, None] * mean_x[:, None, :]
    cov_y = sums[:, 1:-1, -1] - count * mean_x * mean_y
    # A spread that is rounding noise of the second moment is a constant column.
    diag = np.diagonal(cov, axis1=1, axis2=2)
    scale = np.abs(np.diagonal(gram, axis1=1, axis2=2))
    flat = diag <= 1e-13 * scale
    sd = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, diag) / count))
    cov = np.where(flat[:, :, None] | flat[:, None, :], 0.0, cov) / (sd[:, :, None] * sd[:, None, :])
    cov_y = np.where(flat, 0.0, cov_y) / sd
    cov += l2 * np.eye(x.shape[1])
    coef = np.linalg.solve(cov, cov_y[:, :, None])[:, :, 0] / sd
    pred = mean_y[:, 0] + ((x - mean_x) * coef).sum(axis=1)
    return pred, mean_y[:, 0] - (mean_x * coef).sum(axis=1), coef


#: Cells of the training sums that are held at a time: rows go in portions of so many.
_CELLS = 4_000_000
_FITS = "ticker {ticker}, date date, pred double, actual double, intercept double, coef array<double>"
GRAM_STATE = "ticker {ticker}, last_date date, origin array<double>, sums array<double>"


def _walk(rows: np.ndarray, gram: Gram, min_train: int, l2: float):
    """Fits of all rows that have `min_train` rows before them: (first such row, pred, intercept, coef). Rows are added."""
    k = rows.shape[1] - 1
    at_once = max(1, _CELLS // (rows.shape[1] + 1) ** 2)
    first = max(0, min_train - int(gram.sums[0, 0]))
    out = []
    for at in range(0, len(rows), at_once):
        some = rows[at : at + at_once]
        before = gram.before_each(some)
        own = max(0, first - at)
        if own < len(some):
            x = some[own:, :k] - gram.origin[:k]
            out.append(ridge_fits(before[own:], x, l2))
    pred, intercept, coef = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0), np.empty(0), np.empty((0, k)))
    # Back from the origin.
    return first, gram.origin[k] + pred, gram.origin[k] + intercept - (coef * gram.origin[:k]).sum(axis=1), coef


def _matrix(table: pa.Table, names: list[str]) -> tuple[pa.Table, np.ndarray]:
    """A ticker's rows by date, with its features and target as one array."""
    table = table.sort_by("date")
    return table, np.stack([table.column(c).to_numpy() for c in (*names, "target")], axis=1).astype(float)


def _fitted(table: pa.Table, rows: np.ndarray, gram: Gram, min_train: int, l2: float) -> pa.Table:
    first, pred, intercept, coef = _walk(rows, gram, min_train, l2)
    own = table.slice(first) if first < len(table) else table.slice(0, 0)
    return pa.table(
        {
            "ticker": own.column("ticker"), "date": own.column("date"), "pred": pa.array(pred), "actual": own.column("target"),
            "intercept": pa.array(intercept), "coef": pa.array(list(coef), pa.list_(pa.float64())),
        }
    )


def _schema(frame: DataFrame, text: str) -> str:
    return text.format(ticker=frame.schema["ticker"].dataType.simpleString())


def _shown(fits: DataFrame, names: list[str], coefficients: bool) -> DataFrame:
    if not coefficients:
        return fits.select("ticker", "date", "pred", "actual")
    named = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.col("coef"))
    return fits.select("ticker", "date", "pred", "actual", "intercept", named.alias("coef"))


def walk_forward(
    features: DataFrame, *, min_train: int = MIN_TRAIN, l2: float = L2, coefficients: bool = False
) -> DataFrame:
    """Predict each month from a ridge fitted on the ticker's earlier months only.

    Returns (ticker, date, pred, actual) for every month after `min_train`; with
    `coefficients` also each fit's intercept and its coefficients by feature. The
    fit needs only sums over the earlier rows, which a ticker's rows add to one
    after the other (`Gram`): the plan holds one group per ticker, whatever the
    number of features, and a group is bounded by the months on the calendar.
    """
    names = feature_names(features)

    def fit(table: pa.Table) -> pa.Table:
        table, rows = _matrix(table, names)
        return _fitted(table, rows, Gram.empty(rows[0]), min_train, l2)

    rows = features.select("ticker", "date", *[F.col(f"`{c}`").cast("double").alias(c) for c in (*names, "target")])
    return _shown(rows.groupBy("ticker").applyInArrow(fit, _schema(features, _FITS)), names, coefficients)


def gram_state(features: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """What a walk-forward keeps of a history: (ticker, last_date, origin, sums), one row a ticker.

    With `state` only rows dated after a ticker's last one are added to it; rows up to
    that date are taken as known. One array holds the sums of k features in (k + 2)^2 cells.
    """
    return _advance(features, state, None, None)


def walk_forward_on(
    features: DataFrame, state: DataFrame, *, min_train: int = MIN_TRAIN, l2: float = L2, coefficients: bool = False
) -> DataFrame:
    """Predictions for the months after a stored state only, equal to those of a walk over the whole history.

    `features` holds at least the new months, with the features that the state was
    built with; `state` comes from `gram_state`.
    """
    return _shown(_advance(features, state, min_train, l2), feature_names(features), coefficients)


def _advance(features: DataFrame, state: DataFrame | None, min_train: int | None, l2: float | None) -> DataFrame:
    """New fits, or without `min_train` the new state."""
    names = feature_names(features)
    kind = _schema(features, GRAM_STATE)
    if state is None:
        state = features.sparkSession.createDataFrame([], kind)

    def step(new: pa.Table, had: pa.Table) -> pa.Table:
        known = had.to_pylist()[0] if len(had) else None
        gram = None
        if known:
            side = len(names) + 2
            if len(known["sums"]) != side * side:
                raise ValueError(f"the state holds {math.isqrt(len(known['sums'])) - 2} features, not {len(names)}")
            gram = Gram(np.array(known["origin"]), np.array(known["sums"]).reshape(side, side))
            new = new.filter(pc.greater(new.column("date"), pa.scalar(known["last_date"])))
        new, rows = _matrix(new, names)
        gram = gram or Gram.empty(rows[0])
        if min_train is not None:
            return _fitted(new, rows, gram, min_train, l2)
        last = new.column("date")[-1].as_py() if len(new) else known["last_date"]
        for at in range(0, len(rows), 256):
            z = gram.shifted(rows[at : at + 256])
            gram.sums = gram.sums + z.T @ z
        ticker = new.column("ticker")[0] if len(new) else had.column("ticker")[0]
        return pa.table(
            {
                "ticker": pa.array([ticker.as_py()], new.schema.field("ticker").type), "last_date": pa.array([last], pa.date32()),
                "origin": pa.array([gram.origin.tolist()]), "sums": pa.array([gram.sums.ravel().tolist()]),
            }
        )

    rows = features.select("ticker", "date", *[F.col(f"`{c}`").cast("double").alias(c) for c in (*names, "target")])
    both = rows.groupBy("ticker").cogroup(state.groupBy("ticker"))
    return both.applyInArrow(step, kind if min_train is None else _schema(features, _FITS))


def forecast_metrics(backtest: DataFrame, tickers: DataFrame) -> DataFrame:
    """Out-of-sample scorecard, one row for every ticker in `tickers`.

    The baseline predicts zero. A ticker without predictions has n = 0 and NULLs.
    """
    actual, pred = F.col("actual"), F.col("pred")
    hit = F.when(actual != 0, (F.signum(pred) == F.signum(actual)).cast("double"))
    sums = backtest.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((actual - pred) * (actual - pred)).alias("_res"),
        F.sum(actual * actual).alias("_base"),
        F.avg(hit).alias("hit_rate"),
    )
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return (
        tickers.select("ticker")
        .join(sums, "ticker", "left")
        .select(
            "ticker",
            n.alias("n"),
            F.sqrt(F.col("_res") / F.col("_n")).alias("rmse"),
            F.sqrt(F.col("_base") / F.col("_n")).alias("rmse_baseline"),
            (F.lit(1.0) - ratio(F.col("_res"), F.col("_base"))).alias("oos_r2"),
            "hit_rate",
        )
        .withColumn("beats_baseline", F.coalesce(F.col("rmse") < F.col("rmse_baseline"), F.lit(False)))
    )


def backtest_stocks(prices: DataFrame, *, min_train: int = MIN_TRAIN, l2: float = L2, **inputs) -> DataFrame:
    """Features and walk-forward predictions of every ticker in `prices`."""
    return walk_forward(arx_features(prices, **inputs), min_train=min_train, l2=l2)


def forecast_leaderboard(backtest: DataFrame, constituents: DataFrame, securities: DataFrame) -> DataFrame:
    """Scorecard of every current constituent with its name, best out-of-sample fit first."""
    named = securities.select("ticker", "name", "subsector")
    scored = forecast_metrics(backtest, constituents).join(named, "ticker", "left")
    return scored.select(
        "ticker", F.coalesce("name", "ticker").alias("name"), "subsector",
        "n", "rmse", "rmse_baseline", "oos_r2", "hit_rate", "beats_baseline",
    ).orderBy(F.desc_nulls_last("oos_r2"), "ticker")


def leaderboard_summary(leaderboard: DataFrame) -> DataFrame:
    """How many stocks were modelled, how many beat the baseline, and the mean hit rate."""
    return leaderboard.agg(
        F.count(F.lit(1)).alias("stocks"),
        F.count(F.when(F.col("beats_baseline"), True)).alias("beats"),
        F.avg("hit_rate").alias("avg_hit_rate"),
    )
