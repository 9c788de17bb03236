"""Table schemas of the model. Keys are noted; Spark does not enforce them."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _F, _TS = T.StringType(), T.DateType(), T.DoubleType(), T.TimestampType()

# key: source, series_id
SERIES_META = _struct(
    source=_S, series_id=_S, metric_name=_S, frequency=_S, unit=_S, subsector=_S,
    notes=_S, first_obs=_D, last_obs=_D, last_fetched=_TS,
)
# key: source, series_id, date, as_of
OBSERVATIONS = _struct(source=_S, series_id=_S, date=_D, as_of=_D, value=_F)
# key: ticker
SECURITIES = _struct(ticker=_S, name=_S, subsector=_S, from_date=_D, to_date=_D, notes=_S)
# key: ticker, date
PRICES = _struct(ticker=_S, date=_D, close=_F, adj_close=_F, shares_out=_F)
# key: index_id, date
INDEX_VALUES = _struct(index_id=_S, date=_D, level_pr=_F, level_tr=_F)
# key: index_id, rebalance_date, ticker
INDEX_WEIGHTS = _struct(index_id=_S, rebalance_date=_D, ticker=_S, weight=_F)
# what index levels are chained from, one folder per period
INDEX_DAYS = _struct(
    index_id=_S, rebalance_date=_D, date=_D, growth_pr=_F, growth_tr=_F, total_pr=_F, total_tr=_F,
    left=T.ArrayType(_struct(open_date=_D, gain_pr=_F, gain_tr=_F)), period=_D,
)
TICKER_ENDS = _struct(
    ticker=_S, date=_D, close=_F, adj_close=_F, open_date=_D, open_cap=_F, open_pr=_F, open_tr=_F,
    carried=T.BooleanType(), period=_D,
)
PERIOD_WEIGHTS = _struct(index_id=_S, rebalance_date=_D, ticker=_S, weight=_F, period=_D)
PERIOD_BASELINES = _struct(index_id=_S, ticker=_S, date=_D, close=_F, adj_close=_F, period=_D)
# the price batches and settings that the stored days hold for
INDEX_MARKS = _struct(settings=_S, base_value=_F, prices=T.LongType(), landed_prices=T.LongType())
# one row per pull
RAW_LANDING = _struct(source=_S, series_id=_S, fetched_at=_TS, payload=_S)
# observations of a pull that could not be read
OBSERVATION_REJECTS = _struct(
    source=_S, series_id=_S, fetched_at=_TS, date_text=_S, value_text=_S, reason=_S
)
# stored prices and rejected ones; status is "clean" or "rejected" and a folder level.
# A rejected row keeps the text of what was sent. fetched_at says which of several prints of a day came last.
PRICE_PRINTS = _struct(
    ticker=_S, date=_D, close=_F, adj_close=_F, shares_out=_F, date_text=_S, close_text=_S, adj_close_text=_S,
    fetched_at=_TS, reason=_S, status=_S,
)
# what a stream's batch did to each series
INGEST_STATS = _struct(
    source=_S, series_id=_S, entries=T.LongType(), errors=T.LongType(), first_obs=_D, last_obs=_D
)
# the JSON document inside RAW_LANDING.payload
PAYLOAD = _struct(observations=T.ArrayType(_struct(date=_S, value=_S)))
# the same for a pull of prices, whose series_id is the ticker
PRICE_PAYLOAD = _struct(prices=T.ArrayType(_struct(date=_S, close=_S, adj_close=_S, shares_out=_S)))
OBSERVATION_KEY = ["source", "series_id", "date", "as_of"]
PRICE_KEY = ["ticker", "date"]
SECURITY_KEY = ["ticker"]
META_KEY = ["source", "series_id"]
