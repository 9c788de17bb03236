"""DuckDB text shared by the checking queries.

`FRAGMENTS` are common table expressions over the driver's tables, each naming
the ones it reads. They restate the model with other means than the Spark code
where that is practical: full grids, self joins and QUALIFY.
"""

from __future__ import annotations

FRAGMENTS: dict[str, tuple[list[str], str]] = {
    "line": (
        [],
        """
        SELECT cast(l_suppkey AS varchar) AS ticker, l_partkey, l_orderkey, l_linenumber, l_tax,
               l_discount, l_quantity, l_extendedprice, cast(l_shipdate AS date) AS date,
               cast(round(l_extendedprice * 100) AS bigint) AS gross,
               cast(round(l_extendedprice * 100) AS bigint)
                 * (100 - cast(round(l_discount * 100) AS bigint)) AS net,
               cast(l_quantity AS bigint) AS qty
        FROM lineitem""",
    ),
    "px": (
        ["line"],
        """
        SELECT ticker, date,
               cast(sum(gross) AS double) / 100 / cast(sum(qty) AS double) AS close,
               cast(sum(net) AS double) / 10000 / cast(sum(qty) AS double) AS adj_close,
               cast(sum(qty) AS double) AS shares_out
        FROM line GROUP BY ticker, date""",
    ),
    "bpx": (
        ["line"],
        """
        SELECT p_brand AS ticker, date,
               cast(sum(gross) AS double) / 100 / cast(sum(qty) AS double) AS close,
               cast(sum(net) AS double) / 10000 / cast(sum(qty) AS double) AS adj_close,
               cast(sum(qty) AS double) AS shares_out
        FROM line JOIN part ON l_partkey = p_partkey GROUP BY p_brand, date""",
    ),
    # The last share count of each supplier and order day.
    "counts": (
        ["line"],
        """
        SELECT ticker, cast(o_orderdate AS date) AS date,
               arg_max(l_quantity * 1000, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS shares
        FROM line JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON ticker = cast(s_suppkey AS varchar)
        WHERE s_acctbal >= 0 GROUP BY ALL""",
    ),
    # The last usable print of each ticker and day, from the unchecked ones.
    "cleanpx": (
        ["line"],
        """
        SELECT ticker, date, l_extendedprice / l_quantity AS close,
               l_extendedprice / l_quantity * (1 - l_discount) AS adj_close, l_quantity AS shares_out
        FROM line WHERE l_tax NOT IN (0.0, 0.08) AND l_discount NOT IN (0.0, 0.1)
        QUALIFY row_number() OVER (PARTITION BY ticker, date
                                   ORDER BY l_orderkey * 10 + l_linenumber DESC, l_quantity DESC, gross DESC, l_discount DESC) = 1""",
    ),
    "sec": (
        [],
        """
        SELECT cast(s_suppkey AS varchar) AS ticker, s_name AS name, r_name AS subsector,
               date '1995-01-01' + cast(s_suppkey % 10 * 90 AS integer) AS from_date,
               CASE WHEN s_suppkey % 7 = 0 THEN date '2000-12-31' END AS to_date
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    ),
    "mem": (
        ["sec"],
        """
        SELECT 'ALL' AS index_id, ticker, from_date, to_date FROM sec
        UNION ALL
        SELECT 'ALL_' || upper(subsector), ticker, from_date, to_date FROM sec
        WHERE subsector IS NOT NULL""",
    ),
    "mpx": (
        ["mem", "px"],
        """
        SELECT index_id, ticker, date, close, adj_close, shares_out, from_date, to_date,
               date_trunc('quarter', date) AS p
        FROM px JOIN mem USING (ticker)""",
    ),
    "reb": (
        ["mpx"],
        "SELECT index_id, p, min(date) AS k FROM mpx GROUP BY index_id, p",
    ),
    "wt": (
        ["mpx", "reb"],
        """
        SELECT index_id, p, k, ticker,
               close * shares_out / sum(close * shares_out) OVER (PARTITION BY index_id, k) AS weight
        FROM mpx JOIN reb USING (index_id, p)
        WHERE date = k AND close * shares_out > 0
          AND (from_date IS NULL OR from_date <= k) AND (to_date IS NULL OR k <= to_date)""",
    ),
    "days": (
        ["mpx"],
        "SELECT DISTINCT index_id, date, p FROM mpx",
    ),
    # The whole (index day x weighted ticker) grid with carried prices.
    "grid": (
        ["days", "wt", "px"],
        """
        SELECT d.index_id, d.date, d.p, w.k, w.ticker, w.weight,
               last_value(px.close IGNORE NULLS) OVER held AS f_pr,
               last_value(px.adj_close IGNORE NULLS) OVER held AS f_tr
        FROM days d JOIN wt w ON d.index_id = w.index_id AND d.p = w.p
        LEFT JOIN px ON px.ticker = w.ticker AND px.date = d.date
        WINDOW held AS (PARTITION BY d.index_id, d.p, w.ticker ORDER BY d.date
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "grown": (
        ["grid"],
        """
        SELECT index_id, date, p, any_value(k) AS k,
               sum(weight * f_pr / o_pr) AS g_pr, sum(weight * f_tr / o_tr) AS g_tr
        FROM (SELECT *, first_value(f_pr) OVER w AS o_pr, first_value(f_tr) OVER w AS o_tr
              FROM grid WINDOW w AS (PARTITION BY index_id, p, ticker ORDER BY date))
        GROUP BY index_id, date, p""",
    ),
    "chain": (
        ["days", "reb", "grown"],
        """
        SELECT index_id, date, k, coalesce(g_pr, 1) AS g_pr, coalesce(g_tr, 1) AS g_tr,
               CASE WHEN date = k OR g_pr IS NULL THEN 1 ELSE g_pr / lag(g_pr) OVER w END AS f_pr,
               CASE WHEN date = k OR g_tr IS NULL THEN 1 ELSE g_tr / lag(g_tr) OVER w END AS f_tr
        FROM (SELECT d.index_id, d.date, reb.k, g.g_pr, g.g_tr
              FROM days d JOIN reb ON d.index_id = reb.index_id AND d.p = reb.p
              LEFT JOIN grown g ON g.index_id = d.index_id AND g.date = d.date)
        WINDOW w AS (PARTITION BY index_id ORDER BY date)""",
    ),
    "lev": (
        ["chain"],
        """
        SELECT index_id, date, 100 * product(f_pr) OVER w AS level_pr,
               100 * product(f_tr) OVER w AS level_tr
        FROM chain WINDOW w AS (PARTITION BY index_id ORDER BY date
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    # Each index's rebalance days with what the weights held until then gained on them.
    "carry": (
        ["reb", "grid", "px"],
        """
        SELECT r.index_id, r.k,
               sum(l.weight * coalesce(x.close, l.f_pr) / l.o_pr) / sum(l.weight * l.f_pr / l.o_pr) AS c_pr,
               sum(l.weight * coalesce(x.adj_close, l.f_tr) / l.o_tr) / sum(l.weight * l.f_tr / l.o_tr) AS c_tr
        FROM (SELECT index_id, k, lag(p) OVER (PARTITION BY index_id ORDER BY p) AS p FROM reb) r
        JOIN (SELECT index_id, p, ticker, any_value(weight) AS weight, arg_max(f_pr, date) AS f_pr, arg_min(f_pr, date) AS o_pr,
                     arg_max(f_tr, date) AS f_tr, arg_min(f_tr, date) AS o_tr
              FROM grid GROUP BY index_id, p, ticker) l USING (index_id, p)
        LEFT JOIN px x ON x.ticker = l.ticker AND x.date = r.k
        GROUP BY r.index_id, r.k""",
    ),
    "levc": (
        ["chain", "carry"],
        """
        SELECT index_id, date, 100 * product(CASE WHEN date = k THEN coalesce(c_pr, 1) ELSE f_pr END) OVER w AS level_pr,
               100 * product(CASE WHEN date = k THEN coalesce(c_tr, 1) ELSE f_tr END) OVER w AS level_tr
        FROM chain LEFT JOIN carry USING (index_id, k)
        WINDOW w AS (PARTITION BY index_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    # Prices with a late restatement: every third ticker's of one quarter are half as high again.
    "restated": (
        ["cleanpx"],
        """
        SELECT ticker, date, CASE WHEN hit THEN close * 1.5 ELSE close END AS close,
               CASE WHEN hit THEN adj_close * 1.5 ELSE adj_close END AS adj_close, shares_out
        FROM (SELECT *, date >= date '1997-04-01' AND date < date '1997-07-01' AND cast(ticker AS bigint) % 3 = 0 AS hit
              FROM cleanpx)""",
    ),
    "base": (
        ["bpx"],
        """
        SELECT 'BASE_' || upper(replace(ticker, '#', '')) AS index_id, date,
               100 * close / first_value(close) OVER w AS level_pr,
               100 * adj_close / first_value(adj_close) OVER w AS level_tr
        FROM bpx WHERE close > 0 AND adj_close > 0
        WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    ),
    "obs": (
        [],
        """
        SELECT 'ORD' AS source, c_mktsegment AS series_id,
               cast(date_trunc('month', o_orderdate) AS date) AS date,
               cast(l_shipdate AS date) AS as_of,
               cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS double) / 100 AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE cast(l_shipdate AS date) >= cast(date_trunc('month', o_orderdate) AS date)
        GROUP BY ALL""",
    ),
    "cur": (
        ["obs"],
        """
        SELECT source, series_id, date, value FROM obs
        QUALIFY row_number() OVER (PARTITION BY source, series_id, date ORDER BY as_of DESC) = 1""",
    ),
    "spec": (
        [],
        """
        SELECT DISTINCT 'ORD' AS source, c_mktsegment AS series_id, c_mktsegment AS metric_name,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Q' ELSE 'M' END AS frequency, 'USD' AS unit,
               CASE WHEN c_mktsegment < 'G' THEN 'spending' ELSE 'prices' END AS subsector
        FROM customer""",
    ),
    "meta": (
        ["spec", "obs"],
        """
        SELECT s.*, b.first_obs, b.last_obs, timestamp '2002-01-01 00:00:00' AS last_fetched
        FROM spec s LEFT JOIN (SELECT source, series_id, min(date) AS first_obs, max(date) AS last_obs
                               FROM obs GROUP BY ALL) b USING (source, series_id)""",
    ),
    "daily": (
        [],
        """
        SELECT 'EVT' AS source, event_type AS series_id, cast(ts AS date) AS date,
               cast(sum(cast(round(value * 100) AS bigint)) AS bigint) AS cents
        FROM events GROUP BY ALL""",
    ),
    "landed": (
        ["daily"],
        """
        SELECT source, series_id, date,
               cast(date_trunc('week', date) AS date) + 7 AS as_of,
               CASE WHEN cents % 2 = 0 THEN NULL ELSE cast(cents AS double) / 100 END AS value
        FROM daily""",
    ),
    # Month-end closes per ticker on an unbroken run of months, and their returns.
    "mpr": (
        ["px"],
        """
        SELECT ticker, m, date, v, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY m) AS pad
        FROM (SELECT s.ticker, s.m, last_day(s.m) AS date, x.v
              FROM (SELECT ticker, cast(unnest(generate_series(min(date_trunc('month', date)),
                           max(date_trunc('month', date)), interval 1 month)) AS date) AS m
                    FROM px GROUP BY ticker) s
              LEFT JOIN (SELECT ticker, cast(date_trunc('month', date) AS date) AS m,
                                arg_max(adj_close, date) AS v
                         FROM px GROUP BY ALL) x USING (ticker, m))""",
    ),
    "ret": (
        ["mpr"],
        """
        SELECT ticker, m, date, ret
        FROM (SELECT ticker, m, date,
                     pad / lag(pad) OVER (PARTITION BY ticker ORDER BY m) - 1 AS ret FROM mpr)
        WHERE ret IS NOT NULL""",
    ),
    "ilev": (
        ["lev"],
        """
        SELECT index_id, m, last_day(m) AS date, v,
               last_value(v IGNORE NULLS) OVER (PARTITION BY index_id ORDER BY m) AS pad
        FROM (SELECT s.index_id, s.m, x.v
              FROM (SELECT index_id, cast(unnest(generate_series(min(date_trunc('month', date)),
                           max(date_trunc('month', date)), interval 1 month)) AS date) AS m
                    FROM lev GROUP BY index_id) s
              LEFT JOIN (SELECT index_id, cast(date_trunc('month', date) AS date) AS m,
                                arg_max(level_tr, date) AS v
                         FROM lev GROUP BY ALL) x USING (index_id, m))""",
    ),
    "mom": (
        ["ilev"],
        """
        SELECT index_id, m, date, pad / lag(pad, 3) OVER w - 1 AS momentum, pad / lag(pad) OVER w - 1 AS ret
        FROM ilev WINDOW w AS (PARTITION BY index_id ORDER BY m)""",
    ),
    "exog": (
        ["cur"],
        """
        SELECT series_id, m,
               lag(pad, 1) OVER w / lag(pad, 13) OVER w - 1 AS x
        FROM (SELECT series_id, m, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY m) AS pad
              FROM (SELECT i.series_id, s.m, c.value
                    FROM (SELECT cast(unnest(generate_series(min(date), max(date), interval 1 month)) AS date) AS m
                          FROM cur) s
                    CROSS JOIN (SELECT DISTINCT series_id FROM cur) i
                    LEFT JOIN cur c ON c.series_id = i.series_id AND c.date = s.m))
        WINDOW w AS (PARTITION BY series_id ORDER BY m)""",
    ),
    "lastw": (
        ["wt"],
        "SELECT * FROM wt QUALIFY k = max(k) OVER (PARTITION BY index_id)",
    ),
    "cret": (
        ["px", "lastw", "sec"],
        """
        SELECT index_id, ticker, name, subsector, (v / b - 1) * 100 AS return_pct
        FROM lastw JOIN (
            SELECT ticker, arg_max(adj_close, date) AS v,
                   arg_max(adj_close, date) FILTER (date <= (SELECT max(date) FROM px) - 365) AS b
            FROM px GROUP BY ticker) USING (ticker)
        LEFT JOIN sec USING (ticker)
        WHERE b IS NOT NULL AND b <> 0""",
    ),
}


def _needed(names: list[str], seen: dict[str, None], known: dict) -> dict[str, None]:
    for name in names:
        if name not in seen:
            _needed(known[name][0], seen, known)
            seen[name] = None
    return seen


def sql(final: str, *names: str, prices: str = "px") -> str:
    """`final` below the fragments it names and those they read; `prices` may stand in for px."""
    known = FRAGMENTS | ({"px": ([prices], f"SELECT * FROM {prices}")} if prices != "px" else {})
    parts = [f"{name} AS MATERIALIZED ({known[name][1]})" for name in _needed(list(names), {}, known)]
    return f"WITH {', '.join(parts)} {final}" if parts else final


def r(expr: str, digits: int = 6) -> str:
    """Round a double; the sum turns -0 into 0."""
    return f"(round({expr}, {digits}) + cast(0 AS double))"


def sig(expr: str) -> str:
    """Keep the leading seven digits of a double of any size."""
    return f"cast(cast({expr} AS float) AS double)"
