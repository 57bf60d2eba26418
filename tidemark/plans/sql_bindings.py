"""The bindings of `sources.bindings` as SQL, for the checks in DuckDB."""

MARKET = """
stock AS (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close, count(*) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
market AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close, count(*) AS volume FROM orders GROUP BY 1),
sr AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM stock),
mr AS (SELECT *, lag(close) OVER (ORDER BY date) AS prev FROM market),
joined AS (SELECT s.ticker, s.date, s.close AS stock_close, s.volume AS stock_volume, k.close AS market_close,
  k.volume AS market_volume, s.close / s.prev - 1 AS r, k.close / k.prev - 1 AS m
  FROM sr s JOIN mr k ON s.date = k.date WHERE s.prev > 0 AND k.prev > 0),
aligned AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS total FROM joined),
ev AS (SELECT o_orderkey AS event_id, c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS event_date
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 450000)
"""

TRANSFERS = """
transfers AS (SELECT l_orderkey AS deal_id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS date, o_custkey AS player_id, c_name AS player,
  c_nationkey AS from_id, s_nationkey AS to_id, CASE WHEN l_returnflag = 'R' THEN 'out' ELSE 'in' END AS direction,
  CAST(18 + p_size % 20 AS DOUBLE) AS age, p_retailprice * l_quantity AS market_value_eur,
  CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0.0 END AS transfer_fee_eur, l_tax * 100000000 AS wage_eur_annual,
  l_returnflag = 'A' AS is_loan, p_brand AS position
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
"""

CLAIMS = """
ek AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
claims AS (SELECT event_id AS claim_id, ts AS published_at, 'reporter ' || user_id AS journalist, 'outlet ' || (user_id % 12) AS source,
  'NATION_' || (k % 25) AS club, 'player ' || (k % 40) AS player,
  CASE event_type WHEN 'view' THEN 'linked' WHEN 'click' THEN 'talks' WHEN 'signup' THEN 'agreed' WHEN 'purchase' THEN 'official' ELSE 'unclear' END AS rumor_stage,
  CASE WHEN event_type IN ('view', 'click') THEN 'in' WHEN event_type = 'purchase' THEN 'out' ELSE 'unclear' END AS direction,
  value AS fee, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'direct' END AS prediction_scope,
  'Headline ' || (k % 7) || ' for player ' || (k % 40) || ' - outlet ' || (user_id % 12) AS title FROM ek)
"""

ARTICLES = """
articles AS (SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, coalesce(text, '') AS body, source, lang,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS published_at FROM documents)
"""

HEADLINES = """
headlines AS (SELECT o_orderkey AS article_id, replace(n_name, '_', ' ') AS club, 'Pat Surname' || c_custkey AS player, CAST(o_orderdate AS DATE) AS date,
  replace(n_name, '_', ' ') || ' ' || (['close on deal to sign', 'in talks with', 'interested in transfer of', 'confirm agreement to sign', 'bid for',
    'medical booked for', 'loan with option for', 'sell', 'match report about', 'set to join from', 'monitoring the exit of', 'deal agreed for'])[o_orderkey % 12 + 1]
    || ' Pat Surname' || c_custkey AS title,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Fee of €' || e || 'm, wage £' || e || 'k a week.' ELSE 'Worth $' || e || '.5m.' END AS snippet
  FROM (SELECT *, CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) AS VARCHAR) AS e FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

PREDICTIONS = """
p0 AS (SELECT doc_id AS case_id, (['negative', 'neutral', 'positive'])[doc_id % 3 + 1] AS actual_label,
  (doc_id * 37 % 100) / 250.0::DOUBLE + 0.1::DOUBLE AS prob_positive, (n_chars % 100) / 250.0::DOUBLE + 0.1::DOUBLE AS prob_negative,
  (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[doc_id % 5 + 1] AS club, 'player ' || (doc_id % 60) AS player,
  CAST(DATE '1996-01-01' + CAST(doc_id * 13 % 1800 AS INTEGER) AS DATE) AS signal_date,
  CAST(CAST(floor(1995 + (doc_id * 13 % 1800) / 365.0::DOUBLE) AS INTEGER) AS VARCHAR) || '-x' AS season,
  CASE doc_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'live' ELSE 'train' END AS split, (['in', 'out', 'unclear'])[n_chars % 3 + 1] AS direction,
  (['linked', 'talks', 'bid', 'advanced', 'agreed', 'medical', 'official'])[doc_id % 7 + 1] AS rumor_stage,
  CASE WHEN n_chars % 2 = 0 THEN 'buyer' ELSE 'seller' END AS target_role, (n_chars % 101) / 100.0::DOUBLE AS credibility_score,
  (doc_id % 89) / 88.0::DOUBLE AS transfer_indicator, (doc_id % 11) / 10.0::DOUBLE AS rumor_stage_score, (n_chars % 13) / 12.0::DOUBLE AS stock_context_indicator,
  (n_chars % 17) / 16.0::DOUBLE AS journalist_rep, (doc_id % 19) / 18.0::DOUBLE AS conversion, 18.0::DOUBLE + doc_id % 20 AS age, (n_chars % 500) * 200000.0::DOUBLE AS market_value_eur, source FROM documents),
p1 AS (SELECT *, 1 - prob_positive - prob_negative AS prob_neutral FROM p0),
predictions AS (SELECT *, greatest(prob_negative, prob_neutral, prob_positive) AS prediction_confidence,
  CASE WHEN prob_negative >= greatest(prob_neutral, prob_positive) THEN 'negative' WHEN prob_neutral >= prob_positive THEN 'neutral' ELSE 'positive' END AS predicted_label FROM p1)
"""
