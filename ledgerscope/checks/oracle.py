"""The result of each query in plain SQL, written apart from the DataFrame code."""

from __future__ import annotations

# --- the derived bank tables -----------------------------------------------------

TX = """
tx as (
  select o_orderdate as ts,
    lpad(cast(o_custkey % 26 as varchar), 3, '0') as from_bank,
    cast(o_custkey as varchar) as from_account,
    lpad(cast(l_suppkey % 26 as varchar), 3, '0') as to_bank,
    cast(l_suppkey as varchar) as to_account,
    l_extendedprice * l_discount / 100 as amount,
    case l_returnflag when 'A' then 'Euro' when 'R' then 'Yen' else 'US Dollar' end as currency,
    case o_orderpriority when '1-URGENT' then 'Wire' when '2-HIGH' then 'ACH'
      when '3-MEDIUM' then 'Cheque' when '4-NOT SPECIFIED' then 'Credit Card'
      else 'Bitcoin' end as payment_format
  from lineitem join orders on o_orderkey = l_orderkey),
usd as (select * from tx where lower(currency) = 'us dollar'),
period_1 as (select * from tx
  where ts between timestamp '1995-01-01 00:00:00' and timestamp '1995-01-31 23:59:00'),
period_2 as (select * from tx
  where ts between timestamp '1995-02-01 00:00:00' and timestamp '1996-12-31 23:59:00'),
usd_1 as (select * from period_1 where lower(currency) = 'us dollar'),
usd_2 as (select * from period_2 where lower(currency) = 'us dollar')"""

ACCOUNTS = """
accounts as (
  select case when n_regionkey = 0 and c_mktsegment = 'MACHINERY' then n_name || ' TRADE'
      else n_name end as bank_name,
    cast(c_nationkey as varchar) as bank_id, cast(c_custkey as varchar) as account_number,
    'E' || cast(c_custkey as varchar) as entity_id, c_name as entity_name
  from customer join nation on n_nationkey = c_nationkey)"""

RATES = """
rates as (
  select d as rate_date, iso, rate from (
    select d, 'EUR' as iso, 0.9E0 + extract(day from d) * 0.001E0 as rate
    from (select distinct cast(o_orderdate as date) as d from orders)
    union all
    select d, 'JPY', 140.0E0 + extract(day from d) * 0.125E0
    from (select distinct cast(o_orderdate as date) as d from orders))
  where isodow(d) < 6),
rates_1 as (select * from rates where rate_date between date '1995-01-01' and date '1995-01-31'),
iso as (select * from (values ('euro', 'EUR'), ('yen', 'JPY')) v(currency_name, code)),
conversion as (select * from period_1 where lower(payment_format) in ('wire', 'ach')),
priced as (
  select c.*, r.rate, c.amount * (1.0E0 / coalesce(r.rate, 1.0E0)) as converted
  from conversion c left join iso on lower(c.currency) = currency_name
    left join rates_1 r on r.iso = iso.code and r.rate_date = cast(c.ts as date)),
priced_all as (
  select c.*, r.rate, c.amount * (1.0E0 / coalesce(r.rate, 1.0E0)) as converted
  from tx c left join iso on lower(c.currency) = currency_name
    left join rates_1 r on r.iso = iso.code and r.rate_date = cast(c.ts as date))"""

GRAPH = """
e as (select distinct from_bank as fb, from_account as fa, to_bank as tb, to_account as ta
  from usd where ts between timestamp '1995-01-01 00:00:00' and timestamp '2001-12-31 23:59:00'),
outs as (select fb, fa, count(*) as n from e group by fb, fa),
ins as (select tb, ta, count(*) as n from e group by tb, ta),
scatter as (select e.* from e join outs on e.fb = outs.fb and e.fa = outs.fa where n >= 5),
gather as (select e.* from e join ins on e.tb = ins.tb and e.ta = ins.ta where n >= 5),
paths as (
  select x.fb as src_bank, x.fa as src_account, x.tb as mid_bank, x.ta as mid_account,
    y.tb as dst_bank, y.ta as dst_account
  from scatter x join gather y on x.tb = y.fb and x.ta = y.fa
  where not (x.fb = y.tb and x.fa = y.ta)),
counts as (select src_bank, src_account, dst_bank, dst_account, count(*) as mids
  from paths group by 1, 2, 3, 4),
unpruned as (
  select x.fb as from_bank, x.fa as from_account, y.tb as to_bank, y.ta as to_account,
    count(*) as mids
  from e x join e y on x.tb = y.fb and x.ta = y.fa
  where not (x.fb = y.tb and x.fa = y.ta) group by 1, 2, 3, 4),
pairs as (select * from unpruned where mids >= 5),
degrees as (
  select coalesce(fb, tb) as node_bank, coalesce(fa, ta) as node_account,
    coalesce(ins.n, 0) as in_degree, coalesce(outs.n, 0) as out_degree
  from outs full join ins on fb = tb and fa = ta)"""

EVENTS = """
ev as (
  select cast(event_id as varchar) as message_id,
    'client-' || cast(user_id % 3 as varchar) as client_id, ts,
    lpad(cast(user_id % 26 as varchar), 3, '0') as from_bank,
    cast(user_id as varchar) as from_account,
    lpad(cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 26 as varchar), 3, '0')
      as to_bank,
    cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as varchar) as to_account,
    value as amount,
    case when event_type = 'error' then 'Euro' else 'US Dollar' end as currency,
    event_type as payment_format
  from events),
ev_usd as (select * from ev where lower(currency) = 'us dollar'),
ev_1 as (select * from ev
  where ts between timestamp '2024-01-01 00:00:00' and timestamp '2024-01-15 23:59:00'),
ev_2 as (select * from ev_usd
  where ts between timestamp '2024-01-16 00:00:00' and timestamp '2024-01-31 23:59:00'),
ev_avg as (
  select lower(trim(payment_format)) as format_key, sum(amount) as total_amount,
    count(*) as tx_count, avg(amount) as average_amount
  from ev_1 where lower(currency) = 'us dollar' group by 1)"""


def _with(parts: list[str], body: str) -> str:
    return "with " + ",".join(parts) + "\n" + body.strip()


def _tx(body: str) -> str:
    return _with([TX], body)


def _graph(body: str) -> str:
    return _with([TX, GRAPH], body)


def _rates(body: str) -> str:
    return _with([TX, RATES], body)


def _events(body: str) -> str:
    return _with([EVENTS], body)


_RESULT_1 = "from_bank, from_account, to_bank, to_account, amount as amount_paid"

_NAMES = """
names as (select bank_id, min(bank_name) as bank_name from accounts group by bank_id)"""


def _ranked(rows: str, by: str = "") -> str:
    return f"""ranked as (
  select {by} cast(cast(from_bank as bigint) as varchar) as bank_id, from_account, amount,
    row_number() over (partition by {by} cast(from_bank as bigint)
      order by amount desc, from_account) as place from {rows})"""


def _bank_max(join: str) -> str:
    return _with(
        [TX, ACCOUNTS, _NAMES, _ranked("usd")],
        f"""select coalesce(bank_name, 'Unknown') as bank_name, from_account,
  amount as amount_paid
from ranked {join} join names on ranked.bank_id = names.bank_id where place = 1""",
    )


_Q1 = _tx(f"select {_RESULT_1} from usd where amount < 10")

_Q3 = _tx("""
, a as (select lower(trim(payment_format)) as pf, avg(amount) as av from usd_1 group by 1)
select from_bank, from_account, amount as amount_paid
from usd_2 join a on lower(trim(payment_format)) = pf
where av > 0 and amount < 0.01E0 * av""")

_PAIRS = _graph("select from_bank, from_account, to_bank, to_account from pairs")

_ACCOUNTS_4 = _graph("""
select from_bank as bank, from_account as account from pairs
union select to_bank, to_account from pairs""")

# Rounded as text is, and not by the bound that the operators compare with.
_LOW = "cast(printf('%.2f', converted) as double) < 1.0E0"

_LINE_1 = """from_bank || ',' || from_account || ',' || to_bank || ',' || to_account || ','
  || cast(amount as varchar)"""

_DAMAGED_REASON = (
    "case payment_format when 'Credit Card' then 'timestamp' when 'Cheque' then 'amount' end"
)

_SHARD = "c.h1 % 7"
for _word in ("h2", "h3", "h4"):
    _SHARD = f"(({_SHARD}) * 4294967296 + c.{_word}) % 7"

ORACLE: dict[str, str] = {
    # sources and sinks
    "scan_transactions": _tx("""
select strftime(ts, '%Y/%m/%d %H:%M') as timestamp, from_bank, from_account, to_bank, to_account,
  amount as amount_received, currency as receiving_currency,
  amount as amount_paid, currency as payment_currency, payment_format, '0' as is_laundering
from tx"""),
    "damaged_lines": _tx("""
select from_account,
  case cast(from_account as bigint) % 4 when 3 then to_account else '' end as to_account,
  case when cast(from_account as bigint) % 4 < 2 then 'fields' else '' end as reason,
  count(*) as tx_count
from tx group by all"""),
    "scan_accounts": _with([ACCOUNTS], "select * from accounts"),
    "scan_fx_rates": _rates("""
select * from rates
union all
select * from (values
  (date '2022-09-01', 'BTC', 1.0E0 / 19793.1E0),
  (date '2022-09-02', 'BTC', 1.0E0 / 199999.0E0),
  (date '2022-09-03', 'BTC', 1.0E0 / 19831.4E0),
  (date '2022-09-04', 'BTC', 1.0E0 / 19952.7E0),
  (date '2022-09-05', 'BTC', 1.0E0 / 20126.1E0)) btc(rate_date, iso, rate)"""),
    "stream_scan": _events("select * from ev"),
    "stream_scan_numbered": _tx("select * from tx"),
    "sink_query_csv": _tx(f"select {_LINE_1} as line from usd where amount < 10"),
    "sink_by_client": _with(
        [TX, ACCOUNTS, _NAMES, _ranked("usd", "payment_format,")],
        f"""
select {_LINE_1} as line, 'client-' || lower(payment_format) as client_id,
  cast(1 as integer) as query_id
from usd where amount < 10
union all
select coalesce(bank_name, 'Unknown') || ',' || from_account || ',' || cast(amount as varchar),
  'client-' || lower(payment_format), cast(2 as integer)
from ranked left join names on ranked.bank_id = names.bank_id where place = 1""",
    ),
    "verify_result_files": _tx("""
select 'client-' || lower(payment_format) as client_id, cast(1 as integer) as query_id,
  count(*) as missing, cast(0 as bigint) as surplus
from usd where amount >= 10 and amount < 20 group by 1"""),
    "verify_multiset": _tx(f"""
, a as (select {_RESULT_1}, count(*) as n from usd where amount < 10 group by all),
b as (select {_RESULT_1}, count(*) as n from usd where amount < 12 group by all)
select from_bank, from_account, to_bank, to_account, amount_paid,
  coalesce(a.n, 0) - coalesce(b.n, 0) as surplus
from a full join b using (from_bank, from_account, to_bank, to_account, amount_paid)
where coalesce(a.n, 0) <> coalesce(b.n, 0)"""),
    "verify_multiset_quick": _tx(f"""
select {_RESULT_1}, -count(*) as surplus from tx
where amount < 12 and lower(payment_format) = 'wire' group by all"""),
    # projections
    "tx_normalize": _tx("select * from tx"),
    "tx_normalize_valid": _tx(
        "select * from tx where payment_format not in ('Cheque', 'Credit Card')"
    ),
    "tx_rejected": _tx(f"""
select payment_format, from_bank, {_DAMAGED_REASON} as reject_reason, count(*) as tx_count
from tx where payment_format in ('Cheque', 'Credit Card') group by 1, 2, 3"""),
    "bank_catalog": _with([ACCOUNTS], "select bank_id, bank_name as name from accounts"),
    "tx_for_conversion": _rates("select ts, amount, currency from conversion"),
    "usd_amount": _rates("select cast(printf('%.2f', converted) as double) as amount from priced"),
    "project_results": _tx(
        "select from_bank, from_account, amount as amount_paid from usd"
    ),
    "route_usd_all": _tx("""
select *, 'all' as branch from tx
union all select *, 'usd' from usd
union all select *, 'usd_max' from usd"""),
    # filters
    "filter_usd": _tx("select * from usd"),
    "q1_low_usd": _Q1,
    "classify_period": _tx("""
select *, 'all.period1' as route from period_1
union all select *, 'usd.period1' from usd_1
union all select *, 'usd.period2' from usd_2"""),
    "filter_payment_format": _tx(
        "select * from tx where lower(payment_format) in ('wire', 'ach')"
    ),
    "filter_required": _tx("""
, gaps as (select ts, nullif(from_bank, '005') as from_bank, from_account,
    nullif(to_bank, '007') as to_bank, to_account, amount, currency,
    nullif(payment_format, 'Bitcoin') as payment_format from tx)
select *, 'low_usd' as step from gaps where from_bank is not null and to_bank is not null
union all select *, 'bank_max' from gaps where from_bank is not null
union all select *, 'format_average' from gaps where payment_format is not null
union all select *, 'anomaly' from gaps where payment_format is not null and from_bank is not null
union all select *, 'conversion' from gaps where payment_format is not null
union all select *, 'edges' from gaps where from_bank is not null and to_bank is not null"""),
    "anomaly_predicate": _tx("""
, a as (select lower(payment_format) as pf, avg(amount) as av from usd_1
  where payment_format <> 'Cheque' group by 1)
select lower(payment_format) as format_key,
  coalesce(av > 0 and amount < 0.01E0 * av, false) as anomalous, count(*) as tx_count
from usd left join a on lower(payment_format) = pf group by 1, 2"""),
    "low_amount_predicate": _rates("""
select currency, cast(printf('%.2f', converted) as double) < 1.0E0 as low, count(*) as tx_count
from priced_all group by 1, 2"""),
    "degree_threshold": _graph(
        "select * from degrees where in_degree >= 5 or out_degree >= 5"
    ),
    "path_endpoints_differ": _graph(
        "select mid_bank, mid_account, count(*) as paths from paths group by 1, 2"
    ),
    "path_threshold": _graph("select * from counts where mids >= 5"),
    "path_threshold_hubs": _graph("select * from counts where mids >= 5"),
    # joins
    "q2_bank_name_join": _bank_max("left"),
    "q2_bank_name_join_drop": _bank_max("inner"),
    "q3_anomaly_join": _Q3,
    "q3_anomaly_by_client": _tx("""
, a as (select lower(trim(payment_format)) as pf, avg(amount) as av from usd_1 group by 1)
select 'client-' || lower(payment_format) as client_id, from_bank, from_account,
  amount as amount_paid
from usd_2 join a on lower(trim(payment_format)) = pf
where av > 0 and amount < 0.01E0 * av"""),
    "fx_rate_join": _rates("select ts, currency, amount, rate, converted from priced"),
    "fx_unmatched_rates": _rates("""
select cast(ts as date) as rate_date, lower(currency) as currency_key, count(*) as tx_count
from priced where rate is null and lower(currency) in ('euro', 'yen') group by 1, 2"""),
    "two_hop_paths": _graph("select * from paths"),
    "frequent_edge_semijoin": _graph("""
select fb as src_bank, fa as src_account, tb as dst_bank, ta as dst_account,
  true as is_scatter from scatter
union all select fb, fa, tb, ta, false from gather"""),
    # aggregates
    "bank_max_partial": _with(
        [TX, _ranked("usd", "payment_format,")],
        "select payment_format, bank_id, from_account, amount from ranked where place = 1",
    ),
    "q2_bank_max": _with(
        [TX, _ranked("usd")], "select bank_id, from_account, amount from ranked where place = 1"
    ),
    "q2_bank_max_merged": _with(
        [TX, _ranked("usd")], "select bank_id, from_account, amount from ranked where place = 1"
    ),
    "q2_bank_max_window": _with(
        [TX, _ranked("usd")], "select bank_id, from_account, amount from ranked where place = 1"
    ),
    "format_sum_count": _tx("""
select lower(payment_format) as format_key, round(sum(amount), 4) as total_amount,
  count(*) as tx_count from usd_1 group by 1"""),
    # Whole numbers of 1/2**60 add up exactly, and a number read from text is the nearest double.
    "format_sum_exact": _tx("""
select *, total_amount / tx_count as average_amount from (
  select lower(payment_format) as format_key,
    cast(cast(sum(cast(amount * 1152921504606846976.0E0 as hugeint)) as varchar) as double) / 1152921504606846976.0E0
      as total_amount,
    count(*) as tx_count
  from usd_1 group by 1)"""),
    "q3_format_average": _tx("""
select lower(payment_format) as format_key, round(avg(amount), 6) as average_amount
from usd_1 group by 1"""),
    "low_amount_count": _rates("""
select payment_format, count(*) filter (where cast(printf('%.2f', converted) as double) < 1.0E0) as count
from priced_all group by 1"""),
    "q5_count": _rates("select count(*) as count from priced where cast(printf('%.2f', converted) as double) < 1.0E0"),
    "q5_count_by_client": _rates("""
select 'client-' || lower(t.payment_format) as client_id, coalesce(n, 0) as count
from (select distinct payment_format from tx) t left join (
  select payment_format, count(*) as n from priced where cast(printf('%.2f', converted) as double) < 1.0E0 group by 1) p
on p.payment_format = t.payment_format"""),
    "account_degrees": _graph("select * from degrees"),
    "path_mid_count": _graph("select * from counts"),
    # sets
    "bidirectional_edges": _tx("""
select from_bank as node_bank, from_account as node_account, to_bank as other_bank,
  to_account as other_account, true as is_sender from usd
union all select to_bank, to_account, from_bank, from_account, false from usd"""),
    "distinct_edges": _graph(
        "select fb as src_bank, fa as src_account, tb as dst_bank, ta as dst_account from e"
    ),
    "path_endpoints": _graph("""
select from_bank as bank, from_account as account from pairs
union all select to_bank, to_account from pairs"""),
    "distinct_accounts": _graph("""
select fb as bank, fa as account from e union select tb, ta from e"""),
    "bank_name_conflicts": _with([ACCOUNTS], """
select bank_id, count(distinct bank_name) as names, min(bank_name) as bank_name
from accounts group by bank_id having count(distinct bank_name) > 1"""),
    # scatter-gather
    "q4_scatter_gather": _ACCOUNTS_4,
    "q4_scatter_gather_hubs": _ACCOUNTS_4,
    "q4_pairs": _PAIRS,
    "q4_pairs_no_prune": _PAIRS,
    "q4_pairs_hubs": _PAIRS,
    "q4_by_client": _tx("""
, e as (select distinct 'client-' || lower(payment_format) as client_id, from_bank as fb,
    from_account as fa, to_bank as tb, to_account as ta
  from usd where ts between timestamp '1995-01-01 00:00:00' and timestamp '2001-12-31 23:59:00'),
p as (select x.client_id, x.fb, x.fa, y.tb, y.ta from e x join e y
  on x.client_id = y.client_id and x.tb = y.fb and x.ta = y.fa
  where not (x.fb = y.tb and x.fa = y.ta) group by 1, 2, 3, 4, 5 having count(*) >= 3)
select client_id, fb as bank, fa as account from p
union select client_id, tb, ta from p"""),
    # scalar functions
    "normalize_bank_id": _tx("""
select from_bank, ltrim(substr(from_bank, 1, 2), '0') || substr(from_bank, 3) as bank_id,
  count(*) as tx_count from tx group by 1, 2"""),
    "format_key": """
select lower(o_orderpriority) as format_key, count(*) as tx_count from orders group by 1""",
    "parse_ts": "select o_orderkey, date_trunc('minute', o_orderdate) as ts from orders",
    "rate_date": "select event_id, cast(ts as date) as rate_date from events",
    "currency_iso": _tx("""
select currency, case currency when 'Euro' then 'EUR' when 'Yen' then 'JPY' end as iso,
  count(*) as tx_count from tx group by 1, 2"""),
    "convert_usd": """
select l_orderkey, l_linenumber, l_extendedprice,
  cast(printf('%.2f', l_extendedprice
    * (1.0E0 / coalesce(nullif(l_discount, 0) * 140.0E0, 1.0E0))) as double) as usd
from lineitem""",
    "stable_shard": f"""
select c_custkey, {_SHARD} as shard from (
  select c_custkey,
    cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from (select c_custkey, md5(cast(c_custkey as varchar)) as h from customer)) c""",
    "float_parse": "select o_orderkey, o_totalprice as amount from orders",
    "float_text": "select o_orderkey, cast(o_totalprice as varchar) as amount_text from orders",
    # ledger
    "ledger_q1": _Q1,
    "ledger_q2": _bank_max("left"),
    "ledger_q3": _Q3,
    "ledger_q4": _ACCOUNTS_4,
    "ledger_q5": _rates(f"select count(*) as count from priced where {_LOW}"),
    "summary_q2": _bank_max("left"),
    "summary_q3": _Q3,
    "summary_q5": _rates(f"select count(*) as count from priced where {_LOW}"),
    # streaming
    "stream_q1": _events(f"select {_RESULT_1} from ev_usd where amount < 10").replace(
        f"select {_RESULT_1}", f"select client_id, {_RESULT_1}"
    ),
    "stream_dedup": _events("select * from ev"),
    "stream_dedup_watermark": _events("select * from ev"),
    "stream_dedup_evicting": _events("select * from ev"),
    "stream_bank_max": _with(
        [EVENTS, _ranked("ev_usd")],
        "select bank_id, from_account, amount from ranked where place = 1",
    ),
    "stream_format_avg": _events("""
select format_key, round(total_amount, 4) as total_amount, tx_count,
  round(average_amount, 6) as average_amount from ev_avg"""),
    "stream_low_count": _events("""
, ev_priced as (select *, amount * (1.0E0 /
    case when currency = 'Euro' then 0.5E0 + extract(day from ts) * 0.125E0 else 1.0E0 end) as converted
  from ev_1 where lower(payment_format) in ('error', 'signup'))
select count(*) as count from ev_priced where """ + _LOW),
    "stream_low_count_by_client": _events("""
, ev_priced as (select *, amount * (1.0E0 /
    case when currency = 'Euro' then 0.5E0 + extract(day from ts) * 0.125E0 else 1.0E0 end) as converted
  from ev_1 where lower(payment_format) in ('error', 'signup')),
low as (select client_id, count(*) as n from ev_priced where """ + _LOW + """ group by 1)
select c.client_id, coalesce(n, 0) as count
from (select distinct client_id from ev) c left join low using (client_id)"""),
    "stream_side_input": _events("""
, by_client as (select client_id as client, lower(trim(payment_format)) as format_key,
    avg(amount) as average_amount
  from ev_1 where lower(currency) = 'us dollar' group by 1, 2)
select client_id, from_bank, from_account, amount as amount_paid
from ev_2 join by_client on lower(trim(payment_format)) = format_key and client_id = client
where average_amount > 0 and amount < 0.01E0 * average_amount"""),
    "stream_side_input_held": _events("""
, by_client as (select client_id as client, lower(trim(payment_format)) as format_key,
    avg(amount) as average_amount
  from ev_1 where lower(currency) = 'us dollar' group by 1, 2)
select client_id, from_bank, from_account, amount as amount_paid
from ev_2 join by_client on lower(trim(payment_format)) = format_key and client_id = client
where average_amount > 0 and amount < 0.01E0 * average_amount and client_id <> 'client-2'"""),
    "stream_edges": _events("""
, e as (select distinct client_id as c, from_bank as fb, from_account as fa, to_bank as tb,
    to_account as ta from ev_usd),
p as (select x.c, x.fb, x.fa, y.tb, y.ta
  from e x join e y on x.c = y.c and x.tb = y.fb and x.ta = y.fa
  where not (x.fb = y.tb and x.fa = y.ta) group by all having count(*) >= 5)
select c as client_id, fb as bank, fa as account from p union select c, tb, ta from p"""),
    "stream_by_client": _with(
        [EVENTS, _ranked("ev_usd", "client_id,")],
        "select client_id, bank_id, from_account, amount from ranked where place = 1",
    ),
}


def _lines(query: str, line: str, number: int) -> str:
    return (
        f"select {line} as line, client_id, cast({number} as integer) as query_id "
        f"from ({ORACLE[query]})"
    )


ORACLE["stream_edges_growing"] = ORACLE["stream_edges"]

# The first two results are there already; the other three are lines of queries above.
ORACLE["sink_by_client"] = " union all ".join(
    [
        f"select * from ({ORACLE['sink_by_client']})",
        _lines(
            "q3_anomaly_by_client",
            "from_bank || ',' || from_account || ',' || cast(amount_paid as varchar)",
            3,
        ),
        _lines("q4_by_client", "bank || ',' || account", 4),
        _lines("q5_count_by_client", "cast(count as varchar)", 5),
    ]
)

ORACLE["summary_q5_by_client"] = ORACLE["q5_count_by_client"]
