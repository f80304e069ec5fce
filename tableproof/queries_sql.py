"""DuckDB SQL that gives the rows of queries.py."""

from __future__ import annotations

from tableproof.plans.fixtures import WIDE

NULLS = "('', 'na', 'n/a', 'null', 'none', '-', '--', 'nan')"
CENTS = "CAST(CAST({} AS DECIMAL(12,2)) AS VARCHAR)"
K = "o_orderkey"
DIRTY_ORDERS = f"""dirty_orders AS (SELECT {K} AS row_index,
  CASE {K} % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d %b %Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'N/A' END AS order_date,
  strftime(o_orderdate, '%m/%d/%Y') AS us_date,
  CASE {K} % 6 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN concat('  ', replace(o_orderpriority, ' ', '   ')) ELSE o_orderpriority END AS priority,
  replace({CENTS.format('o_totalprice')}, '.', ',') AS price,
  CASE WHEN {K} % 11 = 0 THEN '--' WHEN {K} % 13 = 0 THEN ' null ' ELSE o_orderstatus END AS status,
  lpad(CAST({K} AS VARCHAR), 8, '0') AS code FROM orders)"""
ORDER_COLUMNS = ["order_date", "us_date", "priority", "price", "status", "code"]
EXTRA = f"""orders_extra AS (SELECT {K} AS row_index, CAST(date_diff('day', date '1899-12-30', o_orderdate::date) AS VARCHAR) AS excel_serial,
  {CENTS.format('o_totalprice - 100000')} AS amount, concat(CAST({K} AS VARCHAR), '.234') AS thousandish,
  concat('$', CAST({K} % 9 + 1 AS VARCHAR), ',', lpad(CAST({K} % 1000 AS VARCHAR), 3, '0'), '.50') AS dollars,
  concat(CAST({K} % 9 + 1 AS VARCHAR), '.', lpad(CAST({K} % 1000 AS VARCHAR), 3, '0'), ',5') AS euros,
  CASE WHEN {K} % 2 = 0 THEN '1,5' ELSE '1.5' END AS mixed FROM orders)"""
EXTRA_COLUMNS = ["excel_serial", "amount", "thousandish", "dollars", "euros", "mixed"]
DIRTY_EVENTS = f"""dirty_events AS (SELECT event_id AS row_index, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS epoch_s,
  CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN concat(event_type, '  ') ELSE event_type END AS event_type,
  CASE WHEN event_id % 3 = 0 THEN {CENTS.format('value')} ELSE 'n/a' END AS sparse_value,
  CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag FROM events)"""
EVENT_COLUMNS = ["epoch_s", "event_type", "sparse_value", "flag"]
DIRTY_CUSTOMER = """dirty_customer AS (SELECT c_custkey AS row_index, c_name AS name,
  CASE WHEN c_custkey % 20 = 0 THEN concat('user', CAST(c_custkey AS VARCHAR), '-at-example.com') ELSE concat('user', CAST(c_custkey AS VARCHAR), '@example.com') END AS email,
  c_mktsegment AS segment, c_mktsegment AS segment_copy FROM customer)"""
DIRTY_PART = """dirty_part AS (SELECT p_partkey AS row_index,
  CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, '!') WHEN 2 THEN replace(p_name, ' ', '-') ELSE p_name END AS name,
  p_brand AS brand, CASE WHEN p_partkey % 5 = 0 THEN '--' ELSE p_type END AS ptype FROM part)"""
LINEITEM = f"""text_lineitem AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, extended, returnflag, shipdate) - 1 AS row_index, quantity, extended, returnflag, shipdate
  FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity, {CENTS.format('l_extendedprice')} AS extended, l_returnflag AS returnflag, strftime(l_shipdate, '%Y-%m-%d') AS shipdate FROM lineitem))"""
LINE_COLUMNS = ["quantity", "extended", "returnflag", "shipdate"]

MISSING = f"(raw IS NULL OR lower(trim(raw)) IN {NULLS})"


def long(view: str, columns: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT row_index, '{c}' AS col_name, {c} AS raw FROM {view}" for c in columns)
    return f"cells AS ({rows})"


def profile(cte: str, view: str, columns: list[str], tail: str, cap: int = 50_000) -> str:
    """The cascade over one view; tail selects from prof."""
    plain = r"replace(replace(replace(replace(replace(replace(replace(token, '$', ''), '€', ''), '£', ''), '¥', ''), chr(160), ''), ' ', ''), chr(9), '')"
    lit = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
    rate = lambda e: f"sum(CASE WHEN inn AND regexp_matches({e}, '{lit}') THEN 1 ELSE 0 END)"
    clock = r"\d{1,2}:\d{2}(?::\d{2})?"
    dateish = rf"^(?:\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}(?:[ T]{clock})?|\d{{1,2}}[\s-]+[A-Za-zÀ-ÿ]{{3,}}\.?\s+\d{{2,4}}(?:[\s,]+{clock})?|[A-Za-zÀ-ÿ]{{3,}}\.?\s+\d{{1,2}},?\s+\d{{2,4}}(?:[\s,]+{clock})?)$"
    hit = lambda test: f"sum(CASE WHEN inn AND {test} THEN 1 ELSE 0 END)"
    some = lambda test: f"coalesce(bool_or(inn AND {test}), false)"
    return rf"""
WITH {cte}, {long(view, columns)},
t AS (SELECT *, {MISSING} AS miss, CASE WHEN NOT {MISSING} THEN trim(raw) END AS token FROM cells),
r AS (SELECT *, sum(CASE WHEN miss THEN 0 ELSE 1 END) OVER (PARTITION BY col_name ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS nth FROM t),
s AS (SELECT *, NOT miss AND nth <= {cap} AS inn, {plain} AS bare FROM r),
a AS (SELECT col_name, count(*) AS total, sum(miss::INT) AS missing, count(DISTINCT token) AS n_distinct, sum((NOT miss)::INT) AS present, sum(inn::INT) AS n,
  {hit("lower(token) IN ('true','false','yes','no','y','n','oui','non','vrai','faux')")} AS bools, {hit(r"regexp_matches(token, '^[+-]?\d+$')")} AS ints,
  {some(r"regexp_matches(token, '^[+-]?0\d+$')")} AS lead0, {some("regexp_matches(token, '[.,]')")} AS seps, {some("contains(token, '.')")} AS dots, {some("contains(token, ',')")} AS commas,
  {some(r"regexp_matches(token, '\.\d{1,2}$')")} AS ddot, {some(r"regexp_matches(token, ',\d{1,2}$')")} AS dcomma, {some("bare <> token")} AS stripped,
  {hit(r"regexp_matches(bare, '^[+-]?\d{1,3}(?:[ .,]\d{3})*(?:[.,]\d+)?$')")} AS loose, {hit(f"regexp_matches(token, '{dateish}')")} AS datish,
  {rate("bare")} AS f0, {rate("bare")} AS f1, {rate("replace(bare, ',', '')")} AS f2, {rate("replace(bare, ',', '.')")} AS f3, {rate("replace(replace(bare, '.', ''), ',', '.')")} AS f4
  FROM s GROUP BY col_name),
b AS (SELECT *, (ddot AND dcomma) OR (seps AND NOT ddot AND NOT dcomma) AS amb FROM a),
c AS (SELECT *, CASE WHEN NOT amb AND ddot THEN '.' WHEN NOT amb AND dcomma THEN ',' END AS dec0 FROM b),
e AS (SELECT *, CASE WHEN dec0 = '.' AND commas THEN ',' WHEN dec0 = ',' AND dots THEN '.' END AS tho0 FROM c),
g AS (SELECT *, CASE WHEN dec0 IS NULL THEN f0 WHEN dec0 = '.' AND tho0 IS NULL THEN f1 WHEN dec0 = '.' THEN f2 WHEN tho0 IS NULL THEN f3 ELSE f4 END / n AS rate FROM e),
h AS (SELECT *, CASE WHEN n = 0 THEN 'none' WHEN bools / n >= 0.95 THEN 'bool' WHEN ints / n >= 0.95 AND lead0 THEN 'lead' WHEN ints / n >= 0.95 THEN 'int64' WHEN amb THEN 'amb'
  WHEN rate >= 0.95 THEN 'float64' WHEN datish / n >= 0.95 THEN 'datetime' WHEN n_distinct <= 50 AND n_distinct / n <= 0.5 THEN 'category' ELSE 'string' END AS kind FROM g),
prof AS (SELECT col_name, CASE WHEN kind IN ('none', 'lead', 'amb') THEN 'string' ELSE kind END AS dtype,
  CAST(CASE kind WHEN 'none' THEN 0 WHEN 'bool' THEN bools / n WHEN 'lead' THEN ints / n WHEN 'int64' THEN ints / n WHEN 'amb' THEN loose / n WHEN 'float64' THEN rate WHEN 'datetime' THEN datish / n ELSE 1 END AS DOUBLE) AS confidence,
  missing / total AS null_like_rate, n_distinct,
  concat_ws(',', CASE WHEN present > n THEN 'sampled' END, CASE kind WHEN 'none' THEN 'all_null' WHEN 'lead' THEN 'leading_zeros_kept_as_string' WHEN 'amb' THEN 'numeric_locale_ambiguous' WHEN 'float64' THEN CASE WHEN stripped THEN 'currency_or_spaces_stripped' END WHEN 'category' THEN 'low_cardinality' END) AS flags,
  CASE WHEN kind = 'float64' THEN tho0 END AS thousands, CASE WHEN kind = 'float64' THEN dec0 END AS decimal, bools, ints, n FROM h)
{tail}"""


FIELDS = "col_name, dtype, confidence, null_like_rate, n_distinct, flags, thousands, decimal"

MONTH_LIST = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
#: iso of the orders' date forms: the slashed ones by the vote of their column.
ISO = rf"""CASE WHEN regexp_full_match(token, '\d{{4}}-\d{{2}}-\d{{2}}') THEN token
  WHEN regexp_full_match(token, '\d{{4}}/\d{{2}}/\d{{2}}') THEN replace(token, '/', '-')
  WHEN regexp_full_match(token, '\d{{1,2}} [A-Za-z]{{3}} \d{{4}}') THEN concat(split_part(token, ' ', 3), '-', lpad(CAST(list_position({MONTH_LIST}, lower(split_part(token, ' ', 2))) AS VARCHAR), 2, '0'), '-', lpad(split_part(token, ' ', 1), 2, '0'))
  WHEN regexp_full_match(token, '\d{{2}}/\d{{2}}/\d{{4}}') AND vote = 'DMY' AND CAST(split_part(token, '/', 2) AS INT) <= 12 THEN concat(split_part(token, '/', 3), '-', split_part(token, '/', 2), '-', split_part(token, '/', 1))
  WHEN regexp_full_match(token, '\d{{2}}/\d{{2}}/\d{{4}}') AND vote = 'MDY' AND CAST(split_part(token, '/', 1) AS INT) <= 12 THEN concat(split_part(token, '/', 3), '-', split_part(token, '/', 1), '-', split_part(token, '/', 2)) END"""
VOTE = r"""present AS (SELECT row_index, col_name, trim(raw) AS token FROM cells WHERE NOT """ + MISSING + r"""),
slashed AS (SELECT col_name, CAST(split_part(token, '/', 1) AS INT) AS x, CAST(split_part(token, '/', 2) AS INT) AS y FROM present WHERE regexp_full_match(token, '\d{2}/\d{2}/\d{4}')),
votes AS (SELECT col_name, CASE WHEN bool_or(x > 12) THEN 'DMY' WHEN bool_or(y > 12) THEN 'MDY' END AS vote FROM slashed GROUP BY col_name)"""
PARSED = VOTE + f""",
parsed AS (SELECT p.*, vote, {ISO} AS iso, regexp_full_match(token, '\\d{{2}}/\\d{{2}}/\\d{{4}}') AS slash FROM present p LEFT JOIN votes USING (col_name)),
state AS (SELECT *, CASE WHEN iso IS NOT NULL THEN 'resolved' WHEN slash AND vote IS NULL THEN 'ambiguous' ELSE 'failed' END AS st FROM parsed),
tally AS (SELECT col_name, count(*) AS present, count(*) FILTER (st = 'resolved') AS resolved, count(*) FILTER (st = 'ambiguous') AS ambiguous, count(*) FILTER (st = 'failed') AS failed FROM state GROUP BY col_name)"""
WORSE = "worse_orders AS (SELECT *, CASE WHEN row_index % 10 = 0 THEN 'not a date' ELSE us_date END AS worse FROM dirty_orders)"
LOW = "low_days AS (SELECT o_orderkey AS row_index, strftime(o_orderdate, '%d/%m/%Y') AS low_date FROM orders WHERE day(o_orderdate) <= 12)"


def changes(kind: str, row: str, column: str, before: str, after: str, rule: str, confidence: str, source: str) -> str:
    return f"SELECT {kind} AS kind, {column} AS col_name, {row} AS row_index, {before} AS old_value, {after} AS new_value, {rule} AS rule, CAST({confidence} AS DOUBLE) AS confidence FROM {source}"


DATE_CHANGES = changes("'date_norm'", "row_index", "col_name", "token", "iso", "'date:iso'", "1", "parsed WHERE iso <> token")
SURFACE = r"trim(regexp_replace(raw, '\s+', ' ', 'g'))"


def surface_changes(form: str) -> str:
    return f"WITH {DIRTY_ORDERS}, {long('dirty_orders', ['priority'])}, shown AS (SELECT *, {form.format(SURFACE)} AS surf FROM cells WHERE NOT {MISSING}) " + changes("'text_norm'", "row_index", "col_name", "raw", "surf", "'text:surface'", "1", "shown WHERE surf <> raw")


TITLE = "list_aggregate(list_transform(regexp_extract_all({}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '')"
SHOWN = f"shown AS (SELECT *, {SURFACE} AS surface FROM cells WHERE NOT {MISSING})"
FREQ = "freq AS (SELECT col_name, surface, count(*) AS n, min(row_index) AS first_row, row_number() OVER (PARTITION BY col_name ORDER BY surface) AS pos FROM shown GROUP BY col_name, surface)"


def ratio(pairs: str, out: str, a: str = "l", b: str = "r") -> str:
    """CTEs that give out: the rows of pairs with sim, the token-set similarity of their texts a and b."""
    return rf"""
{out}_0 AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array({a}, '[\s\x1f]+'), lambda w: w <> ''))) AS wa, list_sort(list_distinct(list_filter(regexp_split_to_array({b}, '[\s\x1f]+'), lambda w: w <> ''))) AS wb FROM {pairs}),
{out}_1 AS (SELECT *, array_to_string(list_filter(wa, lambda w: list_contains(wb, w)), ' ') AS common, array_to_string(list_filter(wa, lambda w: NOT list_contains(wb, w)), ' ') AS x, array_to_string(list_filter(wb, lambda w: NOT list_contains(wa, w)), ' ') AS y FROM {out}_0),
{out}_2 AS (SELECT *, length(common) AS s, length(x) AS p, length(y) AS q,
  CASE WHEN x = '' OR y = '' THEN 0 ELSE list_last(list_reduce(list_transform(range(1, length(x) + 1), lambda i: [i]),
    lambda prev, i: list_reduce(list_transform(range(1, length(y) + 1), lambda j: [j]), lambda cur, j: list_append(cur, CASE WHEN substr(x, i[1], 1) = substr(y, j[1], 1) THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[len(cur)]) END), [0]),
    list_transform(range(0, length(y) + 1), lambda z: 0))) END AS lcs FROM {out}_1),
{out} AS (SELECT *, CAST(CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 WHEN s > 0 AND (p = 0 OR q = 0) THEN 100
  WHEN s = 0 THEN 100 - 100.0::DOUBLE * (p + q - 2 * lcs) / (p + q)
  ELSE greatest(100 - 100.0::DOUBLE * (p + q - 2 * lcs) / (2 * s + 2 + p + q), 100 - 100.0::DOUBLE * (1 + p) / (2 * s + 1 + p), 100 - 100.0::DOUBLE * (1 + q) / (2 * s + 1 + q)) END AS DOUBLE) AS sim FROM {out}_2)"""


VALUE_PAIRS = "pairs AS (SELECT a.col_name, a.pos AS a, b.pos AS b, lower(a.surface) AS l, lower(b.surface) AS r, a.surface AS left_value, b.surface AS right_value FROM freq a JOIN freq b ON a.col_name = b.col_name AND a.pos < b.pos)"
CLUSTER = (
    FREQ + ", " + VALUE_PAIRS + "," + ratio("pairs", "scored") + r""",
edge AS (SELECT col_name, a, b FROM scored WHERE sim >= 90 UNION ALL SELECT col_name, b, a FROM scored WHERE sim >= 90),
reach(col_name, node, top) AS (SELECT col_name, pos, pos FROM freq UNION SELECT r.col_name, e.b, r.top FROM reach r JOIN edge e ON e.col_name = r.col_name AND e.a = r.node),
clus AS (SELECT col_name, node AS pos, min(top) AS cluster FROM reach GROUP BY col_name, node),
member AS (SELECT f.*, cluster FROM freq f JOIN clus USING (col_name, pos)),
win AS (SELECT col_name, cluster, arg_max(surface, n * 1000000000 - first_row) AS winner, count(*) AS members FROM member GROUP BY col_name, cluster),
canon AS (SELECT m.*, winner, members FROM member m JOIN win USING (col_name, cluster))"""
)
BRANDS = f"{DIRTY_PART}, {long('dirty_part', ['brand'])}, {SHOWN}, "

KEY = lambda c: f"CASE WHEN lower(trim({c})) IN {NULLS} THEN '' ELSE trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) END"
FULL = " + ".join(f"(lower(trim({c})) NOT IN {NULLS})::INT" for c in ("name", "brand", "ptype"))
KEYED = f"{DIRTY_PART}, keyed AS (SELECT row_index, {KEY('name')} AS k, {FULL} AS completeness FROM dirty_part), sigged AS (SELECT *, left(k, 1) AS sig FROM keyed), ranked AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY row_index) AS nth, count(*) OVER (PARTITION BY sig) AS blk, min(row_index) OVER (PARTITION BY sig) AS block_first FROM sigged), cmp AS (SELECT * FROM ranked WHERE nth <= 1500 AND blk > 1), kid AS (SELECT sig, k, min(row_index) AS kid FROM cmp GROUP BY sig, k)"
EDGES = KEYED + ", kp AS (SELECT a.sig, a.kid AS a, b.kid AS b, a.k AS l, b.k AS r FROM kid a JOIN kid b ON a.sig = b.sig AND a.kid < b.kid)," + ratio("kp", "ks")
GROUPS = (
    EDGES
    + r""",
edge AS (SELECT sig, a, b FROM ks WHERE sim >= 70 UNION ALL SELECT sig, b, a FROM ks WHERE sim >= 70),
reach(sig, node, top) AS (SELECT sig, kid, kid FROM kid UNION SELECT r.sig, e.b, r.top FROM reach r JOIN edge e ON e.sig = r.sig AND e.a = r.node),
root AS (SELECT sig, node AS kid, min(top) AS root FROM reach GROUP BY sig, node),
placed AS (SELECT c.*, root FROM cmp c JOIN kid USING (sig, k) JOIN root ON root.sig = c.sig AND root.kid = kid.kid WHERE k <> ''),
sizes AS (SELECT sig, root, count(*) AS size, min(row_index) AS gf, min(block_first) AS bf FROM placed GROUP BY sig, root HAVING count(*) > 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY bf, gf) - 1 AS gid FROM sizes),
grp AS (SELECT p.*, gid FROM placed p JOIN numbered USING (sig, root)),
best AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY completeness DESC, row_index) AS rk, first_value(k) OVER (PARTITION BY gid ORDER BY completeness DESC, row_index) AS wk FROM grp),
lost AS (SELECT row_index, k, gid, wk FROM best WHERE rk > 1)"""
)
#: distinct pairs of keys are compared once
LOSERS = GROUPS + ", lp AS (SELECT DISTINCT k AS l, wk AS r FROM lost)," + ratio("lp", "ls")
CLEANING = f"{DIRTY_ORDERS}, {long('dirty_orders', ['order_date'])}, {PARSED}, moved AS ({DATE_CHANGES}), allc AS ({' UNION ALL '.join(f"SELECT row_index, '{c}' AS col_name, {c} AS raw FROM dirty_orders" for c in ORDER_COLUMNS)}), fixed AS (SELECT 'coherence_fix' AS kind, col_name, row_index, raw AS old_value, '' AS new_value, 'null:unify' AS rule, 1.0::DOUBLE AS confidence FROM allc WHERE {MISSING} AND trim(raw) <> '' AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.col_name = allc.col_name AND m.row_index = allc.row_index)), led AS (SELECT * FROM moved UNION ALL SELECT * FROM fixed), dec AS (SELECT *, CASE row_index % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM led)"
REC = "WITH RECURSIVE "

ORACLES: dict[str, str] = {
    "null_like_tokens": f"WITH {DIRTY_ORDERS}, {long('dirty_orders', ORDER_COLUMNS)} SELECT row_index, col_name, raw FROM cells WHERE {MISSING}",
    "profile_null_rate": profile(DIRTY_ORDERS, "dirty_orders", ORDER_COLUMNS, "SELECT col_name, null_like_rate FROM prof"),
    "profile_distinct": profile(DIRTY_ORDERS, "dirty_orders", ORDER_COLUMNS, "SELECT col_name, n_distinct FROM prof"),
    "profile_orders": profile(DIRTY_ORDERS, "dirty_orders", ORDER_COLUMNS, f"SELECT {FIELDS} FROM prof"),
    "profile_events": profile(DIRTY_EVENTS, "dirty_events", EVENT_COLUMNS, f"SELECT {FIELDS} FROM prof"),
    "infer_bool_int_shares": f"SELECT * FROM ({profile(DIRTY_ORDERS, 'dirty_orders', ORDER_COLUMNS, 'SELECT col_name, CAST(n AS BIGINT) AS sampled, CAST(bools AS BIGINT) AS bools, CAST(ints AS BIGINT) AS ints FROM prof')}) UNION ALL SELECT * FROM ({profile(DIRTY_EVENTS, 'dirty_events', EVENT_COLUMNS, 'SELECT col_name, CAST(n AS BIGINT) AS sampled, CAST(bools AS BIGINT) AS bools, CAST(ints AS BIGINT) AS ints FROM prof')})",
    "leading_zero_guard": profile(DIRTY_ORDERS, "dirty_orders", ["code"], "SELECT col_name, dtype, flags, confidence FROM prof"),
    "locale_vote": profile(EXTRA, "orders_extra", EXTRA_COLUMNS, f"SELECT {FIELDS} FROM prof"),
    "first_samples": f"WITH {DIRTY_ORDERS}, {long('dirty_orders', ORDER_COLUMNS)}, f AS (SELECT col_name, trim(raw) AS token, min(row_index) AS fr FROM cells WHERE NOT {MISSING} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY fr) AS rank FROM f) SELECT col_name, rank, token FROM r WHERE rank <= 5",
    "sample_cap_profile": profile(LINEITEM, "text_lineitem", LINE_COLUMNS, f"SELECT {FIELDS} FROM prof"),
    "type_cast_proposals": profile(DIRTY_ORDERS, "dirty_orders", ORDER_COLUMNS, changes("'type_cast'", "CAST(NULL AS BIGINT)", "col_name", "'string'", "dtype", "concat('cast:', dtype)", "confidence", "prof WHERE dtype IN ('bool','int64','float64','category')")),
    "type_override": profile(DIRTY_ORDERS, "dirty_orders", ORDER_COLUMNS, changes("'type_cast'", "CAST(NULL AS BIGINT)", "col_name", "'string'", "dtype", "concat('cast:', dtype)", "confidence", "(SELECT col_name, dtype, confidence FROM prof WHERE col_name <> 'code' UNION ALL SELECT 'code', 'int64', 1.0) WHERE dtype IN ('bool','int64','float64','category')")),
    "date_iso_parse": f"WITH {DIRTY_ORDERS} SELECT row_index, order_date AS raw, replace(order_date, '/', '-') AS iso FROM dirty_orders WHERE regexp_matches(order_date, '^[0-9]{{4}}[-/]')",
    "date_month_name": f"WITH {DIRTY_ORDERS} SELECT row_index, order_date AS raw, strftime(strptime(order_date, '%-d %b %Y'), '%Y-%m-%d') AS iso FROM dirty_orders WHERE regexp_matches(order_date, '[A-Za-z]{{3}} [0-9]')",
    "date_vote": f"WITH {DIRTY_ORDERS}, {long('dirty_orders', ['order_date', 'us_date'])}, {VOTE} SELECT col_name, vote FROM votes",
    "date_norm_changes": f"WITH {DIRTY_ORDERS}, {long('dirty_orders', ['order_date', 'us_date'])}, {PARSED} {DATE_CHANGES}",
    "date_ambiguous": f"WITH {LOW}, {long('low_days', ['low_date'])}, {PARSED} SELECT * FROM tally",
    "date_export_gate": f"WITH {DIRTY_ORDERS}, {WORSE}, {LOW}, cells AS (SELECT row_index, 'order_date' AS col_name, order_date AS raw FROM worse_orders UNION ALL SELECT row_index, 'us_date', us_date FROM worse_orders UNION ALL SELECT row_index, 'worse', worse FROM worse_orders UNION ALL SELECT row_index, 'low_date', low_date FROM low_days), {PARSED} SELECT col_name, (resolved > 0 AND failed / present > 0.05) OR ambiguous > 0 AS blocked FROM tally",
    "date_warnings": f"WITH {DIRTY_ORDERS}, {WORSE}, {long('worse_orders', ['order_date', 'worse', 'priority'])}, {PARSED} SELECT 'warn_date_unparsed' AS key, col_name, failed AS n FROM tally WHERE failed > 0 UNION ALL SELECT 'warn_date_ambiguous', col_name, ambiguous FROM tally WHERE ambiguous > 0 UNION ALL SELECT 'warn_date_none', col_name, 0 FROM tally WHERE resolved = 0 AND ambiguous = 0 AND present > 0",
    "date_epoch": f"WITH {DIRTY_EVENTS}, e AS (SELECT row_index, epoch_s AS raw, make_timestamp(CAST(epoch_s AS BIGINT) * 1000000) AS t FROM dirty_events) SELECT row_index, raw, CASE WHEN t = date_trunc('day', t) THEN strftime(t, '%Y-%m-%d') ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS iso FROM e",
    "date_excel": f"WITH {EXTRA} SELECT row_index, excel_serial AS raw, strftime(date '1899-12-30' + CAST(excel_serial AS INT), '%Y-%m-%d') AS iso FROM orders_extra",
    "text_surface_keep": surface_changes("{}"),
    "text_surface_lower": surface_changes("lower({})"),
    "text_surface_upper": surface_changes("upper({})"),
    "text_surface_title": surface_changes(TITLE),
    "value_frequency": f"WITH {DIRTY_ORDERS}, {long('dirty_orders', ['priority'])}, {SHOWN}, {FREQ} SELECT col_name, surface, n, first_row FROM freq",
    "token_set_pairs": f"WITH {BRANDS}{FREQ}, {VALUE_PAIRS},{ratio('pairs', 'scored')} SELECT left_value, right_value, sim AS similarity FROM scored",
    "category_clusters": f"{REC}{DIRTY_PART}, {DIRTY_ORDERS}, cells AS (SELECT row_index, 'brand' AS col_name, brand AS raw FROM dirty_part UNION ALL SELECT row_index, 'priority', priority FROM dirty_orders), {SHOWN}, {CLUSTER} SELECT col_name, surface, cluster FROM canon",
    "category_winner": f"{REC}{BRANDS}{CLUSTER} SELECT surface, winner, members FROM canon",
    "cat_merge_changes": f"{REC}{DIRTY_ORDERS}, {long('dirty_orders', ['priority', 'status'])}, {SHOWN}, {CLUSTER}, lp AS (SELECT DISTINCT lower(surface) AS l, lower(winner) AS r FROM canon WHERE surface <> winner),{ratio('lp', 'ls')}, pl AS (SELECT s.*, winner FROM shown s JOIN canon USING (col_name, surface)) "
    + changes("'cat_merge'", "row_index", "col_name", "raw", "winner", "'text:cat_merge'", "sim / 100", "pl JOIN ls ON l = lower(surface) AND r = lower(winner) WHERE winner <> surface AND winner <> raw")
    + " UNION ALL "
    + changes("'text_norm'", "row_index", "col_name", "raw", "surface", "'text:surface'", "1", "pl WHERE surface <> raw AND (winner = surface OR winner = raw)"),
    "null_unify_changes": f"WITH {CLEANING} SELECT * FROM fixed",
    "warn_locale": profile(EXTRA, "orders_extra", EXTRA_COLUMNS, "SELECT 'warn_ambiguous' AS key, col_name FROM prof WHERE contains(flags, 'numeric_locale_ambiguous')"),
    "warn_high_null": profile(DIRTY_EVENTS, "dirty_events", EVENT_COLUMNS, "SELECT 'warn_high_null' AS key, col_name, null_like_rate AS rate FROM prof WHERE null_like_rate > 0.5"),
    "duplicate_columns": f"WITH {DIRTY_CUSTOMER} SELECT col1, col2 FROM (SELECT 'segment' AS col1, 'segment_copy' AS col2, bool_and(segment = segment_copy) AS same FROM dirty_customer UNION ALL SELECT 'name', 'email', bool_and(name = email) FROM dirty_customer UNION ALL SELECT 'name', 'segment', bool_and(name = segment) FROM dirty_customer UNION ALL SELECT 'email', 'segment', bool_and(email = segment) FROM dirty_customer) WHERE same",
    "future_dates": f"WITH {DIRTY_ORDERS}, {long('dirty_orders', ['order_date', 'us_date'])}, {PARSED} SELECT col_name, count(*) AS n FROM parsed WHERE iso > '1999-01-01' GROUP BY col_name",
    "email_shape": f"WITH {DIRTY_CUSTOMER} SELECT 'email' AS col_name, count(*) AS n FROM dirty_customer WHERE NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')",
    "negative_values": f"WITH {EXTRA} SELECT 'amount' AS col_name, count(*) AS n FROM orders_extra WHERE CAST(amount AS DOUBLE) < 0",
    "dedup_keys": f"WITH {DIRTY_PART}, k AS (SELECT row_index, {KEY('name')} || chr(31) || {KEY('ptype')} AS row_key, {FULL} AS completeness FROM dirty_part) SELECT row_index, row_key, left(row_key, 1) AS sig, completeness FROM k",
    "dedup_blocks": f"WITH {DIRTY_CUSTOMER}, k AS (SELECT row_index, left({KEY('name')}, 1) AS sig FROM dirty_customer), r AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY row_index) AS nth, count(*) OVER (PARTITION BY sig) AS blk FROM k) SELECT sig, count(*) AS n, max(row_index) AS last_row FROM r WHERE nth <= 1500 AND blk > 1 GROUP BY sig",
    "dedup_edges": f"WITH {EDGES} SELECT sig, a, b, sim AS similarity FROM ks WHERE sim >= 70",
    "dedup_groups": f"{REC}{GROUPS} SELECT row_index, gid FROM grp",
    "dedup_losers": f"{REC}{LOSERS} SELECT 'dedup' AS kind, CAST(NULL AS VARCHAR) AS col_name, row_index, k AS old_value, CAST(NULL AS VARCHAR) AS new_value, concat('dedup:g', gid) AS rule, sim / 100 AS confidence FROM lost JOIN ls ON l = k AND r = wk",
    "conflict_resolution": "WITH c AS (SELECT o_orderkey AS row_index, 4 AS pr, 'null:unify' AS rule FROM orders UNION ALL SELECT o_orderkey, 3, 'text:surface' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 1, 'date:iso' FROM orders WHERE o_orderkey % 3 = 0), w AS (SELECT *, first_value(rule) OVER (PARTITION BY row_index ORDER BY pr) AS kept, row_number() OVER (PARTITION BY row_index ORDER BY pr) AS nth FROM c) SELECT row_index, kept, CASE WHEN nth > 1 THEN rule END AS dropped FROM w",
    "apply_cells": f"WITH {CLEANING} SELECT o.row_index, "
    + ", ".join(f"coalesce((SELECT new_value FROM led WHERE led.row_index = o.row_index AND led.col_name = '{c}'), o.{c}) AS {c}" for c in ORDER_COLUMNS)
    + " FROM dirty_orders o",
    "apply_casts": f"WITH {DIRTY_ORDERS} SELECT row_index, TRY_CAST(replace(price, ',', '.') AS DOUBLE) AS price, status, CASE row_index % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, row_index AS whole FROM dirty_orders",
    "apply_dedup": f"{REC}{GROUPS} SELECT row_number() OVER (ORDER BY p.row_index) - 1 AS row_index, name, brand, ptype FROM dirty_part p WHERE p.row_index NOT IN (SELECT row_index FROM lost)",
    "counts_by_kind_status": f"WITH {CLEANING} SELECT kind, status, count(*) AS n FROM dec GROUP BY kind, status",
    "counts_by_status": f"WITH {CLEANING} SELECT s.status, count(d.status) AS n FROM (SELECT unnest(['accepted','pending','rejected']) AS status) s LEFT JOIN (SELECT status FROM dec WHERE status <> 'pending') d USING (status) GROUP BY s.status",
    "report_columns": f"WITH p AS ({profile(DIRTY_ORDERS, 'dirty_orders', ORDER_COLUMNS, f'SELECT {FIELDS} FROM prof')}), n AS (WITH {CLEANING} SELECT col_name, count(*) AS changes_accepted FROM dec WHERE status = 'accepted' GROUP BY col_name) SELECT p.*, coalesce(changes_accepted, 0) AS changes_accepted FROM p LEFT JOIN n USING (col_name)",
    "ledger_ordered": f"WITH {CLEANING} SELECT row_number() OVER (ORDER BY row_index, col_name, kind, rule, old_value, new_value) - 1 AS place, row_index AS cell_row, col_name, kind, new_value FROM led",
    "apply_mismatches": f"WITH {CLEANING.replace('moved AS (', 'moved AS MATERIALIZED (').replace('fixed AS (', 'fixed AS MATERIALIZED (')}, was AS MATERIALIZED (SELECT m.*, CASE m.col_name " + " ".join(f"WHEN '{c}' THEN o.{c}" for c in ORDER_COLUMNS) + f" END AS raw FROM (SELECT col_name, row_index, old_value FROM moved UNION ALL SELECT col_name, row_index, old_value FROM fixed) m JOIN dirty_orders o USING (row_index)), x AS (SELECT col_name, row_index, CASE WHEN row_index % 7 = 0 THEN 'else' WHEN lower(trim(old_value)) IN {NULLS} THEN '' ELSE old_value END AS expected, CASE WHEN lower(trim(raw)) IN {NULLS} THEN '' ELSE raw END AS met FROM was) SELECT * FROM x WHERE expected <> met",
    "apply_summary": f"WITH {CLEANING} SELECT kind AS measure, count(*) AS n FROM dec WHERE status = 'accepted' GROUP BY kind UNION ALL SELECT 'rows_before', count(*) FROM orders UNION ALL SELECT 'rows_after', count(*) FROM orders",
    "analysis_warnings": f"SELECT * FROM ({REC}{DIRTY_PART}, {long('dirty_part', ['brand', 'ptype'])}, {SHOWN}, {CLUSTER} SELECT DISTINCT 'warn_cat_merged' AS key, col_name, winner, 0 AS n FROM canon WHERE members > 1) UNION ALL SELECT * FROM (WITH {KEYED} SELECT DISTINCT 'warn_dup_truncated' AS key, CAST(NULL AS VARCHAR) AS col_name, CAST(NULL AS VARCHAR) AS winner, blk AS n FROM ranked WHERE blk > 1500) UNION ALL SELECT * FROM ({REC}{GROUPS.replace('sim >= 70', 'sim >= 85')} SELECT 'warn_dup_groups' AS key, 'name' AS col_name, CAST(NULL AS VARCHAR) AS winner, count(DISTINCT gid) AS n FROM grp HAVING count(*) > 0)",
}

# -- forms of dates, text beyond ASCII -------------------------------------------------------------------------------

ORACLES["date_month_first"] = f"SELECT {K} AS row_index, strftime(o_orderdate, '%b %-d, %Y') AS raw, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders"
ORACLES["date_short_year"] = f"SELECT {K} AS row_index, concat('5-May-', lpad(CAST({K} % 100 AS VARCHAR), 2, '0')) AS raw, concat(CAST(CASE WHEN {K} % 100 < 70 THEN 2000 ELSE 1900 END + {K} % 100 AS VARCHAR), '-05-05') AS iso FROM orders"
ORACLES["date_clock"] = f"""WITH f AS (SELECT {K} AS row_index, {K} % 4 AS form, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y/%m/%d') AS slash, lpad(CAST({K} % 24 AS VARCHAR), 2, '0') AS hh FROM orders)
SELECT row_index, CASE form WHEN 0 THEN concat(day, ' ', hh, ':07') WHEN 1 THEN concat(day, 'T', hh, ':07:09') WHEN 2 THEN concat(slash, ' 00:00:00') ELSE concat(day, ' 12:00:60') END AS raw,
  CASE form WHEN 0 THEN concat(day, ' ', hh, ':07:00') WHEN 1 THEN concat(day, ' ', hh, ':07:09') WHEN 2 THEN day END AS iso FROM f"""


def _wide(of: int) -> str:
    """text_norm by the table of forms: of names the wanted one."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    forms = ", ".join(f"({i}, {quote(w[0])}, {quote(w[of])})" for i, w in enumerate(WIDE))
    return f"WITH forms(k, raw, surf) AS (VALUES {forms}) " + changes("'text_norm'", K, "'word'", "raw", "surf", "'text:surface'", "1", f"orders JOIN forms ON k = {K} % {len(WIDE)} WHERE raw <> surf")


ORACLES |= {"text_wide_keep": _wide(1), "text_wide_title": _wide(2)}

# -- profiles, names, ledger -----------------------------------------------------------------------------------------

RIVALS = f"rivals AS (SELECT {K} AS row_index, 4 AS pr, 'coherence_fix' AS kind, 'null:unify' AS rule FROM orders UNION ALL SELECT {K}, 3, 'text_norm', 'text:surface' FROM orders WHERE {K} % 2 = 0 UNION ALL SELECT {K}, 1, 'date_norm', 'date:iso' FROM orders WHERE {K} % 3 = 0)"
RESOLVED = f"{RIVALS}, resolved AS (SELECT row_index, arg_min(kind, pr) AS kind FROM rivals GROUP BY row_index)"
NAMED_WARNINGS = f"SELECT 'warn_ambiguous' AS key, 'email' AS col_name, 0 AS n UNION ALL SELECT 'warn_duplicate_columns', 'segment', 0 UNION ALL SELECT 'warn_email_shape', 'email', count(*) FROM dirty_customer WHERE NOT contains(email, '@')"
ORACLES |= {
    "profile_table": profile(DIRTY_ORDERS, "dirty_orders", ORDER_COLUMNS, "SELECT col_name, dtype, round(confidence, 3) AS confidence, round(null_like_rate, 3) AS missing, n_distinct, CASE WHEN flags = '' THEN '-' ELSE replace(flags, ',', ', ') END AS flags FROM prof"),
    "negative_named": f"WITH {EXTRA} SELECT 'warn_negative_values' AS key, 'total amount' AS col_name, count(*) AS n FROM orders_extra WHERE CAST(amount AS DOUBLE) < 0",
    "checks_registry": f"WITH {DIRTY_CUSTOMER} {NAMED_WARNINGS} UNION ALL SELECT 'warn_too_short', c, CAST(sum(short) AS BIGINT) FROM (SELECT unnest(['segment', 'segment_copy']) AS c, (length(segment) < 9)::INT AS short FROM dirty_customer) GROUP BY c",
    "ledger_by_kind": f"WITH {RIVALS} " + changes("kind", "row_index", "'status'", "'x'", "concat('y', row_index)", "rule", "1", "rivals WHERE pr < 4"),
    "ledger_canonical": f"WITH {RESOLVED}, every AS (SELECT 0 AS c, NULL AS cell_row, 'type_cast' AS kind UNION ALL SELECT 1, row_index, kind FROM resolved) SELECT row_number() OVER (ORDER BY c, cell_row) - 1 AS place, cell_row, kind FROM every",
    "ledger_page": f"WITH {RESOLVED} SELECT row_index AS cell_row, kind, (SELECT count(*) FROM resolved) AS total FROM resolved ORDER BY row_index LIMIT 200",
    "confidence_badges": f"SELECT {K} AS row_index, CASE WHEN {K} % 11 >= 9 THEN 'high' WHEN {K} % 11 >= 6 THEN 'mid' ELSE 'low' END AS badge FROM orders",
    "preview_rows": f"WITH {DIRTY_ORDERS} SELECT * FROM dirty_orders ORDER BY row_index LIMIT 50",
    "dedup_unknown_key": "SELECT 'warn_dup_unknown' AS key, 'colour, size' AS cols, 0 AS n_changes",
    "dedup_truncated": f"WITH {DIRTY_CUSTOMER} SELECT 'warn_dup_truncated' AS key, left({KEY('name')}, 1) AS sig, count(*) AS n FROM dirty_customer GROUP BY ALL HAVING count(*) > 100",
    "dedup_redetect": f"{REC}{GROUPS} SELECT 'dedup' AS kind, 'pending' AS status, count(*) AS n FROM lost HAVING count(*) > 0 UNION ALL SELECT 'date_norm', 'accepted', count(*) FROM orders WHERE {K} % 3 = 0 UNION ALL SELECT 'warn_dup_groups', '', count(DISTINCT gid) FROM grp HAVING count(*) > 0",
    "apply_last_writer": f"SELECT {K} AS row_index, concat('y', {K}) AS status FROM orders",
    "apply_all_kinds": f"{REC}{GROUPS}, empty AS (SELECT count(*) AS n FROM dirty_part WHERE ptype = '--') SELECT 'dedup' AS measure, count(*) AS n FROM lost UNION ALL SELECT 'type_cast', 1 UNION ALL SELECT 'casts', 1 UNION ALL SELECT 'coherence_fix', n FROM empty UNION ALL SELECT 'rows_before', count(*) FROM dirty_part UNION ALL SELECT unnest(['rows_after', 'clean_rows']), (SELECT count(*) FROM dirty_part) - (SELECT count(*) FROM lost)",
    "export_gates": "SELECT unnest(['open', 'sure', 'both']) AS dates, unnest([true, false, true]) AS blocked",
    "csv_round_trip": f"WITH {DIRTY_ORDERS} SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, {', '.join(ORDER_COLUMNS)} FROM dirty_orders",
    "csv_found": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, concat(c_name, chr(10), 'n\u00e9') AS cust, CAST(c_custkey AS VARCHAR) AS key, '\u20ac5,\u00fc' AS price, (SELECT count(*) > 100 FROM customer) AS truncated, ';' AS delimiter FROM customer ORDER BY c_custkey LIMIT 100",
    "stream_proposals": f"WITH {DIRTY_ORDERS}, {long('dirty_orders', ['priority', 'status'])}, {SHOWN} "
    + changes("'date_norm'", "row_index", "'us_date'", "us_date", "concat(us_date[7:10], '-', us_date[1:2], '-', us_date[4:5])", "'date:iso'", "1", "dirty_orders")
    + " UNION ALL "
    + changes("'text_norm'", "row_index", "col_name", "raw", "surface", "'text:surface'", "1", "shown WHERE surface <> raw")
    + " UNION ALL "
    + changes("'coherence_fix'", "row_index", "'status'", "status", "''", "'null:unify'", "1", f"dirty_orders WHERE lower(trim(status)) IN {NULLS}"),
}

# -- sessions and reports --------------------------------------------------------------------------------------------

ORACLES["session_round_trip"] = f"WITH {CLEANING} SELECT kind, CASE WHEN row_index % 2 = 0 THEN 'rejected' ELSE 'accepted' END AS status, count(*) AS n, true AS cleared FROM led GROUP BY ALL UNION ALL SELECT 'type_cast', 'pending', 2, true"
ORACLES["report_markdown"] = ORACLES["report_html"] = f"WITH {CLEANING} SELECT col_name, CAST(row_index AS VARCHAR) AS cell_row, kind, status FROM dec"
ORACLES["report_files"] = f"WITH {CLEANING} SELECT 'changes' AS part, concat('| ', concat_ws(' | ', status, kind, col_name, row_index, old_value, new_value, rule, '1.0'), ' |') AS line FROM dec UNION ALL SELECT 'warnings', unnest(['column price kept as string: numeric locale ambiguous', 'column status has 51% missing-like values', 'warn_of_ones_own'])"
ORACLES["report_json"] = f"""WITH p AS ({profile(DIRTY_ORDERS, 'dirty_orders', ORDER_COLUMNS, 'SELECT col_name, dtype, n_distinct FROM prof')}), dec AS MATERIALIZED (WITH {CLEANING} SELECT * FROM dec), done AS (SELECT * FROM dec WHERE status = 'accepted')
SELECT 'kind' AS section, kind AS name, CAST(count(*) AS VARCHAR) AS value FROM dec GROUP BY kind
UNION ALL SELECT 'status', status, CAST(count(*) AS VARCHAR) FROM dec GROUP BY status
UNION ALL SELECT DISTINCT 'rule', rule, '' FROM dec
UNION ALL SELECT 'warning', unnest(['column price kept as string: numeric locale ambiguous', 'column status has 51% missing-like values']), ''
UNION ALL SELECT 'applied', kind, CAST(count(*) AS VARCHAR) FROM done GROUP BY kind
UNION ALL SELECT 'column', p.col_name, concat(dtype, ' ', n_distinct, ' ', (SELECT count(*) FROM done WHERE done.col_name = p.col_name)) FROM p
UNION ALL SELECT 'change', concat(row_index, ' ', col_name), concat(kind, ' ', new_value, ' ', status) FROM dec
UNION ALL SELECT 'rows', unnest(['before', 'after']), (SELECT CAST(count(*) AS VARCHAR) FROM orders)
UNION ALL SELECT 'blocked', 'true', ''"""
