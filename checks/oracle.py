"""DuckDB statements of the registered queries."""

from __future__ import annotations

from . import sql as S
from . import views as V

WIDE_NAMES = [n for n, _ in V.ORDER_WIDE_COLUMNS]
SPARSE_NUMERIC = [n for n, t in V.EVENTS_SPARSE_COLUMNS if S.kind_of(t) == "numeric"]
SPARSE_ANALYSED = [
    "event_id", "value", "value_25null", "value_55null", "value_75null", "flag_num",
]

LINEITEM = S.profile_with("select * from lineitem", V.LINEITEM_COLUMNS)
CUSTOMER = S.profile_with("select * from customer", V.CUSTOMER_COLUMNS)
ORDERS = S.profile_with("select * from orders", V.ORDERS_COLUMNS)
EVENTS = S.profile_with("select * from events", V.EVENTS_COLUMNS)
SPARSE = S.profile_with(V.EVENTS_SPARSE_SQL, V.EVENTS_SPARSE_COLUMNS)
WIDE = S.profile_with(V.ORDER_WIDE_SQL, V.ORDER_WIDE_COLUMNS)
WIDE_PAIRS = S.pairs_with(WIDE_NAMES)
WIDE_SOURCE = f"src as materialized ({V.ORDER_WIDE_SQL})"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::double {n}" for n in names)


def _schema_sql(relation: str, columns) -> str:
    return " union all ".join(
        f"select {i} ordinal, '{n}' \"column\", '{t}' physical_type, count(*) - count({n}) nulls,"
        f" count(*) \"rows\" from {relation}"
        for i, (n, t) in enumerate(columns)
    )


def _severity(c: str) -> str:
    return f"case {c} when 'high' then 3 when 'medium' then 2 else 1 end"


COLUMN_FINDINGS = """
select 1 block, ordinal item, 1 rule, 'quality' category,
  case when null_pct >= 50 then 'high' else 'medium' end severity, "column" subject
from profile where null_pct >= 20
union all select 1, ordinal, 2, 'variability', 'medium', "column" from profile where "distinct" = 1
union all select 1, ordinal, 3, 'identifier', 'low', "column" from profile where distinct_pct >= 95 and "rows" > 100
union all select 1, ordinal, 4, 'outliers', 'medium', "column" from profile
  where outliers_iqr * 100.0::double / greatest(finite, 1) >= 5
union all select 1, ordinal, 5, 'distribution', 'low', "column" from profile where abs(skewness) >= 2"""
PAIR_FINDINGS = """
union all select 2, "rank", 1, 'redundancy', 'medium', column_1 || ' ~ ' || column_2 from strong
  where abs_r >= 0.95::double"""
GROUP_FINDINGS = """
union all select 3, "group", 1, 'group', 'low', 'Group ' || "group" from groups where "group" <= 50"""
SELECTION_FINDINGS = """
union all select 6, 0, 1, 'feature_selection',
  case when count(*) filter (where decision = 'drop') > count(*) filter (where decision = 'use')
       then 'medium' else 'low' end, 'all columns' from selection
union all select 6, place, 2, 'feature_selection', case when risk = 'high' then 'high' else 'medium' end, "column"
  from (select *, row_number() over (order by "position") place from selection where decision = 'drop')
  where place <= 5"""


def _insights_with(*parts: str) -> str:
    return f"""found as ({COLUMN_FINDINGS}{"".join(parts)}),
insights as materialized (
  select row_number() over (order by block = 6, case when block = 6 then 0 else -{_severity("severity")} end,
    block, item, rule) "rank", severity, category, subject from found)"""


ML_SCORES = """ml as (
  select ordinal, "column", analytic_type "type",
    (0.65::double * (1 - greatest(0, least(1, null_pct / 100)))
     + 0.35::double * case when "distinct" <= 1 then 0.0::double
         when "distinct" <= 50 and analytic_type = 'categorical' then 0.75::double
         when analytic_type = 'numeric' then 1.0::double else 0.45::double end)
    * case when distinct_pct >= 95 then 0.35::double else 1.0::double end score
  from profile)"""
ML_OUT = """row_number() over (order by score desc, ordinal) "rank", "column", "type",
  round(score, 6) + 0.0::double score"""
ML_ADVICE = """case when ordinal = -1 then 'target_unusable' when score >= 0.75::double then 'good_candidate'
  when score >= 0.5::double then 'use_after_cleaning' else 'low_value' end advice"""

CHART_ROWS = """
select 1 block, ordinal seq, chart, "column" column_x, '' column_y,
  case when analytic_type = 'numeric' and coalesce(outliers_iqr, 0) > 0 then 'high' else 'medium' end priority
from profile"""
CHART_PAIRS = """
union all select 2, "rank", 'scatter', column_1, column_2,
  case when abs_r >= 0.9::double then 'high' else 'medium' end from strong"""
CHART_OUT = f"""select row_number() over (order by {_severity("priority")} desc, block, seq) "rank",
  priority, chart, column_x, column_y from advice"""


def _bars(value: str, label: str, relation: str, tie: str, limit: int) -> str:
    return f"""select row_number() over (order by v desc, tie) "rank", label, round(v, 6) + 0.0::double "value" from (
  select {label} label, {value} v, {tie} tie from {relation} order by v desc, tie limit {limit})"""


# Clustering, written for any number of clusters and for as many rounds as are ever made: rounds
# after the last that moved a row change nothing.
MOST_ROUNDS = 35
CLUSTER_NAMES = ["sum_qty", "n_lines", "avg_disc", "max_tax"]
ZS = [f"z_{n}" for n in CLUSTER_NAMES]
_Z_LIST = ", ".join(ZS)
STANDARD = f"""moments as (select {", ".join(
    f"avg({n}::double) m{j}, stddev_pop({n}::double) s{j}" for j, n in enumerate(CLUSTER_NAMES))} from src),
std as materialized (select l_orderkey, {", ".join(
    f"greatest(-8.0::double, least(8.0::double, ({n}::double - m{j}) / s{j})) z_{n}"
    for j, n in enumerate(CLUSTER_NAMES))} from src, moments)"""
_GAP = " + ".join(f"(a.{z} - c.{z}) * (a.{z} - c.{z})" for z in ZS)


def _rounds(count: int) -> str:
    parts = [
        """sized as (select n, greatest(2, least(greatest(n // 20, 2),
  case when n < 300 then 3 when n < 3000 then 4 when n < 20000 then 5 else 6 end)) k
  from (select count(*) n from std))""",
        f"""c0 as materialized (
  select s.i, {_Z_LIST} from (select i, least(floor((i + 0.5::double) * n / k)::bigint, n - 1) spot
      from sized, range(6) t(i) where i < k) s
  join (select *, row_number() over (order by l_orderkey) - 1 place from std) p on p.place = s.spot)""",
    ]
    for r in range(1, count + 1):
        parts.append(
            f"""a{r} as materialized (
  select l_orderkey, {_Z_LIST}, i from (
    select a.*, c.i, row_number() over (partition by a.l_orderkey order by {_GAP}, c.i) nr from std a, c{r - 1} c)
  where nr = 1)"""
        )
        means = ", ".join(f"coalesce(round(g.{z}, 12), s.{z}) {z}" for z in ZS)
        parts.append(
            f"""c{r} as materialized (
  select s.i, coalesce(g.size, 0) size, {means} from c0 s left join (
    select i, count(*) size, {", ".join(f"avg({z}) {z}" for z in ZS)} from a{r} group by i) g using (i))"""
        )
    parts.append(
        f"""placed as materialized (
  select a.l_orderkey, a.i, sqrt({_GAP}) d from a{count} a join c{count} c using (i)),
spread as materialized (
  select count(*) n, avg(d) m, stddev_pop(d) s, quantile_cont(d, 0.95) p95, quantile_cont(d, 0.99) p99 from placed),
clusters as materialized (
  select row_number() over (order by size desc, i) "rank", i cluster, size, pct, mean_distance,
    case when pct <= 3 then 'small_segment' when mean_distance >= p95 then 'dispersed' else 'stable' end reading
  from (select c.i, c.size, c.size * 100.0::double / (select n from spread) pct,
          coalesce(g.mean, 0) mean_distance, (select p95 from spread) p95
        from c{count} c left join (select i, avg(d) mean from placed group by i) g on g.i = c.i)),
odd as materialized (
  select row_number() over (order by d desc, l_orderkey) "rank", l_orderkey, i cluster, d distance, z z_score,
    case when d >= p99 or z >= 3 then 'high' else 'medium' end severity
  from (select p.*, w.p95, w.p99, case when w.s > 0 then (d - w.m) / w.s else 0 end z from placed p cross join spread w)
  where d >= p95 or z >= 2.5::double)"""
    )
    moved = " union all ".join(
        f"select {r} r, count(*) filter (where a.i <> b.i) moved from a{r} a join "
        + (f"a{r - 1} b using (l_orderkey)" if r > 1 else "(select l_orderkey, 0 i from std) b using (l_orderkey)")
        for r in range(1, count + 1)
    )
    parts.append(f"settled as (select coalesce(min(r), {count}) rounds, count(*) > 0 converged from ({moved}) where moved = 0)")
    return ",\n".join(parts)


CLUSTERED = f"with {WIDE_SOURCE},\n{STANDARD},\n{_rounds(MOST_ROUNDS)}"
CLUSTER_FINDINGS = """
union all select 4, 0, 1, 'kmeans', case when count(*) >= 20 then 'high' else 'medium' end, 'odd rows' from odd
  having count(*) > 0
union all select 4, place, 2, 'small_segment', 'medium', 'Cluster ' || cluster from (
  select *, row_number() over (order by "rank") place from clusters where pct <= 3)"""

CLUSTER_FEATURES = """select row_number() over (order by score desc, ordinal) "rank", "column", round(score, 6) score from (
  select *, 0.65::double * (1 - greatest(0, least(1, null_pct / 100)))
    + 0.2::double * (greatest(0, least(10, ln(1 + abs(std)))) / 10)
    + 0.15::double * (greatest(0, least(8, ln(1 + coalesce(outliers_iqr, 0)))) / 8) score
  from profile where analytic_type = 'numeric' and null_pct <= 45 and std > 0 and "distinct" > 2
    and not (distinct_pct >= 95 and "rows" >= 500)
)"""

BOOTSTRAP_COLUMNS = """picked as (
  select ordinal, "column", true is_target, null::double score from profile
  where "column" = 'max_tax' and analytic_type = 'numeric'
  union all
  select ordinal, "column", false, 0.45::double * (1 - greatest(0, least(1, null_pct / 100)))
    + 0.25::double * (greatest(0, least(10, ln(1 + abs(std)))) / 10)
    + 0.2::double * (greatest(0, least(8, ln(1 + coalesce(outliers_iqr, 0)))) / 8)
    + 0.1::double * (greatest(0, least(5, abs(coalesce(skewness, 0)))) / 5)
  from profile where analytic_type = 'numeric' and null_pct <= 40 and std > 0 and "distinct" > 5
    and not (distinct_pct >= 95 and "rows" >= 500) and "column" <> 'max_tax'
    and not regexp_matches(lower("column"), 'id|cedula|cédula|codigo|código'))
select row_number() over (order by is_target desc, score desc, ordinal) "rank", "column", is_target,
  round(score, 6) + 0.0::double score
from picked"""

SIMULATED = f"""sorted as materialized (
  select "value" v, row_number() over (order by "value") - 1 pos, count(*) over () n from events),
draws as materialized (
  select id // 250 sim, ('0x' || substr(md5('value|' || id), 1, 15))::bigint % (select count(*) from events) pos
  from range(5000 * 250) t(id))"""
SUMMARY = """drawn as materialized (
  select d.sim, s.v, h.hist_p5, h.hist_p95 from draws d join sorted s using (pos), (
    select quantile_cont("value", 0.05) hist_p5, quantile_cont("value", 0.95) hist_p95 from events) h),
batches as materialized (select sim, avg(v) mean from drawn group by sim),
hist as (select count(*) valid_values, avg("value") hist_mean, stddev_pop("value") hist_std, min("value") hist_min,
    quantile_cont("value", 0.05) hist_p5, quantile_cont("value", 0.5) hist_p50,
    quantile_cont("value", 0.95) hist_p95, max("value") hist_max from events),
sims as (select quantile_cont(mean, 0.05) sim_mean_p5, quantile_cont(mean, 0.5) sim_mean_p50,
    quantile_cont(mean, 0.95) sim_mean_p95 from batches),
tails as (select count(*) filter (where v > hist_p95) * 100.0::double / count(*) pct_above_p95,
    count(*) filter (where v < hist_p5) * 100.0::double / count(*) pct_below_p5 from drawn),
summary as materialized (
  select 1 "position", 'value' "column", h.*, s.*, sim_mean_p5 * 250 sim_total_p5, sim_mean_p50 * 250 sim_total_p50,
    sim_mean_p95 * 250 sim_total_p95, t.*,
    abs(sim_mean_p95 - sim_mean_p5) / abs(sim_mean_p50) rr, hist_std / abs(hist_mean) cv,
    (select outliers_iqr from profile where "column" = 'value') oi,
    (select skewness from profile where "column" = 'value') skew
  from hist h, sims s, tails t),
risk_rows as (
  select 1 seq, case when cv >= 1 then 'high' when cv >= 0.5::double then 'medium' end severity,
    'variation_coefficient' indicator, cv "value" from summary
  union all select 2, case when rr >= 1 then 'high' when rr >= 0.35::double then 'medium' end,
    'relative_simulated_range', rr from summary
  union all select 3, case when abs(skew) >= 2 then 'medium' end, 'skewness', skew from summary
  union all select 4, case when oi * 100.0::double / greatest(valid_values, 1) >= 5 then 'medium' end,
    'outlier_pct', oi * 100.0::double / greatest(valid_values, 1) from summary),
risks as materialized (
  select row_number() over (order by case severity when 'high' then 3 else 2 end desc, seq) "rank",
    severity, 'value' "column", indicator, "value" from risk_rows where severity is not null)"""
EVENTS_SIMULATED = f"with {EVENTS},\n{SIMULATED},\n{SUMMARY}"
SIMULATION_FINDINGS = """
union all select 5, 0, 1, 'montecarlo', case when count(*) filter (where severity = 'high') > 0 then 'high' else 'medium' end,
  'simulated scenarios' from risks having count(*) > 0
union all select 5, "rank", 2, 'risk', severity, "column" from risks"""

SELECTION_OUT = """select "position", ordinal, "column", decision, round(score, 6) + 0.0::double score, analytic_type,
  round(null_pct, 6) null_pct, round(distinct_pct, 6) distinct_pct, round(max_correlation, 6) max_correlation,
  correlated_with, repeats, risk from selection"""
WIDE_SELECTED = f"{WIDE},\n{S.SCORED},\n{WIDE_PAIRS},\n{S.groups_with()},\n{S.selection_with()}"

GAPPED = ["value_25null", "value_55null", "value_97null"]

ORACLE: dict[str, str] = {
    "schema_summary_events": _schema_sql("events", V.EVENTS_COLUMNS),
    "schema_summary_sparse": f"with src as ({V.EVENTS_SPARSE_SQL}) {_schema_sql('src', V.EVENTS_SPARSE_COLUMNS)}",
    "footer_ranges_lineitem": " union all ".join(
        f"select {i} ordinal, '{n}' \"column\", '{t}' physical_type, count(*) - count({n}) nulls, count(*) \"rows\","
        + (f" min({n})::bigint least, max({n})::bigint most" if t in ("int", "bigint") else " null::bigint least, null::bigint most")
        + " from lineitem"
        for i, (n, t) in enumerate(V.LINEITEM_COLUMNS)
    ),
    "footer_ranges_embeddings": """select 0 ordinal, 'vec_id' "column", 'bigint' physical_type, count(*) - count(vec_id) nulls, count(*) "rows",
    min(vec_id)::bigint least, max(vec_id)::bigint most from embeddings
  union all select 1, 'embedding', 'array<float>', count(*) - count(embedding), count(*), null, null from embeddings
  union all select 2, 'label', 'int', count(*) - count(label), count(*), min(label)::bigint, max(label)::bigint from embeddings""",
    "schema_summary_pages": _schema_sql("pages", [("page_id", "bigint"), ("url", "string"), ("html", "string")]),
    "table_size_lineitem": f'select count(*) "rows", {len(V.LINEITEM_COLUMNS)} columns from lineitem',
    "numeric_columns_part": """select p_partkey::double p_partkey, p_size::double p_size,
  p_retailprice::double p_retailprice from part""",
    "finite_pairs_sparse": f"with src as materialized ({V.EVENTS_SPARSE_SQL}) "
    + " union all ".join(
        f"select '{a}' column_1, '{b}' column_2, count(*) common_rows from src"
        f" where isfinite({a}::double) and isfinite({b}::double)"
        for i, a in enumerate(SPARSE_NUMERIC)
        for b in SPARSE_NUMERIC[i + 1 :]
    ),
    "profile_basic_lineitem": f"with {LINEITEM} {S.PROFILE_OUT}",
    "profile_basic_customer": f"with {CUSTOMER} {S.PROFILE_OUT}",
    "profile_shape_events": f"with {EVENTS} {S.PROFILE_OUT}",
    "profile_nulls_sparse": f"with {SPARSE} {S.PROFILE_OUT}",
    "profile_order_wide": f"with {WIDE} {S.PROFILE_OUT}",
    "population_moments_lineitem": f"""with {LINEITEM} select "column", finite, {S.mean("finite_mean")}, {r6("finite_std")}
from profile where finite is not null""",
    "percentiles_lineitem": " union all ".join(
        f"select '{n}' \"column\", "
        + ", ".join(
            f"round(quantile_cont({n}::double, {p}), 6) + 0.0::double p{round(p * 100)}"
            for p in (0.05, 0.5, 0.95, 0.99)
        )
        + " from lineitem"
        for n, t in V.LINEITEM_COLUMNS
        if S.kind_of(t) == "numeric"
    ),
    "pearson_pairs_sparse": f"with src as materialized ({V.EVENTS_SPARSE_SQL}), {S.pairs_with(SPARSE_NUMERIC)}"
    f" select i, j, column_1, column_2, {r6('r')} from pairs",
    "strong_pairs_wide": f"""with {WIDE_SOURCE}, {WIDE_PAIRS}
select "rank", i, j, column_1, column_2, {r6("r", "abs_r")}, strength from strong""",
    "target_relevance_wide": f"""with {WIDE_SOURCE}, {WIDE_PAIRS}
select case when column_1 = 'gross' then j else i end ordinal,
  case when column_1 = 'gross' then column_2 else column_1 end "column", {r6("r")}
from pairs where r is not null and (column_1 = 'gross' or column_2 = 'gross')""",
    "correlation_matrix_wide": f"""with {WIDE_SOURCE}, {WIDE_PAIRS},
ends as (select "rank" * 2 place, column_1 c from strong
  union all select "rank" * 2 + 1, column_2 from strong),
axis as (select row_number() over (order by place) - 1 spot, c from (
  select c, min(place) place from ends group by c)),
both_ways as (select column_1 a, column_2 b, r from strong union all select column_2, column_1, r from strong)
select x.spot "row", y.spot col, x.c column_1, y.c column_2,
  round(case when x.spot = y.spot then 1.0::double else coalesce(r, 0) end, 6) + 0.0::double "value"
from axis x cross join axis y left join both_ways on a = x.c and b = y.c""",
    "column_groups_wide": f"""with recursive {WIDE_SOURCE}, {WIDE_PAIRS}, {S.groups_with()}
select "group", size, {r6("mean_abs_r", "min_abs_r")}, columns from groups""",
    "column_groups_docs": f"""with recursive src as materialized ({V.DOC_SIZES_SQL}),
{S.pairs_with(["doc_id", "n_chars", "words", "lines"])}, {S.groups_with()}
select "group", size, {r6("mean_abs_r", "min_abs_r")}, columns from groups""",
    "column_score_sparse": f'with {SPARSE},\n{S.SCORED} select ordinal, "column", {r6("score")}, risk from scored',
    "feature_selection_wide": f"with recursive {WIDE_SELECTED} {SELECTION_OUT}",
    "feature_selection_alone_sparse": f"with {SPARSE},\n{S.SCORED},\n{S.selection_with(with_pairs=False)} {SELECTION_OUT}",
    "selection_summary_wide": f"""with recursive {WIDE_SELECTED}
select count(*) columns, count(*) filter (where decision = 'use') n_use,
  count(*) filter (where decision = 'review') n_review, count(*) filter (where decision = 'drop') n_drop,
  true applied, 0.55::double threshold,
  (select string_agg("column", '; ' order by "column") from scored where is_num and score >= 0.4125::double) used_columns
from selection""",
    "analysis_columns_sparse": f"""with {SPARSE},\n{S.SCORED},\n{S.selection_with(with_pairs=False)}
select row_number() over (order by ordinal) - 1 place, "column" from selection
where analytic_type = 'numeric' and decision <> 'drop'""",
    "insights_columns_sparse": f"with {SPARSE},\n{_insights_with()} select * from insights",
    "insights_pairs_wide": f"with recursive {WIDE_SELECTED},\n{_insights_with(PAIR_FINDINGS, GROUP_FINDINGS)} select * from insights",
    "insights_selection_sparse": f"with {SPARSE},\n{S.SCORED},\n{S.selection_with(with_pairs=False)},\n"
    f"{_insights_with(SELECTION_FINDINGS)} select * from insights",
    "insights_simulation_events": f"{EVENTS_SIMULATED},\n{_insights_with(SIMULATION_FINDINGS)} select * from insights",
    "insights_clusters_wide": f"with {WIDE},\n{STANDARD},\n{_rounds(MOST_ROUNDS)},\n{_insights_with(CLUSTER_FINDINGS)} select * from insights",
    "findings_digest_wide": f"""with recursive {WIDE_SELECTED},
{_insights_with(PAIR_FINDINGS, GROUP_FINDINGS, SELECTION_FINDINGS)},
lines as (
  select 1 block, 0 item, 'useful_columns' topic, case when count(*) filter (where decision = 'drop')
    > count(*) filter (where decision = 'use') then 'medium' else 'low' end severity from selection
  union all select 2, 0, 'clustering_not_applied', 'low'
  union all select 4, 0, 'strong_pair', case when abs_r >= 0.95::double then 'high' else 'medium' end from strong where "rank" = 1
  union all select 5, 0, 'column_block', 'medium' from groups where "group" = 1
  union all select 6, "rank", category, severity from insights)
select row_number() over (order by block, item) "rank", severity, topic from lines""",
    "chart_advice_orders": f"with {ORDERS}, advice as ({CHART_ROWS}) {CHART_OUT}",
    "chart_advice_wide": f"with recursive {WIDE_SELECTED}, advice as ({CHART_ROWS}{CHART_PAIRS}) {CHART_OUT}",
    "ml_scores_orders": f"with {ORDERS}, {ML_SCORES} select {ML_OUT}, {ML_ADVICE} from ml",
    "ml_scores_target_wide": f"""with {WIDE_SOURCE}, {WIDE_PAIRS},
ml as (select case when column_1 = 'gross' then j else i end ordinal,
  case when column_1 = 'gross' then column_2 else column_1 end "column", 'target_relevance' "type", least(abs(r), 1) score
  from pairs where r is not null and (column_1 = 'gross' or column_2 = 'gross'))
select {ML_OUT}, case when score >= 0.7::double then 'strong_variable' when score >= 0.3::double then 'candidate'
  else 'weak_relation' end advice from ml""",
    "ml_scores_bad_target": f"""with {ORDERS}, {ML_SCORES},
every as (select * from ml union all select -1, 'o_orderstatus', 'target', 0.0::double)
select {ML_OUT}, {ML_ADVICE} from every""",
    "null_bars_sparse": f"with {SPARSE} "
    + _bars("null_pct", '"column"', "profile where null_pct > 0", "ordinal", 8),
    "distinct_bars_sparse": f"with {SPARSE} " + _bars("distinct_pct", '"column"', "profile", "ordinal", 8),
    "ml_bars_orders": f"""with {ORDERS}, {ML_SCORES}, places as (
  select *, row_number() over (order by score desc, ordinal) place from ml) """
    + _bars("score * 100", "\"column\" || ' (' || \"type\" || ')'", "places", "place", 10),
    "sample_orders": """with p as (
  select *, row_number() over (order by o_orderkey) - 1 "position", count(*) over () n from orders),
s as (select *, greatest(1, ceil(n / 1000.0)::bigint) step from p)
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, "position",
  "position" // step sample_position,
  ("position" // step) * ceil(n::double / ceil(n::double / step))::bigint + 1 approx_row_number
from s where "position" % step = 0""",
    "sample_lineitem_copies": """with p as (
  select l_returnflag, l_linestatus, l_linenumber,
    row_number() over (order by l_returnflag, l_linestatus, l_linenumber) - 1 "position", count(*) over () n from lineitem),
s as (select *, greatest(1, ceil(n / 500.0)::bigint) step from p)
select l_returnflag, l_linestatus, l_linenumber, "position", "position" // step sample_position,
  ("position" // step) * ceil(n::double / ceil(n::double / step))::bigint + 1 approx_row_number
from s where "position" % step = 0""",
    "cluster_features_wide": f"with {WIDE} {CLUSTER_FEATURES}",
    "standardize_wide": f"with {WIDE_SOURCE}, {STANDARD} select l_orderkey, {r6(*ZS)} from std",
    "standardize_sparse": f"""with src as materialized ({V.EVENTS_SPARSE_SQL}),
m as (select {", ".join(f"avg({n}) m_{n}, stddev_pop({n}) s_{n}" for n in GAPPED)} from src)
select event_id, {", ".join(
    f"round(case when {n} is null then 0 else greatest(-8.0::double, least(8.0::double, ({n} - m_{n}) / s_{n})) end, 6)"
    f" + 0.0::double z_{n}" for n in GAPPED)}
from src, m where {" + ".join(f"({n} is not null)::int" for n in GAPPED)} >= 2""",
    "kmeans_rounds_wide": f"{CLUSTERED} select i cluster, size, {r6(*ZS)} from c35",
    # the spreads are compared by the query; the statement has the rows and the number of clusters
    "kmeans_ml_wide": f'{CLUSTERED} select k::bigint k, n::bigint "rows", true "close" from sized',
    "cluster_stats_wide": f'{CLUSTERED} select "rank", cluster, size, {r6("pct", "mean_distance")}, reading from clusters',
    "odd_rows_wide": f'{CLUSTERED} select "rank", l_orderkey, cluster, {r6("distance", "z_score")}, severity from odd',
    "cluster_summary_wide": f"""{CLUSTERED} select '{"; ".join(sorted(CLUSTER_NAMES))}' features, k, s.n "rows", rounds, converged,
  round(m, 6) mean_distance, round(s.s, 6) std_distance, round(p95, 6) p95_distance, round(p99, 6) p99_distance,
  (select count(*) from odd) odd_rows from spread s, sized, settled""",
    "cluster_bars_wide": f"{CLUSTERED} " + _bars("pct", "'Cluster ' || cluster", "clusters", '"rank"', 12),
    "bootstrap_columns_wide": f"with {WIDE}, {BOOTSTRAP_COLUMNS}",
    "bootstrap_batches_events": f"""{EVENTS_SIMULATED}
select 1 k, sim, round(avg(v), 6) mean, count(*) filter (where v > hist_p95) above,
  count(*) filter (where v < hist_p5) below, count(*) draws
from drawn group by sim""",
    "bootstrap_summary_events": f"""{EVENTS_SIMULATED}
select "position", "column", valid_values, {r6("hist_mean", "hist_std", "hist_min", "hist_p5", "hist_p50", "hist_p95",
  "hist_max", "sim_mean_p5", "sim_mean_p50", "sim_mean_p95", "sim_total_p5", "sim_total_p50", "sim_total_p95",
  "pct_above_p95", "pct_below_p5")},
  case when rr >= 1 then 'wide' when cv >= 0.75::double then 'volatile' when coalesce(oi, 0) > 0 then 'extremes'
       else 'stable' end reading from summary""",
    "bootstrap_scenarios_events": f"""{EVENTS_SIMULATED}, cut as (
  select "position", "column", 0 seq, 'low_p5' scenario, sim_mean_p5 estimated_mean, sim_total_p5 estimated_total from summary
  union all select "position", "column", 1, 'central_p50', sim_mean_p50, sim_total_p50 from summary
  union all select "position", "column", 2, 'high_p95', sim_mean_p95, sim_total_p95 from summary)
select "position", "column", seq, scenario, {r6("estimated_mean", "estimated_total")} from cut""",
    "bootstrap_risks_events": f"""{EVENTS_SIMULATED} select "rank", severity, "column", indicator, round("value", 6) "value" from risks""",
    "bootstrap_conclusion_events": f"""{EVENTS_SIMULATED}
select 5000 simulations, 250 batch, 1 columns, count(*) risks, count(*) filter (where severity = 'high') high_risks,
  case when count(*) filter (where severity = 'high') > 0 then 'high' when count(*) > 0 then 'moderate' else 'stable' end "level"
from risks""",
    "simulated_range_bars_events": f"""{EVENTS_SIMULATED} """
    + _bars("sim_mean_p95 - sim_mean_p5", '"column"', "summary", '"position"', 12),
    "text_stats_documents": """select doc_id,
  length(text) - length(replace(text, chr(10), ''))
    + case when text <> '' and not ends_with(text, chr(10)) then 1 else 0 end lines, length(text) chars
from documents""",
    "text_totals_documents": """select count(*) documents, sum(length(text) - length(replace(text, chr(10), ''))
    + case when text <> '' and not ends_with(text, chr(10)) then 1 else 0 end)::bigint lines,
  sum(length(text))::bigint chars from documents""",
    "merge_parts_conversations": """select conv_id, 0 chunk, count(*) parts,
  string_agg(text, chr(10) order by turn) merged from conversations where lower(role) <> 'system' group by conv_id""",
    "part_sizes_conversations": """select conv_id, turn, strlen(text) bytes, strlen(text) // 1024 kb from conversations""",
    "merge_size_conversations": """with g as (
  select conv_id, count(*) filter (where lower(role) <> 'system') parts,
    coalesce(sum(strlen(text)) filter (where lower(role) <> 'system'), 0)::bigint bytes from conversations group by conv_id),
m as (select conv_id, false is_total, parts, bytes, bytes + greatest(parts - 1, 0) merged_bytes from g),
t as (select * from m union all
  select null, true, sum(parts)::bigint, sum(bytes)::bigint, sum(merged_bytes)::bigint from m)
select conv_id, is_total, parts, bytes, bytes // 1024 kb, merged_bytes, merged_bytes // 1024 merged_kb from t""",
}
ORACLE["pearson_matrix_sparse"] = ORACLE["pearson_pairs_sparse"]
ORACLE["sample_orders_written"] = ORACLE["sample_orders"]

_FULL = " union all ".join(f"select '{n}' c, {n}::double v from src" for n in CLUSTER_NAMES)
ORACLE["bootstrap_full_wide"] = f"""with {WIDE}, picked as (
  select ordinal, "column" c, outliers_iqr oi, 0.45::double * (1 - greatest(0, least(1, null_pct / 100)))
    + 0.25::double * (greatest(0, least(10, ln(1 + abs(std)))) / 10)
    + 0.2::double * (greatest(0, least(8, ln(1 + coalesce(outliers_iqr, 0)))) / 8)
    + 0.1::double * (greatest(0, least(5, abs(coalesce(skewness, 0)))) / 5) score
  from profile where "column" in ({", ".join(f"'{n}'" for n in CLUSTER_NAMES)})),
named as materialized (select *, row_number() over (order by score desc, ordinal) place from picked),
sorted as materialized (select c, v, row_number() over (partition by c order by v) - 1 pos from ({_FULL})),
hist as materialized (select c, count(*) n, avg(v) hist_mean, stddev_pop(v) hist_std, min(v) hist_min,
    quantile_cont(v, 0.05) hist_p5, quantile_cont(v, 0.5) hist_p50, quantile_cont(v, 0.95) hist_p95, max(v) hist_max
  from sorted group by c),
draws as materialized (
  select h.c, id // 250 sim, ('0x' || substr(md5(h.c || '|' || id), 1, 15))::bigint % h.n pos
  from range(5000 * 250) t(id) cross join hist h),
drawn as materialized (select d.c, d.sim, s.v from draws d join sorted s on s.c = d.c and s.pos = d.pos),
batches as materialized (select c, sim, avg(v) mean from drawn group by c, sim),
sims as materialized (select c, quantile_cont(mean, 0.05) sim_mean_p5, quantile_cont(mean, 0.5) sim_mean_p50,
    quantile_cont(mean, 0.95) sim_mean_p95 from batches group by c),
tails as materialized (
  select d.c, count(*) filter (where d.v > h.hist_p95) * 100.0::double / count(*) pct_above_p95,
    count(*) filter (where d.v < h.hist_p5) * 100.0::double / count(*) pct_below_p5
  from drawn d join hist h on h.c = d.c group by d.c),
summary as materialized (
  select p.place "position", p.c "column", h.n valid_values, h.* exclude (c, n), s.* exclude (c),
    sim_mean_p5 * 250 sim_total_p5, sim_mean_p50 * 250 sim_total_p50, sim_mean_p95 * 250 sim_total_p95,
    t.* exclude (c), abs(sim_mean_p95 - sim_mean_p5) / abs(sim_mean_p50) rr, hist_std / abs(hist_mean) cv, p.oi
  from named p join hist h on h.c = p.c join sims s on s.c = p.c join tails t on t.c = p.c)
select "position", "column", valid_values, {r6("hist_mean", "hist_std", "hist_min", "hist_p5", "hist_p50", "hist_p95",
  "hist_max", "sim_mean_p5", "sim_mean_p50", "sim_mean_p95", "sim_total_p5", "sim_total_p50", "sim_total_p95",
  "pct_above_p95", "pct_below_p5")},
  case when rr >= 1 then 'wide' when cv >= 0.75::double then 'volatile' when coalesce(oi, 0) > 0 then 'extremes'
       else 'stable' end reading from summary"""

# Printed tables: numbers with a fixed count of decimals, blank where there is none.


def _printed(name: str, digits: int) -> str:
    # rounded first: the other engine rounds the shortest digits of a number, this one its exact value
    return f"case when {name} is null or not isfinite({name}) then '' else printf('%.{digits}f', round(round({name}::double, 12), {digits})) end {name}"


_STATS = ("mean", "q1", "median", "q3", '"min"', '"max"', "std", "iqr", "skewness", "kurtosis")
_COUNTS = ("zeros", "negatives", "outliers_iqr", "outliers_z")
ORACLE["csv_profile_lineitem"] = f"""with {LINEITEM} select "column", physical_type, analytic_type, "rows", non_null, nulls,
  {_printed("null_pct", 4)}, coalesce("distinct"::varchar, '') "distinct", {_printed("distinct_pct", 6)},
  {", ".join(_printed(n, 6) for n in _STATS)}, {", ".join(f"coalesce({n}::varchar, '') {n}" for n in _COUNTS)}, chart
from profile"""

_GAPS = " union all ".join(
    f"select l_orderkey, {j} j, '{n}' \"name\", a.z_{n} z, abs(a.z_{n} - c.z_{n}) gap from a{MOST_ROUNDS} a join c{MOST_ROUNDS} c using (i)"
    for j, n in enumerate(CLUSTER_NAMES)
)
ORACLE["odd_rows_explained_wide"] = f"""{CLUSTERED}, words as (
  select l_orderkey, string_agg("name" || '=' || printf('%.2f', z) || 'σ', '; ' order by gap desc, j) explanation
  from (select *, row_number() over (partition by l_orderkey order by gap desc, j) nr from ({_GAPS})) where nr <= 4 group by l_orderkey)
select "rank", l_orderkey, cluster, {r6("distance", "z_score")}, severity,
  printf('distance %.2f, ', distance) || case when severity = 'high' then 'beyond the 99th percentile or 3 deviations'
    else 'beyond the 95th percentile or 2.5 deviations' end reason, explanation
from odd join words using (l_orderkey)"""


ORACLE["sketched_percentiles_lineitem"] = """select "column", p, true within_error
from (values ('l_orderkey'), ('l_partkey'), ('l_suppkey'), ('l_linenumber'), ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) c("column"),
  (select unnest([0.05, 0.25, 0.50, 0.75, 0.95, 0.99]::double[]) p)"""
ORACLE["profile_sketched_lineitem"] = f"""with {LINEITEM} select "column", analytic_type, "rows", nulls, {S.mean("mean")},
  round(std, 6) std, round("min", 6) "min", round("max", 6) "max", zeros, negatives, chart, true in_order from profile"""
ORACLE["odd_rows_top_wide"] = f"select * from ({ORACLE['odd_rows_wide']}) where \"rank\" <= 200"
ORACLE["csv_round_trip_documents"] = """select doc_id, sha256(coalesce(text, '')) text_sha256, coalesce(lang, '') lang, coalesce(source, '') source from documents"""
