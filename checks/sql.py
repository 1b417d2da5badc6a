"""SQL text that states the same results for DuckDB."""

from __future__ import annotations

NUMERIC = {"int", "bigint", "double"}
TEMPORAL = {"timestamp_ntz", "date"}


def kind_of(physical: str) -> str:
    if physical in NUMERIC:
        return "numeric"
    if physical == "boolean":
        return "boolean"
    return "temporal" if physical in TEMPORAL else "other"


def _column_facts(relation: str, ordinal: int, name: str, physical: str) -> str:
    kind = kind_of(physical)
    label = f"select {ordinal} ordinal, '{name}' \"column\", '{physical}' physical_type, '{kind}' kind,"
    counts = (
        f"count(*) \"rows\", count({name}) non_null,"
        f" count(distinct {name}) + coalesce(max(({name} is null)::int), 0) \"distinct\""
    )
    if kind != "numeric":
        gaps = ", ".join(
            f"null::double {n}"
            for n in ("mean", "q1", "median", "q3", "min", "max", "std", "skewness", "kurtosis")
        )
        whole = ", ".join(
            f"null::bigint {n}" for n in ("zeros", "negatives", "outliers_iqr", "outliers_z", "finite")
        )
        return f"{label} {counts}, {gaps}, {whole}, null::double finite_mean, null::double finite_std from {relation}"
    f = f"case when isfinite({name}::double) then {name}::double end"
    return f"""{label} b."rows", b.non_null, b."distinct", b.mean,
      case when b.finite >= 4 then b.q1 end q1, b.median, case when b.finite >= 4 then b.q3 end q3,
      b.lo "min", b.hi "max", b.std,
      case when b.finite >= 4 and b.sp > 0 then b.s3 end skewness,
      case when b.finite >= 4 and b.sp > 0 then b.s4 - 3 end kurtosis,
      b.zeros, b.negatives,
      case when b.finite < 4 then null when b.q3 > b.q1 then b.oi else 0 end outliers_iqr,
      case when b.finite < 4 then null when b.sp > 0 then b.oz else 0 end outliers_z,
      b.finite, b.mf finite_mean, b.sp finite_std
    from (
      select any_value(a."rows") "rows", any_value(a.non_null) non_null, any_value(a."distinct") "distinct",
        any_value(a.mf) mean, any_value(a.mf) mf, any_value(a.q1) q1, any_value(a.q3) q3, any_value(a.median) median,
        any_value(a.lo) lo, any_value(a.hi) hi, any_value(a.std) std, any_value(a.sp) sp,
        any_value(a.finite) finite, any_value(a.zeros) zeros, any_value(a.negatives) negatives,
        avg(case when a.sp > 0 then pow((x.f - a.mf) / a.sp, 3) end) s3,
        avg(case when a.sp > 0 then pow((x.f - a.mf) / a.sp, 4) end) s4,
        count(*) filter (where x.f < a.q1 - 1.5::double * (a.q3 - a.q1) or x.f > a.q3 + 1.5::double * (a.q3 - a.q1)) oi,
        count(*) filter (where a.sp > 0 and abs((x.f - a.mf) / a.sp) >= 3) oz
      from (select {counts}, avg({f}) mf, stddev_pop({f}) sp, stddev_samp({f}) std,
              quantile_cont({f}, 0.25) q1, quantile_cont({f}, 0.5) median, quantile_cont({f}, 0.75) q3,
              min({f}) lo, max({f}) hi, count({f}) finite,
              count(*) filter (where {f} = 0) zeros, count(*) filter (where {f} < 0) negatives
            from {relation}) a
      left join (select {f} f from {relation}) x on true) b"""


def profile_with(source_sql: str, columns: list[tuple[str, str]]) -> str:
    """WITH items ``src``, ``facts`` and ``profile`` of a table."""
    facts = "\nunion all\n".join(_column_facts("src", i, n, t) for i, (n, t) in enumerate(columns))
    return f"""src as materialized ({source_sql}),
facts as materialized ({facts}),
typed as (
  select *, "rows" - non_null nulls,
    case when "rows" > 0 then ("rows" - non_null)::double / "rows" * 100 else 0 end null_pct,
    case when "rows" > 0 then "distinct"::double / "rows" * 100 else 0 end distinct_pct,
    q3 - q1 iqr,
    case when kind <> 'other' then kind
         when "distinct" <= 50 or "rows" = 0 or "distinct"::double / "rows" <= 0.2::double then 'categorical'
         else 'text_id' end analytic_type
  from facts),
profile as materialized (
  select *, case when analytic_type = 'numeric' then 'histogram_boxplot'
         when analytic_type = 'temporal' then 'time_line'
         when analytic_type = 'boolean' then 'bars'
         when analytic_type = 'categorical' then case when "distinct" <= 20 then 'bars' else 'bars_top20' end
         when "distinct" = "rows" then 'skip_possible_id' else 'frequency_top20' end chart
  from typed)"""


ID_WORDS = (
    "id|codigo|código|cod_|^cod|cedula|cédula|dni|ruc|uuid|tramite|trámite|secuencia|numero|número"
)

SCORED = f"""scored0 as (
  select p.*, "rows" = 0 or non_null = 0 is_empty,
    coalesce("distinct", 0) d, coalesce(distinct_pct, 0) dp, analytic_type = 'numeric' is_num,
    regexp_matches(lower("column"), '{ID_WORDS}') and coalesce(distinct_pct, 0) >= 70 id_named
  from profile p),
scored1 as (
  select *, d > 1 and d <= 2 and is_num two_valued,
    not id_named and analytic_type = 'text_id' and dp >= 80 free_text,
    not id_named and analytic_type = 'text_id' and dp < 80 other_text,
    analytic_type = 'categorical' and (d > 1000 or dp >= 50) scattered,
    is_num and not coalesce(std > 0, false) flat,
    is_num and coalesce(outliers_iqr, 0) > 0 has_out
  from scored0),
scored2 as (
  select *, 1.0::double
      - case when null_pct >= 70 then 0.55::double when null_pct >= 40 then 0.25::double else 0.0::double end
      - case when two_valued then 0.25::double else 0.0::double end
      - case when id_named then 0.55::double when free_text then 0.45::double when other_text then 0.2::double else 0.0::double end
      - case when scattered then 0.3::double else 0.0::double end
      - case when has_out then 0.03::double else 0.0::double end
      - case when analytic_type = 'temporal' then 0.05::double else 0.0::double end kept,
    case when null_pct >= 70 then 3 when null_pct >= 40 then 2 else 1 end l1
  from scored1),
scored3 as (select *, case when d <= 1 then 3 when two_valued and l1 = 1 then 2 else l1 end l2 from scored2),
scored4 as (select *, case when id_named then 2 when free_text and l2 = 1 then 2 else l2 end l3 from scored3),
scored5 as (select *, case when scattered and l3 = 1 then 2 else l3 end l4 from scored4),
scored as materialized (
  select *, case when is_empty or null_pct >= 95 or d <= 1 or flat then 0.0::double
         else greatest(0.0::double, least(1.0::double, kept)) end score,
    case when is_empty or flat then 'high' when l4 = 3 then 'high' when l4 = 2 then 'medium' else 'low' end risk
  from scored5)"""


def pairs_with(columns: list[str], relation: str = "src", threshold: float = 0.70) -> str:
    """WITH items ``pairs`` and ``strong`` over the given columns of a relation."""
    parts = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            parts.append(
                f"select {i} i, {j} j, '{a}' column_1, '{b}' column_2,"
                f" case when count(*) >= 2 and var_pop(x) > 0 and var_pop(y) > 0"
                f" then covar_pop(x, y) / (sqrt(var_pop(x)) * sqrt(var_pop(y))) end r"
                f" from (select {a}::double x, {b}::double y from {relation}"
                f" where isfinite({a}::double) and isfinite({b}::double))"
            )
    return f"""pairs as materialized ({" union all ".join(parts)}),
strong as materialized (
  select row_number() over (order by round(abs(r), 9) desc, i, j) "rank", i, j, column_1, column_2, r, abs(r) abs_r,
    case when abs(r) >= 0.9::double then 'very_strong' when abs(r) >= 0.7::double then 'strong'
         when abs(r) >= 0.5::double then 'moderate' when abs(r) >= 0.3::double then 'low' else 'very_low' end
    || case when r > 0 then '_positive' when r < 0 then '_negative' else '_none' end strength
  from pairs where abs(r) >= {threshold}::double)"""


def groups_with(threshold: float = 0.70, min_size: int = 3) -> str:
    """WITH RECURSIVE items ``edges``, ``reach`` and ``groups``."""
    return f"""edges as (
  select column_1 a, column_2 b from strong where abs_r >= {threshold}::double
  union select column_2, column_1 from strong where abs_r >= {threshold}::double),
reach(node, other) as (
  select a, a from edges union select r.node, e.b from reach r join edges e on e.a = r.other),
labels as (select node, min(other) label from reach group by node),
members as (
  select label, count(*) size, string_agg(node, '; ' order by node) columns from labels
  group by label having count(*) >= {min_size}),
ties as (
  select l.label, avg(s.abs_r) mean_abs_r, min(s.abs_r) min_abs_r
  from strong s join labels l on l.node = s.column_1 where s.abs_r >= {threshold}::double group by l.label),
groups as (
  select row_number() over (order by m.size desc, m.label) "group", m.size, t.mean_abs_r, t.min_abs_r, m.columns
  from members m join ties t using (label))"""


def selection_with(min_score: float = 0.55, with_pairs: bool = True) -> str:
    """WITH item ``selection``; needs ``scored`` and, with pairs, ``strong``."""
    t = f"{min_score}::double"
    review = f"{max(min_score * 0.75, 0.40)!r}::double"
    if with_pairs:
        partner = """ends as (
  select "rank", abs_r, column_1 c, column_2 o from strong union all
  select "rank", abs_r, column_2, column_1 from strong),
partners as (select c, arg_min(abs_r, "rank") max_correlation, arg_min(o, "rank") correlated_with from ends group by c),
losers as (
  select s."rank", s.abs_r,
    case when coalesce(a.score, 0) >= coalesce(b.score, 0) then column_2 else column_1 end c,
    case when coalesce(a.score, 0) >= coalesce(b.score, 0) then column_1 else column_2 end o
  from strong s left join scored a on a."column" = s.column_1 left join scored b on b."column" = s.column_2
  where s.abs_r >= 0.98::double),
repeated as (select c, arg_min(o, "rank") repeats from losers group by c),"""
    else:
        partner = """partners as (select ''::varchar c, null::double max_correlation, null::varchar correlated_with where false),
repeated as (select ''::varchar c, null::varchar repeats where false),"""
    return f"""{partner}
chosen as (
  select s.ordinal, s."column", s.analytic_type, s.null_pct, s.distinct_pct, p.max_correlation,
    p.correlated_with, r.repeats,
    case when r.c is not null then least(s.score, greatest({t} - 0.01::double, 0)) else s.score end score,
    case when r.c is not null then 'medium' else s.risk end risk
  from scored s left join partners p on p.c = s."column" left join repeated r on r.c = s."column"),
decided as (
  select *, case when score >= {t} then 'use' when score >= {review} then 'review' else 'drop' end decision
  from chosen),
selection as materialized (
  select row_number() over (order by case decision when 'use' then 0 when 'review' then 1 else 2 end, score desc, ordinal) "position", *
  from decided)"""


def mean(name: str) -> str:
    return f"case when abs({name}) < 1 then round({name}, 8) else round({name}, 6) end {name}"


PROFILE_OUT = f"""select ordinal, "column", physical_type, analytic_type, "rows", non_null, nulls,
  round(null_pct, 6) null_pct, "distinct", round(distinct_pct, 6) distinct_pct,
  {mean("mean")}, round(q1, 6) q1, round(median, 6) median, round(q3, 6) q3,
  round("min", 6) "min", round("max", 6) "max", round(std, 6) std, round(iqr, 6) iqr,
  round(skewness, 6) skewness, round(kurtosis, 6) kurtosis, zeros, negatives,
  outliers_iqr, outliers_z, chart from profile"""
