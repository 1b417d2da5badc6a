from .kinds import (
    analytic_type,
    is_numeric,
    numeric_columns,
    numeric_names,
    suggested_chart,
)
from .scalars import (
    abbreviate,
    clamp,
    cluster_count,
    correlation_strength,
    finite,
    fixed_decimals,
    html_text,
    looks_like_id,
    relative_range,
    severity_rank,
    variation_coefficient,
    whole_number,
    zscore,
)
