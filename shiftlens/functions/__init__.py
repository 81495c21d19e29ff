from shiftlens.functions.columns import (  # noqa: F401
    clip, days_between, erfc, flag, hour_boundaries_between, hours_between,
    micros_between, normal_two_sided_p, r6, safe_ratio, sum_columns,
)
