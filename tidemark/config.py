"""Parameters of a saturation study."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StudyConfig:
    """Every tunable of the analysis, with the published defaults."""

    # store selection
    percentile: float = 0.95
    top_n: int = 30
    # one brand, or a fixed list of stores, of those selected
    store_name: str | None = None
    stores: tuple[int, ...] | None = None
    # the stores of the charts; the top_n busiest if not given
    chart_stores: tuple[int, ...] | None = None
    # working hours, [open_hour, close_hour)
    open_hour: int = 7
    close_hour: int = 21
    # minutes at which a KPI counts as degraded
    wtp_limit: float = 15.0
    prep_limit: float = 30.0
    # level ranges: (0, 5], (5, 10], ... (45, 50], above 50
    range_width: int = 5
    range_cap: int = 50
    # suggestion rules
    increase_wtp: float = 7.5
    follow_up_share: float = 0.05
    critical_share: float = 0.10
    # outcome labels in final_status
    delivered_status: str = "DeliveredStatus"
    canceled_status: str = "CanceledStatus"
    # report R² of avg_min_wtp under the accept and preparation labels as well
    compat_labels: bool = False
    # keep cancelled orders in the level-range report
    include_cancels: bool = False
    # leave out orders whose log rows disagree
    quarantine: bool = False
    # rows of the sample behind the scatter chart
    scatter_rows: int = 5000

    def __post_init__(self) -> None:
        if not 0.0 <= self.percentile <= 1.0:
            raise ValueError("percentile must lie in [0, 1]")
        if not 0 <= self.open_hour < self.close_hour <= 24:
            raise ValueError("working hours must satisfy 0 <= open < close <= 24")
        if self.range_width < 1 or self.range_cap % self.range_width:
            raise ValueError("range_cap must be a multiple of range_width")
        if self.top_n < 1 or self.scatter_rows < 1:
            raise ValueError("top_n and scatter_rows must be positive")

    @property
    def open_minute(self) -> int:
        return self.open_hour * 60

    @property
    def close_minute(self) -> int:
        return self.close_hour * 60

    @property
    def hours(self) -> list[int]:
        return list(range(self.open_hour, self.close_hour))
