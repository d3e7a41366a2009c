"""Run parameters and the reference's fixed operating values."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# Fixed values that results depend on (taken from the reference's defaults):
#   look-back of the peak: 5 minutes
#   sample length implied by the utilisation ratio: 30 seconds (divisor base x 1000 x 30)
#   target headroom: 0.8 x move threshold
#   deployed move / recovery thresholds: 0.8 / 0.7
#   suffix of a moved model's copy: "_LB"
DEFAULT_LOOKBACK = dt.timedelta(minutes=5)
SAMPLE_MS = 1000 * 30
DEFAULT_HEADROOM = 0.8
DEFAULT_MOVE_THRESHOLD = 0.8
DEFAULT_RECOVERY_THRESHOLD = 0.7
COPY_SUFFIX = "_LB"


@dataclass(frozen=True)
class RunParams:
    """One balancing run: the clock it is evaluated at and its look-back.

    ``as_of`` is always passed in (never the wall clock) so that a run can be
    replayed and an oracle can reproduce it.
    """

    as_of: dt.datetime
    lookback: dt.timedelta = DEFAULT_LOOKBACK
    run_id: str = "run-0"
    metric: str = "overall"  # or "interactive_share"
    extra: dict = field(default_factory=dict)

    @property
    def lookback_seconds(self) -> int:
        return int(self.lookback.total_seconds())

    @property
    def window_start(self) -> dt.datetime:
        return self.as_of - self.lookback
