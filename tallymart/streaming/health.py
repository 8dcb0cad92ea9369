"""URL health as a stream: three values of state for each listing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallymart.operators.health import NOT_FOUND_DEAD, TIMEOUTS_DEAD

SCHEMA = "listing_id long, timeouts int, not_found int, is_dead boolean"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    timeouts, missing, dead = state.get if state.exists else (0, 0, False)
    for event in pd.concat(list(batches)).sort_values(["captured_at", "event_id"]).itertuples():
        if event.outcome == "scraped":
            timeouts = missing = 0
        elif event.error_code == "playwright_timeout":
            timeouts, missing = timeouts + 1, 0
            dead = dead or timeouts >= TIMEOUTS_DEAD
        elif event.error_code == "product_not_found":
            timeouts, missing = 0, missing + 1
            dead = dead or missing >= NOT_FOUND_DEAD
        elif event.error_code == "price_not_found":
            timeouts = 0
    state.update((timeouts, missing, dead))
    yield pd.DataFrame({"listing_id": [key[0]], "timeouts": [timeouts], "not_found": [missing], "is_dead": [dead]})


def health_stream(outcomes: DataFrame) -> DataFrame:
    """The state of each listing after each micro-batch that touches it, from a streaming DataFrame of outcomes."""
    return outcomes.groupBy("listing_id").applyInPandasWithState(_update, SCHEMA, "timeouts int, not_found int, is_dead boolean", "update", GroupStateTimeout.NoTimeout)
