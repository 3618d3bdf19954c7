"""The running features as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_form(rows: DataFrame, last: int = 10) -> DataFrame:
    """team, gameid, win_rate and n_games before each game, read before it is recorded.

    `rows` is a stream of team, gameid, date, result.  A team's state are its last
    results and a count, so it stays small however long the stream runs.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        results, count = state.get if state.exists else ([], 0)
        results = list(results)
        out = []
        for batch in batches:
            for row in batch.sort_values(["date", "gameid"]).itertuples():
                out.append((key[0], row.gameid, sum(results) / len(results) if results else 0.5, count))
                results = [*results, int(row.result)][-last:]
                count += 1
        state.update((results, count))
        yield pd.DataFrame(out, columns=["team", "gameid", "win_rate", "n_games"])

    return rows.groupBy("team").applyInPandasWithState(
        step, "team long, gameid long, win_rate double, n_games long", "results array<int>, count long", "append", GroupStateTimeout.NoTimeout
    )


def games_by_window(rows: DataFrame, width: str = "30 days", late: str = "10 days") -> DataFrame:
    """Games and mean result by league and time window; rows later than the watermark are dropped."""
    return rows.withWatermark("date", late).groupBy(F.window("date", width), "league").agg(F.count("*").alias("games"), F.avg("result").alias("mean_result"))
