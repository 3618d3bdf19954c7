"""Everything that looks back along a team's own games, in one pass.

As windows, each frame copies its rows, and a row carries the lists of its last games
through every sort.  Here the games are dealt by team and sorted, and stream through
their tasks: a task holds a batch of games, and the last ones before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import BUFFER, ORDER

#: games that a win rate on a side looks back on
SIDED = 60


def moving_means(x: np.ndarray, known: np.ndarray, place: np.ndarray, last: int) -> list[pa.Array]:
    """For each column of x the mean of its known values in the `last` rows before each row
    that are of its team, by its `place` there; null if there is none.  Added up oldest first."""
    means, n = moving(x, known, place, last)
    return [pa.array(m, mask=k == 0) for m, k in zip(means, n)]


def moving(x: np.ndarray, known: np.ndarray, place: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """moving_means() and the numbers of known values, a row for each column of x."""
    rows = len(x)
    clean = np.ascontiguousarray(np.where(known, x, 0.0).T)
    total = np.zeros(clean.shape)
    for back in range(last, 0, -1):
        if back < rows:
            total[:, back:] += clean[:, :-back]
    young = np.flatnonzero(place < last)  # rows whose window would reach another team
    own = np.zeros((len(clean), len(young)))
    for back in range(last, 0, -1):
        own += np.where(place[young] >= back, clean[:, np.maximum(young - back, 0)], 0.0)
    total[:, young] = own
    n = _before(known.T, np.arange(rows) - np.minimum(place, last))
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / n, n


def _before(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row the sum of x, which are whole numbers, from the row `start` to the one before; along the last axis."""
    sums = np.concatenate([np.zeros((*x.shape[:-1], 1), np.int64), np.cumsum(x, axis=-1, dtype=np.int64)], axis=-1)
    return sums[..., np.arange(x.shape[-1])] - sums[..., np.maximum(start, 0)]


class _Lists:
    """A column of lists as pairs of row and code; equal members have equal codes, the null is coded `size`."""

    def __init__(self, column: pa.ListArray, codes: np.ndarray, size: int):
        length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.length, self.valid = length, column.is_valid().to_numpy(zero_copy_only=False)
        self.row, self.code, self.size = np.repeat(np.arange(len(length)), length), codes, size

    @staticmethod
    def of(*columns) -> list[_Lists]:
        flat = [c.flatten() for c in columns]
        coded = pa.concat_arrays(flat).dictionary_encode()
        size = len(coded.dictionary)
        codes = coded.indices.cast(pa.int64()).fill_null(size).to_numpy(zero_copy_only=False)
        out, at = [], 0
        for column, members in zip(columns, flat):
            out.append(_Lists(column, codes[at : at + len(members)], size))
            at += len(members)
        return out

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        some = self.code < self.size
        return self.row[some], self.code[some]


def listed(rows: pa.RecordBatch, place: np.ndarray) -> list[pa.Array]:
    """The values of LISTED for rows in order; `place` is a row's number among those of its team,
    of which the last SIDED have to be among the rows."""
    n = rows.num_rows
    at = np.arange(n)
    start = lambda last: np.maximum(at - np.minimum(place, last), 0)
    column = lambda name: rows.column(rows.schema.get_field_index(name))
    champs, bans = _Lists.of(column("champs"), column("opp_bans"))
    (roster,) = _Lists.of(column("roster"))
    end = np.concatenate([np.flatnonzero(place[1:] == 0), [n - 1]])  # the last row of each team
    end = end[np.searchsorted(end, at)]

    # distinct champions of the last 20 games: each counts from its game to its next one, at most 20 games
    picks = np.unique(champs.code * n + champs.row)
    code, row = picks // n, picks % n
    following = np.full(len(picks), n)
    following[:-1][code[1:] == code[:-1]] = row[1:][code[1:] == code[:-1]]
    change = np.zeros(n + 2, np.int64)
    np.add.at(change, row + 1, 1)
    np.add.at(change, np.minimum(np.minimum(row + 20, following), end[row]) + 1, -1)
    diversity = np.cumsum(change)[:n]

    # the oldest weight meets the newest result, see windows.weighted_win_rate()
    result = column("result")
    won, known = result.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), result.is_valid().to_numpy(zero_copy_only=False)
    number = column("game_num").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    weight = np.where(number == 1, 1.0, np.where(number == 2, 1.3, 1.5))
    games = np.minimum(place, 10)
    total, weights = np.zeros(n), np.zeros(n)
    for k in range(10):
        some = np.flatnonzero((games > k) & (at - games >= 0))
        w = weight[some - games[some] + k]
        total[some] += won[some - 1 - k] * w
        weights[some] += w
    seen = _before(known, start(10))
    with np.errstate(invalid="ignore", divide="ignore"):
        weighted = np.where(seen == 0, 0.5, total / weights)
    weighted = pa.array(weighted, mask=(seen > 0) & (seen < games))

    # the roster of the game before
    now = np.unique(roster.row * (roster.size + 1) + roster.code)
    row = now // (roster.size + 1)
    stays = np.isin(now - (roster.size + 1), now) & (place[row] > 0)
    both, different = np.bincount(row[stays], minlength=n), np.bincount(row, minlength=n)
    previous = np.concatenate([[0], roster.length[:-1]])
    told = (roster.length > 0) & (place > 0) & (previous > 0)
    overlap = np.where(told, both / np.maximum(roster.length, 1), 0.5)
    subs = np.where(told, different - both, 0)

    # of the last 60 games those on the own side, of them the last 30
    side = column("side").dictionary_encode()
    code = side.indices.cast(pa.int64()).fill_null(len(side.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    keys = code[order] * n + order
    rank = np.searchsorted(keys, code * n + at)
    first = np.maximum(np.searchsorted(keys, code * n + start(SIDED)), rank - 30)
    sums = np.concatenate([[0.0], np.cumsum(won[order])])
    counts = np.concatenate([[0], np.cumsum(known[order])])
    own, n_known = rank - first, counts[rank] - counts[first]
    none = (own == 0) | (code == len(side.dictionary))
    with np.errstate(invalid="ignore", divide="ignore"):
        rate = np.where(none, 0.5, (sums[rank] - sums[first]) / n_known)
    rate = pa.array(rate, mask=~none & (n_known == 0))

    # games of the last 30 with a champion
    row, code = champs.known()
    keys = np.unique(code * n + row)
    past = start(BUFFER)
    games_with = lambda row, code: np.searchsorted(keys, code * n + row) - np.searchsorted(keys, code * n + past[row])
    with np.errstate(invalid="ignore", divide="ignore"):
        comfort = np.bincount(row, games_with(row, code), minlength=n) / champs.length
    comfort = pa.array(comfort, mask=(champs.length == 0) | (_before(champs.valid, past) == 0))
    row, code = bans.known()
    targeted = pa.array(np.bincount(row, games_with(row, code) > 0, minlength=n).astype(np.int32), mask=~bans.valid)
    return [pa.array(diversity, pa.int32()), weighted, pa.array(overlap), pa.array(subs, pa.int32()), rate, comfort, targeted]


LISTED = "champ_div int, wwr double, roster_overlap double, subs_in int, side_wr double, team_champ_comfort double, ban_target int"
GIVEN = ("side", "result", "game_num", "champs", "opp_bans", "roster")


def team_history(sides: DataFrame, means: dict[int, tuple[str, ...]], made: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """gameid, team and what was known of the team before the game: n_games, wr_5, wr_10,
    wr_20, wr_all, those of LISTED, and avg{n}_{s} for the statistics `means` has for n games.

    `made` has expressions of statistics, which are made behind the shuffle; `parts` is the
    number of tasks, as many as sides has if it is not given."""
    stats = list(dict.fromkeys(s for names in means.values() for s in names))
    made = {n: e for n, e in (made or {}).items() if n in stats}
    given = [c for c in sides.columns if made or c in stats]
    dealt = sides.select(*dict.fromkeys(["gameid", "team", "date", *GIVEN, *given])).repartition(parts or sides.rdd.getNumPartitions(), "team").sortWithinPartitions("team", *ORDER)
    dealt = dealt.select("gameid", "team", *GIVEN, *(F.expr(made[s]).alias(s) if s in made else s for s in stats))
    rates = {"wr_5": 5, "wr_10": 10, "wr_20": 20, "wr_all": BUFFER}
    kept = max(SIDED, *means)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, games = None, 0  # the last rows before the batch, and the place of the first of them
        for b in batches:
            if not b.num_rows:
                continue
            before = tail.num_rows if tail is not None else 0
            if before:
                b = pa.concat_batches([tail, b])
            team = b.column(1).to_numpy()
            at = np.arange(len(team))
            new = np.concatenate([[True], team[1:] != team[:-1]])
            place = at - np.maximum.accumulate(np.where(new, at, 0))
            place += np.where(np.cumsum(new) == 1, games, 0)
            columns = [b.column(b.schema.get_field_index(n)) for n in ("result", *stats)]
            x = np.column_stack([c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
            known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
            out = [b.column(0), b.column(1), pa.array(place)]
            out += [moving_means(x[:, :1], known[:, :1], place, n)[0].fill_null(0.5) for n in rates.values()]
            out += listed(b, place)
            for n, names in means.items():
                some = [1 + stats.index(s) for s in names]
                out += moving_means(x[:, some], known[:, some], place, n)
            yield pa.RecordBatch.from_arrays([c[before:] for c in out], names=names_)
            first = max(0, b.num_rows - kept)
            tail, games = b.slice(first), int(place[first])

    kind = ", ".join(["gameid long, team long, n_games long", *(f"{n} double" for n in rates), LISTED, *(f"avg{n}_{s} double" for n, names in means.items() for s in names)])
    names_ = [f.split()[0] for f in kind.split(", ")]
    return dealt.mapInArrow(fold, kind)


PLAYED = "kda double, streak double, trajectory double, comfort double, on_champ long, pool long, experience long"


def player_history(players: DataFrame, parts: int) -> DataFrame:
    """gameid, team, position and what was known of the player before the game, see PLAYED:
    KDA of the last 10 games; mean result of the last 3 less that of the last 15, 0 with fewer
    than 3; relative change of dpm from the 15 games before to the last 5, 0 under 7 games;
    win rate (0.5 if unknown) and games with the champion; champions and games so far.

    One pass over a player's games in order: a task holds a batch, the last games before it
    and a few numbers for each champion of one player."""
    stats = ("kills", "deaths", "assists", "result", "dpm")
    dealt = players.select("gameid", "team", "position", "player", "date", "champ", *stats).repartition(parts, "player").sortWithinPartitions("player", *ORDER)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, games, had = None, 0, {}  # had: of each champion of the last player games, wins and known results
        for b in batches:
            if not b.num_rows:
                continue
            before = tail.num_rows if tail is not None else 0
            if before:
                b = pa.concat_batches([tail, b])
            column = lambda name, b=b: b.column(b.schema.get_field_index(name))
            own = column("player").dictionary_encode(null_encoding="encode").indices.to_numpy()
            at = np.arange(len(own))
            new = np.concatenate([[True], own[1:] != own[:-1]])
            run = np.cumsum(new) - 1
            place = at - np.maximum.accumulate(np.where(new, at, 0)) + np.where(run == 0, games, 0)
            x = np.column_stack([column(c).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in stats])
            known = np.column_stack([column(c).is_valid().to_numpy(zero_copy_only=False) for c in stats])
            (kills, deaths, assists), n = moving(x[:, :3], known[:, :3], place, 10)
            unknown_kda = (n == 0).any(axis=0)
            (short,), (n_short,) = moving(x[:, 3:4], known[:, 3:4], place, 3)
            (now,), (n_now,) = moving(x[:, 4:], known[:, 4:], place, 5)
            (long, then), (n_long, n_then) = moving(x[:, 3:], known[:, 3:], place, 15)
            then, n_then = (np.where(place >= 5, v[np.maximum(at - 5, 0)], 0) for v in (then, n_then))  # the 15 games before the last 5
            enough = (_before(known[:, 4], at - np.minimum(place, BUFFER)) >= 7) & (n_now > 0) & (n_then > 0) & (np.abs(then) >= 1e-6)
            with np.errstate(invalid="ignore"):
                kda = (kills + assists) / np.maximum(np.where(deaths == 0, 1.0, deaths), 0.5)
                streak = np.where(n_long >= 3, short - long, 0.0)
                trajectory = np.where(enough, (now - then) / (np.abs(then) + 1e-6), 0.0)
            out = [c[before:] for c in (pa.array(kda, mask=unknown_kda), pa.array(streak, mask=(n_long >= 3) & (n_short == 0)), pa.array(trajectory))]

            champ = column("champ").slice(before).dictionary_encode(null_encoding="encode")
            code, names = champ.indices.to_numpy().astype(np.int64), champ.dictionary.to_pylist()
            goes_on = before > 0 and not new[before]
            run = run[before:] - run[before]
            won, told = (x[before:, 3] * known[before:, 3]).astype(np.int64), known[before:, 3].astype(np.int64)
            order = np.argsort(run * len(names) + code, kind="stable")
            keys, i = (run * len(names) + code)[order], np.arange(len(order))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), i, 0))
            counts = np.zeros((3, len(order)), np.int64)
            for k, v in enumerate((np.ones(len(order), np.int64), won, told)):
                upto = np.cumsum(v[order]) - v[order]
                counts[k, order] = upto - upto[first]
            if goes_on:
                counts[:, run == 0] += np.array([had.get(c, (0, 0, 0)) for c in names], np.int64).T[:, code[run == 0]]
            fresh = (counts[0] == 0).astype(np.int64)
            upto = np.cumsum(fresh) - fresh
            pool = upto - upto[np.searchsorted(run, run)] + np.where(goes_on & (run == 0), len(had), 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                comfort = np.where(counts[2] > 0, counts[1] / counts[2], 0.5)
            out += [pa.array(v) for v in (comfort, counts[0], pool, place[before:])]
            had = had if goes_on and run[-1] == 0 else {}
            some = run == run[-1]
            for k in np.unique(code[some]):
                mine = some & (code == k)
                had[names[k]] = tuple(int(c) for c in counts[:, mine][:, -1] + (1, won[mine][-1], told[mine][-1]))
            yield pa.RecordBatch.from_arrays([*(c.slice(before) for c in b.columns[:3]), *out], names=names_)
            first = max(0, b.num_rows - BUFFER)
            tail, games = b.slice(first), int(place[first])

    kind = f"gameid long, team long, position string, {PLAYED}"
    names_ = [f.split()[0] for f in kind.split(", ")]
    return dealt.mapInArrow(fold, kind)


def player_sides(players: DataFrame, lanes: tuple[str, ...], parts: int) -> DataFrame:
    """(gameid, team) with means over the side's players of what was known of each before
    the game, and the best and the weakest KDA.

    Extremes follow the roster's order of positions: unknown where the first player's KDA
    is unknown, else those of the known ones.
    """
    means = {"avg_player_kda": "kda", "avg_player_streak": "streak", "avg_player_trajectory": "trajectory", "avg_champ_comfort": "comfort", "avg_champ_games": "on_champ", "avg_player_pool": "pool", "player_experience": "experience"}
    place = F.array_position(F.array(*map(F.lit, lanes)), F.col("position"))
    by = player_history(players, parts).groupBy("gameid", "team").agg(
        *(F.avg(c).alias(n) for n, c in means.items()), F.min_by(F.col("kda").isNotNull(), place).alias("known"), F.max("kda").alias("most"), F.min("kda").alias("least")
    )
    return by.select("gameid", "team", *means, F.when(F.col("known"), F.col("most")).alias("star_player_kda"), F.when(F.col("known"), F.col("least")).alias("weakest_player_kda"))
