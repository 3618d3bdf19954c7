"""Readers and writers of match logs: yearly CSV files, TSV, JSON, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import types as T

# fixed values: numeric and text columns of the raw logs that the engine reads
TEXT_COLUMNS = (
    "gameid", "datacompleteness", "league", "split", "patch", "side", "position", "teamname", "teamid", "playername", "playerid", "champion",
    "pick1", "pick2", "pick3", "pick4", "pick5", "ban1", "ban2", "ban3", "ban4", "ban5",
)
NUMBER_COLUMNS = (
    "teamkills", "teamdeaths", "team kpm", "ckpm", "firstblood", "firstdragon", "dragons", "opp_dragons", "firstherald", "heralds", "opp_heralds",
    "firstbaron", "barons", "opp_barons", "firsttower", "towers", "opp_towers", "dpm", "wpm", "vspm", "earned gpm", "cspm", "golddiffat10", "xpdiffat10",
    "csdiffat10", "golddiffat15", "xpdiffat15", "csdiffat15", "turretplates", "opp_turretplates", "gamelength", "kills", "deaths", "assists",
    "damageshare", "earnedgoldshare", "visionscore", "earnedgold", "damagetochampions",
)
WHOLE_COLUMNS = ("year", "playoffs", "game", "firstPick", "result")


def typed(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The declared columns with their types, and those to keep: missing ones null, NaN null,
    bad times null, the patch kept as text (as a number 16.10 would become 16.1)."""
    have = {c.strip(): c for c in df.columns}
    col = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")
    number = lambda c: F.nanvl(F.expr("cast(null as double)") if c not in have else col(c).try_cast("double"), F.lit(None).cast("double"))
    return df.select(
        *keep,
        *(F.nullif(F.trim(col(c).cast("string")), F.lit("")).alias(c) for c in TEXT_COLUMNS),
        F.try_to_timestamp(col("date").cast("string")).alias("date"),
        *(col(c).try_cast("double").cast("int").alias(c) for c in WHOLE_COLUMNS),
        *(number(c).alias(c.replace(" ", "_")) for c in NUMBER_COLUMNS),
    )


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return [p for p in paths if path(p).getFileSystem(conf).exists(path(p))]


def read_logs(spark: SparkSession, paths: list[str], marks: tuple[str, ...] = ("gameid", "datacompleteness")) -> DataFrame:
    """typed() rows of CSV files with headers of their own, with `file` and `corrupt` (the
    line, where it has not as many fields as its file's header); missing files are skipped.

    All files are one scan of lines.  A line that names the `marks` is a header; where each
    column stands in it is found once for each file and joined to that file's lines.
    Fields may be quoted; a field doesn't reach over lines.
    """
    found = _existing(spark, paths)
    if not found:
        raise FileNotFoundError(f"none of {paths} exists")
    lines = spark.read.text(found).select("value", F.col("_metadata.file_path").alias("file")).filter("trim(value) <> ''")
    quoted = F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, '^\\s*"(.*)"\\s*$', "$1"), '""', '"')
    fields = F.when(F.col("value").contains('"'), F.transform(quoted, bare)).otherwise(F.split("value", ",", -1))
    lines = lines.withColumn("fields", fields)
    names = F.transform("fields", lambda x: F.trim(F.regexp_replace(x, "^\ufeff", "")))
    is_header = F.lit(True)
    for mark in marks:
        is_header &= F.array_contains(names, mark)
    wanted = [*TEXT_COLUMNS, "date", *WHOLE_COLUMNS, *NUMBER_COLUMNS]
    at = F.struct(*(F.coalesce(F.array_position(F.col("names"), c) - 1, F.lit(-1)).cast("int").alias(f"p{i}") for i, c in enumerate(wanted)))
    headers = lines.filter(is_header).groupBy("file").agg(F.first(names).alias("names")).select("file", F.size("names").alias("n"), at.alias("at"))
    rows = lines.filter(~is_header).join(headers, "file")  # files without a header have no columns
    get = lambda i: F.when(F.col(f"at.p{i}") >= 0, F.get("fields", F.col(f"at.p{i}")))
    wide = rows.select("file", F.when(F.size("fields") != F.col("n"), F.col("value")).alias("corrupt"), *(get(i).alias(c) for i, c in enumerate(wanted)))
    return typed(wide, ("file", "corrupt"))


def read_games(spark: SparkSession, paths: list[str], complete_only: bool = True) -> DataFrame:
    """The rows of yearly CSV files, each with the columns it has; missing files are skipped."""
    out = read_logs(spark, paths).drop("file", "corrupt")
    return out.filter("datacompleteness = 'complete'") if complete_only else out


def team_rows(log: DataFrame) -> DataFrame:
    return log.filter("position = 'team' AND teamname IS NOT NULL AND result IS NOT NULL AND date IS NOT NULL")


def player_rows(log: DataFrame) -> DataFrame:
    return log.filter("position <> 'team' AND playerid IS NOT NULL")


def drafted(log: DataFrame) -> DataFrame:
    """(gameid, teamname): champs, picks and bans of games with exactly two team rows;
    picks and champs stand in for each other where one is empty."""
    teams = team_rows(log)
    whole = teams.groupBy("gameid").agg(F.count("*").alias("n")).filter("n = 2").select("gameid")
    lists = teams.join(whole, "gameid", "left_semi").select(
        "gameid",
        "teamname",
        *(F.filter(F.array(*(f"{kind}{i}" for i in range(1, 6))), lambda x: x.isNotNull()).alias(f"{kind}s") for kind in ("pick", "ban")),
    )
    slots = F.array(*(F.lit(p) for p in ("top", "jng", "mid", "bot", "sup")))
    played = log.filter("position <> 'team' AND champion IS NOT NULL").groupBy("gameid", "teamname").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.array_position(slots, F.col("position")).alias("k"), "champion"))), lambda x: x["champion"]).alias("champs")
    )
    out = lists.join(played, ["gameid", "teamname"], "left")
    champs = F.coalesce("champs", F.array().cast("array<string>"))
    return out.select(
        "gameid",
        "teamname",
        F.when(F.size(champs) > 0, champs).otherwise(F.col("picks")).alias("champs"),
        F.when(F.size("picks") > 0, F.col("picks")).otherwise(champs).alias("picks"),
        "bans",
    )


def pair_rows(teams: DataFrame) -> DataFrame:
    """One row for each game with exactly two sides, blue first; keeps the first row of a repeated side."""
    first = Window.partitionBy("gameid", "side").orderBy("date", "teamname")
    rows = teams.withColumn("k", F.row_number().over(first)).filter("k = 1")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return rows.groupBy("gameid").agg(
        F.min("date").alias("date"),
        F.first("league").alias("league"),
        pick("Blue", "teamname").alias("team_a"),
        pick("Red", "teamname").alias("team_b"),
        pick("Blue", "result").alias("result"),
        F.count("*").alias("sides"),
    ).filter("sides = 2 AND team_a IS NOT NULL AND team_b IS NOT NULL").drop("sides")


STAFF_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("Date_Sort", "Date Sort", "Player", "Direction", "Team", "Roles")])


def read_staff_changes(spark: SparkSession, path: str, roles_like: str = "Coach") -> DataFrame:
    """team, person, day, direction, rank of JSON rows whose role list has a coach."""
    from ..functions.scalars import date_prefix, role_rank

    raw = spark.read.schema(STAFF_SCHEMA).json(path)
    day = date_prefix(F.coalesce(F.col("`Date Sort`"), F.col("Date_Sort")))
    held = F.exists(F.split("Roles", ","), lambda r: F.trim(r).endswith(roles_like))
    rows = raw.filter(held).select(F.col("Team").alias("team"), F.col("Player").alias("person"), day.alias("day"), F.col("Direction").alias("direction"), role_rank(F.col("Roles")).alias("rank"))
    return rows.withColumn("event_id", F.xxhash64("team", "person", "day", "direction", "rank"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, in a single file: for small tables."""
    df.coalesce(1).write.mode("overwrite").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """json: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def parsed_rows(df: DataFrame, schema: str) -> DataFrame:
    """The rows of a column json, back in columns."""
    return df.select(F.from_json("json", schema).alias("x")).select("x.*")


class PagedSource(DataSource):
    """Rows of a source that hands out pages of JSON objects: spark.read.format("paged").

    Options: module and function of a Python function fetch(offset, limit), with further
    options as keywords, that returns JSON strings; page_rows; tasks, which share the
    pages.  How many pages there are needn't be known: a task takes every `tasks`-th page
    until it gets a short one.  Where filters on columns of the reader's schema can be left
    to the source, it gets them as `where`: (column, operation, value) for =, <, <=, >, >=,
    in, ends and known; Spark applies the rest.  A failed page is asked for again after
    waits that double from `wait` seconds up to fifty times that.  Without a schema the
    columns are page and json.
    """

    OWN = ("module", "function", "page_rows", "pages", "tasks", "wait", "path")

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "page int, json string"

    def reader(self, schema):
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    SIMPLE = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "In": "in", "StringEndsWith": "ends"}

    def __init__(self, options, schema=None):
        self.options, self.where = dict(options), []
        self.names = schema.fieldNames() if schema is not None else ["page", "json"]
        self.plain = set(self.names) <= {"page", "json"}

    def pushFilters(self, filters):
        for f in filters:
            kind = type(f).__name__
            if self.plain:
                yield f
            elif len(getattr(f, "attribute", ())) == 1 and kind in self.SIMPLE:
                self.where.append((f.attribute[0], self.SIMPLE[kind], list(f.value) if kind == "In" else f.value))
            elif kind == "IsNotNull" and len(f.attribute) == 1:
                self.where.append((f.attribute[0], "known", None))
            else:
                yield f

    def partitions(self):
        return [InputPartition(k) for k in range(int(self.options.get("tasks", "4")))]

    def _page(self, number: int, rows: int) -> list[str]:
        import importlib
        import time

        fetch = getattr(importlib.import_module(self.options["module"]), self.options["function"])
        more = {k: v for k, v in self.options.items() if k not in PagedSource.OWN}
        if self.where:
            more["where"] = self.where
        wait = float(self.options.get("wait", "15"))
        most = 50 * wait
        while True:
            try:
                return fetch(number * rows, rows, **more)
            except OSError:
                if wait > most:
                    raise
                time.sleep(wait)
                wait *= 2

    def read(self, partition):
        import json

        rows, tasks = int(self.options.get("page_rows", "500")), int(self.options.get("tasks", "4"))
        number = partition.value
        while True:
            page = self._page(number, rows)
            for row in page:
                given = {"page": number, "json": row} if self.plain else json.loads(row)
                yield tuple(given.get(n) for n in self.names)
            if len(page) < rows:
                return
            number += tasks


def read_paged(spark: SparkSession, schema: str | None = None, **options) -> DataFrame:
    """The rows of a PagedSource, whose filters reach the source."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("paged").options(**options)
    return (reader.schema(schema) if schema else reader).load()


def stage_pages(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON lines in files of a folder, in order, for fetch_staged()."""
    ordered = df.orderBy(*order)
    ordered.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


#: of each (folder, conditions): rows handed out so far, and the file and byte behind them
_REACHED: dict[tuple[str, str], tuple[int, int, int]] = {}


def fetch_staged(offset: int, limit: int, folder: str, where: list = ()) -> list[str]:
    """A page of the rows of stage_pages() that fit `where`.

    A later page goes on where the one before ended, so a process that asks for pages in
    order reads the files once; an earlier page starts anew."""
    import glob
    import json

    test = {
        "=": lambda x, v: x == v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v,
        "in": lambda x, v: x in v, "ends": lambda x, v: x.endswith(v), "known": lambda x, v: True,
    }
    key = (folder, repr(where))
    done, file, byte = _REACHED.get(key, (0, 0, 0))
    if done > offset:
        done, file, byte = 0, 0, 0
    names = sorted(glob.glob(f"{folder.removeprefix('file://')}/part-*"))
    page: list[str] = []
    while file < len(names) and done < offset + limit:
        with open(names[file], "rb") as f:
            f.seek(byte)
            for line in f:
                byte += len(line)
                row = json.loads(line)
                if all(row.get(c) is not None and test[op](row[c], v) for c, op, v in where):
                    done += 1
                    if done > offset:
                        page.append(line.decode())
                    if done == offset + limit:
                        break
            else:
                file, byte = file + 1, 0
    _REACHED[key] = done, file, byte
    return page


def read_tsv(spark: SparkSession, path: str, schema: str = "team string, year int, coach string") -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small dimension table as one sorted file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_features(df: DataFrame, path: str, partition: str | None = "year") -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(path)


def write_results(df: DataFrame, path: str, event: str | None = None, year: int | None = None) -> str:
    """A result table as CSV; an event's name and year go into the path."""
    to = f"{path}_{event}_{year}" if event else path
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(to)
    return to


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, known, mean, std, distinct values of each column, in one pass."""
    parts = [F.struct(F.lit(c).alias("name"), F.count(c).alias("known"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.count_distinct(c).alias("values")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
