"""Log files with drifting headers, and sources that hand out pages."""

import json

import pytest
from pyspark.sql import functions as F

from rankvane.sources import logs

ROWS = [{"id": k, "role": ["Head Coach", "Player", "Coach", None][k % 4], "day": f"2020-01-{k % 28 + 1:02d}"} for k in range(105)]


def fetch(offset, limit, log, where=()):
    with open(log, "a") as f:
        f.write(json.dumps([offset, limit, where]) + "\n")
    ops = {"ends": str.endswith, ">=": lambda x, v: x >= v, "=": lambda x, v: x == v, "known": lambda x, v: True, "in": lambda x, v: x in v}
    return [json.dumps(r) for r in ROWS if all(r[c] is not None and ops[o](r[c], v) for c, o, v in where)][offset : offset + limit]


def asked(path):
    return [json.loads(line) for line in path.read_text().splitlines()]


@pytest.mark.parametrize("tasks, rows", [("1", "10"), ("4", "7"), ("3", "105"), ("2", "35"), ("5", "1000")])
def test_pages_until_a_short_one(spark, tmp_path, tasks, rows):
    log = tmp_path / "log"
    df = logs.read_paged(spark, "id long, role string", module="tests.test_sources", function="fetch", page_rows=rows, tasks=tasks, log=str(log))
    assert sorted((r.id, r.role) for r in df.collect()) == [(r["id"], r["role"]) for r in ROWS]
    pages = asked(log)
    assert len({p[0] for p in pages}) == len(pages) <= -(-105 // int(rows)) + int(tasks)


def test_filters_reach_the_source(spark, tmp_path):
    log = tmp_path / "log"
    df = logs.read_paged(spark, "id long, role string, day string", module="tests.test_sources", function="fetch", page_rows="10", tasks="2", log=str(log))
    got = df.filter(F.col("role").endswith("Coach") & (F.col("day") >= "2020-01-10") & (F.col("id") % 3 == 0))
    want = [r["id"] for r in ROWS if (r["role"] or "").endswith("Coach") and r["day"] >= "2020-01-10" and r["id"] % 3 == 0]
    assert sorted(r.id for r in got.collect()) == want and want
    assert all(["role", "ends", "Coach"] in where and ["day", ">=", "2020-01-10"] in where for *_, where in asked(log))


def test_headers_drift(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿gameid, datacompleteness ,league,teamname,position,result,date,patch\ng1,complete,"L, ""one""",X,team,1,2020-01-01,16.10\n\ng2,complete,L,,team,0,2020-01-02,\ng3,complete,L,Y\n')
    (tmp_path / "b.csv").write_text("result,extra,position,gameid,datacompleteness,dragons\n1,z,team,g4,complete,NaN\n0,z,top,g5,partial,2.5,more\n")
    (tmp_path / "c.csv").write_text("no header at all\n1,2,3\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "gone.csv", "b.csv", "c.csv")]
    got = {r.gameid: r for r in logs.read_logs(spark, paths).collect()}
    assert sorted(got) == ["g1", "g2", "g3", "g4", "g5"]
    assert (got["g1"].league, got["g1"].teamname, got["g1"].patch, got["g1"].result) == ('L, "one"', "X", "16.10", 1)
    assert got["g2"].teamname is None and got["g2"].patch is None and got["g3"].teamname == "Y" and got["g3"].position is None
    assert (got["g4"].result, got["g4"].position, got["g4"].dragons, got["g4"].league) == (1, "team", None, None)
    assert got["g5"].dragons == 2.5 and {k for k, r in got.items() if r.corrupt} == {"g3", "g5"}
    assert got["g5"].file.endswith("b.csv")
    assert {r.gameid for r in logs.read_games(spark, paths).collect()} == {"g1", "g2", "g3", "g4"}
    with pytest.raises(FileNotFoundError):
        logs.read_games(spark, [paths[1]])
    plan = logs.read_logs(spark, paths)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_staged_pages_are_read_once(tmp_path, monkeypatch):
    rows = [{"id": k, "role": "ab"[k % 2]} for k in range(2000)]
    for part in range(4):
        (tmp_path / f"part-{part}").write_text("".join(json.dumps(r) + "\n" for r in rows[part * 500 : part * 500 + 500]))
    seen, loads = [], json.loads
    monkeypatch.setattr(json, "loads", lambda line: seen.append(1) or loads(line))
    where, got, page = [("role", "=", "a")], [], None
    while page is None or len(page) == 30:
        page = logs.fetch_staged(len(got), 30, f"file://{tmp_path}", where)
        got += page
    assert [loads(line)["id"] for line in got] == list(range(0, 2000, 2)) and len(seen) == 2000
    assert [loads(line)["id"] for line in logs.fetch_staged(60, 2, str(tmp_path), where)] == [120, 122]
    assert [loads(line)["id"] for line in logs.fetch_staged(30, 2, str(tmp_path), where)] == [60, 62]
    assert logs.fetch_staged(5000, 2, str(tmp_path), where) == []
