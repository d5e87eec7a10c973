from __future__ import annotations

from pyspark.sql import functions as F

from tidecue.llm.groups import cells, different, members_mark


def test_a_repeated_member_does_not_cancel_itself(spark):
    rows = [(1, x) for x in (7, 7, 2, 3)] + [(2, x) for x in (9, 9, 2, 3)] + [(3, x) for x in (3, 7, 2, 7)] + [(4, x) for x in (2, 3)]
    sized = spark.createDataFrame(rows, "g int, m long").groupBy("g").agg(F.count(F.lit(1)).alias("size"), *members_mark("m"))
    left = sorted(r["g"] for r in different(sized).collect())
    assert len(left) == 3 and 2 in left and 4 in left and (1 in left) != (3 in left)


def test_cells_carry_columns_and_a_lone_row_meets_only_the_largest_component(spark):
    rows = [(g, i, 1, 10 * i) for g, n in ((1, 4), (2, 5), (3, 2)) for i in range(g * 100, g * 100 + n)]
    known = [(i, 100) for i in range(100, 103)] + [(i, 200) for i in range(200, 203)] + [(300, 300), (301, 300)]
    rows, known = spark.createDataFrame(rows, "group long, id long, mass int, words int"), spark.createDataFrame(known, "node long, component long")
    got = sorted((r["group"], r["y"], r["side"], r["id"]) for r in cells(rows, known, 16, 1 << 20, ("words",)).collect() if r["words"] == 10 * r["id"])
    main = [(1, 0, 1, i) for i in range(100, 103)] + [(2, 0, 1, i) for i in range(200, 203)]
    assert got == sorted([*main, (1, 0, 0, 103), (2, 0, 0, 203), (2, 0, 0, 204), (2, 1, 2, 203), (2, 1, 2, 204)])
    # blocks of few rows: every pair but those of one component still meets once
    cell = {}
    for r in cells(rows, known, 1, 1 << 20).collect():
        cell.setdefault((r["group"], r["x"], r["y"]), []).append((r["side"], r["id"]))
    met = {(min(a, b), max(a, b)) for c in cell.values() for s, a in c for t, b in c if a != b and {s, t} in ({0, 1}, {2})}
    assert met >= {(i, 103) for i in range(100, 103)} | {(i, j) for i in range(200, 203) for j in (203, 204)} | {(203, 204)}


def test_marks_of_groups_are_sums_of_longs(spark):
    sized = spark.createDataFrame([(1, 2), (1, -3)], "g int, m long").groupBy("g").agg(*members_mark("m"))
    assert {kind for name, kind in sized.dtypes if name != "g"} == {"bigint"}
