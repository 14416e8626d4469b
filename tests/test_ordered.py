"""Bucketed order helpers against plain Python, with one part that holds most rows."""

import random

from pyspark.sql import functions as F

from foliospark.plans.ordered import carry, number_rows, running_sum, slot, sorted_positions, text_parts


def rows(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        part = "hot" if rng.random() < 0.7 else rng.choice("ab")
        out.append((part, i * 3, rng.randrange(5), rng.choice([None, i]), f"n{rng.randrange(40)}"))
    return out


SCHEMA = "part string, pos long, size int, mark int, name string"


def by_part(data):
    groups = {}
    for r in sorted(data, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_number_rows_and_running_sum(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for coarse in (None, slot("pos", 200)):
        got = number_rows(df, ["part"], [slot("pos", 16)], [F.col("pos")], "no", coarse=coarse)
        got = running_sum(got, ["part"], [slot("pos", 16)], [F.col("pos")], F.col("size"), "before", inclusive=False, coarse=coarse)
        seen = {(r.part, r.pos): (r.no, r.before) for r in got.collect()}
        for part, items in by_part(data).items():
            total = 0
            for i, r in enumerate(items):
                assert seen[(part, r[1])] == (i, total)
                total += r[2]


def test_number_rows_descending_value_buckets(spark):
    data = rows()
    got = number_rows(
        spark.createDataFrame(data, SCHEMA), ["part"], [F.col("size"), slot("pos", 50)], [F.col("pos")], "no",
        start=1, descending=[True, False],
    )
    seen = {(r.part, r.pos): r.no for r in got.collect()}
    for part, items in by_part(data).items():
        for i, r in enumerate(sorted(items, key=lambda r: (-r[2], r[1])), start=1):
            assert seen[(part, r[1])] == i


def test_carry_both_ways(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for coarse in (None, slot("pos", 300)):
        back = carry(df, ["part"], slot("pos", 20), ["pos"], F.col("mark"), "c", coarse=coarse)
        ahead = carry(df, ["part"], slot("pos", 20), ["pos"], F.col("mark"), "c", backwards=True, coarse=coarse)
        earlier = {(r.part, r.pos): r.c for r in back.collect()}
        later = {(r.part, r.pos): r.c for r in ahead.collect()}
        for part, items in by_part(data).items():
            last = None
            for r in items:
                assert earlier[(part, r[1])] == last
                last = r[3] if r[3] is not None else last
            nxt = None
            for r in reversed(items):
                assert later[(part, r[1])] == nxt
                nxt = r[3] if r[3] is not None else nxt


def test_sorted_positions(spark):
    data = rows()
    got = sorted_positions(spark.createDataFrame(data, SCHEMA), ["part"], [F.col("name").desc(), F.col("pos")], "no")
    seen = {(r.part, r.pos): r.no for r in got.collect()}
    for part, items in by_part(data).items():
        items = sorted(items, key=lambda r: r[1])
        items = sorted(items, key=lambda r: r[4], reverse=True)
        assert [seen[(part, r[1])] for r in items] == list(range(len(items)))


def test_text_parts_join_to_the_whole(spark):
    data = [("x", i, f"t{i}") for i in range(25)]
    df = spark.createDataFrame(data, "book string, i int, t string")
    parts = text_parts(df, ["book"], "i", "t", "\n\n", "text", per_part=10).orderBy("part_no").collect()
    assert [p.part_no for p in parts] == [0, 1, 2]
    assert "\n\n".join(p.text for p in parts) == "\n\n".join(t for _, _, t in data)
