import random

from pyspark.sql import Row, functions as F

from groundwork.operators import dedupe


def plain(names):
    """The rule of the reference, row by row."""
    seen, out = set(), []
    for base in names:
        name, c = base, 0
        while name in seen:
            c += 1
            name = f"{base}-{c}"
        seen.add(name)
        out.append(name)
    return out


def check(spark, names):
    df = spark.createDataFrame([Row(o=i, id=n) for i, n in enumerate(names)]).repartition(3)
    rows = sorted(dedupe.suffix_ids(df, "id", ["o"]).collect(), key=lambda r: r["o"])
    assert [r["unique_id"] for r in rows] == plain(names) and len({r["unique_id"] for r in rows}) == len(names)


def test_taken_suffixes_are_passed(spark):
    check(spark, ["a-1", "a", "a", "a", "a-1", "a-01", "b", "b", "b-1", "b-1", "b-1-1", "-1", "", "", "a-3", "a"])
    rng = random.Random(3)
    check(spark, [rng.choice(["x", "x-1", "x-2", "x-1-1", "x-11", "y-1", "y", "y-0"]) for _ in range(200)])


def test_no_limit_of_suffixes(spark):
    used = F.array(F.lit("a"), *[F.lit(f"a-{i}") for i in range(1, 1202)])
    assert spark.range(1).select(dedupe.next_free_id(F.lit("a"), used).alias("x")).first()["x"] == "a-1202"
