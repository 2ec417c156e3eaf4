"""Prefix lookups against a plain search, over many small ranges."""

import random

import pytest

from reviewlake.operators import prefixes as P


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab_é") for _ in range(rng.randint(1, 5)))
    ids = [(2020 + rng.randrange(3), word(), i) for i in range(300)] + [(2020, "a", i) for i in range(300, 700)] + [(None, "a", 700), (2020, None, 701), (2021, "", 702), (2023, "a", 703)]
    stems = [(2020 + rng.randrange(4), word() + rng.choice(["", "_x", "zz"]), rng.choice([0, 1, None]), f"/p{i}") for i in range(400)] + [(2020, None, 0, "/n"), (None, "ab", 0, "/m")]
    return spark.createDataFrame(ids, "year int, id string, n int"), spark.createDataFrame(stems, "year int, stem string, priority int, path string"), ids, stems


@pytest.fixture(params=["2", "7"])
def ranges(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else few rows end in one range
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_prefix(cases, ranges):
    ids, stems, rows, held = cases
    for delimiter in (None, "_"):
        fits = lambda s, k: s.startswith(k) if delimiter is None else s == k or s.startswith(k + "_")  # noqa: E731, B023
        want = {n: None if k is None else min((s for y, s, _, _ in held if s is not None and y == year and y is not None and fits(s, k)), default=None) for year, k, n in rows}
        assert {r["n"]: r["stem"] for r in P.prefix_lookup(ids, stems.select("year", "stem"), delimiter=delimiter).collect()} == want


def test_priority(cases, ranges):
    ids, stems, rows, held = cases
    found = {r["n"]: (r["stem"], r["path"]) for r in P.priority_lookup(ids, stems).collect()}
    for year, k, n in rows:
        fit = [(-1 if p is None else p, s, path) for y, s, p, path in held if k is not None and s is not None and y == year and y is not None and s.startswith(k)]
        assert found[n] == (min(fit)[1:] if fit else (None, None))
