from collections import defaultdict

import numpy as np

from pageframe.llm import lines

SCHEMA = "doc_id long, text string, source string, site string, kept int, h1 string"


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if key := line.strip(" "):
                sites[key].add(site or "")
                first[key] = min(first.get(key, (True, 1 << 60, 0)), (i is None, i or 0, pos))
    out = []
    for i, text, _ in rows:
        parts = (text or "").split("\n")
        gone = [p for p, x in enumerate(parts) if x.strip(" ") and len(sites[x.strip(" ")]) >= least and first[x.strip(" ")] != (i is None, i or 0, p)]
        out.append((i, "\n".join(x for p, x in enumerate(parts) if p not in gone), len(parts), len(gone)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [f"line {i}" for i in range(12)]
    rows = [(int(i), "\n".join(rng.choice(pool[: int(rng.integers(1, 13))], int(rng.integers(1, 6)))), f"s{rng.integers(14)}") for i in range(80)]
    rows += [(200, None, "s1"), (201, "", None), (202, "  line 1 \n\nline 2\n", None), (203, "solo " * 5000, "s1"), (204, "line 3", "s3"), (204, "line 4\nline 3", "s3")]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    for least in (2, 5, 10):
        got = sorted(map(tuple, lines.without_boilerplate(docs, min_sites=least).collect()), key=str)
        assert got == brute(rows, least)


def test_sketches_of_many_sites_agree_with_exact_counts(spark):
    rows = [(i, f"wide\nmiddle {i % 2}" if i < 900 else f"only {i}", f"s{i}") for i in range(1200)]
    docs = spark.createDataFrame([(*r, "", 0, "") for r in rows], SCHEMA)
    got = sorted(map(tuple, lines.without_boilerplate(docs, min_sites=450).collect()), key=str)
    assert got == brute(rows, 450)


def test_empty_table(spark):
    assert lines.without_boilerplate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_missing_site_counts_at_the_threshold(spark):
    for missing in (None, ""):
        rows = [(i, "shared\nown", f"s{i}" if i < 9 else missing) for i in range(10)]
        docs = spark.createDataFrame([(*r, "", 0, "") for r in rows], SCHEMA)
        assert sorted(map(tuple, lines.without_boilerplate(docs, min_sites=10).collect()), key=str) == brute(rows, 10)
