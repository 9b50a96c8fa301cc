"""Every query against its SQL, and the driver's contract."""

import numpy as np
import pytest
from oracle import rows, same

from dimstar.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(name, spark, sf):
    same(queries.QUERIES[name], queries.SQL[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() >= 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_rest_stands_without_the_text_part(tmp_path):
    """A copy without the subpackage and its pipeline registers all other queries, and nothing in it asks for them."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for path in (root / "dimstar").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "dimstar.llm" not in path.read_text()
    shutil.copytree(root / "dimstar", tmp_path / "dimstar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.plans.QUERIES), sorted(e.oracle_sql()) == sorted(e.plans.SQL), len(e.queries()))"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out[:2] == ["True", "True"] and int(out[2]) == len(queries.QUERIES)


def test_merge_reads_all_rows(spark):
    """Against a plain scan over whole suppliers, of which some have more than 240 rows in a pass."""
    folder, wanted, sizes = "/root/testdata/sf0.01", [], []
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_suppkey < 6").selectExpr("l_suppkey s", "double(l_quantity / 4) p", "double(l_extendedprice / 1000) w").collect()
    for supplier in sorted({r.s for r in rows}):
        one = sorted((-r.w, r.p) for r in rows if r.s == supplier)
        passes = [[x for x in one if x[1] < 3], [x for x in one if x[1] >= 3]]
        sizes += map(len, passes)
        kept = []
        for w, p in sorted(passes[0][:240] + passes[1][:240]):
            if len(kept) < 24 and all(abs(p - q) / q > 0.002 for _, q in kept):
                kept.append((w, p))
        wanted += [(f"TIC {supplier}", i + 1, round(p, 9), round(-w, 9)) for i, (w, p) in enumerate(kept)]
    found = queries.QUERIES["two_pass_merge_dedupe"](spark, folder).filter("int(substr(target, 5)) < 6").collect()
    assert max(sizes) > 240 and sorted((r.target, r.k, round(float(r.period), 9), round(float(r.power), 9)) for r in found) == sorted(wanted)


@pytest.mark.parametrize("name", ["harmonic_match", "combined_objective"])
def test_rules_on_all_rows(name, spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    found = queries.QUERIES[f"{name}_all_rows"](spark, sf)
    assert found.count() == rows if name == "combined_objective" else found.filter("k > 24").count() > 0


def test_registered_search_is_the_whole_one(spark, monkeypatch):
    """A short dip below the normal pass's periods is found; all of the grid's lists against the definition in DataFrames."""
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 27.4, 1500))
    f = rng.normal(0, 0.1, 1500) - 1.0 * ((t - 0.05) % 0.3137 < 0.02)
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(t, f)], "target string, t double, f double")
    monkeypatch.setattr(queries.v, "series", lambda s, d: df)
    found = queries.QUERIES["box_search_series"](spark, "").orderBy("k").collect()
    assert [r.k for r in found] == list(range(1, 25)) and abs(found[0].period / 0.3137 - 1) < 0.002
    thin = [{"periods": p["periods"][5::300], "durations": p["durations"]} for p in queries.search.two_pass_plan()]
    few = df.filter("t < 10").cache()
    got = queries.search.box_search_series(few, [p | {"periods": [x for x in p["periods"] if x <= 4.9]} for p in thin]).orderBy("k").collect()
    wanted = queries.search.merged_passes([queries.search.box_search(few, [x for x in p["periods"] if x <= 4.9], p["durations"]) for p in thin]).orderBy("k").collect()
    assert len(got) == len(wanted) > 5
    for a, b in zip(got, wanted):
        assert a.k == b.k and np.allclose([a.period, a.t0, a.duration, a.depth, a.power], [b.period, b.t0, b.duration, b.depth, b.power])


def test_selection_sql_takes_every_branch(spark, monkeypatch):
    """Random lists with periods below the floor, aliases, ties and unknown spans: the fold over arrays against its SQL."""
    import duckdb
    import pandas as pd

    rng, listed = np.random.default_rng(11), []
    for target in range(600):
        base, n = float(rng.choice([0.04, 0.09, 0.2, 1.3, 4.0, 11.0])), int(rng.integers(1, 25))
        most, spread = (1.0, 0.08) if target % 3 else (0.949, 0.03)
        span = [27.4, 27.4, 0.0, None, 12.0][target % 5]
        for k in range(1, n + 1):
            period = base * float(rng.choice([1, 2, 3, 5, 0.5, 1 / 3, 1.37])) * float(rng.choice([1, 1.004, 1.02]))
            listed.append((f"t{target}", k, period, float(rng.choice([0, 1, 5, 20, 24.5, 60])), round(most - spread * float(rng.integers(0, 9)) / 8, 4), span))
    schema = "target string, k int, period double, power double, cnn double, tspan double"
    monkeypatch.setattr(queries.v, "candidate_lists", lambda s, d: spark.createDataFrame(listed, schema))
    got = queries.QUERIES["select_candidate"](spark, "").toPandas()
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(listed, columns=[c.split()[0] for c in schema.split(", ")]))
    con.sql("CREATE VIEW listed_rows AS SELECT target, k::INTEGER AS k, period, power, cnn, CASE WHEN isnan(tspan) THEN NULL ELSE tspan END AS tspan FROM frame")
    assert rows(got) == rows(con.sql(queries.selection_sql("SELECT * FROM listed_rows")).df()) and len(got) == 600
    for part in ("high_cnn_override", "cnn_qualified_combined", "+floor_guard", "+alias_promote_longer", "+short_alias_guard", "+transit_ceil_guard"):
        assert got["mode"].str.contains(part, regex=False).sum() >= 5, part


def test_registered_windows_have_their_whole_length(spark):
    assert queries.QUERIES["fold_windows"](spark, "/root/testdata/sf0.01").groupBy("target").count().filter("count <> 301").count() == 0
