"""Every query with SQL agrees with another engine on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import catalog

#: Loops over graphs; the driver's own comparison runs them.
SLOW = {"giant_fraction", "relation_coverage", "node_type_coverage", "connectivity_score", "verbatim_subgraph_overlap", "scan_graphml", "fidelity_score"}
NAMES = sorted(set(catalog.ORACLES) - SLOW)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(name, spark, sf_dir, duck):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*[df[f"`{c}`"] for c in cols]).collect()), key=repr)
    found = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
