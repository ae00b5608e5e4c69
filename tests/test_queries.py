"""Every registered query against its SQL in another engine, on the smallest tables."""

import math

import duckdb
import pytest

from acreframe.plans.oracles import ORACLES
from acreframe.plans.queries import QUERIES
from tests.conftest import DATA

FOLDER = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events labels embeddings".split()


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v) + 0.0!r}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, other, name):
    assert plain(QUERIES[name](spark, FOLDER).toPandas()) == plain(other.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_terrain_of_every_cell_with_scenes(spark, monkeypatch):
    from acreframe.plans import queries

    scenes = queries.A.scenes
    monkeypatch.setattr(queries.A, "scenes", lambda spark, d: scenes(spark, d).selectExpr("* except (r, c)", "r + 20 as r", "c + 20 as c"))
    assert {(r.r, r.c) for r in QUERIES["stack_with_terrain"](spark, FOLDER).select("r", "c").collect()} & {(r, c) for r in range(20, 24) for c in range(20, 24)}


@pytest.mark.parametrize("name", ["svm_score", "ensemble_score"])
def test_models_are_fitted_on_all_labelled_rows(spark, monkeypatch, name):
    from acreframe.plans import queries

    train, seen = queries.models.train, []
    monkeypatch.setattr(queries.models, "train", lambda choice, rows, *a: (seen.append(rows.where("y is not null").count()), train(choice, rows, *a))[1])
    QUERIES[name](spark, FOLDER)
    assert set(seen) == {queries.A.features(spark, FOLDER).where("y is not null").count()}
