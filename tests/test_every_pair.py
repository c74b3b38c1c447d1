"""The query similar_pairs gives every pair of rows, copies of a vector among them."""

import duckdb
import numpy as np
import pytest

from promptlake.catalog import all_oracles, all_queries
from promptlake.operators.similarity import every_similar_pair

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def rows():
    rng = np.random.default_rng(11)
    v = rng.standard_normal((40, 8)).astype("float32").tolist()
    out = [(i, x, 0) for i, x in enumerate(v)]
    out += [(100 + i, v[0], 0) for i in range(12)] + [(200 + i, v[i], 0) for i in range(5)]  # copies under ids of their own
    return out + [(7, v[7], 0), (7, v[7], 0), (8, v[9], 0), (300, None, 0), (None, v[0], 0)]  # ids that repeat, no vector, no id


def test_query_equals_sql_with_copies(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in all_queries()["similar_pairs"](spark, str(tmp_path)).select("i", "j", "similarity").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT i, j, similarity FROM ({all_oracles()['similar_pairs']})").fetchall())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])
    assert sum(i >= 100 and j >= 100 and s == 1 for i, j, s in got) >= 66  # the pairs inside a group of copies


@pytest.mark.parametrize("layout", [{}, {"pivots": 4, "block_rows": 6}])
def test_every_pair_of_a_crowd_of_copies(spark, layout):
    v = np.random.default_rng(12).standard_normal((20, 8)).tolist()
    v += [v[3]] * 700  # dealt over more than one part
    df = spark.createDataFrame(list(enumerate(v)), "id bigint, embedding array<float>")
    unit = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    want = set(zip(*(x.tolist() for x in np.nonzero(np.tril(np.round(unit @ unit.T, 6) >= 0.4, -1)))))
    got = [(r.i, r.j) for r in every_similar_pair(df, 0.4, **layout).collect()]
    assert len(got) == len(want) and set(got) == want
    assert every_similar_pair(df.filter("id < 0"), 0.4, **layout).count() == 0
