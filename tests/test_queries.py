"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from vecloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool | str):
        return str(v)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(round(float(v), 5) + 0.0)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(spark, name):
    got = catalog.queries()[name](spark, SF_DIR)
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def exact(v):
    """As plain(), with all digits and the sign of zero."""
    return [exact(x) for x in v] if isinstance(v, list) else "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def exact_rows(spark, name, path, tables):
    """Rows of a query and of its SQL over small tables written below path."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    got = catalog.queries()[name](spark, str(path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted([exact(v) for v in r] for r in got.collect()), sorted([exact(v) for v in r] for r in want)


def odd_vectors(spark):
    """Components about zero of either sign, large, missing and not finite; few components, and none."""
    near = [(i - 32) * 1e-7 for i in range(64)]
    vectors = [near, [-x for x in near], [0.0] * 64, [-0.0] * 64, [-1e-40] * 64, [7e14 * (i + 1) for i in range(64)], [-3e38] * 64, near[:13], near[:5], [], None]
    vectors += [[*near[:10], x, *near[11:]] for x in (0.3, None, math.nan, -math.inf)] + [[0.25 - i * 1e-7 for i in range(64)], [0.5 - i * 1e-7 for i in range(64)]]
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")


def test_conv_bn_fold_is_its_sql_to_the_sign(spark, tmp_path):
    got, want = exact_rows(spark, "conv_bn_fold", tmp_path, {"embeddings": odd_vectors(spark)})
    assert got == want and "-0.0" in str(want)


def test_half_precision_is_its_sql_to_the_sign(spark, tmp_path):
    values = [249.9, 249.99, 250.0, 250.01, 250.1, 249.70197677612305, 381.03, 381.04, 118.96, 249 - 2.0**-11, 251 + 3 * 2.0**-11, 0.0, -0.0, math.inf, -math.inf, math.nan, None]
    events = spark.createDataFrame([(3 * i + k, v) for k in range(3) for i, v in enumerate(values)] + [(None, 251.0), (-1, 251.0)], "event_id long, value double")
    got, want = exact_rows(spark, "half_precision", tmp_path, {"events": events})
    assert got == want and "-0.0" in str(want)


def test_normalize_channels_is_its_sql_to_the_sign(spark, tmp_path):
    got, want = exact_rows(spark, "normalize_channels", tmp_path, {"embeddings": odd_vectors(spark)})
    assert got == want and "-0.0" in str(want)


def test_normalize_channels_is_its_sql_to_the_largest_doubles(spark, tmp_path):
    sizes = [9.9e299, 1e300, 6.148202722298331e300, 1.4399307150384964e301, 1.1779538858209576e302, 1.79e302, 1.8e302, 1.7e308, math.inf, math.nan, None]
    embeddings = spark.createDataFrame([(i, [s and sign * s] * 3, 0) for i, (s, sign) in enumerate((s, g) for s in sizes for g in (1, -1))], "vec_id long, embedding array<double>, label int")
    got, want = exact_rows(spark, "normalize_channels", tmp_path, {"embeddings": embeddings})
    assert got == want
