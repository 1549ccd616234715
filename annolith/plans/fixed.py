"""Index artefacts that follow from the data by a rule, so that SQL can derive them as well.

Lists: the root of the number of vectors; the centroids are the vectors with the first ids. Code words: the residuals of
the next K_WORDS vectors, cut into M subspaces. A trained index has the same form (operators.ivf.build).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators import ivf
from ..operators.kernels import matrix, nearest
from ..operators.pq import from_words
from ..session import table

M, K_WORDS = 8, 16
#: The query set of every search: each vector whose id is divisible by 20, against all vectors.
QUERIES = "vec_id % 20 = 0"


def rule_index(vectors: DataFrame, m: int = M, words: int = K_WORDS) -> ivf.IvfPqIndex:
    n = max(1, math.isqrt(vectors.count()))
    first = vectors.where(f"vec_id < {n + words}").select("vec_id", "embedding").toArrow()
    order = np.argsort(first.column("vec_id").to_numpy())
    x = matrix(first.column("embedding"))[order]
    centroids, rest = x[:n], x[n:]
    own, _ = nearest(rest, centroids)
    parts = (rest - centroids[own]).reshape(len(rest), m, -1)
    pq = from_words([parts[:, j] for j in range(m)])
    return ivf.IvfPqIndex(centroids, pq, ivf.populate(vectors, centroids, pq))


def vectors_and_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v, v.where(QUERIES)


# SQL of the same artefacts, as common table expressions.
L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

VECTORS_SQL = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
q AS (SELECT vec_id AS query_id, e FROM v WHERE mod(vec_id, 20) = 0),
exact AS (
  SELECT query_id, vec_id, label, dist, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank
  FROM (SELECT query_id, vec_id, label, %s AS dist FROM q, v)
)""" % L2.format(a="q.e", b="v.e")

INDEX_SQL = VECTORS_SQL + """,
n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM v),
c AS (SELECT vec_id AS partition_id, e AS c FROM v, n WHERE vec_id < n),
own AS (
  SELECT vec_id, partition_id, d2, res FROM (
    SELECT vec_id, partition_id, d2, list_transform(list_zip(e, c), lambda p: p[1] - p[2]) AS res,
      row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 12), partition_id) AS r
    FROM (SELECT v.vec_id, e, partition_id, c, %s AS d2 FROM v, c))
  WHERE r = 1
),
book AS (
  SELECT j, CAST(vec_id - n AS INTEGER) AS code, list_slice(res, j * 8 + 1, j * 8 + 8) AS w
  FROM own, n, range(8) t(j) WHERE vec_id >= n AND vec_id < n + 16
),
codes AS (
  SELECT vec_id, partition_id, j, code, d FROM (
    SELECT vec_id, partition_id, j, code, d, row_number() OVER (PARTITION BY vec_id, j ORDER BY round(d, 12), code) AS r
    FROM (SELECT own.vec_id, own.partition_id, book.j, book.code, %s AS d FROM own, book))
  WHERE r = 1
)""" % (L2.format(a="v.e", b="c.c"), L2.format(a="list_slice(own.res, book.j * 8 + 1, book.j * 8 + 8)", b="book.w"))

def index_sql(m: int) -> str:
    """INDEX_SQL with another number of subspaces."""
    size = 64 // m
    return INDEX_SQL.replace("range(8)", f"range({m})").replace("j * 8 + 1, book.j * 8 + 8", f"j * {size} + 1, book.j * {size} + {size}").replace("j * 8 + 1, j * 8 + 8", f"j * {size} + 1, j * {size} + {size}")


PROBE_SQL = INDEX_SQL + """,
near AS (
  SELECT query_id, partition_id, d2, e, c, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 12), partition_id) AS rank
  FROM (SELECT query_id, e, partition_id, c, %s AS d2 FROM q, c)
)""" % L2.format(a="q.e", b="c.c")


def search_sql(n_probe: int, name: str = "found", k: int = 10) -> str:
    """Expressions `lut_<name>` and `<name>` (query_id, vec_id, rank, dist) after PROBE_SQL."""
    return f""",
lut_{name} AS (
  SELECT query_id, partition_id, j, code, {L2.format(a="list_slice(list_transform(list_zip(e, c), lambda p: p[1] - p[2]), j * 8 + 1, j * 8 + 8)", b="w")} AS d
  FROM near, book WHERE rank <= {n_probe}
),
{name} AS (
  SELECT * FROM (
    SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank
    FROM (SELECT query_id, vec_id, sum(l.d ORDER BY j) AS dist FROM lut_{name} l JOIN codes USING (partition_id, j, code) GROUP BY query_id, vec_id))
  WHERE rank <= {k}
)"""
