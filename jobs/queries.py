"""The jobs as queries: each runs twice into one new folder and returns the whole output, and the SQL of that output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.session import shared_dir

from . import annotate_documents, marker_words
from .common import WORD, configuration


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document annotated from those that `labels` covers; the second run finds nothing new."""
    out = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        annotate_documents.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/annotated").select("doc_id", "label_id", "label", "votes", F.round("confidence", 6).alias("confidence"))


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers of every language; the second run replaces the output of the first."""
    out = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        marker_words.run(spark, f"{sf_dir}/documents.parquet", out)
    found = spark.read.schema(marker_words.SCHEMA).parquet(out)
    return found.select("category", "rank", "word", "n_in", "n_out", *[F.round(c, 6).alias(c) for c in ("share_in", "share_out", "mean_value")])


_ONE, _TWO = configuration(annotate_documents.NAME), configuration(marker_words.NAME)
_WORDS = f"w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM documents WHERE doc_id IS NOT NULL) GROUP BY ALL)"

JOB1_SQL = f"""WITH {_WORDS},
f AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % {_ONE["dimensions"]} AS j, sum(n) AS v FROM w GROUP BY ALL),
t AS (SELECT doc_id, sum(v) AS total FROM f GROUP BY 1),
e AS (SELECT doc_id, list(coalesce(ln(1 + v * (10000.0::DOUBLE / total)), 0.0::DOUBLE) ORDER BY j) AS e
  FROM t CROSS JOIN range({_ONE["dimensions"]}) r(j) LEFT JOIN f USING (doc_id, j) GROUP BY 1),
ref AS (SELECT doc_id AS vec_id, e AS c, label_id FROM e JOIN (SELECT doc_id, max({_ONE["label"]}) AS label_id FROM labels WHERE {_ONE["label"]} IS NOT NULL GROUP BY 1) USING (doc_id)),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(dist, 9), vec_id) AS rank FROM (
  SELECT doc_id, vec_id, label_id, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM e, ref WHERE doc_id <> vec_id)),
votes AS (SELECT doc_id, label_id, count(*) AS votes FROM near WHERE rank <= {_ONE["neighbours"]} AND label_id >= 0 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, label_id) AS n FROM votes)
SELECT doc_id, label_id, coalesce(CASE label_id {" ".join(f"WHEN {c} THEN '{n}'" for c, n in _ONE["names"].items())} END, 'Unknown') AS label, votes,
  round(votes / {_ONE["neighbours"]}.0, 6) AS confidence
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN (SELECT * FROM best WHERE n = 1) USING (doc_id)"""

JOB2_SQL = f"""WITH {_WORDS},
c AS (SELECT doc_id, coalesce(min({_TWO["category"]}), 'Unknown') AS category FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
size AS (SELECT category, count(*) AS size FROM c GROUP BY 1),
val AS (SELECT category, word, ln(1 + n * (10000.0::DOUBLE / sum(n) OVER (PARTITION BY doc_id))) AS value FROM w JOIN c USING (doc_id)),
inside AS (SELECT category, word, count(*) AS n_in, sum(value) AS value FROM val GROUP BY ALL),
freq AS (SELECT word, CAST(sum(n_in) AS BIGINT) AS n_all FROM inside GROUP BY 1 HAVING sum(n_in) >= {_TWO["least_documents"]}),
r AS (SELECT category, word, n_in, n_all - n_in AS n_out, n_in / size AS share_in,
  CASE WHEN (SELECT count(*) FROM c) > size THEN (n_all - n_in) / ((SELECT count(*) FROM c) - size) ELSE 0 END AS share_out, value / size AS mean_value
  FROM inside JOIN freq USING (word) JOIN size USING (category)),
o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY share_in - share_out DESC, word) AS rank FROM r)
SELECT category, CAST(rank AS INTEGER) AS rank, word, n_in, n_out, round(share_in, 6) AS share_in, round(share_out, 6) AS share_out, round(mean_value, 6) AS mean_value
FROM o WHERE rank <= {_TWO["markers"]}"""

QUERIES = {"job1_annotate_documents": job1, "job2_marker_words": job2}
ORACLE_SQL = {"job1_annotate_documents": JOB1_SQL, "job2_marker_words": JOB2_SQL}
