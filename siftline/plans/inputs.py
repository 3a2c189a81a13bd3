"""Screening inputs derived from the supplied tables.

The tables hold no resumes, so resumes come from customers and their orders,
and jobs from suppliers. The same text runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.shared import hadoop_path, new_path

_SKILLS = "Python,Java,JavaScript,SQL,Git,React,ReactJS,Tensor Flow,Docker,AWS,MERN,Django,REST APIs,Machine Learning,sklearn,PostgreSQL,C++,Figma,LAMP,Flask"
_MONTHS = "January,February,March,April,May,June,July,August,September,October,November,December"

RESUMES_SQL = """
WITH span AS (SELECT o_custkey, min(o_orderdate) lo, max(o_orderdate) hi FROM orders GROUP BY o_custkey)
SELECT c_custkey AS doc_id, concat_ws(chr(10),
  concat('Candidate ', c_custkey),
  CASE WHEN c_custkey % 4 <> 0 THEN concat('user', c_custkey, '@example.com')
       WHEN c_custkey % 8 = 0 THEN 'Available from March 2024'
       WHEN c_custkey % 16 = 12 THEN 'Python SQL Docker' END,
  'Professional Summary', concat('Motivated professional with expertise in ', split_part('<SKILLS>', ',', cast((c_custkey*11+5) % 20 + 1 as int))),
  CASE WHEN lo IS NOT NULL THEN concat('Work History', chr(10), 'Developer', chr(10),
    split_part('<MONTHS>', ',', cast(month(lo) as int)), ' ', year(lo)+10, ' to ', split_part('<MONTHS>', ',', cast(month(hi) as int)), ' ', year(hi)+10, chr(10),
    'Developed systems using ', split_part('<SKILLS>', ',', cast((c_custkey*13) % 20 + 1 as int)), ', ', split_part('<SKILLS>', ',', cast((c_custkey*17+1) % 20 + 1 as int))) END,
  'Skills', split_part('<SKILLS>', ',', cast((c_custkey*3) % 20 + 1 as int)), split_part('<SKILLS>', ',', cast((c_custkey*5+2) % 20 + 1 as int)), split_part('<SKILLS>', ',', cast((c_custkey*7+4) % 20 + 1 as int)),
  CASE WHEN c_custkey % 3 = 0 THEN concat('Certifications', chr(10), 'Certified ', split_part('<SKILLS>', ',', cast((c_custkey*9) % 20 + 1 as int)), ' Practitioner') END,
  'Education', split_part('Bachelor of Science,Master of Science,PhD in Statistics,High School Diploma', ',', cast(c_custkey % 4 + 1 as int)),
  CASE WHEN c_custkey % 6 = 1 THEN concat('Additional Skills', chr(10), split_part('<SKILLS>', ',', cast((c_custkey*19+6) % 20 + 1 as int)))
       WHEN c_custkey % 6 = 2 THEN concat('1. Projects', chr(10), 'Built an application with ', split_part('<SKILLS>', ',', cast((c_custkey*19+6) % 20 + 1 as int))) END,
  CASE WHEN c_custkey % 5 = 0 THEN concat('Languages', chr(10), 'English', chr(10), 'Spanish') END) AS text
FROM customer LEFT JOIN span ON c_custkey = o_custkey
""".replace("<SKILLS>", _SKILLS).replace("<MONTHS>", _MONTHS)

JOBS_SQL = """
SELECT s_suppkey AS job_id, concat_ws(chr(10),
  concat(split_part('<SKILLS>', ',', cast((s_suppkey*3) % 20 + 1 as int)), ' Developer'), '', 'Requirements:',
  CASE WHEN s_suppkey % 7 <> 0 THEN concat('- ', s_suppkey % 6 + 1, '+ years of experience in development.') END,
  concat('- Strong knowledge of ', split_part('<SKILLS>', ',', cast((s_suppkey*7+1) % 20 + 1 as int)), ' and ', split_part('<SKILLS>', ',', cast((s_suppkey*3+2) % 20 + 1 as int)), '.'),
  concat('- Work with ', split_part('<SKILLS>', ',', cast((s_suppkey*9+4) % 20 + 1 as int)), '.'),
  CASE s_suppkey % 3 WHEN 0 THEN '- Bachelor degree in Computer Science.' WHEN 1 THEN '- Master degree preferred.' END,
  'Responsibilities:', concat('- Maintain ', split_part('<SKILLS>', ',', cast((s_suppkey*3) % 20 + 1 as int)), ' applications.'), '- Write clean code.') AS text
FROM supplier
""".replace("<SKILLS>", _SKILLS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: dict[tuple, str] = {}
#: Rows of a derived input in a file. Texts are short and what is done with them
#: is not, so it goes by rows: a file of 64 MB would leave most cores idle.
INPUT_ROWS = 10_000


def _as_table(spark: SparkSession, sf_dir: str, name: str, sources: tuple[str, ...], df: DataFrame) -> DataFrame:
    """A derived input as a table of its own, written once for each session and
    state of the tables it comes from. Otherwise the optimiser copies the
    expression that makes a text into every filter and generator above it."""
    states = []
    for source in sources:
        path, files = hadoop_path(spark, f"{sf_dir}/{source}.parquet")
        states.append((files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime()))
    key = (spark.sparkContext.applicationId, sf_dir, name, *states)
    if key not in _written:
        path = new_path(spark, name)
        df.write.option("maxRecordsPerFile", INPUT_ROWS).parquet(path)
        _written[key] = path
    return spark.read.schema(df.schema).parquet(_written[key])


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: one resume per customer."""
    sql = RESUMES_SQL.replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}")
    made = spark.sql(sql, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    return _as_table(spark, sf_dir, "resumes", ("orders", "customer"), made)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job_id, text)``: one job description per supplier."""
    made = spark.sql(JOBS_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    return _as_table(spark, sf_dir, "jobs", ("supplier",), made)
