"""Inputs that queries derive from the given tables, in SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.workers import reach

# Findings out of orders: paths, lines and values repeat, so groups, merges and joins have work.
FINDINGS = """
SELECT o_orderkey AS ord,
  concat(CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'prod/app' WHEN 1 THEN 'src/api' WHEN 2 THEN 'dev/tools' WHEN 3 THEN 'config/live' WHEN 4 THEN 'lib/test' ELSE 'lib/core' END,
         '/m', CAST(o_custkey % 200 AS STRING), CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.yml' WHEN 2 THEN '.env' ELSE '.tf' END) AS path,
  CAST(o_orderkey % 30 + 1 AS INT) AS line,
  CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'api_key' WHEN 1 THEN 'db_password' WHEN 2 THEN 'token' WHEN 3 THEN 'aws_secret_access_key' WHEN 4 THEN 'session_id' WHEN 5 THEN 'test_value'
       WHEN 6 THEN 'stripe_secret' ELSE 'bearer' END AS variable,
  CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN md5(CAST(o_custkey % 50 AS STRING)) WHEN 1 THEN concat('AK', 'IA', upper(substr(md5(CAST(o_custkey % 40 AS STRING)), 1, 16)))
       WHEN 2 THEN concat('gh', 'p_', md5(CAST(o_custkey % 45 AS STRING))) WHEN 3 THEN 'changeme' WHEN 4 THEN concat('$', '{DB_PASS}') WHEN 5 THEN concat('pass', CAST(o_custkey % 1000 AS STRING))
       WHEN 6 THEN concat(substr(md5(CAST(o_custkey % 35 AS STRING)), 1, 20), upper(substr(md5(CAST(o_custkey % 36 AS STRING)), 3, 20))) WHEN 7 THEN concat('xox', 'b-', md5(CAST(o_custkey % 33 AS STRING)))
       ELSE concat('Zq9+', substr(md5(CAST(o_orderkey % 77 AS STRING)), 5, 14), '/Kw', upper(substr(md5(CAST(o_custkey % 78 AS STRING)), 2, 7))) END AS value,
  concat('rule_', CAST(o_orderkey % 5 AS STRING)) AS rule_id,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'AWS Secret Key' WHEN 1 THEN 'GitHub Token' WHEN 2 THEN 'Database Password' WHEN 3 THEN 'Private Key' ELSE 'Generic Secret' END AS rule_name,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'regex_match' WHEN 1 THEN 'entropy_match' ELSE 'variable_name_match' END AS type,
  CASE CAST(o_orderkey % 2 AS INT) WHEN 0 THEN 'Api Key' ELSE 'Generic Value' END AS pattern,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'aws' WHEN 1 THEN 'github___gitlab___bitbucket' WHEN 2 THEN 'database_credentials' WHEN 3 THEN 'structural_high_value' WHEN 4 THEN 'payments___banking'
       WHEN 5 THEN 'email' ELSE 'general_credentials' END AS pattern_category,
  'secrets' AS category,
  CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'medium' WHEN 5 THEN 'low' WHEN 6 THEN 'info' WHEN 7 THEN 'high' ELSE 'medium' END AS severity,
  CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence,
  concat('Found in ', o_orderpriority) AS description,
  o_orderdate AS seen, o_custkey AS cust
FROM {orders}
"""

# Lines of small files out of lineitem.
CODE = """
SELECT concat(CASE CAST(l_orderkey % 3 AS INT) WHEN 0 THEN 'config/a' WHEN 1 THEN 'src/b' ELSE 'deploy/c' END, CAST(l_orderkey AS STRING), CASE CAST(l_orderkey % 2 AS INT) WHEN 0 THEN '.yml' ELSE '.py' END) AS path,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line,
  CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 'database:' WHEN 1 THEN '  password: hunter2hunter2' WHEN 2 THEN '# todo: rotate' WHEN 3 THEN 'def load(x):' WHEN 4 THEN 'const MAX = 3'
       WHEN 5 THEN 'webhook url' WHEN 6 THEN 'api_key = "abcdef0123456789"' WHEN 7 THEN '[section]' WHEN 8 THEN 'except: print(x)' WHEN 9 THEN '"name": 1' WHEN 10 THEN 'region, zone' ELSE 'x' END AS text
FROM {lineitem}
"""

# Assignments in files of known technologies, out of part.
TECH = """
SELECT CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN concat('svc/', CAST(p_partkey AS STRING), '/Dockerfile') WHEN 1 THEN concat('k8s/', CAST(p_partkey AS STRING), '.yaml')
         WHEN 2 THEN concat('ci', CAST(p_partkey AS STRING), '/.github/workflows/build.yml') WHEN 3 THEN concat('infra/', CAST(p_partkey AS STRING), '.tf') WHEN 4 THEN concat('pkg/', CAST(p_partkey AS STRING), '/.npmrc')
         ELSE concat('plain/', CAST(p_partkey AS STRING), '.txt') END AS path,
  CAST(p_size AS INT) AS line,
  CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'docker_registry_password' WHEN 1 THEN 'my_kube_token' WHEN 2 THEN 'jenkins_api_token' WHEN 3 THEN 'TERRAFORM_TOKEN' WHEN 4 THEN 'npm_token' WHEN 5 THEN 'token'
       ELSE 'docker_secret' END AS word,
  CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'short' WHEN 1 THEN concat('test', md5(p_name)) WHEN 2 THEN substr(md5(p_name), 1, 20) ELSE md5(p_name) END AS value
FROM {part}
"""


TABLE = re.compile(r"\{(orders|lineitem|part)\}")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return reach(spark).sql(TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def duck(sql: str) -> str:
    return TABLE.sub(r"\1", sql)
