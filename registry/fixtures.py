"""Company contact tables derived from the given star-schema tables; the same SELECT for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.plans import computed_once

_C = "cast(c_custkey AS string)"
_O = "cast(o_custkey AS string)"

VIEWS = {
    "persona_hub": f"""
SELECT c_custkey AS id,
  CASE c_custkey % 5 WHEN 0 THEN 'Acme Co' || {_C} WHEN 1 THEN 'globex' || {_C} WHEN 2 THEN 'anz' WHEN 3 THEN NULL
    ELSE 'initech ' || {_C} END AS name,
  CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE c_mktsegment END AS source,
  CASE c_custkey % 6 WHEN 0 THEN 'https://www.co' || {_C} || '.com/about/us' WHEN 1 THEN 'HTTP://Co' || {_C} || '.com.au'
    WHEN 2 THEN 'www.co' || {_C} || '.org' WHEN 3 THEN ' co' || {_C} || '.net ' WHEN 4 THEN 'localhost' ELSE NULL END AS fqdn,
  'slug-' || {_C} AS slug,
  CASE WHEN c_custkey % 10 = 3 THEN 'DRAFT' ELSE 'PUBLISHED' END AS status
FROM {{customer}}""",
    "emails": f"""
SELECT o_orderkey AS email_id, o_custkey AS id, 'slug-' || {_O} AS slug,
  CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 11 = 1 THEN ' ' WHEN o_orderkey % 5 = 0 THEN 'NEW ZEALAND'
    ELSE n_name END AS country,
  CASE WHEN o_custkey % 9 = 4 THEN NULL ELSE CASE o_orderkey % 16 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'masked***'
    WHEN 3 THEN 'No-Reply@co' || {_O} || '.com' WHEN 4 THEN ' Info@Co' || {_O} || '.com '
    WHEN 5 THEN 'sales.au@mail.co' || {_O} || '.com'
    WHEN 6 THEN CASE o_orderkey % 48 WHEN 6 THEN 'shared0@example.com'
      WHEN 22 THEN 'shared1.' || cast(o_orderkey % 144 AS string) || '@example.com'
      ELSE 'shared2.' || cast(o_orderkey % 96 AS string) || '@example.com' END
    WHEN 7 THEN 'user@@bad.com' WHEN 8 THEN 'john doe' || cast(o_orderkey % 211 AS string) || '@gmail.com'
    WHEN 9 THEN 'co' || {_O} || '@gmail.com' WHEN 10 THEN 'contact@co' || {_O} || '.com.au'
    WHEN 11 THEN 'support@co' || {_O} || '.org' WHEN 12 THEN 'donotreply@example.org'
    WHEN 13 THEN 'hello@co' || {_O} || '.net' WHEN 14 THEN 'x@y.z' ELSE 'globex' || {_O} || '@outlook.com' END END AS email,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'valid' WHEN 3 THEN 'invalid' WHEN 4 THEN 'verified'
    WHEN 5 THEN 'unknown' ELSE 'deliverable' END AS verification_status
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "domains": f"""
SELECT id, country, fqdn, website, status_code FROM (
  SELECT CASE WHEN c_custkey % 13 = 0 THEN -c_custkey ELSE c_custkey END AS id, n_name AS country, 'https://www.co' || {_C} || '.com/x' AS fqdn, 'www.co' || {_C} || '.com' AS website,
    CASE WHEN c_custkey % 10 < 6 THEN 200 WHEN c_custkey % 10 = 6 THEN 404 WHEN c_custkey % 10 = 7 THEN NULL
      WHEN c_custkey % 10 = 8 THEN 301 ELSE 500 END AS status_code
  FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
  UNION ALL
  SELECT c_custkey, n_name, 'co' || {_C} || '.org', NULL, 200
  FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 17 = 0) u""",
    "dq_runs": """
SELECT DISTINCT cast(ts AS date) AS run_id,
  CASE WHEN extract(day FROM ts) % 4 = 0 THEN NULL ELSE 'rel-' || cast(cast(ts AS date) AS string) END AS release_label
FROM {events}""",
    "dq_metrics": """
SELECT cast(ts AS date) AS run_id,
  CASE event_type WHEN 'view' THEN 'coverage_with_email_pct' WHEN 'click' THEN 'invalid_format_pct'
    WHEN 'signup' THEN 'duplicate_email_pct' WHEN 'error' THEN 'blocked_email_pct' ELSE 'domain_mismatch_pct' END AS metric_key,
  CASE WHEN event_type = 'error' AND extract(day FROM ts) % 5 = 0 THEN NULL ELSE cast(count(*) AS double) END AS value_pct
FROM {events} GROUP BY cast(ts AS date), extract(day FROM ts), event_type""",
}

# What a later release changes: the columns of a view, its removed rows, and its added ones.
CHANGES = {
    "persona_hub": (
        "id, name, source, fqdn, slug, status",
        "source IS NULL OR status = 'DRAFT'",
        "SELECT id, name, source, fqdn, slug, 'PUBLISHED' AS status FROM {persona_hub} WHERE source IS NOT NULL AND status = 'DRAFT'",
    ),
    "emails": (
        "email_id, id, slug, country, email, verification_status",
        "verification_status = 'unknown' OR verification_status = ''",
        "SELECT email_id, id, slug, country, email, 'valid' AS verification_status FROM {emails} WHERE verification_status = ''",
    ),
    "domains": (
        "id, country, fqdn, website, status_code",
        "status_code = 500",
        "SELECT id + 1000000000 AS id, country, fqdn, website, 200 AS status_code FROM {domains} WHERE status_code = 404",
    ),
}

# The columns the views read. Naming them spares a look at the files for every query.
TABLES = {
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "nation": "n_nationkey int, n_name string",
    "events": "ts timestamp_ntz, event_type string",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view `name` over the parquet tables in `sf_dir`."""
    text = VIEWS[name]
    used = {
        table: spark.read.schema(columns).parquet(f"{sf_dir}/{table}.parquet")
        for table, columns in TABLES.items()
        if "{" + table + "}" in text
    }
    df = spark.sql(text, **used)
    if name == "emails":
        # The operators mean stored columns. Without the generator each filter would repeat the CASE text,
        # and grouping by id would build on the join's partitions, which keeps AQE from splitting a hot one.
        df = computed_once(df, df.columns, id=F.col("id"), email=F.col("email"))
    return df


def change(before: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The added and the removed rows of the later release of the view `name`, given the one before."""
    columns, removed, added = CHANGES[name]
    frames = {name: before}
    spark = before.sparkSession
    return spark.sql(added, **frames), spark.sql(f"SELECT {columns} FROM {{{name}}} WHERE {removed}", **frames)


def later(text: str) -> str:
    """The statement `text` over the later release of its views."""
    for name, (columns, removed, added) in CHANGES.items():
        own = f"{name} AS ({VIEWS[name].format(**{t: t for t in TABLES})})"
        before = f"{name}_before"
        rows = f"SELECT {columns} FROM {before} WHERE ({removed}) IS NOT TRUE UNION ALL {added.format(**{name: before})}"
        text = text.replace(own, own.replace(f"{name} AS", f"{before} AS", 1) + f",\n{name} AS ({rows})")
    return text


def ctes(*names: str) -> str:
    """The views `names` as leading CTEs of a DuckDB statement."""
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
