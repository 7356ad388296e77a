"""Canonical tables of the library, read from the driver's star schema.

Each view is one list of column expressions in SQL that Spark and DuckDB read alike, so that a query and the SQL it is
held against start from the same rows. A user with tables of their own skips this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINES = "lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"
_B, _H = "(20 + p_size) / 100.0E0", "(30 + l_quantity) / 100.0E0"

#: name -> (tables and joins, columns)
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "elements": (
        _LINES,
        {
            "project_id": "o_custkey % 50",
            "drawing_id": "l_orderkey",
            "element_id": "l_orderkey * 10 + l_linenumber",
            "etype": "CASE l_linenumber % 7 WHEN 0 THEN 'column' WHEN 1 THEN 'shear_wall' WHEN 2 THEN 'beam' WHEN 3 THEN 'slab' WHEN 4 THEN 'parapet' WHEN 5 THEN 'foundation' ELSE 'stair' END",
            "subtype": "CASE WHEN l_linenumber % 7 <> 5 THEN '' WHEN l_suppkey % 2 = 0 THEN 'strip' ELSE 'raft' END",
            "b": _B,
            "h": f"CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE {_H} END",
            "length": "l_extendedprice / 10000.0E0",
            "area": f"CASE WHEN l_linenumber % 7 IN (3, 5) THEN l_extendedprice / 2000.0E0 ELSE {_B} * {_H} END",
            "perimeter": f"2 * ({_B} + {_H})",
            "thickness": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE (10 + l_quantity / 2) / 100.0E0 END",
            "treads": "CAST(8 + l_partkey % 5 AS INT)",
            "risers": "CAST(9 + l_partkey % 5 AS INT)",
            "run": "2.0E0 + l_quantity / 50.0E0",
            "landing": "l_tax * 100",
            "storey_height": "2.8E0 + (l_orderkey % 5) * 0.1E0",
            "slab_thickness": "0.15E0",
            "beam_depth": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 0.5E0 END",
            "net_slab": "l_orderkey % 2 = 0",
            "storey_count": "CAST(l_suppkey % 4 + 1 AS INT)",
            "confidence": "0.3E0 + (l_partkey % 70) / 100.0E0",
            "excluded": "l_returnflag = 'R' AND l_linenumber = 1",
            "manual": "l_returnflag = 'N' AND l_linenumber = 2",
            "superseded": "o_orderstatus = 'F' AND o_custkey % 3 = 0",
            "x": "CAST(l_partkey % 500 AS DOUBLE)",
            "y": "CAST(l_suppkey AS DOUBLE)",
        },
    ),
    "drawings": (
        "orders",
        {
            "project_id": "o_custkey % 50",
            "drawing_id": "o_orderkey",
            "block": "substring(o_orderpriority, 1, 1)",
            "plan_type": "CASE o_orderkey % 4 WHEN 0 THEN 'kalip' WHEN 1 THEN 'mimari' WHEN 2 THEN 'kesit' ELSE 'donati' END",
            "level": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 6) * 3.0E0 + (o_custkey % 3) * 0.02E0 END",
            "rank": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS INT) END",
            "revision": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
            "uploaded": "o_orderkey",
            "status": "o_orderstatus",
            "price": "o_totalprice",
            "storey_height": "CASE WHEN o_orderkey % 4 = 0 THEN 2.9E0 + (o_custkey % 4) * 0.1E0 ELSE NULL END",
        },
    ),
    "boq": (
        "lineitem JOIN orders ON l_orderkey = o_orderkey",
        {
            "project_id": "o_custkey % 50",
            "row_id": "l_orderkey * 10 + l_linenumber",
            "drawing_id": "l_orderkey",
            "kind": "CASE l_linenumber WHEN 1 THEN 'beton' WHEN 2 THEN 'kalip' WHEN 3 THEN 'demir' WHEN 4 THEN 'duvar' WHEN 5 THEN 'siva' WHEN 6 THEN 'boya' ELSE 'kablo' END",
            "grp": "CASE WHEN l_partkey % 40 = 0 THEN '*' WHEN l_linenumber = 3 THEN concat('o', CAST(8 + 2 * (l_partkey % 12) AS VARCHAR(9))) WHEN l_linenumber IN (1, 2) THEN CASE l_partkey % 4 WHEN 0 THEN 'column' WHEN 1 THEN 'beam' WHEN 2 THEN 'slab' ELSE 'foundation:raft' END ELSE concat('g', CAST(l_partkey % 40 AS VARCHAR(9))) END",
            "unit": "CASE WHEN l_linenumber = 1 THEN 'm3' WHEN l_linenumber = 3 THEN 'kg' WHEN l_linenumber = 7 THEN 'm' WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 'saat' ELSE 'm2' END",
            "quantity": "l_quantity",
            "cnt": "CAST(l_suppkey % 5 AS DOUBLE)",
            "tier": "CASE l_returnflag WHEN 'A' THEN 'olculdu' WHEN 'N' THEN 'tanindi' ELSE CASE WHEN l_linestatus = 'F' THEN 'turetildi' ELSE 'tahmin' END END",
            "discipline": "CASE WHEN l_linenumber <= 3 THEN 'structural' WHEN l_linenumber <= 6 THEN 'architectural' ELSE 'electrical' END",
            "note": "CASE WHEN l_suppkey % 7 = 0 THEN concat('n', CAST(l_suppkey % 3 AS VARCHAR(9))) ELSE NULL END",
            "per_project": "l_partkey % 10 = 3",
        },
    ),
    "quotes": (
        "lineitem JOIN supplier ON l_suppkey = s_suppkey",
        {
            "quote_id": "l_orderkey * 10 + l_linenumber",
            "scope": "CASE WHEN l_linenumber <= 3 THEN 'material' ELSE 'item' END",
            "key": "CASE WHEN l_partkey % 40 = 0 THEN concat('k', CAST(l_linenumber AS VARCHAR(9)), ':*') ELSE concat('k', CAST(l_linenumber AS VARCHAR(9)), ':g', CAST(l_partkey % 40 AS VARCHAR(9))) END",
            "supplier_id": "l_suppkey",
            "unit_price": "CASE WHEN l_suppkey % 13 = 0 THEN 0.0E0 ELSE floor(l_extendedprice / l_quantity * 100 + 0.5E0) / 100.0E0 END",
            "labor_price": "CASE WHEN l_suppkey % 4 = 0 THEN 0.0E0 ELSE l_quantity END",
            "preferred": "l_returnflag = 'R' AND l_linenumber = 1",
            "updated": "l_shipdate",
        },
    ),
}


def sql_of(name: str) -> str:
    source, columns = VIEWS[name]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"


def with_views(body: str, *names: str) -> str:
    """SQL for DuckDB: body after the definitions of the named views."""
    rest, head = body.strip(), "WITH"
    for start in ("WITH RECURSIVE ", "WITH "):
        if rest.startswith(start):
            rest, head = ", " + rest[len(start) :], start.strip()
            break
    return f"{head} {', '.join(f'{n} AS ({sql_of(n)})' for n in names)} {rest}"


_JOINS = {"lineitem": None, "part": ("l_partkey", "p_partkey"), "orders": ("l_orderkey", "o_orderkey"), "supplier": ("l_suppkey", "s_suppkey")}
#: Bytes of the tables' files that one task of a join gets, so that its sorts and maps do not grow with the tables.
TASK_BYTES = 8 << 20


def size_of(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(where).getLength()


def view(spark: SparkSession, sf_dir: str, name: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The view's rows. Tables that are too large to broadcast meet in as many parts as their bytes ask for: the number of
    shuffle partitions is fixed, and what Spark joins of them into one is as large as many small rows can be."""
    source, columns = VIEWS[name]
    tables = [part.split()[0] for part in source.split(" JOIN ")]
    df, total = spark.read.parquet(f"{sf_dir}/{tables[0]}.parquet"), size_of(spark, f"{sf_dir}/{tables[0]}.parquet")
    small = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    for t in tables[1:]:
        left, right = _JOINS[t]
        other, own = spark.read.parquet(f"{sf_dir}/{t}.parquet"), size_of(spark, f"{sf_dir}/{t}.parquet")
        total += own
        parts = -(-total // task_bytes)
        if own > small and parts > spark.sparkContext.defaultParallelism:
            df, other = df.repartition(parts, left), other.repartition(parts, right)
        df = df.join(other, df[left] == other[right])
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
