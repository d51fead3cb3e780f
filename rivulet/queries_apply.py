"""Queries on the apply of row and schema changes from one stream, derived from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import timeline, versioned
from rivulet.plans.feed import FEED, change_feed, events
from rivulet.session import scratch, staged
from rivulet.sources import logtext

#: Every so many events one is a schema change; tables that are there at first; what a bootstrap takes from the source.
EVERY = 50
THERE = {f"t{i}": ("id", "value") for i in range(4)}
SOURCE = {f"t{i}": ("id", "value", "c1") for i in (0, 1, 2, 4)}


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema changes of the stream as SQL: id, table_name, sql."""
    i, n = F.col("event_id"), F.floor(F.col("event_id") / EVERY)
    table = F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))
    column = lambda k: F.concat(F.lit("c"), ((n + k) % 4).cast("string"))
    rest = F.when(n % 3 == 1, F.concat(F.lit("CREATE TABLE "), table, F.lit(" (id INT, value DECIMAL(20, 4), PRIMARY KEY (id))"))).otherwise(F.concat(F.lit("ALTER TABLE "), table, F.lit(" DROP INDEX ix")))
    alter = (
        F.when(n % 5 == 0, F.concat(F.lit(" ADD COLUMN "), column(0), F.lit(" INT")))
        .when(n % 5 == 1, F.concat(F.lit(" DROP COLUMN "), column(0)))
        .when(n % 5 == 2, F.concat(F.lit(" ADD COLUMN "), column(1), F.lit(" INT, DROP COLUMN "), column(2)))
        .otherwise(F.concat(F.lit(" ADD COLUMN "), column(3), F.lit(" INT")))
    )
    sql = F.when(n % 5 == 4, rest).when((n % 5 == 3) & (n % 4 == 3), F.concat(F.lit("DROP TABLE "), table)).otherwise(F.concat(F.lit("ALTER TABLE "), table, alter))
    return events(spark, sf_dir).where(i % EVERY == EVERY - 1).select(i.alias("id"), table.alias("table_name"), sql.alias("sql"))


def stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(row changes, schema changes, rows of the source, its columns)."""
    user = F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))
    feed = change_feed(spark, sf_dir, user.alias("_user")).withColumn("table_name", F.col("_user")).where("id is not null")
    rows = feed.where(F.col("id") % EVERY != EVERY - 1)
    extra = F.when(F.col("id") % 3 == 0, F.create_map(F.concat(F.lit("c"), (F.floor(F.col("id") / EVERY) % 4).cast("string")), F.col("k").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    after = F.map_concat(F.create_map(F.lit("id"), F.col("pk").cast("string"), F.lit("value"), F.col("value").cast("decimal(20,4)").cast("string")), extra)
    rows = rows.select("id", "table_name", "op", "pk", F.when(F.col("op") != "delete", after).alias("after"))
    found = logtext.ddl_events(staged(statements(spark, sf_dir), "statements").withColumn("current_database", F.lit("shop")).withColumn("statement", F.col("sql")).drop("table_name"), parity=False)
    ddl = found.select("id", "clause_no", "table_name", "object_type", "ddl_action", "object_name", F.when(F.col("ddl_action") == "create", logtext.created_columns(F.col("statement"))).alias("columns"))
    source = feed.where("pk % 3 = 0").select("table_name", "pk").distinct()
    source = source.where(F.col("table_name").isin(*SOURCE)).withColumn("row", F.create_map(F.lit("id"), F.col("pk").cast("string"), F.lit("value"), F.lit("0")))
    columns = spark.createDataFrame([(t, c) for t, cs in SOURCE.items() for c in cs], "table_name string, column_name string")
    return rows, ddl, source, columns


def _applied(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    root = scratch(spark, "target")
    for name, columns in THERE.items():
        versioned.commit(spark.createDataFrame([], "_pk long, " + ", ".join(f"{c} string" for c in columns)), f"{root}/{name}", "load")
    told = timeline.apply_once(spark, root, *stream(spark, sf_dir))
    assert timeline.apply_once(spark, root, *stream(spark, sf_dir)).isEmpty()  # nothing comes after the checkpoint
    return root, told


def apply_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each row change: by the schema at its place, pending schema changes, bootstraps, and keys."""
    return _applied(spark, sf_dir)[1].select("id", "table_name", "op", "cause", "status", "last_error")


def apply_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the apply wrote, a row for each value, and one for the checkpoint."""
    root, _ = _applied(spark, sf_dir)
    out = versioned.read(spark, f"{root}/_checkpoint").select(F.lit("_checkpoint").alias("table_name"), F.lit(0).cast("long").alias("pk"), F.lit("last_id").alias("column_name"), F.col("last_id").cast("string").alias("value"))
    for name, table in timeline.tables(spark, root):
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in table.columns if c != "_pk")))
        out = out.unionByName(table.select(F.lit(name).alias("table_name"), F.col("_pk").alias("pk"), cells.alias("c")).select("table_name", "pk", F.col("c.k").alias("column_name"), F.col("c.v").alias("value")))
    return out.where("value is not null")


QUERIES = {f.__name__: f for f in (apply_timeline, apply_target)}

_COL = lambda k: f"'c' || (n + {k}) % 4"
# Each table is walked event by event: w holds its columns, whether it is there, its life, and up to which id schema
# changes were applied ahead of their turn.
_WALK = f"""{FEED}, e0 AS (SELECT f.*, 't' || e.user_id % 5 AS tab, f.id % {EVERY} = {EVERY - 1} AS ddl, CAST(floor(f.id / {EVERY}) AS BIGINT) AS n FROM feed f JOIN events e ON e.event_id = f.id),
    d AS (SELECT tab, id, CASE WHEN n % 5 = 4 AND n % 3 = 1 THEN 'create' WHEN n % 5 = 3 AND n % 4 = 3 THEN 'drop' END AS whole,
        CASE WHEN n % 5 = 0 THEN [{_COL(0)}] WHEN n % 5 = 2 THEN [{_COL(1)}] WHEN n % 5 = 3 AND n % 4 <> 3 THEN [{_COL(3)}] ELSE [] END AS adds,
        CASE WHEN n % 5 = 1 THEN [{_COL(0)}] WHEN n % 5 = 2 THEN [{_COL(2)}] ELSE [] END AS drops FROM e0 WHERE ddl),
    lim AS (SELECT r.tab, r.id, coalesce(min(x.id), 1000000000000) AS stop FROM e0 r LEFT JOIN d x ON x.tab = r.tab AND x.id > r.id AND x.whole IS NOT NULL WHERE NOT r.ddl GROUP BY 1, 2),
    later AS (SELECT l.tab, l.id, l.stop, x.id AS pos, unnest(list_concat(list_transform(x.adds, lambda c: {{'c': c, 'a': true}}), list_transform(x.drops, lambda c: {{'c': c, 'a': false}}), [{{'c': NULL, 'a': NULL}}])) AS u
        FROM lim l JOIN d x ON x.tab = l.tab AND x.id > l.id AND x.id < l.stop),
    ends AS (SELECT tab, id, u.c AS c, arg_max(u.a, pos) AS a, bool_or(NOT u.a) AS dropped FROM later GROUP BY 1, 2, 3),
    pend AS (SELECT tab, id, list(c) FILTER (WHERE a) AS padds, list(c) FILTER (WHERE c IS NOT NULL AND NOT a) AS pdrops, list(c) FILTER (WHERE a AND dropped) AS pagain FROM ends GROUP BY 1, 2),
    e AS (SELECT r.tab, r.id, r.ddl, r.op, r.pk, row_number() OVER (PARTITION BY r.tab ORDER BY r.id) AS k,
        CASE WHEN r.op = 'delete' THEN [] WHEN r.id % 3 = 0 THEN ['id', 'value', 'c' || r.n % 4] ELSE ['id', 'value'] END AS need,
        d.whole, d.adds, d.drops, l.stop, p.padds IS NOT NULL OR p.pdrops IS NOT NULL OR p.tab IS NOT NULL AS has, coalesce(p.padds, []) AS padds, coalesce(p.pdrops, []) AS pdrops, coalesce(p.pagain, []) AS pagain,
        CASE WHEN r.tab <> 't3' THEN ['id', 'value', 'c1'] END AS src
        FROM e0 r LEFT JOIN d USING (tab, id) LEFT JOIN lim l USING (tab, id) LEFT JOIN pend p USING (tab, id)),
    w AS (SELECT tab, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS id, CASE WHEN tab <> 't4' THEN ['id', 'value'] ELSE [] END AS cols, tab <> 't4' AS there, CAST(0 AS BIGINT) AS life, false AS booted, CAST(-1 AS BIGINT) AS upto,
            CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS VARCHAR) AS cause, CAST([] AS VARCHAR[]) AS fresh FROM (SELECT DISTINCT tab FROM e0)
        UNION ALL SELECT tab, k, id, cols4, there2, life2, CASE WHEN life2 = life THEN booted ELSE boot END, CASE WHEN pull THEN stop ELSE upto END, verdict, CASE WHEN verdict IS NULL AND NOT ddl THEN CASE WHEN pull THEN 'pending_ddl' WHEN boot THEN 'bootstrap' END END, fresh
        FROM (SELECT *, CASE WHEN ddl THEN CASE WHEN NOT on_turn THEN cols WHEN whole = 'drop' THEN [] WHEN whole = 'create' THEN CASE WHEN there THEN cols ELSE ['id', 'value'] END
                    WHEN there THEN list_concat(list_filter(cols, lambda c: NOT list_contains(list_concat(adds, drops), c)), adds) ELSE cols END ELSE cols2 END AS cols4,
                CASE WHEN ddl AND on_turn AND whole = 'drop' THEN false WHEN ddl AND on_turn AND whole = 'create' THEN true ELSE there OR boot END AS there2,
                life + CASE WHEN boot OR (ddl AND on_turn AND (whole = 'drop' OR (whole = 'create' AND NOT there))) THEN 1 ELSE 0 END AS life2,
                CASE WHEN ddl THEN NULL WHEN NOT there AND NOT boot THEN 'table_missing' WHEN len(list_filter(need, lambda c: NOT list_contains(cols2, c))) > 0 THEN 'schema_missing_column' END AS verdict,
                CASE WHEN ddl THEN CASE WHEN NOT on_turn OR whole = 'drop' THEN [] WHEN whole = 'create' THEN CASE WHEN there THEN [] ELSE ['id', 'value'] END WHEN there THEN list_filter(adds, lambda c: NOT list_contains(cols, c)) ELSE [] END
                    ELSE list_concat(CASE WHEN boot THEN src ELSE [] END, CASE WHEN pull THEN list_filter(padds, lambda c: NOT list_contains(cols1, c) OR list_contains(pagain, c)) ELSE [] END) END AS fresh
            FROM (SELECT *, CASE WHEN pull THEN list_concat(list_filter(cols1, lambda c: NOT list_contains(list_concat(padds, pdrops), c)), padds) ELSE cols1 END AS cols2
                FROM (SELECT *, NOT ddl AND (there OR boot) AND has AND id >= upto AND len(list_filter(need, lambda c: NOT list_contains(cols1, c))) > 0 AS pull
                    FROM (SELECT e.*, w.cols, w.there, w.life, w.booted, w.upto, e.id >= w.upto AS on_turn, NOT e.ddl AND NOT w.there AND e.src IS NOT NULL AS boot,
                            CASE WHEN NOT e.ddl AND NOT w.there AND e.src IS NOT NULL THEN e.src ELSE w.cols END AS cols1
                        FROM w JOIN e ON e.tab = w.tab AND e.k = w.k + 1))))),
    src_rows AS (SELECT DISTINCT tab, pk FROM e0 WHERE pk % 3 = 0 AND tab <> 't3'),
    fit AS (SELECT e.*, w.life, w.booted, w.cause FROM w JOIN e USING (tab, k) WHERE NOT e.ddl AND w.verdict IS NULL),
    judged AS (SELECT f.*, coalesce(b.op = 'insert', f.booted AND s.pk IS NOT NULL) AS known FROM (SELECT * FROM fit) f
        ASOF LEFT JOIN (SELECT tab, life, pk, id, op FROM fit WHERE op <> 'update') b ON b.tab = f.tab AND b.life = f.life AND b.pk = f.pk AND f.id > b.id
        LEFT JOIN src_rows s ON s.tab = f.tab AND s.pk = f.pk)"""
ORACLE_SQL = {
    "apply_timeline": f"""WITH RECURSIVE {_WALK}
        SELECT id, tab AS table_name, op, cause, CASE WHEN op = 'insert' AND known THEN 'failed' ELSE 'applied' END AS status, CASE WHEN op = 'insert' AND known THEN 'duplicate_key' WHEN op <> 'insert' AND NOT known THEN 'nothing_there' END AS last_error FROM judged
        UNION ALL SELECT e.id, tab, e.op, NULL, 'failed', w.verdict FROM w JOIN e USING (tab, k) WHERE w.verdict IS NOT NULL""",
    "apply_target": f"""WITH RECURSIVE {_WALK}, fin AS (SELECT tab, arg_max(life, k) AS life, arg_max(booted, k) AS booted, arg_max(there, k) AS there, arg_max(cols, k) AS cols FROM w GROUP BY 1),
        since AS (SELECT tab, c, max(id) AS since FROM (SELECT tab, id, unnest(fresh) AS c FROM w) GROUP BY 1, 2),
        began AS (SELECT w.tab, w.life, min(w.id) AS id FROM w GROUP BY 1, 2),
        hist AS (SELECT j.tab, j.pk, 2 * j.id + 1 AS o, j.id, j.op FROM judged j JOIN fin f ON f.tab = j.tab AND f.life = j.life AND f.there WHERE (j.op = 'insert') <> j.known
            UNION ALL SELECT s.tab, s.pk, 2 * b.id, b.id, 'source' FROM src_rows s JOIN fin f ON f.tab = s.tab AND f.booted AND f.there JOIN began b ON b.tab = f.tab AND b.life = f.life),
        life AS (SELECT tab, pk, arg_max(op, o) FILTER (WHERE op <> 'update') AS last, max(o) FILTER (WHERE op IN ('insert', 'source')) AS born FROM hist GROUP BY 1, 2),
        vals AS (SELECT h.tab, h.pk, h.o, h.id, unnest(CASE WHEN h.op = 'source' THEN [{{'c': 'id', 'v': CAST(h.pk AS VARCHAR)}}, {{'c': 'value', 'v': '0'}}]
                ELSE list_concat([{{'c': 'id', 'v': CAST(h.pk AS VARCHAR)}}, {{'c': 'value', 'v': CAST(CAST(r.value AS DECIMAL(20,4)) AS VARCHAR)}}], CASE WHEN h.id % 3 = 0 THEN [{{'c': 'c' || r.n % 4, 'v': CAST(r.k AS VARCHAR)}}] ELSE [] END) END) AS u
            FROM hist h LEFT JOIN e0 r ON r.id = h.id AND r.tab = h.tab WHERE h.op <> 'delete'),
        best AS (SELECT v.tab, v.pk, u.c AS c, arg_max(u.v, v.o) AS v FROM vals v JOIN life l ON l.tab = v.tab AND l.pk = v.pk AND l.last <> 'delete' AND v.o >= l.born
            JOIN fin f ON f.tab = v.tab LEFT JOIN since s ON s.tab = v.tab AND s.c = u.c WHERE list_contains(f.cols, u.c) AND v.id >= coalesce(s.since, -1) GROUP BY 1, 2, 3)
        SELECT tab AS table_name, pk, c AS column_name, v AS value FROM best WHERE v IS NOT NULL
        UNION ALL SELECT '_checkpoint', 0, 'last_id', CAST(max(id) AS VARCHAR) FROM e0""",
}
