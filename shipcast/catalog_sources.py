"""Registered source / sink queries: CSV scans with explicit schemas,
timestamp parsing, the prepared-data hand-off, projection, and box
statistics per level (blueprint steps 1 and 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .catalog import r9, register
from .catalog_levels import _GRP, MIN_MOVER
from .operators import distributions as D
from .operators import levels as L
from .plans import datasets as ds
from .plans import variables as V
from .sources import files
from .sources.fixtures import order_items
from .sources.tables import load_tables
from .session import fresh_path, stored_table


def _csv_roundtrip(spark, name, df):
    path = fresh_path(spark, name)
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


@register("scan_orders", O.sql("SELECT * FROM oe"))
def q_scan_orders(spark, sf):
    """Order-level table written as CSV and scanned back with its explicit schema."""
    return _csv_roundtrip(spark, "orders_csv", ds.orders(spark, sf))


@register("scan_items", O.sql("SELECT * FROM oi", items=True))
def q_scan_items(spark, sf):
    """Item-level table written as CSV and scanned back with its explicit schema."""
    return _csv_roundtrip(spark, "items_csv", order_items(load_tables(spark, sf)).drop("Rww_ID"))


_TS_COLS = [O.PTS, O.APPR, O.CARR, O.DELIV, O.EST, "shipping_limit_date"]


@register("parse_ts", O.sql(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_parsed, count(*) - count({c}) AS n_null FROM oi"
        for c in _TS_COLS) + ")", items=True))
def q_parse_ts(spark, sf):
    """Parse the item timestamps from CSV text: parsed vs null per column
    (missing or malformed text becomes null)."""
    items = order_items(load_tables(spark, sf)).drop("Rww_ID")
    path = fresh_path(spark, "items_csv_ts")
    files.write_csv(items.select(*_TS_COLS), path)
    raw = spark.read.option("header", True).csv(path)  # all text
    parsed = raw.select(*[files.parse_ts(c).alias(c) for c in _TS_COLS])
    wide = parsed.agg(*[F.count(c).alias(f"{c}__n") for c in _TS_COLS], F.count(F.lit(1)).alias("_all"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n_parsed"),
                                        (F.col("_all") - F.col(f"{c}__n")).alias("n_null")) for c in _TS_COLS]))
    return wide.select(rows.alias("r")).select("r.*")


@register("checkpoint_roundtrip", O.on_features(" UNION ALL ".join(
    f"SELECT Rww_ID, '{part}' AS part, " + ", ".join(V.REG_PREDICTORS) + f", fulfill_duration FROM reg_{part}"
    for part in ("train", "test"))))
def q_checkpoint_roundtrip(spark, sf):
    """Prepared training and test rows written (typed parquet + predictor list)
    to the shared folder and read back for a later session."""
    out = None
    for part, rows in zip(("train", "test"), ds.reg_split(spark, sf, [*V.REG_PREDICTORS, V.REG_TARGET])):
        path = files.write_prepared(rows.select("Rww_ID", *V.REG_PREDICTORS, V.REG_TARGET),
                                    f"reg_{part}", V.REG_PREDICTORS)
        df, preds = files.read_prepared(spark, path)
        df = df.select("Rww_ID", F.lit(part).alias("part"), *preds, V.REG_TARGET)
        out = df if out is None else out.unionByName(df)
    return out


# the schema of the text, and where its fields are spoiled: Rww_ID % modulus == remainder
_TEXT_SCHEMA = ("Rww_ID bigint, order_status string, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
                "order_delivered_customer_date timestamp_ntz, ttl_price double, nbr_items int, customer_state string")
_SPOILED = {"order_approved_at": (101, 5, "yesterday"), "order_delivered_customer_date": (103, 7, "2020-13-45 10:00:00"),
            "ttl_price": (107, 3, "12;50"), "nbr_items": (113, 2, "2.5 items")}
_EXTRA_FIELD = (109, 11)


def _spoiled_text(orders):
    """Lines of CSV text with fields that are not of their type, and lines with a field too many."""
    names = [part.split()[0] for part in _TEXT_SCHEMA.split(", ")]
    fields = []
    for c in names:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        if c in _SPOILED:
            m, r, bad = _SPOILED[c]
            text = F.when(F.col("Rww_ID") % m == r, F.lit(bad)).otherwise(text)
        fields.append(text)
    line = F.concat_ws(",", *fields)
    return orders.select(F.when(F.col("Rww_ID") % _EXTRA_FIELD[0] == _EXTRA_FIELD[1], F.concat(line, F.lit(",surplus")))
                         .otherwise(line).alias("value"))


_TYPES = {"order_approved_at": "timestamp_ntz", "order_delivered_customer_date": "timestamp_ntz", "ttl_price": "double", "nbr_items": "int"}
_WHOLE = f"Rww_ID % {_EXTRA_FIELD[0]} <> {_EXTRA_FIELD[1]}"


@register("quarantine", O.sql(" UNION ALL ".join([
    f"SELECT '{c}' AS column_name, '{_TYPES[c]}' AS reason, '{bad}' AS text, count(*) AS n FROM oe "
    f"WHERE {_WHOLE} AND Rww_ID % {m} = {r} HAVING count(*) > 0" for c, (m, r, bad) in _SPOILED.items()]
    + [f"SELECT NULL, 'fields', NULL, count(*) FROM oe WHERE NOT ({_WHOLE}) HAVING count(*) > 0",
       f"SELECT NULL, 'rows read', NULL, count(*) FROM oe WHERE {_WHOLE}"]
    + [f"SELECT '{c}', 'values read', NULL, count({c}) FROM oe WHERE {_WHOLE} AND Rww_ID % {m} <> {r}"
       for c, (m, r, _) in _SPOILED.items()])))
def q_quarantine(spark, sf):
    """Order text with malformed fields and rows: what went to the side table per column,
    reason and text, and what was read."""
    from pyspark.sql.types import _parse_datatype_string
    path = fresh_path(spark, "spoiled_csv")
    _spoiled_text(ds.orders(spark, sf)).write.text(path)
    rows, bad = files.read_quarantined(spark, path, _parse_datatype_string(_TEXT_SCHEMA))
    text = F.when(F.col("reason") != "fields", F.col("text"))
    found = bad.groupBy("column_name", "reason", text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    wide = rows.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in _SPOILED])
    read = [F.struct(none.alias("column_name"), F.lit("rows read").alias("reason"), none.alias("text"), F.col("_all").alias("n"))]
    read += [F.struct(F.lit(c).alias("column_name"), F.lit("values read").alias("reason"), none.alias("text"), F.col(c).alias("n"))
             for c in _SPOILED]
    return found.unionByName(wide.select(F.explode(F.array(*read)).alias("r")).select("r.*"))


BUCKETS = 16
_GRPD = [c + "__grpd" for c in V.REG_HICARD]


@register("bucketed_handoff", O.sql(f"""
SELECT g.Rww_ID, g.part, r.fulfill_duration, {', '.join('g.' + c for c in _GRPD)}, i.items, i.items_price, i.last_limit
FROM grp g JOIN reg r USING (Rww_ID)
JOIN (SELECT CAST(order_id AS BIGINT) AS Rww_ID, count(*) AS items, round(sum(price), 2) AS items_price,
             max(shipping_limit_date) AS last_limit FROM oi GROUP BY 1) i USING (Rww_ID)""",
    O.FEAT, O.CC, _GRP, items=True))
def q_bucketed_handoff(spark, sf):
    """Prepared orders (split, target, grouped levels) and their items handed over as two
    tables bucketed and sorted by the order: rolled up and joined without an exchange."""
    orders, items = handoff_tables(spark, sf)
    return handoff_join(orders, items)


def handoff_tables(spark, sf):
    train, test = ds.reg_split(spark, sf, [V.REG_TARGET, *V.REG_HICARD])
    both = (train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
            .select("Rww_ID", "part", V.REG_TARGET, *V.REG_HICARD))
    both = stored_table(both, "prepared-orders")
    train = both.where("part = 'train'")
    movers = L.big_movers(L.level_stats(train, V.REG_HICARD, V.REG_TARGET), train, V.REG_TARGET, MIN_MOVER)
    grouped = L.group_rare_levels(both, movers, V.REG_HICARD).select("Rww_ID", "part", V.REG_TARGET, *_GRPD)
    items = order_items(load_tables(spark, sf)).select(F.col("order_id").cast("long").alias("Rww_ID"), "order_item_id", "price", "shipping_limit_date")
    return (files.write_bucketed(grouped, "orders", "Rww_ID", BUCKETS), files.write_bucketed(items, "items", "Rww_ID", BUCKETS))


def handoff_join(orders, items):
    per_order = items.groupBy("Rww_ID").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("price"), 2).alias("items_price"),
                                            F.max("shipping_limit_date").alias("last_limit"))
    return orders.join(per_order, "Rww_ID")


@register("project", O.on_features(" UNION ALL ".join(
    f"SELECT Rww_ID, '{part}' AS part, " + ", ".join(V.CLF_BASIC) + f" FROM clf_{part}" for part in ("train", "test"))))
def q_project(spark, sf):
    """Column projection by name list (pruned down to the parquet scans)."""
    train, test = ds.clf_split(spark, sf, [*V.CLF_BASIC])
    return (train.select("Rww_ID", F.lit("train").alias("part"), *V.CLF_BASIC)
            .unionByName(test.select("Rww_ID", F.lit("test").alias("part"), *V.CLF_BASIC)))


_BOX_VARS = V.REG_LOWCARD


@register("box_stats_by_level", O.on_features("""
SELECT q.variabl, q.ctgry_lvl, q.n, round(q.q1, 9) AS q1, round(q.median, 9) AS median, round(q.q3, 9) AS q3,
       w.whisker_lo, w.whisker_hi, w.n_outliers
FROM bl_piv q JOIN (
  SELECT l.variabl, l.ctgry_lvl,
         min(l.fulfill_duration) FILTER (WHERE l.fulfill_duration >= f.lo) AS whisker_lo,
         max(l.fulfill_duration) FILTER (WHERE l.fulfill_duration <= f.hi) AS whisker_hi,
         count(*) FILTER (WHERE l.fulfill_duration < f.lo OR l.fulfill_duration > f.hi) AS n_outliers
  FROM bl_lv l JOIN (SELECT variabl, ctgry_lvl, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM bl_piv) f
    USING (variabl, ctgry_lvl)
  GROUP BY l.variabl, l.ctgry_lvl) w USING (variabl, ctgry_lvl)""",
    O.long_levels_cte("bl_lv0", "reg_train", _BOX_VARS, [V.REG_TARGET])
    + ",\nbl_lv AS (SELECT * FROM bl_lv0 WHERE fulfill_duration IS NOT NULL),"
    + O.quantiles_cte("bl_q", "bl_lv", ["variabl", "ctgry_lvl"], V.REG_TARGET, [0.25, 0.5, 0.75])
    + """,
bl_piv AS (
  SELECT variabl, ctgry_lvl, max(n) AS n, max(v) FILTER (WHERE p = 0.25) AS q1, max(v) FILTER (WHERE p = 0.5) AS median,
         max(v) FILTER (WHERE p = 0.75) AS q3
  FROM bl_q JOIN (SELECT variabl, ctgry_lvl, count(*) AS n FROM bl_lv GROUP BY 1, 2) c USING (variabl, ctgry_lvl)
  GROUP BY variabl, ctgry_lvl)"""))
def q_box_stats_by_level(spark, sf):
    """Box statistics of the delivery time per level of several categorical
    variables at once (long form, one quartile job and one whisker job)."""
    train, _ = ds.reg_split(spark, sf, [V.REG_TARGET, *V.REG_LOWCARD])
    lv = L.long_levels(train.where(F.col(V.REG_TARGET).isNotNull()), _BOX_VARS, [V.REG_TARGET])
    b = D.box_stats(lv, V.REG_TARGET, ["variabl", "ctgry_lvl"])
    return b.select("variabl", "ctgry_lvl", "n", r9("q1"), r9("median"), r9("q3"), "whisker_lo", "whisker_hi",
                    "n_outliers")
