"""Joins, aggregations, windows and set operations over the star schema and the membership tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.catalog import query, table
from larkspan.operators import ranking
from larkspan.plans.bases import base, sub


@query("star_pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def star_pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("star_revenue_by_nation", """
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_revenue_by_nation(spark, d):
    line, orders, customer, nation, region = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    # Revenue is summed to orders before it meets the rest, so that the large side is shuffled once, on its own key.
    per_order = line.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("part"))
    joined = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum("part"), 2).alias("revenue"), F.count("*").alias("orders"))


@query("star_customers_without_orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def star_customers_without_orders(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("star_segments_with_urgent_orders", """
SELECT c_mktsegment, count(*) AS customers FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') GROUP BY 1""")
def star_segments_with_urgent_orders(spark, d):
    urgent = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("star_cube_status_priority", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def star_cube_status_priority(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("star_rollup_brand_size", "SELECT p_brand, p_size, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY ROLLUP (p_brand, p_size)")
def star_rollup_brand_size(spark, d):
    return table(spark, d, "part").rollup("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("star_running_spend", """
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER w AS previous, row_number() OVER w AS nth
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def star_running_spend(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("previous"), F.row_number().over(w).alias("nth")
    )


@query("star_top_parts_per_brand", """
SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3""")
def star_top_parts_per_brand(spark, d):
    return ranking.top_k_per(table(spark, d, "part"), ["p_brand"], [F.col("p_retailprice").desc(), "p_partkey"], 3).select("p_brand", "p_partkey", "p_retailprice", "rank")


@query("set_nations_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_nations_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set_nations_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_nations_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("set_orders_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_orders_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("set1_union_all_lists", f"SELECT provider, count(*) AS n FROM {sub('results')} GROUP BY 1")
def set1_union_all_lists(spark, d):
    return base(spark, d, "results").groupBy("provider").agg(F.count("*").alias("n"))


_PERMISSIONS = ["search:read", "content:read", "status:read", "knowledge:read", "knowledge:write", "memory:read", "memory:write", "cache:manage"]


def _granted(segment):
    """What a segment's members may do: as many permissions, in canonical order, as its name has letters less five."""
    return F.slice(F.array(*map(F.lit, _PERMISSIONS)), F.lit(1), F.greatest(F.length(segment) - 5, F.lit(1)))


_SQL_ALL = "['search:read','content:read','status:read','knowledge:read','knowledge:write','memory:read','memory:write','cache:manage']"
_SQL_GRANTED = f"list_slice({_SQL_ALL}, 1, greatest(len(segment) - 5, 1))"


@query("join5_active_memberships", f"""
SELECT m.principal_id, w.workspace_id, w.tenant_id, {_SQL_GRANTED} AS permissions FROM {sub('memberships')} m
JOIN {sub('workspaces')} w USING (workspace_id) WHERE m.revoked_at IS NULL AND w.disabled_at IS NULL""")
def join5_active_memberships(spark, d):
    own = base(spark, d, "memberships").filter("revoked_at IS NULL")
    return own.join(base(spark, d, "workspaces").filter("disabled_at IS NULL"), "workspace_id").select("principal_id", "workspace_id", "tenant_id", _granted(F.col("segment")).alias("permissions"))


@query("set3_effective_permissions", f"""
SELECT principal_id, list_filter({_SQL_GRANTED}, lambda x: x IN ('search:read', 'knowledge:read', 'knowledge:write')) AS effective FROM {sub('memberships')}""")
def set3_effective_permissions(spark, d):
    asked = F.array(*map(F.lit, ("search:read", "knowledge:read", "knowledge:write")))
    return base(spark, d, "memberships").select("principal_id", F.array_intersect(_granted(F.col("segment")), asked).alias("effective"))


@query("set6_still_granted", f"SELECT principal_id, list_has_all({_SQL_GRANTED}, ['search:read', 'knowledge:read']) AS granted FROM {sub('memberships')}")
def set6_still_granted(spark, d):
    asked = F.array(F.lit("search:read"), F.lit("knowledge:read"))
    return base(spark, d, "memberships").select("principal_id", (F.size(F.array_except(asked, _granted(F.col("segment")))) == 0).alias("granted"))


@query("flt10_permission", f"SELECT principal_id FROM {sub('memberships')} WHERE list_contains({_SQL_GRANTED}, 'knowledge:write')")
def flt10_permission(spark, d):
    return base(spark, d, "memberships").filter(F.array_contains(_granted(F.col("segment")), "knowledge:write")).select("principal_id")


@query("join14_workspace_members", f"""
SELECT w.workspace_id, count(m.principal_id) AS members, list_sort(list(m.principal_id) FILTER (WHERE m.principal_id IS NOT NULL)) AS names
FROM {sub('workspaces')} w LEFT JOIN {sub('memberships')} m USING (workspace_id) GROUP BY 1""")
def join14_workspace_members(spark, d):
    joined = base(spark, d, "workspaces").join(base(spark, d, "memberships"), "workspace_id", "left")
    names = F.array_sort(F.collect_list("principal_id"))
    return joined.groupBy("workspace_id").agg(F.count("principal_id").alias("members"), F.when(F.size(names) > 0, names).alias("names"))


@query("gov3_dispatch_decisions", f"""
SELECT event_id, CASE WHEN tool NOT IN ('view', 'click', 'purchase', 'signup') THEN 'unknown_tool' WHEN tool = 'purchase' AND user_id % 5 <> 0 THEN 'forbidden'
  WHEN tool = 'signup' AND user_id % 2 = 0 THEN 'execution_mode_unavailable' ELSE 'run' END AS decision FROM {sub('usage')}""")
def gov3_dispatch_decisions(spark, d):
    tool, user = F.col("tool"), F.col("user_id")
    decision = (
        F.when(~tool.isin("view", "click", "purchase", "signup"), "unknown_tool")
        .when((tool == "purchase") & (user % 5 != 0), "forbidden")
        .when((tool == "signup") & (user % 2 == 0), "execution_mode_unavailable")
        .otherwise("run")
    )
    return base(spark, d, "usage").select("event_id", decision.alias("decision"))


@query("gov10_token_eligibility", f"""
SELECT tenant_id, count(*) AS eligible FROM {sub('memberships')} m JOIN {sub('workspaces')} w USING (workspace_id)
WHERE revoked_at IS NULL AND disabled_at IS NULL GROUP BY 1""")
def gov10_token_eligibility(spark, d):
    return join5_active_memberships(spark, d).groupBy("tenant_id").agg(F.count("*").alias("eligible"))
