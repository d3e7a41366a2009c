"""Model tables derived from the driver's TPC-H-like tables (FIXTURES.md §2).

Every model table is a projection/filter of a given table, so its size grows
with the scale factor. Ids are cast to strings, as in the model.

Fixture policies (FIXTURES.md): T = 0.5, R = 0.3, headroom 0.8,
as_of 2024-01-22 00:00; P1 targets the smallest customer key of nation 0,
P2 the smallest of nation 2. Look-back 12 h at every scale.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capshift import schemas
from capshift.functions.timecols import ts_literal
from capshift.params import RunParams

# Fixed fixture values.
AS_OF = dt.datetime(2024, 1, 22)
STATE_CREATED_AT = dt.datetime(2024, 1, 15)
MOVE_T, RECOVER_R, HEADROOM = 0.5, 0.3, 0.8
TARGET_NATION = {"P1": 0, "P2": 2}
COPY_OFFSET = 10 ** 9
UNKNOWN_OFFSET = 2 * 10 ** 9
LOOKBACK = dt.timedelta(hours=12)  # at every scale
INTERACTIVE_TYPES = ("click", "view", "purchase")


def _k() -> F.Column:
    return F.expr("try_cast(get_json_object(props, '$.k') AS INT)")


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


class Fixture:
    """Model tables for one fixture policy run over ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str, policy: str = "P1"):
        self.spark, self.sf_dir, self.policy = spark, sf_dir.rstrip("/"), policy
        self.params = RunParams(as_of=AS_OF, lookback=LOOKBACK, run_id=f"fixture-{policy}")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # -- events ---------------------------------------------------------------
    @staticmethod
    def envelope_from_events(events: DataFrame) -> DataFrame:
        """``events`` -> capacity event envelope ``(time, data JSON)``."""
        k = _k()
        payload = F.struct(
            (F.col("user_id") % 25).cast("string").alias("capacityId"),
            (F.col("value") * 1000).alias("capacityUnitMs"),
            F.when(k == 0, F.lit(0.0)).otherwise((8 + k % 8).cast("double")).alias("baseCapacityUnits"),
            F.when(F.col("event_type").isin(*INTERACTIVE_TYPES), F.col("value"))
             .otherwise(F.lit(0.0)).alias("utilizationInteractive"),
            k.cast("double").alias("utilizationBackground"),
        )
        return events.select(F.col("ts").alias("time"), F.to_json(payload).alias("data"))

    @cached_property
    def capacity_events(self) -> DataFrame:
        return self.envelope_from_events(self.table("events"))

    # -- inventory ------------------------------------------------------------
    @cached_property
    def target_workspace(self) -> str:
        """Smallest customer key of the policy's nation (one scalar)."""
        row = (self.table("customer").where(F.col("c_nationkey") == TARGET_NATION[self.policy])
               .agg(F.min("c_custkey").alias("k")).first())
        return str(row["k"])

    @cached_property
    def workspaces(self) -> DataFrame:
        return self.table("customer").select(
            _s("c_custkey").alias("workspace_id"), F.col("c_name").alias("name"),
            _s("c_nationkey").alias("capacity_id"))

    @cached_property
    def datasets(self) -> DataFrame:
        o = self.table("orders")
        key = F.col("o_orderkey")
        originals = o.where(key % 3 == 0).select(
            _s(key).alias("dataset_id"),
            F.concat(F.lit("model_"), _s(key % 997)).alias("name"),
            _s("o_custkey").alias("workspace_id"))
        initial = key - key % 3
        copies = (o.where(key % 14 == 0).select(initial.alias("d")).distinct().select(
            _s(F.col("d") + COPY_OFFSET).alias("dataset_id"),
            F.concat(F.lit("model_"), _s(F.col("d") % 997), F.lit("_LB")).alias("name"),
            F.lit(self.target_workspace).alias("workspace_id")))
        return originals.unionByName(copies)

    @cached_property
    def reports(self) -> DataFrame:
        key = F.col("o_orderkey")
        ds = key - key % 3 + F.when(key % 14 == 0, F.lit(COPY_OFFSET)).otherwise(F.lit(0))
        return self.table("orders").select(
            _s(key).alias("report_id"), _s("o_custkey").alias("workspace_id"), _s(ds).alias("dataset_id"))

    @cached_property
    def watch_lists(self) -> DataFrame:
        """Watched ids as comma lists, one list per block of 1,000 order keys.

        Tokens carry stray whitespace (space, tab, newline) that must be
        stripped. Each list is bounded by its block, never one list per policy.
        """
        key = F.col("o_orderkey")
        ids = self.table("orders").select(key)
        tokens = ids.select(
            F.floor(key / 1000).alias("block"),
            F.explode(F.when(key % 700 == 0, F.array(key, key + UNKNOWN_OFFSET))
                      .otherwise(F.array(key))).alias("id"))
        pad = F.col("id") % 3
        token = (F.when(pad == 1, F.concat(F.lit(" "), _s("id")))
                 .when(pad == 2, F.concat(_s("id"), F.lit("\t\n")))
                 .otherwise(_s("id")))
        # The policy id is a per-row value, as it is when read from a table. A
        # bare literal on both sides of the policy join lets the optimizer turn
        # the key into an always-true filter and plan a cross product.
        return (tokens.select("block", token.alias("token"))
                .groupBy("block").agg(F.concat_ws(",", F.collect_list("token")).alias("report_ids"))
                .select(F.when(F.col("block").isNotNull(), F.lit(self.policy)).alias("policy_id"), "report_ids"))

    @cached_property
    def state(self) -> DataFrame:
        key = F.col("o_orderkey")
        initial = key - key % 3
        return self.table("orders").where(key % 14 == 0).select(
            _s(initial).alias("initial_dataset_id"), _s("o_custkey").alias("report_workspace_id"),
            _s(key).alias("report_id"), _s(initial + COPY_OFFSET).alias("target_dataset_id"),
            F.lit(self.target_workspace).alias("target_workspace_id"),
            ts_literal(STATE_CREATED_AT).alias("created_at"))

    @cached_property
    def datasources(self) -> DataFrame:
        li = self.table("lineitem")
        key = F.col("l_orderkey")  # three reports share a model, so their line items share its datasources
        return li.select(_s(key - key % 3).alias("dataset_id"), _s("l_suppkey").alias("datasource_id")).distinct()

    @cached_property
    def connections(self) -> DataFrame:
        gw = F.when(F.col("s_nationkey") % 5 == 0, F.lit(None).cast("string")).otherwise(_s("s_nationkey"))
        return self.table("supplier").select(
            _s("s_suppkey").alias("datasource_id"),
            F.when(gw.isNull(), F.lit("Cloud")).otherwise(F.lit("Gateway"))
             .alias("connectivity_type"),
            gw.alias("gateway_id"),
            F.struct(F.col("s_name").alias("path"), F.lit("SQL").alias("type")).alias("connection_details"))

    @cached_property
    def refresh_schedules(self) -> DataFrame:
        key = F.col("o_orderkey")
        d = F.col("o_orderdate")
        return self.table("orders").where(key % 3 == 0).select(
            _s(key).alias("dataset_id"),
            F.array(F.date_format(d, "EEEE"), F.date_format(F.date_add(d, 3), "EEEE")).alias("days"),
            F.array(F.format_string("%02d:00", (key % 24).cast("int")),
                    F.format_string("%02d:30", ((key + 7) % 24).cast("int"))).alias("times"),
            F.lit("UTC").alias("local_time_zone_id"),
            (key % 2 == 0).alias("enabled"))

    @cached_property
    def policies(self) -> DataFrame:
        row = (self.policy, "", "", self.target_workspace, MOVE_T, RECOVER_R, HEADROOM)
        return self.spark.createDataFrame([row], schemas.POLICIES)

    # -- policies derived from customers (exercise every validation rule) -----
    @cached_property
    def customer_policies(self) -> DataFrame:
        """One policy per customer; its key picks one combination of settings.

        key % 8: 0 explicit target; 1 existing name; 2 unknown name + capacity
        (create); 3 target + capacity (invalid); 4 name + target (invalid);
        5 capacity without name (invalid); 6 nothing set (invalid);
        7 explicit unknown workspace. Thresholds come from the balance; every
        ninth has R >= T (invalid).
        """
        c = self.table("customer")
        key = F.col("c_custkey")
        case = key % 8
        name = F.col("c_name")
        ws_name = (F.when(case == 1, name).when(case == 2, F.concat(name, F.lit("_LB")))
                   .when(case == 4, name).otherwise(F.lit("")))
        cap = F.when(case.isin(2, 3, 5), _s("c_nationkey")).otherwise(F.lit(""))
        target = (F.when(case.isin(0, 3, 4), _s(key)).when(case == 7, _s(key + UNKNOWN_OFFSET))
                  .otherwise(F.lit("")))
        t = F.round(F.abs(F.col("c_acctbal")) / 10000, 2)
        r = F.when(key % 9 == 0, t + 0.1).otherwise(F.round(t * 0.8, 2))
        return c.select(
            F.concat(F.lit("C"), _s(key)).alias("policy_id"), ws_name.alias("workspace_name"),
            cap.alias("capacity_to_deploy"), target.alias("target_workspace"),
            t.alias("move_threshold"), r.alias("recovery_threshold"), F.lit(HEADROOM).alias("headroom"))
