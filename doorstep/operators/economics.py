"""Order economics: cost lines, margins, break-even, exposure, exemplar reconciliation.

Money stays decimal. Each line is rounded to two places first and every total is the sum
of rounded lines, so the published identities hold exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.scalar import flag, lookup, ratio

COST_LINES = ("forward_shipping_cost", "packaging_cost", "payment_processing_fee",
              "cod_handling_cost", "reverse_shipping_cost", "reverse_handling_cost",
              "shrink_cost", "cod_failed_attempt_cost", "working_capital_cost",
              "support_ndr_cost", "ops_allocation_cost")


def _d(text: str, kind: str = "decimal(9,7)") -> Column:
    return F.lit(text).cast(kind)


def _money(col: Column, kind: str = "decimal(10,2)") -> Column:
    return col.cast(kind)


def order_economics(orders: DataFrame, products: DataFrame, geography: DataFrame, *,
                    ndr_base: str = "9", wc_factor: str = P.WC_FACTOR,
                    noise: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per order with the eleven cost lines and the derived margins.

    ``noise`` maps ``forward``, ``packaging``, ``reverse_shipping`` or ``reverse_handling``
    to an additive column; it defaults to zero.
    """
    noise = dict(noise or {})
    extra = lambda name: noise.get(name, _d("0", "decimal(6,2)"))
    p = products.select("product_id", "cogs_ratio", "weight_band", "shrink_rate")
    g = geography.select(F.col("geography_id").alias("delivery_geography_id"),
                         "forward_freight_base")
    o = orders.join(p, "product_id").join(g, "delivery_geography_id")

    cod = F.col("payment_method") == "COD"
    delivered, rto = flag("is_delivered"), flag("rto_flag")
    shipped, cancelled = F.col("is_shipped"), F.col("is_cancelled_preship")
    zero = _d("0", "decimal(10,2)")
    only = lambda cond, col: F.when(cond, col).otherwise(zero)
    nonneg = lambda col: F.greatest(col, _d("0", "decimal(6,2)"))

    value = F.col("order_value")
    revenue = (value + _d(P.SHIPPING_FEE, "decimal(6,2)")
               + F.when(cod, _d(P.COD_FEE, "decimal(6,2)")).otherwise(_d("0", "decimal(6,2)"))
               ).cast("decimal(10,2)")
    goods = (F.col("cogs_ratio") * revenue).cast("decimal(14,5)")
    weight = lookup("weight_band", P.FREIGHT_WEIGHT_FACTOR, kind="decimal(3,2)")
    forward = only(shipped, nonneg((F.col("forward_freight_base") * weight + extra("forward"))
                                   .cast("decimal(12,4)"))).cast("decimal(12,4)")
    rail_rate = F.when(F.col("payment_rail").isNull(), _d("0", "decimal(4,3)")).otherwise(
        lookup("payment_rail", P.RAIL_FEE_RATE, default=P.PG_FEE_RATE, kind="decimal(4,3)"))
    handling = _d(P.COD_HANDLING_RATE, "decimal(4,3)") * value + _d(P.COD_HANDLING_FIXED,
                                                                   "decimal(4,2)")
    attempts = F.coalesce(F.col("delivery_attempts").cast("int"), F.lit(1))
    gross_fee = F.when(cod, _d("0", "decimal(6,2)")).otherwise(_money(rail_rate * value,
                                                                      "decimal(6,2)"))
    gross_pack = nonneg(lookup("weight_band", P.PACKAGING, kind="decimal(6,2)")
                        + extra("packaging"))
    raw = o.select(
        "order_id", "gmv", cancelled.alias("_cancelled"), rto.alias("_rto"),
        (F.col("gmv") - value).cast("decimal(10,2)").alias("discount_cost"),
        _money(only(delivered, _d(P.SHIPPING_FEE, "decimal(6,2)")), "decimal(6,2)")
        .alias("shipping_fee_revenue"),
        _money(only(delivered & cod, _d(P.COD_FEE, "decimal(6,2)")), "decimal(6,2)")
        .alias("cod_fee_revenue"),
        _money(only(delivered, revenue)).alias("net_revenue"),
        _money(only(delivered, goods)).alias("cogs"), _money(goods).alias("cogs_value"),
        _money(forward, "decimal(6,2)").alias("forward_shipping_cost"),
        _money(only(rto, nonneg((_d(P.REVERSE_FREIGHT_MULTIPLIER, "decimal(3,2)") * forward
                                 + extra("reverse_shipping")).cast("decimal(14,6)"))),
               "decimal(6,2)").alias("reverse_shipping_cost"),
        _money(only(shipped, gross_pack), "decimal(6,2)").alias("packaging_cost"),
        _money(gross_fee, "decimal(6,2)").alias("payment_processing_fee"),
        _money(only(cod & delivered, handling), "decimal(6,2)").alias("cod_handling_cost"),
        _money(only(rto & cod, _d(P.COD_FAILED_ATTEMPT_FEE, "decimal(6,2)")), "decimal(6,2)")
        .alias("cod_failed_attempt_cost"),
        _money(only(rto, nonneg((_d(P.REVERSE_HANDLING_BASE, "decimal(4,2)") * weight
                                 + extra("reverse_handling")).cast("decimal(12,4)"))),
               "decimal(6,2)").alias("reverse_handling_cost"),
        _money(only(rto, F.col("shrink_rate") * goods), "decimal(8,2)").alias("shrink_cost"),
        _money(F.when(rto, _d(ndr_base, "decimal(8,4)") + _d(str(P.SUPPORT_NDR_SLOPE),
                                                             "decimal(4,2)") * attempts)
               .when(delivered, _d(P.SUPPORT_DELIVERED, "decimal(6,2)"))
               .otherwise(_d("0", "decimal(6,2)")), "decimal(6,2)").alias("support_ndr_cost"),
        _money(only(rto, goods * _d(wc_factor, "decimal(8,7)")), "decimal(6,2)")
        .alias("working_capital_cost"),
        _money(only(delivered, _d(P.OPS_ALLOCATION_DELIVERED, "decimal(6,2)")), "decimal(6,2)")
        .alias("ops_allocation_cost"),
        _money(revenue - goods - forward - only(shipped, gross_pack) - rail_rate * value
               * F.when(cod, F.lit(0)).otherwise(F.lit(1))
               - F.when(cod, handling.cast("decimal(14,5)")).otherwise(_d("0", "decimal(14,5)"))
               - _d(P.SUPPORT_DELIVERED, "decimal(6,2)")
               - _d(P.OPS_ALLOCATION_DELIVERED, "decimal(6,2)"))
        .alias("counterfactual_cm_if_delivered"))
    lines = [c for c in raw.columns if not c.startswith("_") and c != "order_id"]
    kinds = dict(raw.dtypes)
    raw = raw.select("order_id", "_rto", *[
        F.when(F.col("_cancelled"), F.lit(0)).otherwise(F.col(c)).cast(kinds[c]).alias(c)
        for c in lines], (F.col("_rto") & ~F.col("_cancelled")).alias("_lost"))
    total = sum((F.col(c) for c in COST_LINES[1:]), F.col(COST_LINES[0]))
    raw = raw.withColumn("total_variable_cost", _money(total))
    raw = raw.withColumn("contribution_margin",
                         _money(F.col("net_revenue") - F.col("cogs")
                                - F.col("total_variable_cost")))
    raw = raw.withColumns({
        "rto_cash_loss": _money(only(F.col("_lost"), -F.col("contribution_margin"))),
        "foregone_cm": _money(only(F.col("_lost"), F.col("counterfactual_cm_if_delivered")))})
    raw = raw.withColumn("rto_economic_cost",
                         _money(F.col("rto_cash_loss") + F.col("foregone_cm")))
    from ..schemas import columns
    return raw.select(*columns("fct_order_economics"))


def ndr_base(orders: DataFrame, target: float = P.SUPPORT_NDR_TARGET,
             slope: float = P.SUPPORT_NDR_SLOPE) -> DataFrame:
    """Support-cost base so that returned orders average ``target``; NULL without returns."""
    attempts = F.coalesce(F.col("delivery_attempts").cast("double"), F.lit(1.0))
    return orders.agg(
        F.count_if(flag("rto_flag")).alias("rto_orders"),
        F.avg(F.when(flag("rto_flag"), attempts)).alias("mean_attempts")).select(
        "rto_orders", "mean_attempts",
        (F.lit(target) - slope * F.col("mean_attempts")).alias("ndr_base"))


def breakeven(orders: DataFrame, economics: DataFrame) -> DataFrame:
    """Realised COD break-even return probability."""
    e = economics.select("order_id", "contribution_margin", "rto_cash_loss", "rto_economic_cost")
    cod = orders.where(F.col("payment_method") == "COD").select(
        "order_id", flag("is_delivered").alias("delivered"), flag("rto_flag").alias("rto"))
    mean = lambda cond, c: ratio(F.sum(F.when(F.col(cond), F.col(c))),
                                 F.count_if(F.col(cond)))
    one = cod.join(e, "order_id").agg(
        mean("delivered", "contribution_margin").alias("cod_delivered_cm"),
        mean("rto", "rto_cash_loss").alias("cash"), mean("rto", "rto_economic_cost").alias("econ"))
    return one.select("cod_delivered_cm", (-F.col("cash")).alias("cod_rto_cash_loss"),
                      (-F.col("econ")).alias("cod_rto_economic_cost"),
                      ratio("cod_delivered_cm", F.col("cod_delivered_cm") + F.col("cash"))
                      .alias("breakeven_rto_probability"))


def annualised_exposure(orders: DataFrame, economics: DataFrame) -> DataFrame:
    """Annual return cost in crore, scaled on resolved orders only."""
    j = orders.join(economics.select("order_id", "rto_economic_cost"), "order_id")
    resolved = ~F.col("is_cancelled_preship") & ~F.col("is_censored")
    one = j.agg(F.count(F.lit(1)).alias("orders"), F.count_if(resolved).alias("resolved"),
                F.sum(F.when(flag("rto_flag"), F.col("rto_economic_cost"))).alias("cost"))
    return one.select(
        "orders", "resolved", (F.col("orders") - F.col("resolved")).alias("excluded"),
        (ratio("cost", "resolved") * P.POPULATION_ANNUAL_ORDERS / 1e7).alias("exposure_cr"))


def prepaid_economics(orders: DataFrame, economics: DataFrame) -> DataFrame:
    """Return rate and mean margins of resolved prepaid orders."""
    base = orders.where((F.col("payment_method") == "PREPAID") & F.col("is_shipped")
                        & ~F.col("is_censored"))
    j = base.join(economics.select("order_id", "contribution_margin"), "order_id")
    rto = flag("rto_flag")
    mean = lambda cond: ratio(F.sum(F.when(cond, F.col("contribution_margin"))),
                              F.count_if(cond))
    return j.agg(ratio(F.count_if(rto), F.count(F.lit(1))).alias("prepaid_rto_rate"),
                 mean(~rto).alias("cm_delivered"), mean(rto).alias("cm_rto"))


def exemplar(gmv: float = 1000.0) -> dict[str, float]:
    """Closed-form margins of one order of ``gmv`` at blended parameters."""
    blend = lambda values, weights: sum(float(values[k]) * w for k, w in weights.items())
    value = gmv * (1 - P.PLATFORM_DISCOUNT)
    goods = P.COGS_RATIO_MEAN * value
    forward = (blend(P.FORWARD_FREIGHT, P.GEO_TIER_WEIGHTS)
               * blend(P.FREIGHT_WEIGHT_FACTOR, P.WEIGHT_BAND_WEIGHTS))
    shared = forward + blend(P.PACKAGING, P.WEIGHT_BAND_WEIGHTS)
    fixed = float(P.SUPPORT_DELIVERED) + float(P.OPS_ALLOCATION_DELIVERED)
    margin = lambda fee: value - goods - shared - fixed - fee
    prepaid = margin(float(P.PG_FEE_RATE) * value)
    cod = margin(float(P.COD_HANDLING_RATE) * value + float(P.COD_HANDLING_FIXED))
    blocked_days = math.exp(P.WC_DAYS_MU + P.WC_DAYS_SIGMA ** 2 / 2)
    cash = (shared + float(P.REVERSE_FREIGHT_MULTIPLIER) * forward
            + float(P.REVERSE_HANDLING_BASE)
            + blend(P.SHRINK_BY_CATEGORY, P.CATEGORY_WEIGHTS) * goods
            + goods * P.WC_ANNUAL_RATE * blocked_days / 365
            + float(P.COD_FAILED_ATTEMPT_FEE) + P.SUPPORT_NDR_TARGET)
    return {"prepaid_delivered_cm": prepaid, "cod_delivered_cm": cod,
            "cod_rto_cash_loss": -cash, "cod_rto_economic_cost": -(cash + cod),
            "breakeven_rto_prob": cod / (cod + cash)}
