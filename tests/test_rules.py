"""Rules: fixed example cases, text rounding, and random rows against a plain-Python reading."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from stockrisk.functions import rules
from stockrisk.functions.numeric import fixed_text
from stockrisk.operators.analysis import analyse, evaluate_rules, rejected_values, stored_analysis
from stockrisk.operators.tasks import TASK_TYPES, generate_tasks
from stockrisk.schemas import STORED_ANALYSIS

NULL = "cast(NULL AS double)"

CASES = [
    # daily sales, cover, stockout level
    (rules.daily_sales("10D", "8D"), 10.0),
    (rules.daily_sales("0D", "10D"), 10.0),
    (rules.daily_sales("0D", "0D"), 0.0),
    (rules.cover_days("500", "10D"), 50.0),
    (rules.cover_days("140", "20D"), 7.0),
    (rules.cover_days("50", "10D"), 5.0),
    (rules.cover_days("100", "0D"), None),
    (rules.cover_days("1000", "5D"), 200.0),
    (rules.cover_days("900", "10D"), 90.0),
    (rules.stockout_level("500", "50D", "7", "30"), "low"),
    (rules.stockout_level("0", NULL, "7", "30"), "critical"),
    (rules.stockout_level("50", "5D", "7", "30"), "critical"),
    (rules.stockout_level("200", "25D", "7", "30"), "high"),
    (rules.stockout_level("300", "35D", "7", "30"), "medium"),
    (rules.stockout_level("500", "60D", "7", "30"), "low"),
    (rules.stockout_level("100", NULL, "7", "30"), "unknown"),
    (rules.stockout_level("10", "7D", "7", "30"), "critical"),
    (rules.stockout_level("10", "30D", "7", "30"), "high"),
    (rules.stockout_level("10", "37D", "7", "30"), "medium"),
    (rules.stockout_level("10", "5D", "NULL", "NULL"), "medium"),
    # overstock
    (rules.overstock_level("1000", "5D", "200D"), "high"),
    (rules.overstock_level("500", "0D", NULL), "high"),
    (rules.overstock_level("500", "5D", "100D"), "medium"),
    (rules.overstock_level("300", "10D", "30D"), "low"),
    (rules.overstock_level("0", "0D", NULL), "low"),
    (rules.overstock_level("10", "5D", NULL), "unknown"),
    (rules.overstock_level("10", "5D", "180D"), "high"),
    (rules.overstock_level("10", "5D", "90D"), "medium"),
    (rules.overstock_score("'high'", "220D", "2D", "0.10D"), 96.0),
    (rules.overstock_score("'high'", NULL, "0D", "0.5D"), 85.0),
    (rules.overstock_score("'low'", NULL, "0D", "NULL"), 85.0),
    (rules.overstock_score("'medium'", "100D", "2D", "NULL"), 63.0),
    # inbound, cartons, quantities
    (rules.effective_inbound("50", "30"), 80),
    (rules.effective_inbound("0", "NULL"), 0),
    (rules.carton_round("25", "24"), 48),
    (rules.carton_round("24", "24"), 24),
    (rules.carton_round("2.1D", "NULL"), 3),
    (rules.carton_round("-3", "24"), 0),
    (rules.carton_round(f"({rules.missing_quantity('45', '10D', '100', '80')})", "24"), 288),
    (rules.carton_round(f"({rules.missing_quantity('45', '10D', '100', '50')})", "24"), 312),
    (rules.carton_round(f"({rules.missing_quantity('45', '10D', '500', '0')})", "NULL"), 0),
    (rules.carton_round(f"({rules.missing_quantity('45', '10D', '100', '0')})", "NULL"), 350),
    (rules.lifted_to_minimum("24L", "100", "24"), 120),
    (rules.lifted_to_minimum("0L", "100", "24"), 0),
    (rules.lifted_to_minimum("144L", "NULL", "24"), 144),
    (rules.replenish_target_days("0", "30", "7", "'stable'"), 37.0),
    (rules.replenish_target_days("50", "30", "7", "'DOWN'"), 40.0),
    (rules.replenish_days("34.5D"), 35),
    (rules.replenish_days("0D"), 0),
    (rules.replenish_action("120L"), "replenish_now"),
    (rules.replenish_action("0L"), "keep_monitoring"),
    # demand
    (rules.demand_signal("300", "'rising'", "0.25D"), "rising"),
    (rules.demand_score("'rising'", "120", "0.25D"), 95.0),
    (rules.demand_signal("0", "'rising'", "0.25D"), "no_sales"),
    (rules.demand_signal("10", "NULL", "-0.15D"), "declining"),
    (rules.demand_score("'declining'", "1", "-0.6D"), 10.0),
    (rules.demand_score("'stable'", "0", "0D"), 35.0),
    # data quality
    (rules.data_quality("false", "true", "true", "5D", "5D", "30"), "missing_inventory"),
    (rules.data_quality("true", "false", "true", "5D", "5D", "30"), "missing_sales"),
    (rules.data_quality("true", "true", "false", "5D", "5D", "30"), "missing_config"),
    (rules.data_quality("true", "true", "true", "-1D", "5D", "30"), "invalid_sales"),
    (rules.data_quality("true", "true", "true", "5D", "5D", "-1"), "invalid_config"),
    (rules.data_quality("true", "true", "true", "0D", "0D", "NULL"), "complete"),
    (
        rules.data_quality_strict("true", "true", "true", "0D", "0D", "0", "30", "45", "7", "'complete'"),
        "missing_sales",
    ),
    (
        rules.data_quality_strict("true", "true", "true", "1D", "1D", "60", "30", "45", "7", "'complete'"),
        "invalid_sales",
    ),
    (
        rules.data_quality_strict("true", "true", "true", "1D", "1D", "30", "0", "45", "7", "'complete'"),
        "invalid_config",
    ),
    (
        rules.data_quality_strict("true", "true", "true", "1D", "1D", "30", "30", "45", "7", "'inactive'"),
        "missing_config",
    ),
    # actions and approval
    (rules.recommended_action("'critical'", "'low'", "100", "'missing_sales'"), "complete_missing_data"),
    (rules.recommended_action("'critical'", "'low'", "100", "'complete'"), "replenish_now"),
    (rules.recommended_action("'high'", "'low'", "100", "'complete'"), "replenish_now"),
    (rules.recommended_action("'medium'", "'low'", "0", "'complete'"), "prepare_replenishment"),
    (rules.recommended_action("'low'", "'high'", "0", "'complete'"), "clearance_or_reduce_replenishment"),
    (rules.recommended_action("'low'", "'low'", "0", "'complete'"), "keep_monitoring"),
    (rules.recommended_action("'low'", "'low'", "0", "NULL"), "complete_missing_data"),
    (rules.decided_action("'low'", "'low'", "0", "NULL"), "keep_monitoring"),
    (rules.decided_confidence("'complete_missing_data'", "'unknown'"), 45.0),
    (rules.needs_manual_approval("'replenish_now'", "10"), True),
    (rules.needs_manual_approval("'clearance_or_reduce_replenishment'", "0"), True),
    (rules.needs_manual_approval("'keep_monitoring'", "500"), True),
    (rules.needs_manual_approval("'keep_monitoring'", "499"), False),
    (rules.needs_manual_approval("NULL", "NULL"), False),
    (rules.profit_signal("20D", "18D", "0.10D"), "low_margin"),
    (rules.profit_approval("'low_margin'", "100"), True),
    (rules.profit_approval("'healthy'", "100"), False),
    # dates
    (rules.stockout_date("date'2026-05-27'", "7.9D"), date(2026, 6, 3)),
    (rules.stockout_date("date'2026-05-27'", NULL), None),
    (rules.stockout_date("date'2026-06-07'", "5.1D"), date(2026, 6, 12)),
    (rules.stockout_date("date'2025-05-25'", "7D"), date(2025, 6, 1)),
    # stockout score with and without a delivery
    (rules.stockout_score("'critical'", "'rising'", "false"), 95.0),
    (rules.stockout_score("'high'", "'rising'", "false"), 88.0),
    (rules.stockout_score("'critical'", "'stable'", "true"), 80.0),
    (rules.relieved_level("'critical'", "true"), "high"),
    (rules.relieved_level("'high'", "true"), "medium"),
    (rules.relieved_level("'low'", "true"), "low"),
    (rules.delivery_relief("5D", "date'2026-06-07'", "date'2026-06-10'"), True),
    (rules.delivery_relief("5D", "date'2026-06-07'", "date'2026-07-20'"), False),
    (rules.delivery_relief("5D", "date'2026-06-07'", "cast(NULL AS date)"), False),
    (rules.lost_units("5", "0.5D", "30", "10D"), 295),
    (rules.money("295", "30D"), 8850.0),
    (rules.lost_units("0", NULL, "30", "10D"), 300),
    # texts
    (
        rules.action_reason("'SKU-001'", "12.345D", "'high'", "'low'", "120"),
        f"SKU SKU-001 当前可售天数为 {12.345:.2f} 天，断货风险为 high，滞销风险为 low，建议补货数量为 120。",
    ),
    (
        rules.action_reason("''", NULL, "NULL", "NULL", "NULL"),
        "SKU 未知 SKU 当前可售天数为 无法计算，断货风险为 unknown，滞销风险为 unknown，建议补货数量为 0。",
    ),
    (
        rules.stockout_text("'unknown'", "3", "2", NULL, "30"),
        "Stockout risk is unknown; fulfillable inventory is 3, reserved inventory is 2, available days are unknown, "
        "lead time is 30 days.",
    ),
]


def test_example_cases(spark):
    row = spark.range(1).selectExpr(*[f"{text} AS c{i}" for i, (text, _) in enumerate(CASES)]).first()
    wrong = [(CASES[i][0], row[i], CASES[i][1]) for i in range(len(CASES)) if row[i] != CASES[i][1]]
    assert not wrong


@pytest.mark.parametrize("digits", [1, 2])
def test_fixed_text_is_exact_on_ties(spark, digits):
    rng = random.Random(digits)
    step = 10.0**-digits
    values = [k * step + step / 2 for k in range(20, 3000)]
    values += [n / d for n in range(1, 200) for d in (0.8, 1.6, 3.2, 6.4, 1.15, 2.4, 7.2)]
    values += [rng.randint(1, 400) * f for f in (1.15, 0.8, 1.0) for _ in range(300)]
    values += [rng.uniform(0.05, 1e6) for _ in range(1000)] + [0.0, 63.125, 1.005, 1e15]
    values += [-v for v in values[:500]]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.selectExpr("v", f"{fixed_text('v', digits)} AS t").collect()
    wrong = [(r.v, r.t, f"{r.v:.{digits}f}") for r in rows if r.t != f"{r.v:.{digits}f}"]
    # A negative value that rounds to zero keeps its sign in Python only.
    wrong = [w for w in wrong if float(w[1]) != 0]
    assert not wrong


FACT_SCHEMA = """seller_id string, marketplace_id string, seller_sku string, asin string, current_price double,
purchase_cost double, landed_cost double, gross_margin double, inventory_snapshot_id bigint,
fulfillable_quantity int, total_quantity int, inbound_shipped_quantity int, inbound_receiving_quantity int,
total_unfulfillable_quantity int, total_reserved_quantity int, has_inventory boolean, sales_summary_id bigint,
sales_7d int, sales_30d int, sales_trend string, sales_trend_rate double, avg_daily_sales_7d double,
avg_daily_sales_30d double, has_sales boolean, replenishment_config_id bigint, total_replenishment_days int,
target_cover_days int, safety_stock_days int, carton_quantity int, moq int, config_status string,
has_config boolean, inbound_eta_date date"""
TODAY = date(2026, 6, 7)


def random_facts(count: int) -> list[dict]:
    rng = random.Random(7)
    pick = rng.choice
    rows = []
    for number in range(count):
        average = pick([-1.0, 0.0, 0.0, 0.5, 1.0, 1.6, 5.0, round(rng.uniform(0, 20), 2)])
        eta = pick([None, TODAY + timedelta(days=rng.randint(-3, 60))])
        rows.append(
            {
                "seller_id": "s",
                "marketplace_id": "m",
                "seller_sku": f"SKU-{number}",
                "asin": "B",
                "current_price": pick([0.0, 8.0, 16.0, round(rng.uniform(1, 80), 2)]),
                "purchase_cost": pick([None, 0.0, round(rng.uniform(1, 40), 2)]),
                "landed_cost": pick([None, 0.0, -1.0, 8.0, round(rng.uniform(1, 80), 2)]),
                "gross_margin": pick([None, 0.0, 0.15, 0.18, 0.35, -0.2, round(rng.uniform(-1, 1), 4)]),
                "inventory_snapshot_id": number,
                "fulfillable_quantity": pick([0, 0, 1, 101, rng.randint(0, 900)]),
                "total_quantity": pick([0, 180, 90, rng.randint(0, 2000)]),
                "inbound_shipped_quantity": rng.randint(0, 50),
                "inbound_receiving_quantity": rng.randint(0, 50),
                "total_unfulfillable_quantity": pick([0, 0, 3]),
                "total_reserved_quantity": rng.randint(0, 9),
                "has_inventory": rng.random() > 0.05,
                "sales_summary_id": number,
                "sales_7d": pick([0, rng.randint(0, 100)]),
                "sales_30d": pick([-3, 0, rng.randint(0, 400)]),
                "sales_trend": pick([None, "stable", "rising", "UP", "declining", "Down", "flat"]),
                "sales_trend_rate": pick([None, 0.15, -0.15, 0.1499, round(rng.uniform(-1, 1), 4)]),
                "avg_daily_sales_7d": pick([0.0, average]),
                "avg_daily_sales_30d": average,
                "has_sales": rng.random() > 0.05,
                "replenishment_config_id": number,
                "total_replenishment_days": pick([None, -1, 0, 30, rng.randint(1, 60)]),
                "target_cover_days": pick([0, 45, 35, rng.randint(1, 90)]),
                "safety_stock_days": pick([0, 7, rng.randint(0, 20)]),
                "carton_quantity": pick([None, 0, 1, 6, 24]),
                "moq": pick([None, 0, 50, 100]),
                "config_status": "complete",
                "has_config": rng.random() > 0.05,
                "inbound_eta_date": eta,
            }
        )
    return rows


LEVELS = ["low", "medium", "high", "critical"]


def evaluated(spark, facts: list[dict]) -> list:
    names = [part.split()[0] for part in FACT_SCHEMA.replace("\n", " ").split(",")]
    frame = spark.createDataFrame([tuple(row[n] for n in names) for row in facts], FACT_SCHEMA)
    found = {r.seller_sku: r for r in evaluate_rules(frame, TODAY).collect()}
    return [found[row["seller_sku"]] for row in facts]


def test_quantities_fill_cartons_and_reach_the_minimum(spark):
    facts = random_facts(2000)
    for row, result in zip(facts, evaluated(spark, facts), strict=True):
        quantity, carton, minimum = result.recommended_replenishment_quantity, row["carton_quantity"], row["moq"]
        assert quantity >= 0
        if quantity and carton:
            assert quantity % carton == 0
        if quantity and minimum:
            assert quantity >= minimum


def test_more_stock_never_raises_the_risk(spark):
    facts = [row for row in random_facts(2000) if row["avg_daily_sales_30d"] > 0]
    richer = [row | {"fulfillable_quantity": row["fulfillable_quantity"] + 40} for row in facts]
    for before, after in zip(evaluated(spark, facts), evaluated(spark, richer), strict=True):
        assert after.recommended_replenishment_quantity <= before.recommended_replenishment_quantity
        if "unknown" not in (before.base_stockout_level, after.base_stockout_level):
            assert LEVELS.index(after.base_stockout_level) <= LEVELS.index(before.base_stockout_level)
        assert after.available_days is None or after.available_days >= before.available_days


def test_a_coming_delivery_never_raises_the_risk(spark):
    facts = random_facts(2000)
    alone = [row | {"inbound_eta_date": None} for row in facts]
    for with_delivery, without in zip(evaluated(spark, facts), evaluated(spark, alone), strict=True):
        assert with_delivery.stockout_risk_score <= without.stockout_risk_score
        if "unknown" not in (with_delivery.stockout_risk_level, without.stockout_risk_level):
            assert LEVELS.index(with_delivery.stockout_risk_level) <= LEVELS.index(without.stockout_risk_level)


# Units in stock at one unit a day, seven days of safety and thirty of lead time -> level; both sides of each bound.
@pytest.mark.parametrize(
    ("units", "level"),
    [(0, "critical"), (7, "critical"), (8, "high"), (30, "high"), (31, "medium"), (37, "medium"), (38, "low"), (900, "low")],
)
def test_stockout_levels_at_their_bounds(spark, units, level):
    row = random_facts(1)[0] | {
        "fulfillable_quantity": units,
        "avg_daily_sales_7d": 1.0,
        "avg_daily_sales_30d": 1.0,
        "safety_stock_days": 7,
        "total_replenishment_days": 30,
        "inbound_eta_date": None,
    }
    assert evaluated(spark, [row])[0].stockout_risk_level == level


def test_incomplete_data_decides_the_action(spark):
    facts = random_facts(2000)
    for row, result in zip(facts, evaluated(spark, facts), strict=True):
        missing = [kind for kind in ("inventory", "sales", "config") if not row[f"has_{kind}"]]
        if missing:
            assert result.data_quality_status == f"missing_{missing[0]}"
        assert (result.recommended_action == "complete_missing_data") == (result.data_quality_status != "complete")


def test_tasks_follow_from_the_analysis(spark):
    facts = [row | {"inbound_eta_date": None} for row in random_facts(1500)]
    names = [part.split()[0] for part in FACT_SCHEMA.replace("\n", " ").split(",")]
    frame = spark.createDataFrame([tuple(row[n] for n in names) for row in facts], FACT_SCHEMA)
    analysed = {r.seller_sku: r for r in analyse(frame, "b-1", TODAY).collect()}
    kinds: dict[str, list] = {sku: [] for sku in analysed}
    for r in generate_tasks(analyse(frame, "b-1", TODAY), datetime(2026, 6, 7)).orderBy("seller_sku", "task_order").collect():
        kinds[r.seller_sku].append(r.task_type)
        assert r.estimated_impact_value >= 0 and r.priority in ("P0", "P1", "P2", "P3")
        assert (r.impact_level == "high") == (r.estimated_impact_value >= 5000)
    for sku, found in kinds.items():
        row = analysed[sku]
        assert found == [kind for kind in TASK_TYPES if kind in found]
        assert ("data_missing_alert" in found) == (row.data_quality_status != "complete")
        assert ("overstock_warning" in found) == (row.overstock_risk_level == "high")
        assert ("unfulfillable_inventory_alert" in found) == (row.total_unfulfillable_quantity > 0)


def test_outliers_leave_the_run_and_are_listed(spark):
    facts = random_facts(50)
    facts[7] |= {"fulfillable_quantity": 2_000_000_000, "avg_daily_sales_7d": 0.0001, "avg_daily_sales_30d": 0.0001}
    facts[9] |= {"total_replenishment_days": 30, "current_price": 1e300, "fulfillable_quantity": 0, "avg_daily_sales_7d": 5.0, "avg_daily_sales_30d": 5.0}
    names = [part.split()[0] for part in FACT_SCHEMA.replace("\n", " ").split(",")]
    frame = spark.createDataFrame([tuple(row[n] for n in names) for row in facts], FACT_SCHEMA)
    rows = analyse(frame, "b-1", TODAY)
    stored = {r.seller_sku: r for r in stored_analysis(rows, datetime(2026, 6, 7)).collect()}
    listed = {(r.seller_sku, r.column_name) for r in rejected_values(rows).collect()}
    assert len(stored) == 50 and {sku for sku, _ in listed} == {"SKU-7", "SKU-9"}
    assert all(stored[sku][column] is None for sku, column in listed)
    assert ("SKU-7", "available_days") in listed and generate_tasks(rows, datetime(2026, 6, 7)).count() > 0


def test_stored_analysis_has_the_table_columns(spark):
    assert len(STORED_ANALYSIS.fields) == 37
