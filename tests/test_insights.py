"""Problem groups, their tasks and the parsing of model replies."""

from __future__ import annotations

import json
import random
from datetime import datetime

from stockrisk.operators import insights
from stockrisk.plans.reports import open_task_rows
from stockrisk.schemas import STORED_ANALYSIS, STORED_TASKS


FULL = {
    "id": "x1",
    "title": "Title",
    "risk_level": "high",
    "priority": "P1",
    "affected_sku_count": 3,
    "task_count": "12",
    "summary": "总结 {ok}",
    "recommended_action": "replenish_now",
    "risk_points": ["a", "", "  ", "\t\n", None, 5, True],
    "solution": "not a list",
    "related_skus": ["S1", "S2"],
    "related_task_ids": [],
}
FULL_ROW = (
    "x1", "Title", "high", "P1", 3, 12, "总结 {ok}", "replenish_now", ["a", "5", "True"], [], ["S1", "S2"], []
)


def row(**changed):
    """The row of an empty first insight, with some values changed."""
    values = {
        "id": "risk_insight_1",
        "title": "Risk insight 1",
        "risk_level": "unknown",
        "priority": "P3",
        "affected_sku_count": 0,
        "task_count": 0,
        "summary": "",
        "recommended_action": "keep_monitoring",
        "risk_points": [],
        "solution": [],
        "related_skus": [],
        "related_task_ids": [],
    }
    return tuple((values | changed).values())


def reply(*items):
    return json.dumps({"insights": list(items)}, ensure_ascii=False)


BAD = None
CASES = [
    (reply(FULL, {}), [FULL_ROW, row(id="risk_insight_2", title="Risk insight 2")]),
    ("```json\n" + reply(FULL) + "\n```", [FULL_ROW]),
    ("\n\t```json" + reply(FULL) + "```\n ", [FULL_ROW]),
    ("```\n" + reply({"title": "Too MANY -- parts!!"}) + "\n```", [row(id="too_many_parts", title="Too MANY -- parts!!")]),
    ("Sure! Here it is:\n" + reply({"title": "!!!", "id": ""}) + "\nBye", [row(title="!!!")]),
    ("two {objects} " + reply(FULL), BAD),
    (reply(), []),
    (reply(1, FULL), BAD),
    (reply(None), BAD),
    (json.dumps({"insights": {"a": 1}}), BAD),
    (json.dumps({"other": []}), BAD),
    (json.dumps([FULL]), BAD),
    (json.dumps("text"), BAD),
    ("no json at all", BAD),
    ('{"insights": [{"id": "cut"', BAD),
    ("", BAD),
    (
        reply({"affected_sku_count": 9.7, "task_count": "9.7", "title": 12, "id": 0}),
        [row(id="12", title="12", affected_sku_count=9)],
    ),
    (
        reply({"affected_sku_count": True, "task_count": " -4 ", "summary": False, "id": "0"}),
        [row(id="0", affected_sku_count=1, task_count=-4)],
    ),
    (
        reply({"affected_sku_count": None, "task_count": [], "priority": None, "id": True, "related_skus": {}}),
        [row(id="True")],
    ),
]


def test_parse_replies(spark):
    frame = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "reply_id long, raw_text string")
    rows: dict[int, list] = {}
    for r in insights.parse_insight_replies(frame).orderBy("reply_id", "position").collect():
        rows.setdefault(r.reply_id, []).append(r)
    for number, (raw, expected) in enumerate(CASES):
        assert {r.is_valid for r in rows[number]} == {expected is not BAD}, raw
        assert [tuple(r)[3:] for r in rows[number] if r.id is not None] == (expected or []), raw


def test_odd_replies(spark):
    wide = '\u3000{"insights": [{"id": "a", "risk_points": ["\u3000\u00a0", "x"], "task_count": NaN, "summary": "is NaN, so"}]}\u3000'
    twice = '{"insights": [{"id": "a", "id": "b"}]}'
    inside = r'{"insights": [{"title": "a, NaN, b", "id": "x:NaN", "summary": "\"[Infinity\\", "task_count": -Infinity, "solution": ["NaN", NaN, "\\\" ,NaN"]}]}'
    last = '{"insights": 3, "insights": [{"id": "a", "summary": {"q": 1, "q": NaN}}, {"id": "b", "title": "t", "title": NaN}]}'
    long = '{"insights": [{"id": "l", "title": "' + 'x NaN \\n' * 20_000 + '", "task_count": NaN}]}'
    frame = spark.createDataFrame([(0, wide), (1, twice), (2, inside), (3, last), (4, long)], "reply_id long, raw_text string")
    first, second, third, fourth, fifth, sixth = insights.parse_insight_replies(frame).orderBy("reply_id", "position").collect()
    assert (first.is_valid, first.risk_points, first.task_count, first.summary) == (True, ["x"], 0, "is NaN, so")
    assert second.is_valid and second.id == "b"
    assert (third.title, third.id, third.summary, third.task_count) == ("a, NaN, b", "x:NaN", '"[Infinity\\', 0)
    assert third.solution == ["NaN", "0", '\\" ,NaN']
    assert (fourth.id, fourth.summary, fifth.id, fifth.title) == ("a", '{"q":0}', "b", "Risk insight 2")
    assert sixth.task_count == 0 and sixth.title == "x NaN \n" * 20_000



def sample_tasks(spark, count=400):
    rng = random.Random(11)
    rows = []
    for i in range(count):
        sku = "SKU-hot" if rng.random() < 0.3 else f"SKU-{rng.randint(0, 60)}"
        rows.append(
            {
                "task_id": f"t{i}",
                "seller_id": "s",
                "marketplace_id": "m",
                "seller_sku": sku,
                "task_type": rng.choice(["stockout_warning", "overstock_warning", "data_missing_alert", "other"]),
                "priority": rng.choice(["P0", "P1", "P2", "P3"]),
                "risk_level": rng.choice(["critical", "high", "medium", "low"]),
                "suggested_action": rng.choice(["complete_missing_data", "keep_monitoring"]),
                "task_status": rng.choice(["pending", "pending", "resolved"]),
                "impact_level": rng.choice(["high", "medium", "low", "none", None, ""]),
                "estimated_impact_value": rng.choice([0.0, 12.5, 7000.0, None]),
                "approval_level": rng.choice(["owner", "manager", "operator", "none", None]),
                "task_order": i,
                "created_at": datetime(2024, 1, 1),
            }
        )
    names = list(rows[0])
    kinds = {f.name: f.dataType.simpleString() for f in STORED_TASKS.fields}
    kinds["estimated_impact_value"] = "double"
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    return rows, spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema).to(STORED_TASKS)


def group_of(task):
    if task["risk_level"] == "critical" or task["priority"] == "P0":
        return "critical_stockout"
    if task["risk_level"] == "high" or task["task_type"] == "stockout_warning":
        return "high_stockout"
    if task["task_type"] == "overstock_warning":
        return "overstock_risk"
    if task["task_type"] == "data_missing_alert" or task["suggested_action"] == "complete_missing_data":
        return "data_missing"
    return "other_pending_tasks"


def test_group_sizes_over_all_tasks(spark):
    rows, frame = sample_tasks(spark)
    expected: dict[str, list] = {}
    for task in rows:
        if task["task_status"] == "pending":
            expected.setdefault(group_of(task), []).append(task["seller_sku"])
    ours = {r.id: (r.affected_sku_count, r.task_count) for r in insights.insight_groups(frame).collect()}
    assert ours == {name: (len(set(skus)), len(skus)) for name, skus in expected.items()}


def test_cards_related_tasks_and_rollups(spark):
    rows, frame = sample_tasks(spark)
    pending = [t for t in rows if t["task_status"] == "pending"]
    order = {"P0": 1, "P1": 2, "P2": 3}
    pending.sort(key=lambda t: (order.get(t["priority"], 4), t["seller_sku"], t["task_order"]))
    top = spark.createDataFrame(
        [("b", "s", "m", "SKU-1", "critical", "high", 7.0), ("b", "s", "m", "SKU-10", "high", "low", 3.25)],
        "analysis_batch_id string, seller_id string, marketplace_id string, seller_sku string, "
        "stockout_risk_level string, overstock_risk_level string, available_days double",
    ).to(STORED_ANALYSIS)
    # Few and many tasks: the second list reaches every group.
    for limit in (50, 300):
        listed = pending[:limit]
        groups: dict[str, list] = {}
        for task in listed:
            groups.setdefault(group_of(task), []).append(task)
        cards = insights.insight_cards(open_task_rows(frame, limit), top)
        names = [g["id"] for g in insights.GROUPS if g["id"] in groups]
        found = cards.collect()
        assert [c.id for c in found] == names
        for card in found:
            members = groups[card.id]
            skus = sorted({t["seller_sku"] for t in members})
            assert card.related_task_ids == [t["task_id"] for t in members]
            assert card.related_skus == skus and card.affected_sku_count == len(skus)
            fixed = next(g for g in insights.GROUPS if g["id"] == card.id)
            days = {"SKU-1": "7.00", "SKU-10": "3.25"}
            said = [f"{sku} 当前可售天数约为 {days[sku]} 天" for sku in skus[:3] if sku in days]
            assert card.risk_points == fixed["risk_points"] + said

    related = insights.related_tasks(cards, frame)
    pairs = {(r.insight_id, r.task_id) for r in related.select("insight_id", "task_id").collect()}
    expected = {
        (c.id, t["task_id"])
        for c in found
        for t in rows
        if t["task_id"] in c.related_task_ids or t["seller_sku"] in c.related_skus
    }
    assert pairs == expected and related.count() == len(expected)

    unknown = spark.sql("SELECT 'nothing' AS id, array('none') AS related_skus, array('none') AS related_task_ids")
    listed = cards.select("id", "related_skus", "related_task_ids").unionByName(unknown)
    impact = {"high": 3, "medium": 2, "low": 1}
    approval = {"owner": 4, "manager": 3, "operator": 2}
    rollups = {r.insight_id: r for r in insights.insight_rollup(listed, related).collect()}
    firsts = {r.insight_id: r for r in insights.insight_first_value(listed, related).collect()}
    assert tuple(rollups["nothing"]) == ("nothing", 0, 0, "unknown", "none")
    assert tuple(firsts["nothing"]) == ("nothing", "unknown", 0, "none")
    for card in found:
        mine = [t for t in rows if (card.id, t["task_id"]) in expected]
        best = max((impact.get(t["impact_level"], 0) for t in mine))
        assert impact.get(rollups[card.id].impact_level, 0) == best
        best = max((approval.get(t["approval_level"], 1) for t in mine))
        assert approval.get(rollups[card.id].approval_level, 1) == best
        total = sum(t["estimated_impact_value"] or 0 for t in mine)
        assert float(rollups[card.id].estimated_impact_value) == total
        mine.sort(key=lambda t: (t["seller_sku"], t["task_order"]), reverse=True)
        first = next((t["impact_level"] for t in mine if t["impact_level"]), "unknown")
        assert firsts[card.id].impact_level == first
        value = next((t["estimated_impact_value"] for t in mine if t["estimated_impact_value"]), 0)
        assert float(firsts[card.id].estimated_impact_value) == value
