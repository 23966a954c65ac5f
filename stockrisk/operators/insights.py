"""Problem groups over open tasks: classification, cards, related tasks, roll-ups, and parsing of model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockrisk.functions.ranks import OVERSTOCK_RANK, PRIORITY_RANK, STOCKOUT_RANK
from stockrisk.operators.latest import first_per_key

# The problem groups in display order, with their static texts.
GROUPS = [
    {
        "id": "critical_stockout",
        "title": "Critical stockout risk",
        "risk_level": "critical",
        "priority": "P0",
        "recommended_action": "replenish_now",
        "summary": "存在 critical 断货或已断货任务，需要作为最高优先级处理。",
        "risk_points": ["部分 SKU 处于 critical 断货风险", "继续延迟可能造成销售损失和排名波动"],
        "solution": [
            "优先确认可售库存为 0 或可售天数极低的 SKU",
            "立即确认供应商交期并创建补货计划",
            "断货期间谨慎控制广告放量",
        ],
    },
    {
        "id": "high_stockout",
        "title": "High stockout risk",
        "risk_level": "high",
        "priority": "P1",
        "recommended_action": "replenish_now",
        "summary": "存在 high 断货风险任务，需要尽快排入补货处理队列。",
        "risk_points": ["部分 SKU 可售库存偏低", "补货不及时会进入 critical 风险区间"],
        "solution": ["按预计断货日期排序处理", "核对在途库存和实际可售库存", "提前确认采购和入仓计划"],
    },
    {
        "id": "overstock_risk",
        "title": "Overstock and slow-moving risk",
        "risk_level": "high",
        "priority": "P1",
        "recommended_action": "clearance_or_reduce_replenishment",
        "summary": "存在高库存或滞销风险，需要控制后续补货并评估清仓动作。",
        "risk_points": ["部分 SKU 库存覆盖天数偏高", "库存占用可能影响现金流和仓储成本"],
        "solution": [
            "暂停或降低相关 SKU 补货计划",
            "评估优惠、清仓或广告去库存策略",
            "复查近 30 日销量趋势",
        ],
    },
    {
        "id": "data_missing",
        "title": "Data quality issue",
        "risk_level": "unknown",
        "priority": "P2",
        "recommended_action": "complete_missing_data",
        "summary": "存在数据缺失任务，影响系统判断销量、补货或风险状态。",
        "risk_points": ["销量或补货配置缺失会降低分析可信度", "数据不完整会影响补货和清仓决策"],
        "solution": [
            "优先补齐 sales_summary 和 replenishment_config",
            "重新运行库存 Agent",
            "复核数据质量状态是否恢复 complete",
        ],
    },
    {
        "id": "unfulfillable_inventory",
        "title": "Unfulfillable inventory alert",
        "risk_level": "medium",
        "priority": "P2",
        "recommended_action": "keep_monitoring",
        "summary": "存在不可售库存异常任务，需要检查库存状态并处理异常库存。",
        "risk_points": ["不可售库存会降低实际可售能力", "异常库存可能带来仓储成本和运营误判"],
        "solution": ["检查 FBA 不可售原因", "安排移除、弃置或重新上架流程", "同步更新库存快照后重新分析"],
    },
    {
        "id": "other_pending_tasks",
        "title": "Other pending operations tasks",
        "risk_level": "medium",
        "priority": "P3",
        "recommended_action": "keep_monitoring",
        "summary": "仍有其他待处理任务，需要在高风险问题处理后继续跟进。",
        "risk_points": ["部分任务未归入高风险分组", "仍需保持任务闭环"],
        "solution": ["按优先级逐项处理", "处理后刷新任务状态", "必要时重新运行库存 Agent"],
    },
]
CARD_COLUMNS = [
    "id",
    "title",
    "risk_level",
    "priority",
    "affected_sku_count",
    "task_count",
    "summary",
    "recommended_action",
    "risk_points",
    "solution",
    "related_skus",
    "related_task_ids",
]
SKUS_WITH_SENTENCE = 3
SENTENCE = "concat(seller_sku, ' 当前可售天数约为 ', {}, ' 天')"  # fixed value: the text about a SKU's days left

# Fixed value: the order in which the groups are tried; the first matching line wins.
GROUP_OF_TASK = """CASE
    WHEN risk_level = 'critical' OR priority = 'P0' THEN 'critical_stockout'
    WHEN risk_level = 'high' OR task_type = 'stockout_warning' THEN 'high_stockout'
    WHEN task_type = 'overstock_warning' THEN 'overstock_risk'
    WHEN task_type = 'data_missing_alert' OR suggested_action = 'complete_missing_data' THEN 'data_missing'
    WHEN task_type = 'unfulfillable_inventory_alert' THEN 'unfulfillable_inventory'
    ELSE 'other_pending_tasks' END"""
# Position of a task in the open list; comparable as a struct.
OPEN_POSITION = f"""struct({PRIORITY_RANK} AS r,
    created_at AS c, seller_sku AS k, seller_id AS s, marketplace_id AS m, task_order AS t)"""


def _sql_literal(value: object) -> str:
    if isinstance(value, list):
        return f"array({', '.join(_sql_literal(item) for item in value)})"
    return f"'{value}'"


def group_attributes(spark: SparkSession) -> DataFrame:
    """The fixed group table as a local relation; its six rows are always broadcast."""
    names = list(GROUPS[0])
    rows = ", ".join(
        f"({position}, {', '.join(_sql_literal(group[name]) for name in names)})"
        for position, group in enumerate(GROUPS)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS g(position, {', '.join(names)})")


def classified(tasks: DataFrame) -> DataFrame:
    """Pending tasks with the group each belongs to."""
    return tasks.filter("task_status = 'pending'").withColumn("insight_id", F.expr(GROUP_OF_TASK))


def insight_groups(tasks: DataFrame) -> DataFrame:
    """Group sizes over all pending tasks; empty groups are left out."""
    sizes = (
        classified(tasks)
        .groupBy("insight_id")
        .agg(
            F.count_distinct("seller_sku").alias("affected_sku_count"),
            F.count(F.lit(1)).alias("task_count"),
        )
    )
    attributes = group_attributes(tasks.sparkSession)
    rows = sizes.join(F.broadcast(attributes), sizes["insight_id"] == attributes["id"])
    return rows.orderBy("position").select(
        "id",
        "title",
        "risk_level",
        "priority",
        "recommended_action",
        "affected_sku_count",
        "task_count",
        "summary",
    )


def insight_members(open_rows: DataFrame) -> DataFrame:
    """One row per group of a limited open list: sorted SKUs and task ids in list order."""
    members = classified(open_rows).groupBy("insight_id").agg(
        F.expr("array_sort(collect_set(seller_sku))").alias("related_skus"),
        F.expr(f"array_sort(collect_list(struct({OPEN_POSITION} AS at, task_id)))").alias("placed"),
    )
    return members.selectExpr(
        "insight_id",
        "related_skus",
        "transform(placed, x -> x.task_id) AS related_task_ids",
        "size(related_skus) AS affected_sku_count",
        "size(placed) AS task_count",
    )


def sku_sentences(members: DataFrame, top_risk: DataFrame) -> DataFrame:
    """For the first SKUs of each group, a sentence with the days left, where the top list knows the SKU."""
    first = members.selectExpr(
        "insight_id", f"posexplode(slice(related_skus, 1, {SKUS_WITH_SENTENCE})) AS (position, seller_sku)"
    )
    # A SKU name listed twice (several sellers) counts with its last entry.
    days = top_risk.groupBy("seller_sku").agg(
        F.expr(
            f"max_by(available_days, struct({STOCKOUT_RANK}, {OVERSTOCK_RANK}, available_days, seller_id, marketplace_id))"
        ).alias("available_days")
    )
    return first.join(days, "seller_sku", "left").selectExpr(
        "insight_id",
        "position",
        "seller_sku",
        "available_days",
        f"{SENTENCE.format('available_days')} AS sentence",
    )


def seller_members(tasks: DataFrame, size: int) -> DataFrame:
    """One row per seller and group: counts over all its pending tasks, its first SKUs and its first task ids.

    Which rows belong to a list is decided on rows, by a rank that is cut on both sides of its shuffle, so that a seller with
    a third of all tasks sends ``size`` rows per group and map task; arrays are built of at most ``size`` rows at the end.
    """
    pending = classified(tasks)
    group = ["seller_id", "insight_id"]
    per_sku = pending.groupBy(*group, "seller_sku").agg(F.count(F.lit(1)).alias("n"))
    counts = per_sku.groupBy(*group).agg(F.count(F.lit(1)).cast("int").alias("affected_sku_count"), F.sum("n").cast("int").alias("task_count"))
    skus = first_per_key(per_sku, group, [F.asc("seller_sku")], size).groupBy(*group).agg(
        F.expr("array_sort(collect_list(seller_sku))").alias("related_skus")
    )
    placed = pending.select(*group, "task_id", F.expr(OPEN_POSITION).alias("at"))
    ids = first_per_key(placed, group, [F.asc("at"), F.asc("task_id")], size).groupBy(*group).agg(
        F.expr("transform(array_sort(collect_list(struct(at, task_id))), x -> x.task_id)").alias("related_task_ids")
    )
    return counts.join(skus, group).join(ids, group)


def seller_cards(tasks: DataFrame, analysis: DataFrame, size: int, top: int) -> DataFrame:
    """Cards of every seller over all its pending tasks, with lists of at most ``size`` entries and sentences for its first
    SKUs that are among its ``top`` riskiest, in display order."""
    members = seller_members(tasks, size)
    worst = [F.expr(STOCKOUT_RANK), F.expr(OVERSTOCK_RANK), F.col("available_days").asc_nulls_first(), F.asc("seller_sku"), F.asc("marketplace_id")]
    listed = first_per_key(analysis, ["seller_id"], worst, top)
    days = listed.groupBy("seller_id", "seller_sku").agg(
        F.expr(f"max_by(available_days, struct({STOCKOUT_RANK}, {OVERSTOCK_RANK}, available_days, marketplace_id))").alias("days")
    )
    first = members.selectExpr(
        "seller_id", "insight_id", f"posexplode(slice(related_skus, 1, {SKUS_WITH_SENTENCE})) AS (position, seller_sku)"
    )
    told = first.join(days, ["seller_id", "seller_sku"]).where("days IS NOT NULL")
    sentences = told.groupBy("seller_id", "insight_id").agg(
        F.expr(f"transform(array_sort(collect_list(struct(position, {SENTENCE.format('days')} AS text))), x -> x.text)").alias("sentences")
    )
    attributes = group_attributes(tasks.sparkSession).withColumnRenamed("id", "insight_id")
    joined = (
        members.join(sentences, ["seller_id", "insight_id"], "left")
        .join(F.broadcast(attributes), "insight_id")
        .withColumn("risk_points", F.expr("concat(risk_points, coalesce(sentences, array()))"))
        .withColumnRenamed("insight_id", "id")
    )
    return joined.orderBy("seller_id", "position").select("seller_id", *CARD_COLUMNS)


def insight_cards(open_rows: DataFrame, top_risk: DataFrame) -> DataFrame:
    """Cards of a limited open list and a limited top list, in display order."""
    members = insight_members(open_rows)
    sentences = (
        sku_sentences(members, top_risk)
        .filter("sentence IS NOT NULL")
        .groupBy("insight_id")
        .agg(F.expr("array_sort(collect_list(struct(position, sentence)))").alias("placed"))
        .selectExpr("insight_id", "transform(placed, x -> x.sentence) AS sentences")
    )
    attributes = group_attributes(open_rows.sparkSession)
    joined = (
        members.join(sentences, "insight_id", "left")
        .join(F.broadcast(attributes.withColumnRenamed("id", "insight_id")), "insight_id")
        .withColumn("risk_points", F.expr("concat(risk_points, coalesce(sentences, array()))"))
        .withColumnRenamed("insight_id", "id")
    )
    return joined.orderBy("position").select(*CARD_COLUMNS)


def related_tasks(insights: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks that an insight names by id or whose SKU it names; each pair once.

    The either-or match is one equi-join: insights list their ids and SKUs as typed references, and each task
    offers its own two, so the tasks are read once and no nested loop is needed.
    """
    wanted = insights.selectExpr(
        "id AS insight_id",
        """explode(array_distinct(concat(
            transform(related_task_ids, x -> concat('task:', x)),
            transform(related_skus, x -> concat('sku:', x))))) AS reference""",
    )
    offered = tasks.selectExpr(
        "*", "explode(array(concat('task:', task_id), concat('sku:', seller_sku))) AS reference"
    )
    matched = offered.join(wanted, "reference").drop("reference")
    return matched.dropDuplicates(["insight_id", "task_id"])


def _for_each(insights: DataFrame, found: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """One row per insight: the values found for it, or the defaults if it has no related task."""
    ids = insights.selectExpr("id AS insight_id").distinct()
    values = [f"coalesce({name}, {default}) AS {name}" for name, default in defaults.items()]
    return ids.join(found, "insight_id", "left").selectExpr("insight_id", *values)


def insight_rollup(insights: DataFrame, related: DataFrame) -> DataFrame:
    """Total impact, highest impact level and highest approval level of the related tasks, for every insight."""
    ranks = related.groupBy("insight_id").agg(
        F.count(F.lit(1)).alias("related_task_count"),
        F.expr("sum(coalesce(estimated_impact_value, 0))").alias("estimated_impact_value"),
        F.expr("max(CASE impact_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)").alias(
            "impact_rank"
        ),
        F.expr(
            "max(CASE approval_level WHEN 'owner' THEN 4 WHEN 'manager' THEN 3 WHEN 'operator' THEN 2 ELSE 1 END)"
        ).alias("approval_rank"),
    )
    found = ranks.selectExpr(
        "insight_id",
        "related_task_count",
        "estimated_impact_value",
        "element_at(array('unknown', 'low', 'medium', 'high'), impact_rank + 1) AS impact_level",
        "element_at(array('none', 'operator', 'manager', 'owner'), approval_rank) AS approval_level",
    )
    defaults = {
        "related_task_count": "0L",
        "estimated_impact_value": "0",
        "impact_level": "'unknown'",
        "approval_level": "'none'",
    }
    return _for_each(insights, found, defaults)


def insight_first_value(insights: DataFrame, related: DataFrame) -> DataFrame:
    """First filled impact level, impact value and approval level in list order (newest task first), for every insight."""
    newest = "struct(created_at, seller_sku, seller_id, marketplace_id, task_order)"

    def first(name: str, filled: str, default: str) -> str:
        value = f"max_by({name}, {newest}) FILTER (WHERE {filled})"
        return f"coalesce({value}, {default}) AS {name}"

    found = related.groupBy("insight_id").agg(
        F.expr(first("impact_level", "impact_level <> ''", "'unknown'")),
        F.expr(first("estimated_impact_value", "estimated_impact_value <> 0", "0")),
        F.expr(first("approval_level", "approval_level <> ''", "'none'")),
    )
    return _for_each(
        insights, found, {"impact_level": "'unknown'", "estimated_impact_value": "0", "approval_level": "'none'"}
    )


def _kind(value: str) -> str:
    return f"schema_of_variant({value})"


def _scalar_text(value: str) -> str:
    """Text of a JSON value; booleans are capitalised."""
    return f"""CASE {_kind(value)}
        WHEN 'BOOLEAN' THEN initcap(try_variant_get({value}, '$', 'string'))
        ELSE try_variant_get({value}, '$', 'string') END"""


def _field(name: str) -> str:
    return f"variant_get(item, '$.{name}', 'variant')"


def _text(name: str, default: str) -> str:
    """Text of a field; missing, empty, zero and false values give the default."""
    text = _scalar_text(_field(name))
    empty = "('', '0', '0.0', 'False', '[]', '{}')"
    # A string of one of these spellings is not empty, apart from ''.
    return f"""CASE
        WHEN {_field(name)} IS NULL OR {_kind(_field(name))} = 'VOID' THEN {default}
        WHEN {_kind(_field(name))} = 'STRING' THEN coalesce(nullif({text}, ''), {default})
        WHEN {text} IN {empty} THEN {default}
        ELSE {text} END"""


def _whole_number(name: str) -> str:
    """Whole number of a field: text only if it is a plain number, fractions are cut, anything else is 0."""
    value = _field(name)
    text = f"try_variant_get({value}, '$', 'string')"
    return f"""coalesce(CASE
        WHEN {_kind(value)} = 'STRING' AND {text} RLIKE '^\\\\s*[+-]?[0-9]+(_[0-9]+)*\\\\s*$'
            THEN try_cast(replace(trim({text}), '_', '') AS bigint)
        WHEN {_kind(value)} = 'STRING' THEN 0L
        WHEN {_kind(value)} = 'BOOLEAN' THEN CASE {text} WHEN 'true' THEN 1L ELSE 0L END
        WHEN {_kind(value)} = 'BIGINT' THEN try_variant_get({value}, '$', 'bigint')
        ELSE try_cast(try_variant_get({value}, '$', 'double') AS bigint) END, 0L)"""


def _text_list(name: str) -> str:
    """Texts of a list field without null and blank entries; anything but a list is empty."""
    items = f"try_variant_get({_field(name)}, '$', 'array<variant>')"
    texts = f"transform(filter({items}, x -> x IS NOT NULL AND {_kind('x')} <> 'VOID'), x -> {_scalar_text('x')})"
    return f"coalesce(filter({texts}, t -> t RLIKE '(?U)[^\\\\s]'), cast(array() AS array<string>))"


def finite_numbers(text: str) -> str:
    """JSON text in which bare NaN and Infinity are 0; those inside of strings stay.

    Escaped backslashes and quotes are set aside first, so that a quote is the end of a string and nothing else.  Then a mark is
    put behind every string and in place of every such number: a mark without a string before it is a number.
    """
    aside = rf"""replace(replace({text}, r'\\', '\u0001'), r'\"', '\u0002')"""
    marked = rf"""regexp_replace({aside}, '("[^"]*+")|-?(?:NaN|Infinity)', '$1\u0003')"""
    filled = rf"""replace(replace({marked}, '"\u0003', '"'), '\u0003', '0')"""
    return rf"""replace(replace({filled}, '\u0002', r'\"'), '\u0001', r'\\')"""


def parse_insight_replies(replies: DataFrame) -> DataFrame:
    """Turn model replies (``reply_id``, ``raw_text``) into insight rows.

    Code fences are removed; text that is no JSON is retried from its first to its last brace.  The root must be an
    object with a list ``insights`` of objects; a reply that is not gives one row with ``is_valid`` false.  Of a key that an
    object repeats, the last value counts; Spark decides that by a session setting, which this function sets.  Bare NaN and
    Infinity count 0.  Blanks are all of Unicode's.
    """
    replies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    bare_text = r"regexp_replace(raw_text, '(?U)^\\s+|\\s+$', '')"
    fenced = rf"regexp_replace(regexp_replace({bare_text}, '(?U)^```(?:json)?\\s*', ''), '(?U)\\s*```$', '')"
    braces = r"regexp_extract(body, '(?s)\\{.*\\}', 0)"
    tries = ["body", braces, finite_numbers("body"), finite_numbers(braces)]
    bare = replies.selectExpr("reply_id", f"{fenced} AS body")
    parsed = bare.selectExpr("reply_id", f"coalesce({', '.join(f'try_parse_json({t})' for t in tries)}) AS root")
    listed = parsed.selectExpr(
        "reply_id",
        f"""CASE WHEN {_kind('root')} LIKE 'OBJECT%'
            THEN try_variant_get(root, '$.insights', 'array<variant>') END AS items""",
    )
    checked = listed.selectExpr(
        "reply_id",
        f"items IS NOT NULL AND forall(items, x -> {_kind('x')} LIKE 'OBJECT%') AS is_valid",
        "items",
    )
    exploded = checked.selectExpr(
        "reply_id", "is_valid", "posexplode_outer(CASE WHEN is_valid THEN items END) AS (position, item)"
    )
    titled = exploded.withColumn("title", F.expr(_text("title", "concat('Risk insight ', position + 1)")))
    slug = "nullif(trim(BOTH '_' FROM regexp_replace(lower(title), '[^a-z0-9]+', '_')), '')"
    own_id = _text("id", f"coalesce({slug}, concat('risk_insight_', position + 1))")

    def if_item(text: str, name: str) -> str:
        return f"CASE WHEN item IS NOT NULL THEN {text} END AS {name}"

    return titled.selectExpr(
        "reply_id",
        "is_valid",
        "position",
        if_item(own_id, "id"),
        if_item("title", "title"),
        if_item(_text("risk_level", "'unknown'"), "risk_level"),
        if_item(_text("priority", "'P3'"), "priority"),
        if_item(_whole_number("affected_sku_count"), "affected_sku_count"),
        if_item(_whole_number("task_count"), "task_count"),
        if_item(_text("summary", "''"), "summary"),
        if_item(_text("recommended_action", "'keep_monitoring'"), "recommended_action"),
        if_item(_text_list("risk_points"), "risk_points"),
        if_item(_text_list("solution"), "solution"),
        if_item(_text_list("related_skus"), "related_skus"),
        if_item(_text_list("related_task_ids"), "related_task_ids"),
    )
