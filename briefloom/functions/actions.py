"""What to do about a change, in words made from a record's own fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, truncated

# Marks of a change's type and what that kind of change asks for; the first kind with a mark that occurs holds.
KINDS = (
    ("price pricing cost billing 价格 费用 成本", "{audience}应在{horizon}按当前用量重新计算{area}，并与当前方案对比"),
    ("policy law regulation terms compliance 政策 法规 条款 合规", "{audience}应在{horizon}核对{area}的适用范围和生效时间，并更新合规清单"),
    ("benchmark evaluation eval score 基准 评测 评分", "{audience}应在{horizon}使用自身任务集复测{area}，不要仅凭公开基准改变选型"),
    ("repository repo open_source github 开源 仓库", "{audience}应在{horizon}于隔离环境验证{area}，并核查安装方式、许可证和维护状态"),
    ("api sdk model release version launch 模型 发布 版本", "{audience}应在{horizon}先在非生产环境验证{area}的兼容性、性能和成本，再决定是否采用"),
)
OTHERWISE = "{audience}应在{horizon}针对{area}进行小范围验证，再决定是否扩大使用"
TODAY, WITHIN, BASIS, MOST_CHARACTERS = "今天", "天内", "。依据：", 300


def filled(form: str, values: dict[str, Column]) -> Column:
    """The form with the values in the places of their names."""
    parts = re.split(r"\{(\w+)\}", form)
    return F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts) if x])


def within(days: Column) -> Column:
    return F.when(days == 0, TODAY).otherwise(F.concat(F.least(F.coalesce(days, F.lit(7)), F.lit(30)).cast("string"), F.lit(WITHIN)))


def first_named(values: Column) -> Column:
    """The first value that is not blank, on one line; null if there is none."""
    return F.get(F.filter(F.transform(values, collapsed), lambda x: x != ""), F.lit(0))


def recommended(changes: Column, audience: Column, area: Column, days: Column) -> Column:
    """What the first change with a statement asks for, and the statement as its basis, in MOST_CHARACTERS at most.

    changes: array of (statement, change_type).  Null where there is no such change, or nobody or nothing that it concerns."""
    change = F.get(F.filter(changes, lambda c: collapsed(c["statement"]) != ""), F.lit(0))
    kind = F.lower(change["change_type"])
    values = {"audience": first_named(audience), "area": first_named(area), "horizon": within(days)}
    asked = filled(OTHERWISE, values)
    for marks, form in reversed(KINDS):
        has = kind.rlike("|".join(marks.split()))
        asked = F.when(has, filled(form, values)).otherwise(asked)
    left = F.greatest(F.lit(0), MOST_CHARACTERS - F.char_length(asked) - len(BASIS))
    return truncated(F.concat(asked, F.lit(BASIS), truncated(change["statement"], left)), MOST_CHARACTERS)
