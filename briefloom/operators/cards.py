"""Briefings as Markdown and as card documents, one for each run, from column expressions.

A run has a bounded number of events and items, so its lines meet in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped_markdown
from ..functions.urls import is_evidence_url
from .compose import BOARD_LIMITS
from .history import ZONE

# Labels, the most bytes of each text, and the words of a card.
BOARD_LABELS = {"must_read": "今日必看", "try_now": "值得试用", "watch": "观察项"}
EVENT_LABELS = {
    "models_products": "模型与产品", "companies_business": "公司与商业", "policy_regulation": "政策与监管",
    "research_breakthroughs": "科研突破", "adoption_society": "大众应用与社会影响",
}
REASON_LABELS = {
    "funding_only": "只有融资金额，缺少业务或技术数据", "opinion_without_evidence": "只有观点，缺少事实证据", "policy_without_terms_or_date": "政策缺少具体条款或生效时间",
    "vague_claim_without_evidence": "模糊结论缺少对应证据", "title_body_conflict": "标题与正文信息冲突", "scientific_claim_unverified": "科学结论缺少原始论文或独立验证",
    "duplicate_without_material_update": "过去 7 天重复", "missing_concrete_change": "缺少具体变化", "missing_action": "缺少可执行行动", "missing_affected_audience": "缺少受影响对象",
    "missing_affected_area": "缺少受影响内容", "invalid_evidence_anchor": "证据无法核查", "unverified_primary_source": "原始来源未核查",
}
ITEM_BYTES = {"title_zh": 120, "concrete_change": 300, "affected_audience": 120, "affected_area": 120, "recommended_action": 240}
EVENT_BYTES = {"title_zh": 180, "what_happened_zh": 900, "why_it_matters_zh": 720, "affected_groups_zh": 300, "key_facts": 600, "source_name": 180}
JOINTS = {"affected_audience": "、", "affected_area": "、", "recommended_action": "；", "affected_groups_zh": "、", "key_facts": "；"}
NARRATIVE_BYTES, CONTENT_BYTES, CARD_BYTES, ITEMS_SHOWN, LATE_HOURS = 1500, 18_000, 20_000, 5, 48
TODAY, EVENTS, ITEMS = "## 一分钟读懂今天", "## 全球 AI 重大事件", "## 技术与工具"
NOTHING, WHY, UNNAMED, NO_CANDIDATES = "**今日无内容通过硬门槛**", "主要淘汰原因：", "- 未记录可归类淘汰原因；本轮内容未达到最终分榜阈值", "- 无：本轮未产生候选"
HEADER, GROUP = "AI 每日新闻 · ", "AI 增长内部群"


def _lines(*lines: Column) -> Column:
    """The lines, each with its end."""
    return F.concat(*[x for line in lines for x in (line, F.lit("\n"))])


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _shown(x: Column, limits: dict[str, int]) -> dict[str, Column]:
    return {k: escaped_markdown(F.array_join(x[k], JOINTS[k]) if k in JOINTS else x[k], n) for k, n in limits.items()}


def labelled(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in table.values()]), F.array_position(F.array(*map(F.lit, table)), key).cast("int") - 1), key)


def link(url: Column) -> Column:
    """The link with all but the letters of links percent-encoded; null where it is no evidence link.  Hosts are taken as they are."""
    each = F.regexp_extract_all(url, F.lit("(?s)(.)"), F.lit(1))
    kept = F.transform(each, lambda c: F.when(c.rlike(r"[A-Za-z0-9/:@!$&'*+,;=%~._?#\[\]-]"), c).otherwise(F.url_encode(c)))
    return F.when(is_evidence_url(url), F.array_join(kept, ""))


def item_text(x: Column) -> Column:
    """An item on a board (the fields of ITEM_BYTES, evidence_url, board, verification_status, total, rank); null with a bad link."""
    t = _shown(x, ITEM_BYTES)
    warning = F.when((x["board"] == "watch") & x["verification_status"].isin("unavailable", "blocked"), "  ⚠ 原始来源暂不可核查").otherwise("")
    return _lines(
        _text("**", x["rank"].cast("string"), ". ", t["title_zh"], "**  `总分 ", x["total"].cast("string"), "`"),
        _text("具体变化：", t["concrete_change"]),
        _text("影响：", t["affected_audience"], " · ", t["affected_area"]),
        _text("建议行动：", t["recommended_action"]),
        _text("[核查原文](", link(x["evidence_url"]), ")", warning),
    )


def event_text(x: Column, generated_at: Column) -> Column:
    """A global event (the fields of EVENT_BYTES, category, source_url, published_at, rank); null with a bad link."""
    t = _shown(x, EVENT_BYTES)
    day = F.date_format(F.from_utc_timestamp(x["published_at"], ZONE), "yyyy-MM-dd")
    late = F.when(F.unix_micros(generated_at) - F.unix_micros(x["published_at"]) > LATE_HOURS * 3_600_000_000, " · 回看").otherwise("")
    return _lines(
        _text("**", x["rank"].cast("string"), ". 🌍 [", labelled(EVENT_LABELS, x["category"]), "] ", t["title_zh"], "**"),
        _text("发生了什么：", t["what_happened_zh"]),
        _text("为什么重要：", t["why_it_matters_zh"]),
        _text("影响：", t["affected_groups_zh"]),
        _text("关键事实：", t["key_facts"]),
        _text("日期：", day, late),
        _text("来源：", t["source_name"], " · [查看原文](", link(x["source_url"]), ")"),
    )


def empty_text(candidates: Column, shortlisted: Column, verified: Column, rejected: Column, reasons: Column) -> Column:
    """What a run without items says: how many it looked at, and why they went; reasons: array of (reason, n)."""
    order = lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).when(a["reason"] < b["reason"], -1).when(a["reason"] > b["reason"], 1).otherwise(0)
    told = F.transform(F.array_sort(reasons, order), lambda r: _text("- ", labelled(REASON_LABELS, r["reason"]), "：", r["n"].cast("string")))
    some = candidates + shortlisted + verified + rejected > 0
    why = F.when(F.size(told) > 0, F.array_join(told, "\n")).when(some, UNNAMED).otherwise(NO_CANDIDATES)
    looked = _text("已检查候选 ", candidates.cast("string"), " 条，粗筛 ", shortlisted.cast("string"), " 条，已核查来源 ", verified.cast("string"), " 条。")
    return F.concat_ws("\n", F.lit(NOTHING), F.lit(""), looked, F.lit(""), F.lit(WHY), why)


def rendered(briefings: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """(run_id, content, card, n_events, n_items) of all runs.

    briefings: run_id, run_status, generated_at, narrative, the four counts and reasons of empty_text(); events and items: run_id and
    the fields of event_text() and item_text().  The last of the first ITEMS_SHOWN items go until the content fits; where even none
    fits, a link is bad, or the card is too large, content and card are null."""
    place = F.array_position(F.array(*map(F.lit, BOARD_LIMITS)), F.col("board"))
    fields = lambda df: F.struct(*[c for c in df.columns if c != "run_id"])
    told = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", fields(events).alias("x")))).alias("e"))
    shown = items.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "rank", fields(items).alias("x")))).alias("i"))
    both = briefings.join(told, "run_id", "left").join(shown, "run_id", "left")
    e = F.coalesce(F.transform("e", lambda r: event_text(r["x"], F.col("generated_at"))), F.array().cast("array<string>"))
    title = lambda x: F.when(x["rank"] == 1, _text("### ", labelled(BOARD_LABELS, x["board"]), "\n\n")).otherwise("")
    i = F.coalesce(F.transform(F.slice("i", 1, ITEMS_SHOWN), lambda r: F.concat(title(r["x"]), item_text(r["x"]))), F.array().cast("array<string>"))
    # written lines are read several times below
    both = both.withColumns({"_e": e, "_i": i})
    sound = F.forall(F.concat("_e", "_i"), lambda x: x.isNotNull())

    def content(n: Column) -> Column:
        head = F.array(_text(TODAY, "\n\n", escaped_markdown(F.col("narrative"), NARRATIVE_BYTES), "\n"))
        of_events = F.when(F.size("_e") > 0, F.concat(F.array(_text(EVENTS, "\n")), F.col("_e"))).otherwise(F.array().cast("array<string>"))
        of_items = F.when(n > 0, F.concat(F.array(_text(ITEMS, "\n")), F.slice("_i", F.lit(1), n))).otherwise(F.array().cast("array<string>"))
        return F.regexp_replace(F.array_join(F.concat(head, of_events, of_items), "\n"), r"\s+$", "")

    sizes = F.reverse(F.sequence(F.lit(0), F.size("_i")))
    fit = F.get(F.filter(F.transform(sizes, lambda n: F.struct(content(n).alias("text"), n.alias("n"))), lambda c: F.octet_length(c["text"]) <= CONTENT_BYTES), F.lit(0))
    nothing = F.col("run_status") == "no_qualifying_items"
    none = empty_text(*[F.col(c) for c in ("candidate_count", "shortlist_count", "source_verified_count", "rejected_count", "reasons")])
    done = both.withColumn("_fit", F.when(nothing, F.struct(none.alias("text"), F.lit(0).alias("n"))).when(sound, fit))
    # the card tells how many items of the day there are, not how many of them fit
    counts = _text("全球大事 ", F.size("_e").cast("string"), " · 技术情报 ", F.size("_i").cast("string"), " · ", GROUP)
    subtitle = F.when(nothing, "严格筛选完成 · " + GROUP).otherwise(counts)
    done = done.select("run_id", F.col("_fit.text").alias("content"), card(F.col("generated_at"), subtitle, F.col("_fit.text")).alias("card"), F.size("_e").alias("n_events"), F.coalesce("_fit.n", F.lit(0)).alias("n_items"))
    fits = F.octet_length("card") <= CARD_BYTES
    return done.withColumns({"content": F.when(fits, F.col("content")), "card": F.when(fits, F.col("card"))})


def card(generated_at: Column, subtitle: Column, content: Column) -> Column:
    """The card document as JSON; null without content."""
    plain = lambda x: F.struct(F.lit("plain_text").alias("tag"), x.alias("content"))
    title = _text(HEADER, F.date_format(F.from_utc_timestamp(generated_at, ZONE), "yyyy-MM-dd"))
    header = F.struct(plain(title).alias("title"), plain(subtitle).alias("subtitle"), F.lit("blue").alias("template"), F.lit("12px 12px 12px 12px").alias("padding"))
    element = F.struct(F.lit("markdown").alias("tag"), content.alias("content"), F.lit("left").alias("text_align"), F.lit("normal_v2").alias("text_size"), F.lit("0px 0px 0px 0px").alias("margin"))
    body = F.struct(F.lit("vertical").alias("direction"), F.lit("12px 12px 12px 12px").alias("padding"), F.array(element).alias("elements"))
    document = F.struct(F.lit("2.0").alias("schema"), F.struct(F.lit(True).alias("update_multi")).alias("config"), header.alias("header"), body.alias("body"))
    return F.when(content.isNotNull(), F.to_json(F.struct(F.lit("interactive").alias("msg_type"), document.alias("card"))))
