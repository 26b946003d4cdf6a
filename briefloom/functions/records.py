"""Evidence records as struct columns: their bounds and where they come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from . import text, urls

# How many characters a field keeps; for lists, how many entries of how many characters.
BOUNDS = {
    "candidate_id": 160, "title_zh": 80, "summary_zh": 220, "source_url": 1000, "primary_entity": 160, "product_or_model": 160,
    "change_signature": 160, "version_or_metric": 120,
}
LIST_BOUNDS = {
    "concrete_changes": (5, 500), "evidence_anchors": (8, None), "affected_audience": (5, 160), "affected_area": (5, 160),
    "recommended_action": (5, 300), "event_entities": (10, 160), "policy_terms": (10, 300),
}
# Kinds of sources by host (or a host below it) and path.
SOURCE_KINDS = (
    ("repository", r"(^|\.)github\.com$", ""),
    ("model_card", r"^huggingface\.co$", "/blob/"),
    ("paper", r"^(arxiv\.org|openreview\.net)$", ""),
    ("financial_filing", r"(^|\.)sec\.gov$", ""),
    ("law_or_regulation", r"\.gov(\.cn)?$", ""),
)
OTHER_KIND, SECONDARY = "official_announcement", "trusted_secondary"


_TEXT, _FLAG, _TEXTS = StringType(), BooleanType(), ArrayType(StringType())
_CHANGES = ArrayType(StructType([StructField("change_type", _TEXT, False), StructField("statement", _TEXT, False), StructField("numbers", _TEXTS), StructField("entities", _TEXTS)]))
_ANCHORS = ArrayType(StructType([StructField("quote", _TEXT, False), StructField("locator", _TEXT, False)]))


def _kind(needed: dict[str, DataType], other: dict[str, DataType]) -> StructType:
    return StructType([StructField(name, t, bool(optional)) for optional, fields in enumerate((needed, other)) for name, t in fields.items()])


def _each(names: str, kind: DataType) -> dict[str, DataType]:
    return dict.fromkeys(names.split(), kind)


# The fields of the records that an extractor answers with, those that it must have and those that it may leave out.
TECHNICAL_KIND = _kind(
    _each("candidate_id title_zh summary_zh category source_url source_type verification_status primary_entity change_signature", _TEXT),
    {"concrete_changes": _CHANGES, "evidence_anchors": _ANCHORS, "action_horizon_days": IntegerType()}
    | _each("extra_categories affected_audience affected_area event_entities policy_terms", _TEXTS)
    | _each("product_or_model version_or_metric effective_date relevance_signal original_source_status", _TEXT)
    | _each("resource_available funding_only opinion_only policy_claim vague_claim_without_evidence title_body_conflict scientific_claim original_paper_or_independent_validation marketing_exaggeration evidence_covers_full_claim", _FLAG),
)
GLOBAL_KIND = _kind(
    _each("candidate_id", _TEXT) | _each("occurred material_change", _FLAG) | _each("category title_zh what_happened_zh why_it_matters_zh", _TEXT) | _each("affected_groups_zh key_facts", _TEXTS)
    | {"evidence_anchors": _ANCHORS} | _each("source_url source_type verification_status primary_entity change_signature impact_scope", _TEXT),
    _each("product_or_policy version_or_metric effective_date", _TEXT) | _each("event_entities geographic_scope", _TEXTS)
    | _each("funding_only opinion_only policy_claim policy_text_available title_body_conflict scientific_claim scientific_verified", _FLAG),
)
_ANCHOR = {"$.evidence_anchors[].quote": (4, 500), "$.evidence_anchors[].locator": (1, 200)}
_STATUS = ("verified", "insufficient", "unavailable", "blocked")
TECHNICAL_BOUNDS = _ANCHOR | {
    "$.title_zh": (1, 1 << 30), "$.summary_zh": (1, 1 << 30), "$.extra_categories": (0, 3), "$.relevance_signal": ("direct", "adjacent", "low"), "$.action_horizon_days": (0, 1 << 30),
    "$.verification_status": _STATUS, "$.original_source_status": _STATUS,
}
GLOBAL_BOUNDS = _ANCHOR | {
    "$.candidate_id": (1, 160), "$.title_zh": (1, 80), "$.what_happened_zh": (1, 360), "$.why_it_matters_zh": (1, 320), "$.affected_groups_zh": (1, 5), "$.key_facts": (1, 5), "$.evidence_anchors": (1, 8),
    "$.source_url": (0, 1000), "$.primary_entity": (1, 160), "$.product_or_policy": (0, 160), "$.change_signature": (1, 160), "$.version_or_metric": (0, 120), "$.effective_date": (0, 32), "$.event_entities": (0, 10),
    "$.geographic_scope": (0, 8), "$.verification_status": _STATUS,
}


def technical_rule(r: Column) -> Column:
    """What is wrong with an answered record beyond its fields, or null: the reader's texts must be Chinese."""
    return F.when(~text.is_chinese(r["title_zh"]), "title_zh is not Chinese").when(~text.is_chinese(r["summary_zh"]), "summary_zh is not Chinese")


def global_rule(r: Column) -> Column:
    """As technical_rule(), for the global lane, which takes no repository's name as a title either."""
    wrong = F.when(text.is_repository_name(r["title_zh"]), "title_zh is a repository's name")
    for name in ("title_zh", "what_happened_zh", "why_it_matters_zh"):
        wrong = wrong.when(~text.is_chinese(r[name]), f"{name} is not Chinese")
    for name in ("affected_groups_zh", "key_facts"):
        wrong = wrong.when(F.exists(r[name], lambda x: ~text.is_chinese(x)), f"{name} is not Chinese")
    return wrong


def filled(record: Column, kind: StructType) -> Column:
    """The record with what an answer left out: flags are false (but its evidence covers the claim), texts and lists empty, its relevance low; a date or a number stays null."""
    fields = []
    for field in kind.fields:
        value = record[field.name]
        if field.nullable and field.name not in ("effective_date", "original_source_status"):
            if isinstance(field.dataType, BooleanType):
                value = F.coalesce(value, F.lit(field.name == "evidence_covers_full_claim"))
            elif isinstance(field.dataType, StringType):
                value = F.coalesce(value, F.lit("low" if field.name == "relevance_signal" else ""))
            elif isinstance(field.dataType, ArrayType):
                value = F.coalesce(value, F.array().cast(field.dataType))
        fields.append(value.alias(field.name))
    return F.when(record.isNotNull(), F.struct(*fields))


def safe(value: Column, most: int) -> Column:
    """One line without secrets, of a bounded length."""
    return text.truncated(text.redacted(text.collapsed(value)), most)


def bounded(record: Column, kind: StructType) -> Column:
    """The record with every known field within its bounds; lists lose empty texts, links their secrets, and what is no date is null."""
    out = record
    for field in kind.fields:
        name, value = field.name, record[field.name]
        if name in LIST_BOUNDS and isinstance(field.dataType, ArrayType):
            entries, most = LIST_BOUNDS[name]
            value = F.slice(value, 1, entries)
            if most and isinstance(field.dataType.elementType, StringType):
                value = F.filter(F.transform(value, lambda x: safe(x, most)), lambda x: x != "")  # noqa: B023
        elif name in BOUNDS:
            value = safe(urls.redacted_url(value) if name == "source_url" else value, BOUNDS[name])
        elif name == "effective_date":
            day = safe(value, 32)
            value = F.when(text.is_calendar_date(day), day)
        else:
            continue
        out = out.withField(name, value)
    return out


def source_kind(url: Column) -> Column:
    host, path = urls.host(url), F.lower(urls.part(url, 3))
    kind = F.lit(OTHER_KIND)
    for name, pattern, within in reversed(SOURCE_KINDS):
        kind = F.when(host.rlike(pattern) & F.contains(path, F.lit(within)), name).otherwise(kind)
    return kind


def same_host(left: Column, right: Column) -> Column:
    a, b = (F.regexp_replace(urls.host(x), r"^www\.", "") for x in (left, right))
    return F.coalesce((a != "") & (a == b), F.lit(False))


def with_provenance(record: Column, tier: Column, asked: Column, found: Column, original_status: Column) -> Column:
    """The record with the kind of source that its link shows: a record of a source of tier 3, or of a page on another host than was
    asked for, is secondary, and so is one that says so while its original was looked up."""
    secondary = (record["source_type"] == SECONDARY) & original_status.isNotNull() | (tier > 2) | ~same_host(asked, found)
    return record.withField("source_type", F.when(secondary, SECONDARY).otherwise(source_kind(found))).withField("original_source_status", original_status)


def global_provenance(record: Column, tier: Column, source_status: Column) -> Column:
    """A global record's source is official where its candidate's is of the first tier and secondary elsewhere, whatever it says, and its status is what the fetch came to."""
    return record.withField("source_type", F.when(tier == 1, OTHER_KIND).otherwise(SECONDARY)).withField("verification_status", source_status)


# How many characters the texts of a draft keep.
DRAFT_BOUNDS = {
    "candidate_id": 160, "original_title": 120, "title_en": 120, "summary_en": 320, "title_zh": 80, "summary_zh": 220,
    "concrete_change": 1200, "evidence_url": 1000, "event_fingerprint": 1000, "update_of": 500, "source": 120,
}
NO_SUMMARY, JOINT = "No summary was provided by the source.", "；"


def draft(c: Column, r: Column, fingerprint: Column, update_of: Column, score: Column) -> Column:
    """A publishable item from a candidate (candidate_id, title, summary, source, published_at), its record and its score.

    Of a secondary source whose original cannot be had, that is the item's status."""
    lost = (r["source_type"] == SECONDARY) & r["original_source_status"].isin("unavailable", "blocked")
    texts = {
        "candidate_id": c["candidate_id"],
        "original_title": c["title"],
        "title_en": c["title"],
        "summary_en": F.coalesce(F.nullif(c["summary"], F.lit("")), F.lit(NO_SUMMARY)),
        "title_zh": r["title_zh"],
        "summary_zh": r["summary_zh"],
        "concrete_change": F.array_join(F.transform(r["concrete_changes"], lambda x: x["statement"]), JOINT),
        "evidence_url": r["source_url"],
        "event_fingerprint": fingerprint,
        "update_of": update_of,
        "source": c["source"],
    }
    same = "affected_audience affected_area recommended_action primary_entity product_or_model event_entities change_signature version_or_metric effective_date resource_available category".split()
    return F.struct(
        *[safe(x, DRAFT_BOUNDS[name]).alias(name) for name, x in texts.items()],
        F.when(F.coalesce(lost, F.lit(False)), r["original_source_status"]).otherwise(r["verification_status"]).alias("verification_status"),
        r["original_paper_or_independent_validation"].alias("scientific_verified"),
        *[r[name].alias(name) for name in same],
        F.slice(F.filter(r["extra_categories"], lambda x: x != r["category"]), 1, 3).alias("extra_categories"),
        c["published_at"].alias("published_at"),
        score.alias("score"),
    )
