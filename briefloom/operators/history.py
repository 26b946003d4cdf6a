"""Memory between runs: URLs that were sent, events that were told, deliveries that were made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugs
from ..functions.urls import canonical_url

URL_DAYS, EVENT_DAYS, ZONE = 30, 7, "Asia/Shanghai"
# Names too general to tell one event from another.
GENERIC = ("ai", "api", "sdk", "model", "agent", "release", "update")


def local_day(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, ZONE))


def is_active(at: Column, now: Column) -> Column:
    """Whether a record's day is at most a week before the run's, and not after it."""
    return F.datediff(local_day(now), local_day(at)).between(0, EVENT_DAYS)


def _kept(at: Column, now: Column) -> Column:
    return at.between(now - F.expr(f"INTERVAL {URL_DAYS} DAYS"), now)


def unsent(candidates: DataFrame, history: DataFrame, now: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates whose page was not sent within the last 30 days. history: (url, recorded_at), and the columns `by` of both where each has a history of its own."""
    sent = history.where(_kept(F.col("recorded_at"), now)).select(*by, canonical_url(F.col("url")).alias("_sent")).distinct()
    return candidates.withColumn("_sent", canonical_url(F.col("url"))).join(sent, [*by, "_sent"], "left_anti").drop("_sent")


def url_history(history: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The latest time of each page, of both tables (url, recorded_at), pruned to 30 days."""
    both = history.select("url", "recorded_at").unionByName(new.select("url", "recorded_at"))
    latest = both.groupBy(canonical_url(F.col("url")).alias("url")).agg(F.max("recorded_at").alias("recorded_at"))
    return latest.where(_kept(F.col("recorded_at"), now))


def event_history(history: DataFrame, new: DataFrame, now: Column, keys: list[str] | None = None) -> DataFrame:
    """New records over old ones of the same key (lane and fingerprint, or the fingerprint alone), pruned to a week."""
    keys = keys or ["lane", "fingerprint"]
    both = history.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    order = [F.col("age"), F.col("recorded_at").desc(), *[F.col(c) for c in ("event_id",) if c in history.columns]]
    last = both.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth", "age")
    return last.where(is_active(F.col("recorded_at"), now))


#: What an entry of the technical lane's history tells besides its time and fingerprint.
ENTRY = ("product_or_model", "entities", "version_or_metric", "effective_date", "resource_available", "scientific_verified")


#: What joins a record to earlier ones of its company and change.
_ABOUT = ["lane", "primary_entity", "change_signature"]


def technical_tokens(product: Column, entities: Column, company: Column) -> Column:
    """What two records of one company and change must share to tell of the same thing: a product or an entity, neither general nor the company."""
    own = F.array_except(F.coalesce(entities, F.array().cast("array<string>")), F.array(F.coalesce(company, F.lit("")), F.lit(""), *map(F.lit, GENERIC)))
    named = F.when((product != "") & ~product.isin(*GENERIC), F.array(F.concat(F.lit("product "), product))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.filter(own, lambda e: e.isNotNull()), lambda e: F.concat(F.lit("entity "), e)), named)


def global_tokens(entities: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: e.isNotNull()))


def _nearest(open_ones: DataFrame, latest: DataFrame, key: str, tokens: Callable[[str], Column]) -> DataFrame:
    """(key, near): of each open record the latest entry of its company and change that shares a token with it.

    Entries are an inverted index: of all that have a token only the latest is kept, counted up in each task first, so a company with any number of
    entries is a row for each of its tokens, and a record meets as many rows as it has tokens."""
    posted = latest.select(*_ABOUT, "old", F.explode(tokens("old.")).alias("token"))
    posted = posted.groupBy(*_ABOUT, "token").agg(F.max_by("old", F.struct("old.recorded_at", "old.fingerprint")).alias("old"))
    asked = open_ones.select(key, *_ABOUT, F.explode(tokens("")).alias("token"))
    return asked.join(posted.hint("merge"), [*_ABOUT, "token"]).groupBy(key).agg(F.max_by("old", F.struct("old.recorded_at", "old.fingerprint")).alias("near"))


def _told(records: DataFrame, history: DataFrame, now: Column, key: str, fields: tuple[str, ...], tokens: Callable[[str], Column], newly: Callable[[str], Column]) -> DataFrame:
    """records with dup_status and update_of; newly: what is new over an entry, and makes its update a material one."""
    active = history.where(is_active(F.col("recorded_at"), now))
    latest = active.groupBy(*_ABOUT, "fingerprint").agg(F.max_by(F.struct("recorded_at", "fingerprint", *fields), F.struct("recorded_at", "event_id")).alias("old"))
    found = records.join(latest.select("lane", "fingerprint", F.col("old").alias("same")), ["lane", "fingerprint"], "left")
    first = _nearest(found.where(F.col("same").isNull() & (F.col("primary_entity") != "")), latest, key, tokens)
    both = found.join(first.hint("merge"), key, "left")
    changed = (F.col("version_or_metric") != F.col("near.version_or_metric")) | (F.col("effective_date") != F.col("near.effective_date")) | newly("near")
    status = (
        F.when(F.col("same").isNotNull(), F.when(newly("same"), "material_update").otherwise("duplicate"))
        .when(F.col("near").isNotNull(), F.when(changed, "material_update").otherwise("minor_update"))
        .otherwise("unique")
    )
    update = F.when(F.col("same").isNotNull(), F.when(newly("same"), F.col("same.fingerprint"))).otherwise(F.col("near.fingerprint"))
    return both.withColumn("dup_status", status).withColumn("update_of", update).drop("same", "near")


def classified(records: DataFrame, history: DataFrame, now: Column, key: str = "event_id") -> DataFrame:
    """records with dup_status and update_of, against a history of the same lane.

    The latest entry with the same fingerprint decides; else the latest of the same company and change
    that shares the product or an entity that is neither the company nor general; else the record is unique.
    Every record is held against the same history, whatever else comes with it."""
    newly = lambda o: (F.col("resource_available") & ~F.col(f"{o}.resource_available")) | (F.col("scientific_verified") & ~F.col(f"{o}.scientific_verified"))
    tokens = lambda at: technical_tokens(F.col(f"{at}product_or_model"), F.col(f"{at}entities"), F.col("primary_entity"))
    return _told(records, history, now, key, ENTRY, tokens, newly)


def classified_global(records: DataFrame, history: DataFrame, now: Column, key: str = "event_id") -> DataFrame:
    """As classified(), for the global lane: any shared entity makes entries near, and new regions or a first primary source make an update material."""
    fields = ("entities", "version_or_metric", "effective_date", "geographic_scope", "source_type")
    wider = lambda o: (F.size(F.array_except("geographic_scope", f"{o}.geographic_scope")) > 0) | ((F.col("source_type") != "trusted_secondary") & (F.col(f"{o}.source_type") == "trusted_secondary"))
    return _told(records, history, now, key, fields, lambda at: global_tokens(F.col(f"{at}entities")), wider)


def delivery_ledger(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (day, target), the latest; only runs that ended well count. Rows: (target, sent_at, run_status)."""
    ok = new.where(F.col("run_status").isin("published", "no_qualifying_items")).withColumn("day", local_day(F.col("sent_at")))
    both = ledger.select("day", "target", "sent_at", "run_status").unionByName(ok.select("day", "target", "sent_at", "run_status"))
    return both.groupBy("day", "target").agg(F.max_by(F.struct("sent_at", "run_status"), F.struct("sent_at", "run_status")).alias("x")).select("day", "target", "x.*")


def undelivered(attempts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Attempts (day, target) that have not succeeded yet."""
    return attempts.join(ledger.select("day", "target"), ["day", "target"], "left_anti")


def latest_by_key(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Last write wins."""
    order = [F.col(at).desc(), F.col(tie).desc()]
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def confirmed(payload: DataFrame, today: Column, statuses: tuple[str, ...]) -> DataFrame:
    """Confirmations (delivery_date, delivery_id, run_status) that count: of today, with an id of 32 lower-case hex digits and a good status."""
    good = (F.col("delivery_date") == F.date_format(today, "yyyy-MM-dd")) & F.col("delivery_id").rlike("^[0-9a-f]{32}$") & F.col("run_status").isin(*statuses)
    return payload.where(F.coalesce(good, F.lit(False)))


def day_states(states: DataFrame) -> DataFrame:
    """The latest state of each day (day, at, delivery_status, sync_pending, dashboard_pending): whether it blocks another delivery,
    and whether a sent day has work left."""
    last = states.groupBy("day").agg(F.max_by(F.struct("delivery_status", "sync_pending", "dashboard_pending"), "at").alias("s"))
    sent = F.col("s.delivery_status") == "sent"
    return last.select("day", F.col("s.delivery_status").isin("sent", "uncertain_delivery").alias("blocks"), (sent & (F.col("s.sync_pending") | F.col("s.dashboard_pending"))).alias("pending"))


def snapshots(records: DataFrame, lane: str, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records as entries of event history, with the columns `keep`: their names as slugs, and what they are about as one sorted set.

    records: fingerprint, primary_entity, product_or_model, change_signature, version_or_metric, effective_date, event_entities, source_url;
    of the technical lane resource_available, scientific_verified and source_type, of the global one scientific_verified,
    source_type and geographic_scope, where known.  What a lane does not tell is false or empty."""
    known = lambda name, default: F.coalesce(name, default) if name in records.columns else default
    none = F.array().cast("array<string>")
    names = ["primary_entity", "product_or_model", "change_signature", "version_or_metric", "effective_date"]
    scope = known("geographic_scope", none) if lane == "global" else none
    entities = F.coalesce("event_entities", none)
    # one call for all names of a row
    read = records.withColumn("_s", slugs(F.concat(F.array(*names), entities, scope))).withColumn("_n", F.size(entities))
    s = F.col("_s")
    about = F.concat(F.slice(s, 1, 2), F.slice(s, F.lit(len(names) + 1), F.col("_n")))
    return read.select(
        *keep,
        "fingerprint",
        F.lit(lane).alias("lane"),
        now.alias("recorded_at"),
        F.array_sort(F.array_distinct(F.filter(about, lambda x: x != ""))).alias("entities"),
        *[s[k].alias(name) for k, name in enumerate(names)],
        (known("resource_available", F.lit(False)) if lane == "technical" else F.lit(False)).alias("resource_available"),
        known("scientific_verified", F.lit(False)).alias("scientific_verified"),
        known("source_type", F.lit("")).alias("source_type"),
        F.slice(s, F.lit(len(names) + 1) + F.col("_n"), F.greatest(F.lit(0), F.size(s))).alias("geographic_scope"),
        "source_url",
    )
