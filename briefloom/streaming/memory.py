"""Events of a stream against what earlier runs told: keyed state in place of a history table.

The key is (lane, company, change), which all that can match a record share.  Its state is
`entries`, the latest record of each fingerprint, and `posted`, for each token (product or entity, or entity alone in the global lane) the
fingerprints that have it, by time.  A record reads its own fingerprint and its own tokens, whatever else the key holds.
Entries leave by a timer at the end of the last day on which they count, so the state is what a week tells.  A key with entries has one timer, for the first of
them to leave; what no later run can meet (runs come in order) is never written.  Each read or write is a call to the state store, so a key of which nothing is held
is asked for nothing but that.

All records of a run (rows with one `now`) are held against the state that earlier runs left, and recorded only after that;
a batch may hold several runs, but a run is in one batch.  Runs come in the order of their time, and no record is
of a later day than its run; rows older than the watermark are late and left out.  Rows of one key in a batch go through one
task and are held there, so a trigger's size (maxFilesPerTrigger) bounds memory."""

from __future__ import annotations

import contextlib
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import history

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "at bigint, day int, event_id bigint, version string, date string, first boolean, second boolean, scope array<string>, tokens array<string>"
_OUT = "event_id bigint, lane string, dup_status string, update_of string"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within, state of several variables with timers can be kept; the session's own setting is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class EventMemory(StatefulProcessor):
    """The state of one (lane, company, change)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "fingerprint string", _ENTRY)
        self.posted = handle.getMapState("posted", "token string", "ats array<bigint>, fingerprints array<string>")

    def _open(self) -> None:
        """Nothing of this key is held yet.  What is read is held until _close(), so that each entry and list crosses once in a batch."""
        self._stored = self.entries.exists()
        self._entries: dict[str, tuple | None] = {}
        self._posts: dict[str, list[tuple[int, str]]] = {}
        self._new: tuple[set, set] = set(), set()

    def _close(self, last_day: int) -> None:
        """Writes what is new and still counts for a run of that day or a later one; what is older is left out, of the lists too."""
        fingerprints, tokens = self._new
        for fingerprint in list(fingerprints):
            e = self._entries[fingerprint]
            if last_day - e[1] > history.EVENT_DAYS:
                for token in e[8]:
                    self._drop(self._post(token), (e[0], fingerprint))
                    tokens.add(token)
                fingerprints.remove(fingerprint)
                if self._stored:
                    self.entries.removeKey((fingerprint,))
        for fingerprint in fingerprints:
            self.entries.updateValue((fingerprint,), self._entries[fingerprint])
        for token in tokens:
            self._put(token, self._posts[token])
        if fingerprints and not self._stored:
            self.handle.registerTimer(min(self._gone(self._entries[f][1]) for f in fingerprints))
        elif self._stored and not self.entries.exists():
            self._forget_timers()

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _entry(self, fingerprint: str) -> tuple | None:
        if fingerprint not in self._entries:
            found = self.entries.getValue((fingerprint,)) if self._stored else None
            self._entries[fingerprint] = None if found is None else tuple(found)
        return self._entries[fingerprint]

    def _post(self, token: str) -> list[tuple[int, str]]:
        if token not in self._posts:
            found = self.posted.getValue((token,)) if self._stored else None
            self._posts[token] = [] if found is None else list(zip(found[0], found[1]))
        return self._posts[token]

    def _put(self, token: str, post: list[tuple[int, str]]) -> None:
        if post:
            self.posted.updateValue((token,), ([a for a, _ in post], [f for _, f in post]))
        elif self._stored:
            self.posted.removeKey((token,))

    @staticmethod
    def _newly(row: Row, first: bool, second: bool, scope: list[str], lane: str) -> bool:
        """What makes an update a material one: a resource or a proof that was not there; in the global lane a new region, or a first primary source."""
        wider = lane == "global" and bool(set(row["scope"]) - set(scope))
        return bool(wider or (row["first"] and not first) or (row["second"] and not second))

    def _judged(self, lane: str, company: str, row: Row) -> tuple[str, str | None]:
        counts = lambda day: 0 <= row["now_day"] - day <= history.EVENT_DAYS
        same = self._entry(row["fingerprint"])
        if same is not None and counts(same[1]):
            return ("material_update", row["fingerprint"]) if self._newly(row, same[5], same[6], same[7], lane) else ("duplicate", None)
        best = None
        for token in row["tokens"] if company else ():
            for at, fingerprint in reversed(self._post(token)):
                if best is not None and (at, fingerprint) <= best[0]:
                    break
                entry = self._entry(fingerprint)
                if counts(entry[1]):
                    best = (at, fingerprint), entry
                    break
                if row["now_day"] > entry[1]:
                    break  # all before it are older still
        if best is None:
            return "unique", None
        e = best[1]
        changed = row["version"] != e[3] or row["date"] != e[4] or self._newly(row, e[5], e[6], e[7], lane)
        return "material_update" if changed else "minor_update", best[0][1]

    def _record(self, rows: list[Row]) -> None:
        """The latest of each fingerprint over what is there."""
        last: dict[str, Row] = {}
        for row in rows:
            had = last.get(row["fingerprint"])
            if had is None or (row["at"], row["event_id"]) > (had["at"], had["event_id"]):
                last[row["fingerprint"]] = row
        entries, tokens = self._new
        for fingerprint, row in last.items():
            old = self._entry(fingerprint)
            if old is not None:
                if (old[0], old[2]) > (row["at"], row["event_id"]):
                    continue
                for token in old[8]:
                    self._drop(self._post(token), (old[0], fingerprint))
                    tokens.add(token)
            for token in row["tokens"]:
                insort(self._post(token), (row["at"], fingerprint))
                tokens.add(token)
            self._entries[fingerprint] = tuple(row[c] for c in ("at", "day", "event_id", "version", "date", "first", "second", "scope", "tokens"))
            entries.add(fingerprint)

    @staticmethod
    def _drop(post: list[tuple[int, str]], item: tuple[int, str]) -> None:
        k = bisect_left(post, item)
        if k < len(post) and post[k] == item:
            del post[k]

    def handleInputRows(self, key, rows, timerValues):
        lane, company, _ = key
        runs: dict[int, list[Row]] = {}
        for row in rows:
            runs.setdefault(row["now_micros"], []).append(row)
        self._open()
        for _, own in sorted(runs.items()):
            for row in own:
                status, update = self._judged(lane, company, row)
                yield Row(event_id=row["event_id"], lane=lane, dup_status=status, update_of=update)
            self._record(own)
        self._close(max(row["now_day"] for row in own))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Removes the entries whose last day is over, and their places in the lists."""
        ended = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._open()
        left, tokens = [], set()
        for fingerprint, e in [(k[0], tuple(e)) for k, e in self.entries.iterator()]:
            if self._gone(e[1]) > ended:
                left.append(self._gone(e[1]))
                continue
            for token in e[8]:
                self._drop(self._post(token), (e[0], fingerprint))
                tokens.add(token)
            self.entries.removeKey((fingerprint,))
        for token in tokens:
            self._put(token, self._posts[token])
        if left:
            self.handle.registerTimer(min(left))
        return iter(())

    @staticmethod
    def _gone(day: int) -> int:
        """When an entry of a local day (numbered from 1970) no longer counts, in milliseconds; the zone is eight hours ahead all year."""
        return (day + history.EVENT_DAYS + 1) * 86_400_000 - 8 * 3_600_000

    def close(self) -> None:
        pass


def classified_stream(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(event_id, lane, dup_status, update_of) of records as history.classified() and classified_global() take them, with `now`, the time of their run.
    Start it within keyed_state().  late: by how much rows may come after later ones."""
    known = lambda name, default: F.coalesce(F.col(name), default) if name in stream.columns else default
    no, none = F.lit(False), F.array().cast("array<string>")
    is_global = F.col("lane") == "global"
    day = history.local_day(F.col("recorded_at"))
    number = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    tokens = F.when(is_global, history.global_tokens(F.col("entities"))).otherwise(history.technical_tokens(F.col("product_or_model"), F.col("entities"), F.col("primary_entity")))
    rows = stream.withWatermark("recorded_at", late).select(
        "lane", F.coalesce("primary_entity", F.lit("")).alias("primary_entity"), F.coalesce("change_signature", F.lit("")).alias("change_signature"), "event_id", "fingerprint", "recorded_at",
        F.unix_micros("recorded_at").alias("at"), number(day).alias("day"), F.unix_micros("now").alias("now_micros"), number(history.local_day(F.col("now"))).alias("now_day"),
        F.col("version_or_metric").alias("version"), F.col("effective_date").alias("date"), tokens.alias("tokens"),
        F.when(is_global, no).otherwise(known("resource_available", no)).alias("first"),
        F.when(is_global, known("source_type", F.lit("")) != "trusted_secondary").otherwise(known("scientific_verified", no)).alias("second"),
        F.when(is_global, known("geographic_scope", none)).otherwise(none).alias("scope"),
    )
    return rows.groupBy("lane", "primary_entity", "change_signature").transformWithState(EventMemory(), _OUT, "append", "eventTime")
