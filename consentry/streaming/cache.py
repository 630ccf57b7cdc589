"""The decision cache over a stream: time to live, and invalidation of a domain.

State is kept per domain and shard of its cache keys, so that a domain of any share
of the events is spread, and a change of its policy reaches every shard. All times are event
times, so a repeated batch gives the same answers; a timer frees what has run out when the
watermark passes it. Only what a cache may keep is kept: no triage, no model's answer, no missing policy.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

CACHED = ("consent_guardrail", "fast_system", "rule_fallback")
DECIDED = ("event_id", "ts", "domain", "cache_key", "decision", "risk_score", "system_used", "n_evidence")
SERVED = "event_id long, ts timestamp, domain string, cache_key string, decision string, risk_score double, system_used string, n_evidence long, from_cache boolean, age_seconds double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class DecisionCache(StatefulProcessor):
    """One shard of a domain: cached decisions by key, the time of the last change, and the next timer."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "cache_key string", "since long, decision string, risk_score double, system_used string, n_evidence long")
        self.changed = handle.getValueState("changed", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # of one time a change comes first, then events by id
        all_ = pd.concat(list(rows)).sort_values(["ts", "change", "event_id"], ascending=[True, False, True], kind="stable")
        changed = self.changed.get()[0] if self.changed.exists() else None
        out = []
        for r in all_.itertuples(index=False):
            now = _ms(r.ts)
            if r.change:
                if changed is None or now > changed:
                    changed = now
                    self.changed.update((now,))
                    for (k,), v in list(self.kept.iterator()):
                        if v[0] < now:
                            self.kept.removeKey((k,))
                continue
            known = self.kept.getValue((r.cache_key,)) if self.kept.containsKey((r.cache_key,)) else None
            if known is not None and known[0] <= now < known[0] + self.ttl:
                out.append((r.event_id, r.ts, r.domain, r.cache_key, *known[1:], True, (now - known[0]) / 1000))
                continue
            out.append((r.event_id, r.ts, r.domain, r.cache_key, r.decision, r.risk_score, r.system_used, r.n_evidence, False, 0.0))
            # what was decided before the last change must not be served after it, and a late event replaces nothing newer
            if r.system_used in CACHED and (changed is None or now >= changed) and (known is None or now > known[0]):
                self.kept.updateValue((r.cache_key,), (now, r.decision, float(r.risk_score), r.system_used, int(r.n_evidence)))
                self._wake(now + self.ttl)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SERVED.split(", ")])

    def _wake(self, at: int) -> None:
        """A timer at the time, if there is none that comes before it."""
        if not self.timer.exists() or at < self.timer.get()[0]:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        for (k,), v in list(self.kept.iterator()):
            if v[0] + self.ttl <= now:
                self.kept.removeKey((k,))
            else:
                left.append(v[0] + self.ttl)
        self.timer.clear()
        if left:
            self._wake(min(left))
        return iter(())

    def close(self) -> None:
        pass


def served(decided: DataFrame, changes: DataFrame, ttl: str = "1 hour", late: str = "10 minutes", shards: int = 64) -> DataFrame:
    """The stream of decisions as a cache serves them: SERVED's columns.

    decided: a stream of DECIDED's columns, each event with the decision made afresh (as decide.decide gives it);
    changes: a stream of domain and ts, when a domain's policies changed. An event gets
    the decision made for its key within ttl before it, unless its domain changed since;
    else its own, which is then kept. Events of one time are served by id. Null domains and keys count as empty.
    Events later than late behind the greatest time seen are dropped, as by any watermark.
    """
    decided.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only one that has map states and timers
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    events = decided.select(*DECIDED).withColumns({"domain": text("domain"), "cache_key": text("cache_key"), "change": F.lit(False)})
    events = events.withColumn("shard", F.pmod(F.xxhash64("cache_key"), F.lit(shards)).cast("int")).withWatermark("ts", late)
    types = dict(events.dtypes)
    marks = changes.select("ts", text("domain").alias("domain"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    marks = marks.withColumns({c: F.lit(None).cast(types[c]) for c in DECIDED if c not in ("ts", "domain")} | {"change": F.lit(True)}).withWatermark("ts", late)
    both = events.unionByName(marks.select(*events.columns))
    return both.groupBy("domain", "shard").transformWithStateInPandas(DecisionCache(ttl_ms), SERVED, "Update", "EventTime")
