"""The cache over a stream: expiry, invalidation, what may be kept, and state that is freed, over several micro-batches."""

import datetime as dt
import json

from consentry.streaming import cache

EVENT = "event_id long, ts timestamp, domain string, cache_key string, decision string, risk_score double, system_used string, n_evidence long"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return (START + dt.timedelta(minutes=minutes)).isoformat()


def event(i, minutes, domain, key, decision, used="rule_fallback"):
    return {"event_id": i, "ts": at(minutes), "domain": domain, "cache_key": key, "decision": decision, "risk_score": i / 100, "system_used": used, "n_evidence": i}


def run(spark, tmp_path, batches, **options):
    """Each batch is (events, changes); the served decisions by event id."""
    (tmp_path / "e").mkdir()
    (tmp_path / "c").mkdir()
    events = spark.readStream.schema(EVENT).json(str(tmp_path / "e"))
    changes = spark.readStream.schema("domain string, ts timestamp").json(str(tmp_path / "c"))
    out = []
    for k, (some, marks) in enumerate(batches):
        (tmp_path / "e" / f"{k}.json").write_text("\n".join(map(json.dumps, some)) + "\n")
        (tmp_path / "c" / f"{k}.json").write_text("\n".join(json.dumps({"domain": d, "ts": at(m)}) for d, m in marks) + "\n")
        served = cache.served(events, changes, **options)
        q = served.writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return {r.event_id: r for r in out}, len(out)


def test_expiry_and_invalidation(spark, tmp_path):
    first = [event(1, 0, "a.org", "k1", "allow"), event(2, 10, "a.org", "k1", "deny"), event(3, 20, "b.org", "k2", "transform"), event(4, 30, None, None, "allow"), event(5, 31, "a.org", "m", "deny", "llm_agent"), event(6, 32, "a.org", "m", "allow", "no_policy")]
    second = [event(11, 59, "a.org", "k1", "deny"), event(12, 60, "a.org", "k1", "deny"), event(13, 61, "a.org", "k1", "allow"), event(14, 70, "b.org", "k2", "deny"), event(15, 76, "b.org", "k2", "allow"), event(16, 71, None, None, "deny"), event(17, 80, "a.org", "m", "transform", "fast_system"), event(18, 81, "a.org", "m", "deny")]
    third = [event(21, 500, "a.org", "k1", "transform"), event(22, 501, "a.org", "k1", "deny")]
    got, n = run(spark, tmp_path, [(first, [("z.org", 1)]), (second, [("b.org", 75)]), (third, [("b.org", 400)])], ttl="1 hour", late="4 hours", shards=3)
    assert n == len(got) == 16
    told = {i: (r.decision, r.from_cache) for i, r in got.items()}
    assert told[1] == ("allow", False) and told[2] == ("allow", True) and told[11] == ("allow", True)
    assert told[12] == ("deny", False)  # an hour after the first: it has run out
    assert told[13] == ("deny", True) and got[13].age_seconds == 60
    assert told[3] == ("transform", False) and told[14] == ("transform", True)
    assert told[15] == ("allow", False)  # its domain changed in between
    assert told[4] == ("allow", False) and told[16] == ("allow", True)  # null domains and keys
    assert told[5] == ("deny", False) and told[6] == ("allow", False)  # neither may be kept
    assert told[17] == ("transform", False) and told[18] == ("transform", True)
    assert told[21] == ("transform", False) and told[22] == ("transform", True)
    assert (got[11].risk_score, got[11].system_used, got[11].n_evidence) == (0.01, "rule_fallback", 1)


def test_state_is_freed_and_time_orders_a_batch(spark, tmp_path):
    first = [event(2, 5, "a", f"k{k}", "allow") | {"event_id": 100 + k} for k in range(20)]
    late = [event(1, 3, "a", "x", "deny"), event(3, 1, "a", "x", "allow")]  # as they come, the later one first
    second = [event(50, 600, "b", "y", "allow")]
    third = [event(60, 601, "a", "k1", "deny")]
    got, _ = run(spark, tmp_path, [(first + late, []), (second, [("q", 600)]), (third, [("q", 601)])], ttl="10 minutes", late="1 minute", shards=2)
    assert (got[3].decision, got[1].decision, got[1].from_cache) == ("allow", "allow", True)
    assert (got[60].decision, got[60].from_cache) == ("deny", False)
    kept = spark.read.format("statestore").option("path", str(tmp_path / "p")).option("stateVarName", "kept").load()
    assert {r["key"]["domain"] for r in kept.select("key").collect()} <= {"a", "b"} and kept.count() <= 3
