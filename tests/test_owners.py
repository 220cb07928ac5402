"""Ownership by state gives what the batch finds, in any order, over restarts."""

import random

import pandas as pd
from pyspark.sql import functions as F

from strata.operators import catalog
from strata.streaming import owners


def test_moves_end_where_the_batch_does(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(2)
    events, state = [], {}
    for seq in range(120):
        s, c = f"s{r.randrange(6)}", f"c{r.randrange(5)}"
        last = r.choice([None, f"2026-07-{r.randrange(1, 28):02d}"])
        first = r.choice([None, "2026-06-01"])
        events.append((c, s, last, first, r.random() < 0.75, seq))
        state[c, s] = events[-1]
    late = events[:]
    r.shuffle(late)
    out = []
    run = lambda: owners.owner_moves(spark.readStream.schema(owners.EVENT).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(
        lambda rows, n: out.extend((n, *x) for x in rows.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    for k in range(3):  # the query ends and starts again between the parts; the third part repeats some events
        part = late[k * 40 : k * 40 + 40] + (late[:20] if k == 2 else [])
        spark.createDataFrame(part, owners.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    held = {}
    for n, claim, was, owner in out:
        assert held.get(claim) == was != owner
        held[claim] = owner
    # The batch's view: one rank for each holder of each claim.
    rows = [(c, f"{s}|{c}", e[2], e[3]) for (c, s), e in state.items() if e[4]]
    df = spark.createDataFrame(rows, "claim_key string, session_id string, last_timestamp string, first_timestamp string")
    want = {x.claim_key: x.session_id.split("|")[0] for x in catalog.claim_owners(df.select("claim_key", "session_id"), df.drop("claim_key")).collect()}
    assert {c: o for c, o in held.items() if o} == want and len(want) == 5
    assert spark.createDataFrame(rows, df.schema).filter(F.col("claim_key") == "c0").count() > 1


def test_a_session_meets_the_state_once_a_part():
    """Each row asked the state and wrote it, two or three calls to the JVM."""
    class Held(dict):
        calls = 0

        def containsKey(self, k):  # noqa: N802
            Held.calls += 1
            return k in self

        def getValue(self, k):  # noqa: N802
            Held.calls += 1
            return self[k]

        def updateValue(self, k, v):  # noqa: N802
            Held.calls += 1
            self[k] = v

        def iterator(self):
            return iter(self.items())

    class One:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, v):
            self.value = v

        def clear(self):
            self.value = None
    mine = owners.Owners()
    mine.sessions, mine.owner = Held(), One()
    r, state, seqs = random.Random(5), {}, list(range(3000))
    r.shuffle(seqs)
    rows = [("c", f"s{r.randrange(20)}", r.choice([None, f"2026-07-{r.randrange(1, 28):02d}"]), None, r.random() < 0.6, n) for n in seqs]
    for row in sorted(rows, key=lambda x: x[5]):
        state[row[1]] = row
    parts = [pd.DataFrame(rows[k : k + 1000], columns=["claim_key", "session_id", "last_timestamp", "first_timestamp", "held", "seq"]) for k in (0, 1000, 2000)]
    out = [x for part in parts for x in mine.handleInputRows(("c",), iter([part]), None)]
    assert out[-1].owner[0] == min(owners.rank(x[2], x[3], x[1]) for x in state.values() if x[4])[2]
    assert {k[0]: v[3] for k, v in mine.sessions.items()} == {k: x[5] for k, x in state.items()} and Held.calls <= 3 * 3 * 20
