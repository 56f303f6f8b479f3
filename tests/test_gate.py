import datetime as dt
import random

from tessera.schema import MSG_TOKEN_TIMEOUT
from tessera.session import fresh_path
from tessera.streaming import gate, jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "job_id string, ts timestamp_ntz, state string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, batches, clock):
    """Each batch is one run of the stream that goes on from the checkpoint of the run before."""
    incoming, out, checkpoint = (fresh_path(spark, t) for t in ("events", "out", "ckpt"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
        stream = gate.token_gate_stream(spark.readStream.schema(SCHEMA).parquet(incoming), clock=clock)
        jobs.run_available(stream.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint,
                           {"once": True} if clock == "processing" else None)
    return out


def test_restarted_stream_gives_the_batch_rule(spark):
    rng = random.Random(5)
    rows = []
    for j in range(40):  # ready before, at and after checks and the deadline, more than once, or never
        start = rng.randrange(2000)
        rows += [(f"j{j}", at(start + rng.choice([0, 7])), "WAITING") for _ in range(rng.choice([1, 2]))]
        rows += [(f"j{j}", at(start + rng.choice([-5, 1, 30, 31, 600, 1169, 1170, 1171, 1200, 1500])), "ENCODING")
                 for _ in range(rng.choice([0, 1, 2]))]
    rows += [("never", at(100), "ENCODING"), (None, at(50), "WAITING")]
    rows.sort(key=lambda r: r[1])
    batches = [[r for r in rows if r[1] <= at(900)], [r for r in rows if r[1] > at(900)], [("end", at(10 ** 6), "NONE")]]
    for b in batches:
        rng.shuffle(b)
    out = run(spark, batches, "event")
    want = {r["job_id"]: (r["t0"], r["outcome"], r["checks"], r["decided_at"])
            for r in jobs.token_gate(spark.createDataFrame(rows, SCHEMA)).collect()}
    # equality joins leave a null job's readiness out of the batch rule; here it has none
    got = gate.decisions(spark, out).collect()
    assert {r["job_id"]: (r["t0"], r["outcome"], r["checks"], r["decided_at"]) for r in got} == want and len(got) == len(want)
    assert {o for _, o, _, _ in want.values()} == {"ENCODING", "FAILED"}
    assert all((r["message"] == MSG_TOKEN_TIMEOUT) == (r["outcome"] == "FAILED") for r in got)
    entered = spark.read.parquet(out).where("state = 'WAITING'")
    assert entered.count() == len(want) and entered.where("t0 <> decided_at").count() == 0


def test_processing_clock_and_rows_after_the_decision(spark):
    """Under the processing clock, past deadlines are over at once; later rows change nothing."""
    out = run(spark, [[("a", at(0), "WAITING")], [("x", at(1), "NONE")], [("a", at(60), "ENCODING"), ("a", at(9), "WAITING")],
                      [("x", at(2), "NONE")]], "processing")
    rows = spark.read.parquet(out).where("job_id = 'a'").collect()
    assert sorted(r["state"] for r in rows) == ["FAILED", "WAITING"]


def test_gated_jobs_fail_or_go_on(spark, sf_small):
    from tessera.plans.queries import q_encode_jobs_gated
    rows = q_encode_jobs_gated(spark, sf_small).collect()
    failed = [r for r in rows if r["message"] == MSG_TOKEN_TIMEOUT]
    assert 0 < len(failed) < len(rows)
    assert all((r["n_vectors"] == 0) == ("FAILED" in r["states"]) == (r in failed) for r in rows)
