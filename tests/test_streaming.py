import random

from pyspark.sql import functions as F

from kbspark.streaming import jobs
from kbspark.streaming.deltas import Deltas


def test_intake_and_chunks(spark, tmp_path):
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    for i, rows in enumerate(([(1, "a b c"), (2, " a b c "), (3, "d e")], [(4, "d e"), (1, "new text here"), (3, "")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        queue = Deltas(spark, str(tmp_path / "queue"), jobs.STATUS, "doc_id")
        chunks, lineage = Deltas(spark, str(tmp_path / "chunks"), jobs.CHUNKS, "doc_id"), Deltas(spark, str(tmp_path / "lineage"), jobs.LINEAGE, "source_id")
        jobs.intake(jobs.watch(spark, str(tmp_path / "in"), schema), queue, str(tmp_path / "c1")).awaitTermination()
        jobs.refresh_chunks(jobs.watch(spark, str(tmp_path / "in"), schema), chunks, lineage, str(tmp_path / "c2"), 2, 0).awaitTermination()
        assert queue.read().count() == (2, 3)[i]
    left = chunks.read().collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, "here"), (1, "new text"), (2, "a b"), (2, "c"), (4, "d e")]  # 3 is empty now
    assert {(r["source_id"], r["chunk_id"]) for r in lineage.read().collect()} == {(str(r["doc_id"]), r["chunk_id"]) for r in left}
    out, counts = jobs.progress(queue.read(), queue.read().select("doc_id", F.lit(True).alias("ok")).limit(1))
    assert {r["status"]: r["n"] for r in counts.collect()} == {"pending": 0, "processing": 2, "processed": 1, "failed": 0, "all": 3}


def in_order(events):
    """State and history as of events taken one by one."""
    state, history = {}, []
    for seq, key, event, text in sorted(events):
        if event == "ADD" and (text or "").strip() or event == "UPDATE" and (text or "").strip() and key in state or event == "DELETE" and key in state:
            history.append((seq, key, state.get(key), None if event == "DELETE" else text, event, event == "DELETE"))
            state[key] = text
            if event == "DELETE":
                del state[key]
    return state, history


def test_memory_stream_equals_events_one_by_one(spark, tmp_path):
    schema = "seq long, memory_id long, event string, text string"
    r = random.Random(3)
    events = [(k, r.randrange(12), r.choice(["ADD", "UPDATE", "UPDATE", "DELETE", "NONE"]), r.choice(["a", "b", " ", None, f"t{k}"])) for k in range(120)]
    state, history = Deltas(spark, str(tmp_path / "s"), jobs.MEMORY, "memory_id", 4, 2), Deltas(spark, str(tmp_path / "h"), jobs.HISTORY, "seq", 4, 2)
    for at in range(0, 120, 30):
        spark.createDataFrame(events[at : at + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.memory_changes(jobs.watch(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), state, history, str(tmp_path / "c")).awaitTermination()
    want, log = in_order(events)
    assert {x["memory_id"]: x["memory"] for x in state.read().collect()} == want
    assert sorted(map(tuple, history.read().collect())) == log


def test_runs_are_merged_in_tiers(spark, tmp_path):
    """After many batches a read meets few runs, and a batch that is run again changes nothing."""
    r = random.Random(5)
    table, want = Deltas(spark, str(tmp_path / "t"), "k long, v string", "k", 3, 3), {}
    for n in range(20):
        rows = [(k, f"{n}-{j}") for k in r.sample(range(15), 3) for j in range(2)]
        gone = r.sample(range(15), 2)
        gone = [g for g in gone if g not in {k for k, _ in rows}]
        for again in range(1 + (n % 7 == 6)):
            table.write(spark.createDataFrame(rows, "k long, v string").coalesce(1), n, spark.createDataFrame([(g,) for g in gone], "k long"))
        for k in {k for k, _ in rows} | set(gone):
            want.pop(k, None)
        for k, v in rows:
            want.setdefault(k, []).append(v)
        if n % 5 == 4:
            got = {}
            for x in table.read().collect():
                got.setdefault(x["k"], []).append(x["v"])
            assert {k: sorted(v) for k, v in got.items()} == want
            assert len(table.runs()) <= 6
    some = table.read(keys=spark.createDataFrame([(1,), (2,), (99,)], "k long")).collect()
    assert sorted((x["k"], x["v"]) for x in some) == sorted((k, v) for k in (1, 2) for v in want.get(k, []))
    assert Deltas(spark, str(tmp_path / "none"), "k long, v string", "k").read().count() == 0


def test_last_k_state(spark, tmp_path):
    schema = "conv_id long, turn long, text string"
    spark.createDataFrame([(1, i, f"t{i}") for i in range(5)] + [(2, 0, "x")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.last_k(jobs.watch(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), 2)
    q = out.writeStream.format("memory").queryName("lastk").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["conv_id"]: r["texts"] for r in spark.sql("select * from lastk").collect()} == {1: ["t3", "t4"], 2: ["x"]}


def test_lots_of_several_files_arrive_in_order(spark, tmp_path):
    """History of events whose files are in no order, held to going through the events one by one."""
    from kbspark.plans import catalog_more, views

    r, kinds = random.Random(5), ["signup", "click", "view", "error", "purchase"]
    rows = [(k, r.randrange(6), r.choice(kinds)) for k in range(1, 400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    there, want = {}, set()
    for seq, user, kind in rows:
        if kind == "purchase" or (kind != "signup" and user not in there):
            continue
        event = {"signup": "ADD", "error": "DELETE"}.get(kind, "UPDATE")
        new = None if kind == "error" else kind
        want.add((seq, user, event, new, there.get(user)))
        if new:
            there[user] = new
        else:
            del there[user]
    got = catalog_more.r5_history(views.Tables(spark, str(tmp_path))).collect()
    assert {tuple(x) for x in got} == want


def test_rows_without_a_place_arrive(spark, tmp_path):
    from kbspark.plans import catalog_more, views

    spark.createDataFrame([(k if k % 5 else None, f"text {k}") for k in range(40)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog_more.r1_r2_intake(views.Tables(spark, str(tmp_path))).count() == 40
