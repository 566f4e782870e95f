import json
import random

import pytest
from pyspark.sql import functions as F
from samples import HIGH, LOW, message

from txnloom.config import Channel, Lake
from txnloom.operators import lake as lake_ops
from txnloom.operators import medallion, scoring, training
from txnloom.plans.fixtures import transactions
from txnloom.sources import writers
from txnloom.streaming import pipelines


def send(spark, channel, *texts):
    """Deliver messages as one new file."""
    rows = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, value string")
    rows.coalesce(1).write.mode("append").parquet(channel.path)


@pytest.fixture
def lake(tmp_path):
    return Lake(str(tmp_path / "lake"))


@pytest.fixture
def channel(tmp_path):
    return Channel("parquet", path=str(tmp_path / "raw"))


def at(minute, **changes):
    return message(event_time=f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00", **changes)


def test_raw_to_lake_restarts_without_duplicates(spark, lake, channel):
    send(spark, channel, message(event_id="1"), message(event_id="2", type="PAYMENT"), "{broken",
         "{}", '{"foo":1}')
    pipelines.run_raw_to_lake(spark, channel, lake, once=True)
    pipelines.run_raw_to_lake(spark, channel, lake, once=True)
    send(spark, channel, message(event_id="3"), message(event_id="4", amount="1"))
    pipelines.run_raw_to_lake(spark, channel, lake, once=True)

    bronze = lake_ops.resolve_table(spark, lake, "bronze")[1]
    assert sorted(r["event_id"] for r in bronze.collect()) == ["1", "2", "3", "4"]
    assert spark.read.parquet(lake.table("silver")).count() == 4
    diverted = spark.read.parquet(f"{lake.root}/bronze/unreadable").collect()
    assert sorted(r["raw_event"] for r in diverted) == sorted(["{broken", "{}", '{"foo":1}'])

    gold = spark.read.parquet(lake.table("gold"))
    row = gold.filter("summary_level = 'source_dataset_type' AND type = 'TRANSFER'").collect()
    # One row after two batches; the event whose amount could not be read counts, but not in the average.
    assert [(r["transaction_count"], r["amount_count"], r["average_amount"]) for r in row] == [(3, 2, HIGH["amount"])]
    window = gold.filter("summary_level = 'window_type' AND type = 'TRANSFER'").collect()
    assert [(r["transaction_count"], r["average_amount"]) for r in window] == [(3, 0.0)]
    merged = medallion.merge_gold(gold).filter("summary_level = 'source_dataset_type' AND type = 'TRANSFER'").first()
    assert (merged["transaction_count"], merged["average_amount"]) == (3, HIGH["amount"])


def test_runs_report_their_rows(spark, lake, channel):
    for n in range(3):
        send(spark, channel, message(event_id=f"a{n}"), message(event_id=f"b{n}", type="PAYMENT"), "{broken")
    one_file_a_batch = channel.with_rate(1)
    first = pipelines.run_raw_to_lake(spark, one_file_a_batch, lake, once=True)
    assert len(first.layers["bronze"].metrics) == 3
    # Silver reads what bronze has by then as one batch, and gold merges four summaries.
    assert first.rows == {"bronze": 6, "unreadable": 3, "silver": 6, "gold": 4}
    again = pipelines.run_raw_to_lake(spark, one_file_a_batch, lake, once=True)
    assert again.rows == {"bronze": 0, "unreadable": 0, "silver": 0, "gold": 0}
    send(spark, channel, message(event_id="c"))
    assert pipelines.run_raw_to_lake(spark, channel, lake, once=True).rows == {
        "bronze": 1, "unreadable": 0, "silver": 1, "gold": 2,
    }


def test_the_channel_is_decoded_once(spark, lake, channel, monkeypatch):
    decoded, whole = [], medallion.decode
    monkeypatch.setattr(medallion, "decode", lambda m, *rest: decoded.append(m.isStreaming) or whole(m, *rest))
    send(spark, channel, message(event_id="1"))
    run = pipelines.run_raw_to_lake(spark, channel, lake, once=True)
    assert decoded.count(True) == 1
    sources = {n: layer.query.recentProgress[0].sources[0].description for n, layer in run.layers.items()}
    assert channel.path in sources["bronze"]
    assert lake.table("bronze") in sources["silver"] and lake.table("bronze") in sources["unreadable"]
    assert lake.table("silver") in sources["gold"]


def silver_of(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    return medallion.silver(medallion.readable(medallion.decode(rows)))


def test_repeated_batch_replaces_itself(spark, lake):
    batch = silver_of(spark, json.dumps(HIGH))
    write = pipelines.gold_batch_writer(lake)
    for batch_id in (0, 0, 1, 1, 0):
        write(batch, batch_id)
    gold = spark.read.parquet(lake.table("gold"))
    assert sorted(r["transaction_count"] for r in gold.collect()) == [2, 2]
    write(batch.limit(0), 2)
    assert gold.count() == 2


def test_a_batch_cut_short_is_finished(spark, lake):
    """A job lost between two partitions has merged one of them; the replay merges the other."""
    write = pipelines.gold_batch_writer(lake)
    write(silver_of(spark, json.dumps(HIGH)), 0)
    late = HIGH | {"event_time": "2026-02-05T00:00:00"}
    fresh = medallion.gold_period(medallion.gold(silver_of(spark, json.dumps(HIGH), json.dumps(late))))

    def merge(rows):
        writers.merge_batch(rows, lake.table("gold"), 1, pipelines.GOLD_KEYS, medallion.combine_gold, "period")

    merge(fresh.filter("period = 'all'"))
    merge(fresh)
    gold = spark.read.parquet(lake.table("gold"))
    counts = {(r["period"], r["transaction_count"]) for r in gold.collect()}
    first_day = {r["period"] for r in gold.collect()} - {"all", "d20260205"}
    assert counts == {("all", 3), (first_day.pop(), 2), ("d20260205", 1)}


def test_a_new_checkpoint_loses_no_batch(spark, lake, channel):
    send(spark, channel, message(event_id="1"))
    pipelines.run_raw_to_lake(spark, channel, lake, once=True)
    send(spark, channel, message(event_id="2"), message(event_id="3"))
    pipelines.start_bronze(spark, channel, lake, once=True).finish()
    pipelines.start_silver(spark, lake, once=True).finish()
    # Another query starts its batches at 0 again and reads the whole silver table.
    rows = pipelines._silver_table(spark, lake)
    other = pipelines._start_batches(rows, pipelines.gold_batch_writer(lake), f"{lake.root}/second", once=True)
    other.awaitTermination()
    gold = spark.read.parquet(lake.table("gold"))
    counts = gold.filter("summary_level = 'source_dataset_type'").collect()
    assert [r["transaction_count"] for r in counts] == [4] and len(counts[0]["batches"]) == 2


def test_empty_batches_leave_no_folder(spark, tmp_path, counted_reads):
    path, rows = f"{tmp_path}/log", spark.range(3)
    counted, reads = counted_reads(rows)
    writers.write_batch(counted, path, 0)
    assert reads() == 3
    writers.write_batch(rows.limit(0), path, 1)
    writers.write_batch(rows.filter("id > 1"), path, 0)
    stored = spark.read.parquet(path)
    assert [(r["id"], r["batch_id"]) for r in stored.collect()] == [(2, 0)]
    writers.compact_batches(spark, path, f"{tmp_path}/compact")
    assert spark.read.parquet(f"{tmp_path}/compact").count() == 1


def test_repeated_messages_arrive_once(spark, lake, channel):
    def run():
        return pipelines.run_raw_to_lake(spark, channel, lake, once=True, unique_within="1 hour")

    no_id = json.dumps({k: v for k, v in HIGH.items() if k != "event_id"})
    send(spark, channel, message(event_id="1"), message(event_id="1"), message(event_id="2"), no_id)
    send(spark, channel, message(event_id="2"), no_id)
    first = run()
    assert (first.rows["bronze"], first.rows["silver"]) == (6, 3)
    # The job starts again; what it has sent on it still knows.
    send(spark, channel, message(event_id="2"), message(event_id="3"), no_id, message(event_id="1"))
    second = run()
    assert (second.rows["silver"], second.layers["silver"].repeated(), second.layers["silver"].late()) == (1, 3, 0)
    events = [r["event_id"] for r in spark.read.parquet(lake.table("silver")).collect()]
    assert sorted(events, key=str) == ["1", "2", "3", None]


def test_types_the_model_has_not_seen(spark, lake, channel, tmp_path, sf_dir):
    known = transactions(spark, sf_dir).drop("fraud_probability").filter("type <> 'DEBIT'")
    model = training.train_forest(known, numTrees=2, maxDepth=3)
    rows = transactions(spark, sf_dir).drop("fraud_probability")
    assert "DEBIT" not in {r["type"] for r in scoring.score(rows, model).collect()}
    with pytest.raises(Exception, match="DEBIT"):
        scoring.score(rows, model, mode="fail").collect()
    sinks = [Channel("parquet", path=str(tmp_path / name)) for name in ("scored", "errors")]
    send(spark, channel, message(event_id="1"), message(event_id="2", type="DEBIT"))
    pipelines.start_scoring(spark, channel, model, *sinks, lake, once=True).awaitTermination()
    send(spark, channel, message(event_id="3"))
    pipelines.start_scoring(spark, channel, model, *sinks, lake, once=True).awaitTermination()
    scored = spark.read.parquet(f"{lake.root}/logs/scored").collect()
    assert {r["event_id"] for r in scored} == {"1", "3"}
    letters = spark.read.parquet(f"{lake.root}/logs/dead_letters").collect()
    assert [r["event_id"] for r in letters] == ["2"]


def windows(spark, channel, lake, rate=None):
    source = channel.with_rate(rate) if rate else channel
    pipelines.start_bronze(spark, source, lake, once=True).finish()
    pipelines.start_silver(spark, lake, once=True).finish()
    layer = pipelines.start_windows(spark, lake, once=True)
    layer.finish()
    return layer


def test_windows_close_after_the_watermark_and_drop_late_rows(spark, lake, channel):
    send(spark, channel, at(1, event_id="a"), at(5, event_id="b"), at(200, event_id="c"))
    assert windows(spark, channel, lake).late() == 0
    send(spark, channel, at(2, event_id="late"), at(190, event_id="in time"), at(400, event_id="d"))
    assert windows(spark, channel, lake).late() == 1
    rows = spark.read.parquet(f"{lake.root}/gold/window_measures").orderBy("window_start").collect()
    got = [(r["window_start"].hour * 60 + r["window_start"].minute, r["transaction_count"]) for r in rows]
    assert got == [(0, 2), (190, 1), (200, 1)]


def test_every_row_read_is_kept_or_accounted_for(spark, lake, channel):
    """Files in a shuffled order, one delivery each; a row is late by the largest time before it."""
    draw = random.Random(4)
    minutes = [draw.randrange(0, 1300) for _ in range(60)]
    read = kept = late = repeated = untimed = 0
    highest, emitted, known = None, 0, set()
    expected = {"kept": 0, "late": 0, "repeated": 0, "untimed": 0}
    for n in range(6):
        part = [(f"e{i}", minutes[i]) for i in range(60) if i % 6 == n]
        texts = [at(m, event_id=e) for e, m in part] + [message(event_id=f"x{n}", event_time="soon")]
        texts += [at(m, event_id=e) for e, m in part[:2]]
        send(spark, channel, *texts)
        layer = windows(spark, channel, lake)
        read += layer.total("read.rows")
        kept += layer.total("kept.rows")
        late, repeated, untimed = late + layer.late(), repeated + layer.repeated(), untimed + layer.total("read.untimed")
        for e, m in [*part, *part[:2]]:
            if highest is not None and m <= highest - 60:
                expected["late"] += 1
            elif e in known:
                expected["repeated"] += 1
            else:
                known.add(e)
                expected["kept"] += 1
        expected["untimed"] += 1
        highest = max([highest or 0, *(m for _, m in part)])
    assert {"kept": kept, "late": late, "repeated": repeated, "untimed": untimed} == expected
    assert late > 0 and read == 6 * 13 == kept + late + repeated + untimed
    # Once a far later event closes every window, the table holds the rows kept.
    send(spark, channel, message(event_id="end", event_time="2026-03-01T00:00:00"))
    windows(spark, channel, lake)
    send(spark, channel, message(event_id="end2", event_time="2026-03-01T00:00:00"))
    windows(spark, channel, lake)
    emitted = spark.read.parquet(f"{lake.root}/gold/window_measures").agg(F.sum("transaction_count")).first()[0]
    assert emitted == kept


def test_gold_equals_its_two_parts(spark):
    events = [HIGH, LOW, HIGH | {"event_time": None}, LOW | {"type": None, "amount": None}]
    rows = spark.createDataFrame([(json.dumps(e),) for e in events], "value string")
    silver = medallion.silver(medallion.decode(rows))
    names = ["summary_level", "source_dataset", "type", "transaction_count", "average_amount",
             "amount_count", "high_amount_count", "zero_balance_count"]

    def key(row):
        return [(v is None, str(v)) for v in row]

    both = medallion.gold_by_type(silver).select(*names).unionByName(
        medallion.gold_by_window(silver).select(*names)
    )
    fused = sorted(map(tuple, medallion.gold(silver).select(*names).collect()), key=key)
    assert fused == sorted(map(tuple, both.collect()), key=key)
    assert {r[0] for r in fused} == {"source_dataset_type", "source_dataset", "window_type", "window"}


@pytest.fixture(scope="module")
def small_model(spark, sf_dir):
    rows = transactions(spark, sf_dir).drop("fraud_probability")
    return training.train_forest(rows, numTrees=5, maxDepth=4)


def test_scoring_stream_isolates_bad_records(spark, lake, channel, tmp_path, small_model):
    scored_sink = Channel("parquet", path=str(tmp_path / "scored"))
    errors_sink = Channel("parquet", path=str(tmp_path / "errors"))

    def run():
        pipelines.start_scoring(
            spark, channel, small_model, scored_sink, errors_sink, lake, once=True
        ).awaitTermination()

    send(spark, channel, message(event_id="1", type="transfer"), "{broken",
         message(event_id="2", amount=-1), message(event_id="3", type="X"))
    run()
    send(spark, channel, message(event_id="4", type="PAYMENT"))
    run()
    run()

    log = {r["event_id"]: r for r in spark.read.parquet(f"{lake.root}/logs/scored").collect()}
    assert set(log) == {"1", "4"}
    assert log["1"]["type"] == "TRANSFER" and log["1"]["rule_risk_score"] == 95
    assert log["1"]["final_decision"] == "BLOCK / MANUAL REVIEW"
    letters = spark.read.parquet(f"{lake.root}/logs/dead_letters")
    assert {r["event_id"]: r["error_message"].split()[0] for r in letters.collect()} == {
        None: "event", "2": "amount", "3": "Invalid",
    }
    audit = spark.read.parquet(f"{lake.root}/logs/audit")
    explanation = json.loads(audit.filter("event_id = '1'").first()["explanation"])
    assert len(explanation) == 5 and set(explanation[0]) == {
        "feature", "feature_value", "impact_score",
    }
    errors = spark.read.parquet(errors_sink.path).collect()
    assert {r["key"] for r in errors} == {"unknown", "2", "3"}
    assert all(json.loads(r["value"])["event"] for r in errors)

    pipelines.start_scored_to_gold(spark, scored_sink, lake, once=True).awaitTermination()
    decisions = spark.read.parquet(lake.table("scored_gold"))
    assert {r["event_id"] for r in decisions.collect()} == {"1", "4"}
    assert decisions.filter("size(triggered_rules) > 0 AND fraud_probability IS NOT NULL").count() >= 1


def test_lake_summary_without_tables(spark, lake):
    row = lake_ops.lake_summary(spark, lake).first()
    assert row["available"] is False
    assert (row["bronze_count"], row["silver_count"], row["gold_count"]) == (0, 0, 0)


def test_lake_summary_finds_the_second_location(spark, lake):
    spark.range(3).write.parquet(lake.candidates("bronze")[1])
    row = lake_ops.lake_summary(spark, lake).first()
    assert row["available"] is True and row["bronze_count"] == 3
    assert lake_ops.resolve_table(spark, lake, "bronze")[0].endswith("raw_transactions")
    assert lake_ops.resolve_table(spark, lake, "silver")[1] is None


def test_layer_status_and_its_forms(spark, lake):
    stamp = "TIMESTAMP '2026-01-02 03:04:05'"
    spark.range(5).selectExpr("id", f"{stamp} AS ingestion_timestamp").write.parquet(lake.table("silver"))
    status = {r["layer"]: r for r in lake_ops.layer_status(spark, lake).collect()}
    assert list(status) == ["bronze", "silver", "gold", "scored_gold"]
    assert (status["silver"]["row_count"], status["silver"]["table_exists"]) == (5, True)
    assert str(status["silver"]["latest_ingestion"]) == "2026-01-02 03:04:05"
    assert (status["gold"]["row_count"], status["gold"]["table_exists"], status["gold"]["latest_ingestion"]) == (0, False, None)
    assert status["bronze"]["path"] == lake.candidates("bronze")[0]
    summary = lake_ops.lake_summary(spark, lake)
    document = json.loads(lake_ops.as_json(summary).first()["document"])
    assert document["silver_count"] == 5 and document["available"] is True
    assert document["latest_ingestion"].startswith("2026-01-02T03:04:05")
    lines = [r["line"] for r in lake_ops.as_text(summary).orderBy("position").collect()]
    assert lines[0] == "tables found" and "silver: 5 rows" in lines and len(lines) == 6
    nothing = lake_ops.lake_summary(spark, Lake(f"{lake.root}/other"))
    assert json.loads(lake_ops.as_json(nothing).first()["document"])["latest_ingestion"] is None
    assert lake_ops.as_text(nothing).orderBy("position").first()["line"] == "no tables found"


def test_table_profile(spark):
    got = lake_ops.table_profile(spark.range(4).withColumn("x", F.lit("a"))).collect()
    assert [tuple(r) for r in got] == [(0, "id", "bigint", 4), (1, "x", "string", 4)]
    assert lake_ops.preview(spark.range(40)).count() == 10


def test_scoring_takes_a_large_channel_in_parts(spark, lake, channel, tmp_path, small_model, monkeypatch):
    """What waits in the channel is scored whole, a bounded part at a time."""
    monkeypatch.setattr(pipelines, "BYTES_A_CORE", 1)
    monkeypatch.setattr(writers, "ROWS_A_FILE", 5)
    texts = [(f"k{i}", message(event_id=str(i), type="PAYMENT")) for i in range(20)]
    writers.publish(spark.createDataFrame(texts, "key string, value string").coalesce(1), channel)
    assert len(list((tmp_path / "raw").glob("*.parquet"))) == 4
    sinks = [Channel("parquet", path=str(tmp_path / name)) for name in ("scored", "errors")]
    pipelines.start_scoring(spark, channel, small_model, *sinks, lake, once=True).awaitTermination()
    log = spark.read.parquet(f"{lake.root}/logs/scored")
    assert sorted(int(r["event_id"]) for r in log.collect()) == list(range(20))
    assert log.select("batch_id").distinct().count() == 4


def test_a_rate_of_its_own_stays(channel):
    assert channel.with_rate(3).bounded(10, 100).options == {"maxFilesPerTrigger": "3"}
    assert channel.bounded(10, 100).options == {"maxBytesPerTrigger": "100"}
    assert Channel.kafka_source("b", "t").bounded(10, 100).options["maxOffsetsPerTrigger"] == "10"
