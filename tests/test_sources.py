import pytest
from samples import HIGH, frame

from txnloom.config import Channel
from txnloom.sources import readers, writers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


PAYSIM = (
    "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,"
    "newbalanceDest,isFraud,isFlaggedFraud\n"
    "1,payment,9839.64,C1,170136.0,160296.36,M1,0,0,0,0\n"
    "2,,bad,,1,1,M2,0,0,1,\n"
)


def test_paysim_file(spark, tmp_path):
    path = write(tmp_path / "p.csv", PAYSIM)
    rows = readers.load_transactions(spark, " PaySim ", [path]).orderBy("step").collect()
    assert (rows[0]["type"], rows[0]["amount"], rows[0]["sender_id"]) == ("PAYMENT", 9839.64, "C1")
    assert rows[0]["source_dataset"] == "paysim" and rows[0]["event_time"].endswith("+00:00")
    assert (rows[1]["type"], rows[1]["amount"], rows[1]["sender_id"]) == ("TRANSFER", 0.0, "")
    assert (rows[1]["isFlaggedFraud"], rows[1]["isFraud"]) == (0, 1)
    assert rows[0]["event_id"] != rows[1]["event_id"]
    again = readers.load_paysim(spark, path).orderBy("step").collect()
    assert [r["event_id"] for r in again] == [r["event_id"] for r in rows]
    assert readers.load_paysim(spark, path).count() == 2


IEEE = (
    "isFraud,TransactionID,TransactionDT,TransactionAmt,ProductCD,card1,addr1,addr2,P_emaildomain\n"
    "0,10,86400,68.5,w,13926,315,87,\n"
    "1,11,86401,29,,,330,,gmail.com\n"
)


def test_ieee_files(spark, tmp_path):
    path = write(tmp_path / "t.csv", IEEE)
    alone = readers.load_ieee(spark, path, str(tmp_path / "missing.csv"))
    rows = {r["event_id"]: r for r in alone.collect()}
    first, second = rows["10"], rows["11"]
    assert (first["type"], first["sender_id"], first["receiver_id"]) == ("W", "13926", "87")
    assert (second["type"], second["sender_id"]) == ("IEEE", "330")
    assert second["receiver_id"] == "gmail.com" and second["isFraud"] == 1
    assert first["step"] == 86400 and first["oldbalanceOrg"] == 0.0
    identity = write(tmp_path / "i.csv", "TransactionID,id_01\n10,a\n10,b\n")
    joined = readers.load_transactions(spark, "ieee", [path, identity])
    assert sorted(r["event_id"] for r in joined.collect()) == ["10", "10", "11"]


def test_unknown_dataset(spark):
    with pytest.raises(ValueError):
        readers.load_transactions(spark, "other", ["x"])


def test_request_log(spark, tmp_path):
    lines = (
        '{"timestamp":"2024-01-01T00:00:01.5+00:00","method":"POST","path":"/predict",'
        '"status_code":200,"duration_ms":12.5}\n{"timestamp":"bad"}\n'
    )
    rows = readers.read_request_log(spark, write(tmp_path / "r.log", lines)).collect()
    assert rows[0]["status_code"] == 200 and rows[0]["timestamp"].second == 1
    assert rows[1]["timestamp"] is None


def test_kafka_channels_are_configuration(spark):
    source = Channel.kafka_source("host:9092", "transactions.raw")
    assert source.format == "kafka" and source.options["startingOffsets"] == "earliest"
    assert Channel.kafka_sink("host:9092", "t").options["topic"] == "t"


def test_sinks(spark, tmp_path):
    rows = frame(spark, [HIGH])
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    for _ in range(2):
        writers.append(rows, table, by=["source_dataset"])
        writers.append_log(rows, log)
        writers.write_batch(rows, f"{table}_batches", 7)
        writers.export_csv(rows, f"{log}_export")
    assert spark.read.parquet(table).count() == 2
    assert readers.read_csv(spark, log).count() == 2
    assert spark.read.parquet(f"{table}_batches").count() == 1
    assert readers.read_csv(spark, f"{log}_export").count() == 1


def test_require_rows(spark):
    with pytest.raises(ValueError, match="empty"):
        readers.require_rows(spark.range(0), "x")
