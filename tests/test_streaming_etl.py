"""Streaming ingest and the batch ETL run."""
import json
import os

from spendlens.plans.etl import run_etl
from spendlens.sources.sinks import read_fact
from spendlens.streaming import ingest_stream

HDR = ["年月", "地區", "信用卡產業別", "年齡層", "信用卡交易筆數", "信用卡交易金額[新臺幣]"]


def _csv(path, rows):
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write(",".join(HDR) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_stream_ingest_incremental_and_idempotent(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    os.makedirs(src)
    table, ckpt = os.path.join(tmpdir_fresh, "t"), os.path.join(tmpdir_fresh, "ck")
    _csv(os.path.join(src, "a.csv"), [("202401", "TW", "food", "未滿20歲", '"1,000"', "5"),
                                      ("202401", "TW", "food", "未滿20歲", '"1,000"', "5")])
    _csv(os.path.join(src, "b.csv"), [("202402", "TW", "toys", "NA", "n/a", "7")])
    ingest_stream(spark, src, table, ckpt, max_files_per_trigger=1).awaitTermination()
    got = sorted(tuple(r) for r in read_fact(spark, table).collect())
    assert got == [("202401", "TW", "food", "未滿20歲", 1000, 5), ("202402", "TW", "toys", None, None, 7)]
    # a new file with one known and one new row: only the new row is added
    _csv(os.path.join(src, "c.csv"), [("202401", "TW", "food", "未滿20歲", "1000", "5"),
                                      ("202403", "TW", "food", "未滿20歲", "2", "3")])
    ingest_stream(spark, src, table, ckpt).awaitTermination()
    assert read_fact(spark, table).count() == 3


def test_run_etl_json_twice(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "x.json")
    recs = [dict(zip(HDR, ["202401", "TW", "food", "未滿20歲", "1,000", "5"])),
            dict(zip(HDR, ["202401", "TW", None, "未滿20歲", "3000", None])),
            dict(zip(HDR, ["202402", "TW", "food", "未滿20歲", "n/a", "7"]))]
    with open(p, "w", encoding="utf-8") as f:
        json.dump({"records": recs}, f, ensure_ascii=False)
    table = os.path.join(tmpdir_fresh, "t")
    r1 = run_etl(spark, "json", p, table)
    assert r1.appended == 3
    assert r1.report.fill_values == {"trans_count": 2000.0, "trans_total": 6.0, "industry": "food"}
    assert run_etl(spark, "json", p, table).appended == 0
    got = sorted(tuple(r) for r in read_fact(spark, table).collect())
    assert got == [("202401", "TW", "food", "未滿20歲", 1000, 5), ("202401", "TW", "food", "未滿20歲", 3000, 6),
                   ("202402", "TW", "food", "未滿20歲", 2000, 7)]


def test_catching_up_reads_the_table_as_often_as_it_doubles(spark, tmpdir_fresh, monkeypatch):
    from spendlens.streaming import ingest
    src, table, ckpt = (os.path.join(tmpdir_fresh, k) for k in ("src", "t", "ck"))
    os.makedirs(src)
    for k in range(8):
        _csv(os.path.join(src, f"{k}.csv"), [("202401", "TW", "food", "a", str(k), "5"), ("202401", "TW", "food", "a", "77", "5")])
    appends = []
    monkeypatch.setattr(ingest, "append_new_rows", lambda s, df, path, f=ingest.append_new_rows: appends.append(f(s, df, path)))
    ingest_stream(spark, src, table, ckpt, max_files_per_trigger=1).awaitTermination()
    assert len(appends) <= 5 and sum(appends) == 9
    assert sorted(r["trans_count"] for r in read_fact(spark, table).collect()) == [*range(8), 77]
    assert not os.path.exists(f"{ckpt}-staged")
    # Rows left staged by a run that nobody waited for are appended by the next.
    spark.createDataFrame([("202402", "TW", "toys", "a", 1, 2)], read_fact(spark, table).schema).write.parquet(f"{ckpt}-staged/batch=99")
    ingest_stream(spark, src, table, ckpt).awaitTermination()
    assert read_fact(spark, table).count() == 10
