"""Extract readers (CSV / JSON layouts), source dispatch and the sink."""
import json
import os

import pytest

from spendlens.config import local_path
from spendlens.sources.extracts import ingest, read_csv_extract, read_json_extract
from spendlens.sources.sinks import append_new_rows, read_fact

HDR = ["年月", "地區", "信用卡產業別", "年齡層", "信用卡交易筆數", "信用卡交易金額[新臺幣]"]


def test_csv_bom_headers_and_na_tokens(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "a.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write(",".join(HDR) + "\n")
        f.write('202401,TW,food,未滿20歲,"1,234",NA\n')
        f.write("202402, ,NULL,n/a,,Na\n")
    df = read_csv_extract(spark, p)
    assert df.columns == HDR
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("202401", "TW", "food", "未滿20歲", "1,234", None),
                    ("202402", None, None, None, None, None)]


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


RECS = [{"a": 1, "b": "x"}, {"a": 2.5, "b": None}]


@pytest.mark.parametrize("layout,text", [
    ("array", json.dumps(RECS)),
    ("wrapped", json.dumps({"meta": {"n": 2}, "rows": RECS})),
    ("keyed", json.dumps({"r1": RECS[0], "r2": RECS[1]})),
    ("lines", "\n".join(json.dumps(r) for r in RECS) + "\n"),
])
def test_json_layouts_explicit_and_auto(spark, tmpdir_fresh, layout, text):
    p = _write(tmpdir_fresh, f"{layout}.json", text)
    for lay in (layout, "auto"):
        df = read_json_extract(spark, p, layout=lay)
        got = sorted((r["a"], r["b"]) for r in df.collect())
        assert got == [("1", "x"), ("2.5", None)], lay


def test_wrapped_empty_list(spark, tmpdir_fresh):
    p = _write(tmpdir_fresh, "e.json", json.dumps({"rows": []}))
    assert read_json_extract(spark, p, layout="wrapped", records_key="rows").count() == 0


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        ingest(spark, "xml", "/nowhere")


def test_append_is_idempotent_and_keeps_month_text(spark, make_fact, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "fact")
    a = make_fact([("202401", "n", "a", "x", 1, 2), ("202401", "n", "a", "x", 1, 2),
                   ("202402", "n", "b", "y", 3, 4)])
    assert append_new_rows(spark, a, path) == 2
    assert append_new_rows(spark, a, path) == 0
    b = make_fact([("202402", "n", "b", "y", 3, 4), ("202403", "n", "c", "z", 5, 6)])
    assert append_new_rows(spark, b, path) == 1
    got = read_fact(spark, path)
    assert dict(got.dtypes)["ym"] == "string"
    assert got.count() == 3
    assert append_new_rows(spark, a.limit(0), path) == 0
    assert os.path.isdir(local_path(path))


def test_malformed_json_lines_fail(spark, tmpdir_fresh):
    p = _write(tmpdir_fresh, "bad.json", '{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        read_json_extract(spark, p, layout="lines").collect()


def test_detect_layout_single_line_document(spark, tmpdir_fresh):
    from spendlens.sources.extracts import detect_json_layout
    p = _write(tmpdir_fresh, "one.json", json.dumps({"r1": {"a": 1}, "r2": {"a": 2}}))
    assert detect_json_layout(spark, p) == "object"
    p = _write(tmpdir_fresh, "pretty.json", json.dumps({"rows": RECS}, indent=2))
    assert detect_json_layout(spark, p) == "object"
    p = _write(tmpdir_fresh, "bom.json", "﻿" + json.dumps(RECS))
    assert detect_json_layout(spark, p) == "array"


def _documents():
    """Large documents by layout, with what must not cut them: quotes, braces and separators in strings."""
    recs = [{"a": str(k), "b": 'q"\\' if k % 3 else "x, [y]", "c": None if k % 5 else "é"} for k in range(200)]
    flat = [{**r, "n": str(k)} if k % 7 == 0 else r for k, r in enumerate(recs)]
    braces = [{**r, "b": "}{"} if k == 50 else r for k, r in enumerate(recs)]
    dump = lambda x, **kw: json.dumps(x, ensure_ascii=False, **kw)
    keyed = {f'k{{"{k}': r for k, r in enumerate(flat)}
    return {
        "array": [(dump(flat), flat), (dump(flat, indent=2) + "\n", flat), ("﻿" + dump(flat), flat), (dump(braces), braces)],
        "wrapped": [(dump({"note": "a [b] {", "n": 1, "rows": flat, "z": 2}), flat), (dump({"rows": flat}, indent=1) + "\n", flat), (dump({"rows": braces}), braces)],
        "keyed": [(dump(keyed), flat), (dump(keyed, indent=1) + "\n\n", flat), (dump({"k": braces[50], "l": braces[0]}), [braces[50], braces[0]])],
    }


@pytest.mark.parametrize("layout", ["array", "wrapped", "keyed"])
def test_large_documents_are_cut_into_records(spark, tmp_path, layout):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    for k, (text, records) in enumerate(_documents()[layout]):
        p = tmp_path / f"{layout}{k}.json"
        p.write_text(text, encoding="utf-8")
        for kind in (layout, "auto"):
            df = read_json_extract(session, str(p), layout=kind, split_over=1000)
            names = sorted({n for r in records for n in r})
            assert sorted(df.columns) == names
            got = [tuple(r[n] for n in names) for r in df.collect()]
            order = lambda t: tuple(x or "" for x in t)
            assert sorted(got, key=order) == sorted((tuple(r.get(n) for n in names) for r in records), key=order)
        if "}{" not in text:  # such a document is parsed whole
            assert df.rdd.getNumPartitions() > 3


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}', '[{"a": 1} {"a": 2}]', '{"k": {"a": 1}\n', '{"k": {"a": 1}}, "l": {"a": 2}}'])
def test_broken_large_documents_fail_like_small_ones(spark, tmp_path, text):
    p = tmp_path / "x.json"
    p.write_text(text)
    layout = "array" if text[0] == "[" else "keyed"
    outcomes = []
    for over in (1 << 30, 0):
        try:
            outcomes.append(sorted(map(tuple, read_json_extract(spark, str(p), layout=layout, split_over=over).collect())))
        except Exception:  # noqa: BLE001
            outcomes.append("error")
    assert outcomes[0] == outcomes[1]


def test_split_and_small_documents_of_one_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": str(k)} for k in range(100)]))
    (tmp_path / "b.json").write_text(json.dumps([{"a": "x", "b": "y"}]))
    df = read_json_extract(spark, str(tmp_path), layout="array", split_over=200)
    assert df.count() == 101 and df.where("b = 'y'").count() == 1


def test_files_of_one_header(spark, tmp_path):
    """The header is the first line that is not blank; a file without one has no rows."""
    from spendlens.sources import extracts

    body = "".join(f"{k},{k}\n" for k in range(400_000))
    (tmp_path / "a.csv").write_text("x,y\n" + body)
    (tmp_path / "b.csv").write_text("\n  \ny,x\n" + body)
    (tmp_path / "c.csv").write_text("\n\n")
    groups = extracts._files_by_header(spark, str(tmp_path), "UTF-8")
    assert [[f.rsplit("/", 1)[1] for f in g] for g in groups] == [["a.csv"], ["b.csv"]]


def test_documents_are_compressed_files_of_one_folder(spark, tmpdir_fresh, monkeypatch):
    import os

    from pyspark.sql import functions as F
    from spendlens.plans import etl
    from spendlens.sources.extracts import ingest
    monkeypatch.setattr(etl, "ROWS_PER_DOC", 100)
    rows = spark.range(1000).select(*[F.col("id").alias(c) for c in etl.LINE_KEY], F.col("id").cast("string").alias("h"))
    for layout in ("array", "wrapped", "keyed"):
        path = etl.write_extract(rows, layout, os.path.join(tmpdir_fresh, layout), ["h"])
        files = [f for f in os.listdir(path) if not f.startswith((".", "_"))]
        assert len(files) == 10 and all(f.endswith(".gz") for f in files)
        for df in (etl.read_extract(spark, layout, path), ingest(spark, "json", path)):
            assert df.columns == ["h"] and sorted(int(r.h) for r in df.collect()) == [*range(1000)]


def _keyed_folder(tmp_path):
    docs = [{"r1": {"a": 1, "b": None}, "r2": {"b": "x", "z": [1, {"q": 2}]}}, {"r1": {"a": "}{", "c": True}}, {"s": {}}, {"t": {"späte": 1.5, "z": None}}]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=k % 2 or None), encoding="utf-8")
    (tmp_path / "4.json").write_text('{"u": {"a": 1, "a": 2, "n": 3, "n": 4}}\n')
    (tmp_path / "5.json").write_text(" \n\n")
    return str(tmp_path)


def test_keyed_documents_are_parsed_once_to_tell_and_read_them(spark, tmp_path, monkeypatch):
    from spendlens.sources import extracts

    path = _keyed_folder(tmp_path)
    whole = read_json_extract(spark, path, layout="keyed")
    monkeypatch.setattr(extracts, "_records_from_keyed", lambda *a: pytest.fail("documents are parsed again"))
    for opened_whole in (extracts.WHOLE_UP_TO, 0):
        monkeypatch.setattr(extracts, "WHOLE_UP_TO", opened_whole)
        told = read_json_extract(spark, path)
        assert told.columns == whole.columns == ["a", "b", "c", "n", "späte", "z"]
        assert sorted(map(repr, told.collect())) == sorted(map(repr, whole.collect()))


def test_keyed_documents_of_no_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"r": {}, "s": {}}')
    assert read_json_extract(spark, str(tmp_path)).columns == []


def test_objects_that_only_begin_like_records_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"r": {"a": 1}, "s": "{text"}')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_json_extract(spark, str(tmp_path)).collect()


ODD_FILES = {
    "array": ["[]", "\ufeff [1]", "\n \t\r\n[\n{}]"],
    "lines": ['{"a": 1}\n{"a": 2}', '{"a": 1} ' + " " * 100 + '\r\n \r\n\ufeff {"a": 2}', '\ufeff{"a": 1}\r{"a": 2}\r'],
    "record": ['{"a": 1}', '{"a": 1}\n\n', '{\n"a": 1\n}', '{"a": 1}\n[]', '{"r": {"a": 1}, "s": null}', "{}", "x"],
    "wrapped": ['{"n": 1, "r": [{"a": 1}]}', '\ufeff{"r": []}\n'],
    "keyed": ['{"r": {"a": 1}}', '\n{"r": {\n"a": 1}}  \n', '\ufeff{"r": {}}'],
    None: ["", " \n\t\r\n", "\ufeff\n"],
}


def test_layouts_of_small_and_large_files(spark, tmp_path, monkeypatch):
    """Small files are told apart many in a task, whatever their number; large ones by
    their first lines, with the same outcome."""
    from spendlens.sources import extracts

    expected = {}
    for kind, texts in ODD_FILES.items():
        for k, text in enumerate(texts * 4):
            (tmp_path / f"{kind}{k:02d}.json").write_bytes(text.encode())
            if kind:
                expected.setdefault(kind, []).append(f"{kind}{k:02d}.json")
    def layouts():
        return {k: [os.path.basename(f) for f in v] for k, v in extracts.detect_json_layouts(spark, str(tmp_path)).items()}
    group, tracker = "layouts-of-small-files", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert layouts() == expected
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < sum(map(len, expected.values())) / 2
    monkeypatch.setattr(extracts, "WHOLE_UP_TO", 0)
    assert layouts() == expected


def test_documents_hold_the_records_texts(spark, tmpdir_fresh, monkeypatch):
    """Documents put together from records' texts: fields without a value left out, ids
    and the number of records as they are, every value escaped."""
    import gzip

    from pyspark.sql import functions as F
    from spendlens.plans import etl
    monkeypatch.setattr(etl, "ROWS_PER_DOC", 4)
    value = F.when(F.col("id") % 3 == 0, F.lit('q"\\,}],{"é\n')).when(F.col("id") % 3 == 1, F.lit(""))
    rows = spark.range(12).select(*[F.col("id").alias(c) for c in etl.LINE_KEY], F.col("id").cast("string").alias("h"), value.alias("a b"))
    expected = [{"h": str(k)} if k % 3 == 2 else {"h": str(k), "a b": "" if k % 3 else 'q"\\,}],{"é\n'} for k in range(12)]
    for layout in ("array", "wrapped", "keyed"):
        path, found = etl.write_extract(rows, layout, os.path.join(tmpdir_fresh, layout), ["h", "a b"]), []
        for name in sorted(f for f in os.listdir(path) if not f.startswith((".", "_"))):
            doc = json.loads(gzip.open(os.path.join(path, name)).read())
            if layout == "wrapped":
                assert list(doc) == ["meta", "records"] and doc["meta"] == {"rows": len(doc["records"])}
                doc = doc["records"]
            elif layout == "keyed":
                block = next(iter(doc)).partition("-")[0]
                assert list(doc) == [f"{block}-{k + 1}" for k in range(len(doc))]
                doc = list(doc.values())
            found += doc
        assert sorted(found, key=lambda r: int(r["h"])) == expected
