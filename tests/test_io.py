import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.sources import files, workbooks, writers
from sluice.sources.errors import Action, JsonLinesSink, Metrics
from sluice.sources.rfc4180 import Dialect, QuoteMode, records
from sluice.sources.yaml_source import YamlOptions, yaml_text


def fields(text, **d):
    return [(r.fields, r.fault and r.fault[0]) for r in records([text], Dialect(**d))]


def test_rfc4180():
    assert fields('a,b\r\n"x ""q"" y","1\n2"\n') == [(["a", "b"], None), (['x "q" y', "1\n2"], None)]
    assert fields('a"b,c') == [(['a"b', "c"], None)]
    assert fields('a"b,c', quote_mode=QuoteMode.ERROR) == [(['a"b', "c"], "CsvQuoteError")]
    assert fields('"open,1\n2')[0][1] == "CsvQuoteError"
    assert fields('"a"x,b', trailing_garbage_is_error=True)[0][1] == "CsvQuoteError"
    assert fields("a,b,c", max_columns=2)[0][1] == "CsvLimitExceeded" and fields("abc", max_record_length=2)[0][1] == "CsvLimitExceeded"
    assert fields("a;b", separator=";x") == [(["a", "b"], None)] and fields("\n\na\n") == [(["a"], None)]
    cut = list(records(['a,"b\r', '\nc"\r', "\nd"], Dialect(normalize_newlines=True)))
    assert [r.fields for r in cut] == [["a", "b\nc"], ["d"]] and [r.line for r in cut] == [1, 3]


def test_pieces_of_csv_do_not_matter():
    """Whole lines are cut at once, single characters go through the states: both give the same records."""
    import random

    draw, tell = random.Random(3), lambda rs: [(r.number, r.line, r.fields, r.raw, r.fault) for r in rs]
    for _ in range(3000):
        text = "".join(draw.choice('ab ,"\r\n') for _ in range(draw.randrange(16)))
        d = Dialect(quote_mode=draw.choice(list(QuoteMode)), trim=draw.random() < 0.5, max_columns=draw.choice([None, 2]), max_record_length=draw.choice([None, 4]))
        assert tell(records([text], d)) == tell(records(list(text), d))


def test_json_commas_and_comments(spark):
    schema = T.StructType([T.StructField("a", T.ArrayType(T.StringType())), T.StructField("n", T.DoubleType())])
    text = '[{"a": ["x",/* c */"y"], "n": 1.50}, {"A": ["//", "z",],\n // d\n }, {"n": 2, "zz": 1}]'
    rows = files.json_text(spark, text, files.JsonOptions(schema=schema)).df.collect()
    assert [(r["a"], r["n"]) for r in rows] == [(["x", "y"], 1.5), (["//", "z"], None), (None, 2.0)]


def test_numbers_of_csv(spark, tmp_path):
    """Numbers as every reading takes them, and those that only the long way reads, by both parsers."""
    schema = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("m", T.DecimalType(20, 4))])
    cells = ["1.5", "+7", "1.234,5", "1,234.5", "1.234", " 8. ", "x", "", "-2,5", "1 234.5"]
    (tmp_path / "n.csv").write_text("d,m\n" + "".join(f'"{c}","{c}"\n' for c in cells))
    for numbered in (False, True):
        rows = files.csv(spark, str(tmp_path / "n.csv"), files.CsvOptions(schema=schema, numbered=numbered)).df.collect()
        want = [1.5, 7.0, 1234.5, 1234.5, 1.234, 8.0, None, None, -2.5, 1234.5]
        assert [r["d"] for r in rows] == want and [r["m"] if r["m"] is None else float(r["m"]) for r in rows] == want
    (tmp_path / "none.csv").write_text("")
    assert files.csv(spark, str(tmp_path / "none.csv")).df.columns == []


def test_csv_policies(spark, tmp_path):
    text = "id,name\n1,a\n2,b,c\n3,d\n"
    with pytest.raises(Exception, match="SchemaError"):
        files.csv_text(spark, text).df.collect()
    metrics, seen = Metrics(), []
    options = files.CsvOptions(action=Action.SKIP, sink=JsonLinesSink(str(tmp_path / "log")), on_error=lambda raw, e: seen.append((raw, str(e))), metrics=metrics)
    result = files.csv_text(spark, text, options).finish()
    assert result.df.count() == 2 and metrics.errors == 1 and seen[0][0] == "2,b,c"
    assert spark.read.json(str(tmp_path / "log")).first()["errorType"] == "SchemaError"
    stop = Metrics()
    assert files.csv_text(spark, text, files.CsvOptions(action=Action.STOP, metrics=stop)).finish().df.count() == 1 and stop.terminated_early
    assert files.csv_text(spark, "a,b\n1\n", files.CsvOptions(allow_missing=False, action=Action.SKIP)).df.count() == 0
    assert files.csv_text(spark, "1,2\n", files.CsvOptions(header=False)).df.columns == ["Column1", "Column2"]
    assert files.csv_text(spark, "", files.CsvOptions(schema=T.StructType([T.StructField("a", T.IntegerType())]))).df.count() == 0


def test_inference(spark):
    df = files.csv_text(spark, "n,z,d,t,s\n1,01,1.5,2024-01-01,x\n2,02,2.5,2024-01-02,\n", files.CsvOptions(infer_schema=True)).df
    assert [t for _, t in df.dtypes] == ["int", "string", "decimal(38,10)", "timestamp", "string"]


def test_json(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("s", T.StringType())])
    text = '/* c */ [{"id":1,"s":"a"}, null, {"id":"x"}, {"ID":3,"s":"long text",},]'
    rows = files.json_text(spark, text, files.JsonOptions(schema=schema, action=Action.SKIP)).df.collect()
    assert [(r["id"], r["s"]) for r in rows] == [(1, "a"), (3, "long text")]
    bad = files.json_text(spark, text, files.JsonOptions(schema=schema, action=Action.SKIP, validator=F.col("id") < 2, max_string_length=5)).errors
    assert sorted(r["error_type"] for r in bad.collect()) == ["JsonException", "JsonSizeLimit"]
    assert files.json_text(spark, '{"id":5}', files.JsonOptions(schema=schema)).df.first()["id"] == 5
    root = files.json_text(spark, '{"id":5}', files.JsonOptions(schema=schema, single_root=False, action=Action.SKIP))
    assert root.errors.first()["error_type"] == "JsonRootError"
    broken = files.json_text(spark, '[{"id":1}, {"id":', files.JsonOptions(schema=schema, action=Action.SKIP))
    assert broken.df.count() == 1 and broken.errors.count() >= 1


def test_yaml(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    read = lambda text, **o: yaml_text(spark, text, YamlOptions(schema=schema, action=Action.SKIP, **o))
    assert [r["id"] for r in read("- id: 1\n  Name: a\n- id: 2\n  zz: 3\n").df.collect()] == [1, 2]
    assert [r["name"] for r in read("id: 1\nname: a\n---\nid: 2\nname: b\n").df.collect()] == ["a", "b"]
    for text, o in (("- &x {id: 1}\n- *x\n", {}), ("- !mine {id: 1}\n", {}), ("- {id: [[[1]]]}\n", {"max_depth": 3}), ("- {name: long}\n", {"max_scalar_length": 3})):
        assert read(text, **o).errors.first()["error_type"] == "YamlSecurityError"
    assert read("a: [1\n").errors.first()["error_type"] == "YamlException"


def book(path, rows, hidden=False):
    cells = lambda r, k: "".join(f'<c r="{chr(65 + i)}{k}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r))
    body = "".join(f'<row r="{k}">{cells(r, k)}</row>' for k, r in enumerate(rows, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Off" sheetId="2" state="hidden" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    book(path, [["id", "name"], ["1", "x, y"], ["2", "z"]])
    df = workbooks.sheet(spark, path, "One", files.CsvOptions(infer_schema=True)).df
    assert [tuple(r) for r in df.collect()] == [(1, "x, y"), (2, "z")]
    assert [p.rpartition("/")[2] for p in workbooks.to_csv(spark, path, workbooks.WorkbookOptions(folder=str(tmp_path / "o")))] == ["One.csv"]
    with pytest.raises(LookupError):
        workbooks.sheet(spark, path, "Off")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "k int, s string").coalesce(1)
    metrics = Metrics()
    writers.json_(df, str(tmp_path / "a.json"), writers.JsonWriteOptions(metrics=metrics))
    import json

    assert json.loads((tmp_path / "a.json").read_text()) == [{"k": 1, "s": 'a "q", b'}, {"k": 2, "s": None}] and metrics.emitted == 2
    import yaml

    writers.yaml_batched(df, str(tmp_path / "a.yaml"), 1)
    assert list(yaml.safe_load_all((tmp_path / "a.yaml").read_text())) == [[{"k": 1, "s": 'a "q", b'}], [{"k": 2, "s": None}]]
    writers.yaml_(df.limit(0), str(tmp_path / "e.yaml"))
    assert (tmp_path / "e.yaml").read_text() == "[]\n"
    writers.csv(df, str(tmp_path / "c"))
    assert files.csv(spark, str(tmp_path / "c/*.csv")).df.count() == 2
    target = tmp_path / "sub" / "x.txt"
    writers.write_in_file(["a"], str(target))
    writers.write_in_file(["b"], str(target))
    assert target.read_text() == "b\n" and (tmp_path / "sub" / "x.txt.old").read_text() == "a\n"
    assert writers.derived_name("/a/b/c.txt", str.upper, True, lambda p: p + "2") == "/a/b2/C.txt"
    (tmp_path / "l.txt").write_bytes("é\nß\n".encode("latin-1"))
    assert [r["value"] for r in files.text(spark, str(tmp_path / "l.txt"), "ISO-8859-1").collect()] == ["é", "ß"]


def test_both_csv_parsers_agree(spark, tmp_path):
    text = 'id,name,note\n1,"a, b",x\n2,"line\nend",\n3,short\n4,too,many,fields\n5,a"b, y \n\n6,"q ""q""",z\n'
    (tmp_path / "t.csv").write_text(text)
    for action in (Action.SKIP,):
        one = files.csv(spark, str(tmp_path / "t.csv"), files.CsvOptions(action=action))
        two = files.csv(spark, str(tmp_path / "t.csv"), files.CsvOptions(action=action, numbered=True))
        assert sorted(map(tuple, one.df.collect()), key=repr) == sorted(map(tuple, two.df.collect()), key=repr)
        assert [(e["error_type"], e["raw_excerpt"]) for e in one.errors.collect()] == [(e["error_type"], e["raw_excerpt"]) for e in two.errors.collect()]
        assert two.errors.first()["record_number"] == 5 and one.errors.first()["record_number"] is None
    with pytest.raises(Exception, match="SchemaError"):
        files.csv(spark, str(tmp_path / "t.csv")).df.collect()
    (tmp_path / "e.csv").write_text("")
    assert files.csv(spark, str(tmp_path / "e.csv"), files.CsvOptions(schema=["a", "b"], header=False)).df.count() == 0


def test_text_lines_of_all_documents(spark, tmp_path):
    from sluice.plans.catalogue import QUERIES

    texts = {0: "a\nb", 49: "", 50: "c", 51: None, 10**6: "d\n\ne\n"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r["value"] for r in QUERIES["text_lines"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(line for t in texts.values() for line in (t or "").split("\n"))


def test_json_schema_of_all_values(spark):
    content = "[" + '{"a": 1}, ' * 1500 + '{"a": 2.5, "late": "x"}]'
    df = files.json_text(spark, content, files.JsonOptions()).df
    assert set(df.columns) >= {"a", "late"} and df.count() == 1501
    assert [(r["a"], r["late"]) for r in df.filter("late IS NOT NULL").collect()] == [(2.5, "x")]


def test_faults_without_line_ends_in_fields(spark, tmp_path):
    """Files that are split find the same faults, whichever columns are asked for."""
    (tmp_path / "f.csv").write_text('id,s,v\n1,a,2.5\n2,b,3,4\n3,c\n4,"d,e",1\n')
    for lines in (True, False):
        r = files.csv(spark, str(tmp_path / "f.csv"), files.CsvOptions(action=Action.SKIP, multi_line=lines))
        assert [e["raw_excerpt"] for e in r.errors.select("raw_excerpt").collect()] == ["2,b,3,4"] and r.errors.count() == 1
        assert r.df.count() == 3 and sorted(x["id"] for x in r.df.select("id").collect()) == ["1", "3", "4"]
