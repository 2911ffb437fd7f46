import zipfile

import numpy as np
import pytest

from quillon.sources import files


def test_csv_with_mark_dictionary_and_bounds(spark, tmp_path):
    (tmp_path / "bp.csv").write_text("﻿patient,visit,age,extra,sexe\n1,V0,40,x,1\n1,V1,400,x,1\n2,V9,30,x,0\n", encoding="utf-8")
    (tmp_path / "sz.csv").write_text("patient,visit,AGE2\n1,V0,thirty\n3,V0,33\n", encoding="utf-8")
    (tmp_path / "dic.csv").write_text("canonical_name,dtype,section,bp_csv_col,sz_csv_col,sanity_min,sanity_max\nage,float,PATIENT,age,AGE2,0,120\nsex,int8 binary,PATIENT,sexe,NA,,\n", encoding="utf-8")
    assert files.header(spark, str(tmp_path / "bp.csv"))[0] == "patient"
    variables = files.read_dictionary(spark, str(tmp_path / "dic.csv"))
    assert [v.sources for v in variables] == [{"bp": "age", "sz": "AGE2"}, {"bp": "sexe"}]
    df = files.unified(spark, {"bp": str(tmp_path / "bp.csv"), "sz": str(tmp_path / "sz.csv")}, variables, visits=["V0", "V1"])
    rows = {(r.cohort, r.patient, r.visit): (r.age, r.sex) for r in df.collect()}
    assert rows == {("BP", "1", "V0"): (40.0, 1), ("BP", "1", "V1"): (None, 1), ("SZ", "1", "V0"): (None, None), ("SZ", "3", "V0"): (33.0, None)}
    with pytest.raises(ValueError):
        files.scan_csv(spark, str(tmp_path / "sz.csv"), [], ["patient", "arm"])


def test_tables_and_generated_cohort(spark, tmp_path):
    df = files.generate_cohort(spark, 500, [[0.8], [0.6], [0.5]])
    files.write_table(df, str(tmp_path / "t"), ["cohort"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 500 and set(back.columns) == set(df.columns)
    files.write_report(back.groupBy("cohort").count(), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 3
    assert 0.15 < back.where("i0 is null").count() / 500 < 0.35


def workbook(path, rows):
    letters = "ABCDEFGHIJ"
    cells = lambda k, r: "".join(f'<c r="{letters[j]}{k + 1}" t="s"><v>{v[1:]}</v></c>' if isinstance(v, str) and v.startswith("#") else f'<c r="{letters[j]}{k + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{letters[j]}{k + 1}"><v>{v}</v></c>' for j, v in enumerate(r) if v is not None)
    sheet = "".join(f"<row>{cells(k, r)}</row>" for k, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>PATIENT</t></si><si><r><t>AG</t></r><r><t>E2</t></r></si></sst>')


def test_dictionary_from_a_workbook(spark, tmp_path):
    workbook(tmp_path / "d.xlsx", [["canonical_name", "dtype", "section", "bp_csv_col", "sz_csv_col", "sanity_max"], ["age", "float", "#0", "age", "#1", 120.0], ["sex", "int8 binary", "#0", "sexe", "NA", None], ["note", "string", "OTHER", None, None, None]])
    found = {v.canonical_name: v for v in files.read_dictionary(spark, str(tmp_path / "d.xlsx"))}
    assert found["age"].sources == {"bp": "age", "sz": "AGE2"} and found["age"].sanity_max == 120 and found["sex"].sources == {"bp": "sexe"}
    assert [v.canonical_name for v in files.in_section(list(found.values()), ["PATIENT"])] == ["age", "sex"]
    assert [v.canonical_name for v in files.in_section(list(found.values()), types=["string"])] == ["note"]


def test_quoted_names_keep_their_commas(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,"dose, mg",visit\n1,"2,5",V0\n', encoding="utf-8")
    assert files.header(spark, str(tmp_path / "q.csv")) == ["id", "dose, mg", "visit"]
    assert [tuple(r) for r in files.scan_csv(spark, str(tmp_path / "q.csv"), ["dose, mg", "visit"]).collect()] == [("2,5", "V0")]


def test_configurations(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# run\nname: 'a: b'\nseed: 3\nrate: 1e-3\non: true\nnone: ~\nitems: [x, 'y z', 2]\nstages:\n  - id: one  # first\n    deep:\n      k: v\n  - two\nflat:\n- 1\n- 2\n", encoding="utf-8")
    assert files.read_config(spark, str(tmp_path / "c.yaml")) == {"name": "a: b", "seed": 3, "rate": 0.001, "on": True, "none": None, "items": ["x", "y z", 2], "stages": [{"id": "one", "deep": {"k": "v"}}, "two"], "flat": [1, 2]}
    (tmp_path / "c.json").write_text('{"a": [1]}', encoding="utf-8")
    assert files.read_config(spark, str(tmp_path / "c.json")) == {"a": [1]}
    for bad in ("a: &x 1", "a: |\n  text", "\ta: 1"):
        with pytest.raises(ValueError):
            files.parse_yaml(bad)


def test_arrays_and_draws(spark, tmp_path):
    given = {"loadings": np.arange(12.0).reshape(2, 3, 2), "sd": np.ones((2, 3))}
    files.write_arrays(spark, str(tmp_path / "a.npz"), given)
    back = files.read_arrays(spark, str(tmp_path / "a.npz"))
    assert back.keys() == given.keys() and all((back[k] == given[k]).all() for k in given)
    rows = {(r.name, r.chain, r.draw, r.place): r.value for r in files.read_draws(spark, str(tmp_path / "a.npz")).collect()}
    assert len(rows) == 18 and rows["loadings", 1, 2, 1] == 11.0
