"""Structure maps, contents and baselines as JSON files."""

from __future__ import annotations

import json

import pytest

from lexatlas.operators import loading

MAP = """{"ley": "LX", "estadisticas": {"titulos": 1}, "titulos": {"PRIMERO": {"nombre": "Uno", "pagina": 3, "capitulos": {
 "I": {"nombre": "A", "articulos": ["1o", "2o-A"]}, "II": {"nombre": null, "secciones": {"I": {"articulos": ["3 Bis"]}, "II": {"articulos": ["3-bis", "4"]}}}}},
 "SEGUNDO": {"nombre": "old", "capitulos": {}}, "SEGUNDO": {"nombre": "Dos", "capitulos": {"I": {"articulos": ["5"]}}}}}"""


def test_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text(MAP)
    maps = loading.read_maps(spark, str(tmp_path))
    got = [tuple(r) for r in loading.preorder(maps).orderBy("orden").collect()]
    assert got == [("LX", 1, "titulo", "PRIMERO", "Uno", None), ("LX", 2, "capitulo", "I", "A", 1), ("LX", 3, "capitulo", "II", None, 1), ("LX", 4, "seccion", "I", None, 3), ("LX", 5, "seccion", "II", None, 3), ("LX", 6, "titulo", "SEGUNDO", "Dos", None), ("LX", 7, "capitulo", "I", None, 6)]
    assert [tuple(r) for r in loading.map_statistics(maps).collect()] == [("LX", 2, 3, 2, 6)]
    places = {r["key"]: (r["title"], r["chapter"], r["section"]) for r in loading.article_places(maps).collect()}
    assert places["3 BIS"] == ("PRIMERO", "II", "II") and places["5"] == ("SEGUNDO", "I", None) and len(places) == 5


def test_content(spark, tmp_path):
    paragraph = {"numero": 1, "tipo": "texto", "contenido": 'with "quotes"\nand é', "identificador": None}
    doc = {"ley": "LX", "ultima_reforma_dof": "2014-06-05", "articulos": [{"numero": "1o", "tipo": "articulo", "orden": 1, "parrafos": [paragraph, paragraph | {"numero": 2, "padre_numero": 1}]}, {"numero": "2o", "orden": 2, "parrafos": []}]}
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "c.json").write_text(json.dumps(doc, indent=1, ensure_ascii=False))
    rows = loading.content_paragraphs(loading.read_content(spark, str(tmp_path / "good"))).collect()
    assert [(r["article"], r["number"], r["content"], r["parent_number"]) for r in rows] == [("1o", 1, paragraph["contenido"], None), ("1o", 2, paragraph["contenido"], 1)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.json").write_text(json.dumps(doc | {"ultima_reforma_dof": None}))
    with pytest.raises(Exception, match="ultima_reforma_dof"):
        loading.read_content(spark, str(tmp_path / "bad")).collect()


def test_baselines_and_replacement(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.json").write_text('{\n "1o": "aa",\n "2o": "bb"\n}')
    (tmp_path / "b" / "two.json").write_text('{"3o":"cc"}\n{"4o":"dd"}\n')
    assert {tuple(r) for r in loading.read_checksums(spark, str(tmp_path / "b")).collect()} == {("1o", "aa"), ("2o", "bb"), ("3o", "cc"), ("4o", "dd")}
    out = str(tmp_path / "laws")
    both = spark.createDataFrame([(1, "LA"), (2, "LB")], "id int, law string")
    loading.replace_law(both, out)
    loading.replace_law(spark.createDataFrame([(3, "LB")], both.schema), out)
    assert {tuple(r) for r in spark.read.parquet(out).select("id", "law").collect()} == {(1, "LA"), (3, "LB")}
    loading.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":1,"b":null}']
