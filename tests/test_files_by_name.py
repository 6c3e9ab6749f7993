import pytest

from specstrata.sources import crawl, sinks

NAMES = ["a", "a b", "a:b", "_x", ".y", "a+b", "a%41", "ü"]


@pytest.mark.parametrize("form", ["{}/p", "file:{}/q", "file://{}/r", "file:{}/s t", "{}/u%20v"])
def test_written_and_read_in_any_form_of_folder(spark, tmp_path, form):
    folder = form.format(tmp_path)
    extracts = spark.createDataFrame([("T", "https://a/", n, f"interface {k} {{}};") for k, n in enumerate(NAMES)] + [("T", "https://a/", "none", "")], "title string, url string, shortname string, idl string")
    sinks.write_documents(sinks.idl_documents(extracts), folder)
    assert (tmp_path / form.rpartition("/")[2] / "idl/a:b.idl").exists()
    linked = sinks.with_files(extracts, "idl", ".idl").select("shortname", "idl")
    assert {r["shortname"]: r["idl"] for r in linked.collect()}["_x"] == "idl/_x.idl"
    back = {r["shortname"]: r["idl"] for r in crawl.expand_extract(linked, folder, "idl").collect()}
    assert back == {n: f"interface {k} {{}};" for k, n in enumerate(NAMES)} | {"none": None}


def test_values_that_name_no_file_stay(spark, tmp_path):
    (tmp_path / "secret.idl").write_text("x")
    (tmp_path / "idl/sub").mkdir(parents=True)
    values = ["idl/gone.idl", "idl/../secret.idl", "idl/sub", "idl/", "other", "idl/" + "x" * 300]
    df = spark.createDataFrame([(v,) for v in values], "idl string")
    assert sorted(r["idl"] for r in crawl.expand_extract(df, str(tmp_path), "idl").collect()) == sorted(values)
    assert [r["css"] for r in crawl.expand_extract(df.selectExpr("'css/a.json' AS css").limit(1), str(tmp_path), "css").collect()] == ["css/a.json"]
