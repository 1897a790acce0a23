import pytest
from pyspark.sql import functions as F

from cloakwork.schema import SPANS, require_columns
from cloakwork.sources import resources as rs


def test_files(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text(" hello \n")
    (tmp_path / "secret.txt").write_text("no")
    assert rs.load_prompt(str(tmp_path / "p"), "a") == "hello"
    with pytest.raises(ValueError):
        rs.load_prompt(str(tmp_path / "p"), "../secret.txt")
    assert rs.model_path("a.txt", [str(tmp_path), str(tmp_path / "p")]).endswith("a.txt")
    with pytest.raises(FileNotFoundError):
        rs.model_path("zz", [str(tmp_path)])
    (tmp_path / "w").write_text("# x\na\n\nb\na\n")
    assert rs.word_list(str(tmp_path / "w")) == ["a", "b"]
    assert rs.md5_of(str(tmp_path / "secret.txt")) == "7fa3b767c460b54a2be4d49030b349c7"


def test_views_and_columns(spark):
    df = spark.createDataFrame([([("B", 5, 6, 0.5, "x", "p"), ("A", 1, 2, 0.5, "y", "p")],)], f"S {SPANS}")
    r = df.select(rs.entity_types(F.col("s")).alias("t"), rs.recognizers(F.col("s")).alias("n"), rs.by_recognizer(F.col("s"), ["y"]).alias("y"), rs.highlights(F.col("s")).alias("h")).first()
    assert r["t"] == ["A", "B"] and r["n"] == ["x", "y"] and len(r["y"]) == 1 and r["h"][0]["label"] == "A"
    assert require_columns(df, ["s"], ["zz"]) == ["S"]
    with pytest.raises(ValueError):
        require_columns(df, ["q"])
