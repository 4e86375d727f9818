import pytest
from kindred.sources import cli, report, tables
from kindred.streaming.online import OnlineMean


def test_split_and_transform(spark):
    df = spark.createDataFrame([("John", "blue|red|green"), ("Philip", None), ("Mary", "a|b")], "name string, colors string")
    rows = [tuple(r) for r in tables.split_column(df, "colors").collect()]
    assert len(rows) == 6 and ("Philip", "") in rows
    assert tables.split_column(df, "colors", target="color").columns == ["name", "colors", "color"]
    out = tables.transform_column(df, "name", ["upper"], target="big", after=True)
    assert out.columns == ["name", "big", "colors"] and out.first()["big"] == "JOHN"
    assert tables.transform_column(df, "name", expression="length(value)").first()["name"] == 4
    with pytest.raises(ValueError):
        tables.transform_column(df, "name", ["nothing"])


def test_cli(spark, tmp_path, capsys):
    path = tmp_path / "x.csv"
    path.write_text('name\n"Doe, John"\nJohn Doe\nJohn Doe\nMary "M" S\n'.replace('"M"', "M"))
    assert cli.main(["cluster", "name", str(path)], spark) == 0
    text = capsys.readouterr().out
    assert "[[cluster]]" in text and 'harmonized = "John Doe"' in text and "nb_rows = 3" in text
    assert cli.main(["cluster", "name", str(path), "--html"], spark) == 0
    assert "<h2>0: John Doe</h2>" in capsys.readouterr().out
    cli.main(["split", "name", str(path), "--separator", " "], spark)
    assert len(capsys.readouterr().out.splitlines()) == 10
    cli.main(["transform", "name", str(path), "--chain", "lower"], spark)
    assert "john doe" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["cluster", "other", str(path)], spark)
    assert report._quoted('a"b\n') == '"a\\"b\\n"'


def test_online_mean():
    m = OnlineMean()
    for x in range(16):
        m.add(x)
    assert m.mean == 7.5
    for x in range(5):
        m.subtract(x)
    assert m.mean == 10
    assert OnlineMean(3, 1).merge(OnlineMean(5, 1)).mean == 4
    with pytest.raises(Exception):
        OnlineMean().mean
