import json

from pyspark.sql import functions as F

from quartzfolio.sources import catalogs, formats


def test_csv_to_items_and_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Nome;Prezzo;Fornitore;Altro\n"Alfa; uno";€ 1.234,50;Acme;x\n;1;Nobody;y\nBeta;12k;;z\n', encoding="utf-8")
    rows = catalogs.read_csv(spark, str(tmp_path / "a.csv"))
    items = catalogs.to_items(rows)
    got = {r["name"]: (r["price"], r["vendor"], json.loads(r["raw"])) for r in items.collect()}
    assert got == {"Alfa; uno": (1234.5, "Acme", {"Altro": "x"}), "Beta": (12000.0, None, {"Altro": "z"})}
    catalogs.save_items(items, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("type = 'product'").count() == 2
    catalogs.save_template(spark, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == list(catalogs.ITEM_FIELDS)


def test_json_catalogs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"products": [{"name": "A", "brand": "B"}, {"vendor": "no name"}], "services": [{"name": "S", "vendor": "V"}]}))
    (tmp_path / "b.json").write_text("not json")
    got = {(r["type"], r["name"], r["vendor"]) for r in catalogs.read_json_catalog(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("product", "A", "B"), ("service", "S", "V")}


def test_columns_are_mapped_once():
    got = catalogs.map_columns(["Product Name", "Vendor", "Prezz", "Price", "Zzz"])
    assert {c: f for c, (f, _) in got.items()} == {"Product Name": "name", "Vendor": "vendor", "Price": "price"}
    assert got["Vendor"][1] == 0.98
    assert catalogs.map_columns(["X"], {"X": "name"}) == {"X": ("name", 0.95)}
    assert catalogs.map_columns([]) == {}


def test_formats(spark):
    rows = [(b"%PDF-1.4", "a.PDF", "x"), (b"\xef\xbb\xbfabc", "b.csv", "a,b,c\n1,2,3"), (b"\xff\xfea\x00", "c", '{"a": 1}'), (b"\xe9t\xe9", "d.zip", "a\tb\tc"), (b"", "e.", "<html>"), (None, None, None)]
    df = spark.createDataFrame(rows, "content binary, name string, text string")
    got = df.select(formats.magic(F.col("content")), formats.by_extension(F.col("name")), formats.encoding(F.col("content")), formats.sniff(F.col("text")), formats.delimiter(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [("pdf", "pdf", "utf-8", "text", ","), (None, "csv", "utf-8", "csv", ","), (None, None, "utf-16le", "json", ","), (None, None, "iso-8859-1", "tsv", "\t"), (None, None, "utf-8", "html", ","), (None, None, "iso-8859-1", "text", ",")]


def test_lists_and_tables(spark):
    text = "Intro\n- Alfa - first\n  more\n* Beta (x)\n\n3) Gamma\nend"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "no list")], "doc_id long, text string")
    got = [(r["item"], r["name"], r["description"]) for r in catalogs.list_items(rows).orderBy("item").collect()]
    assert got == [(1, "Alfa", "first more"), (2, "Beta", "x"), (3, "Gamma", "end")]
    table = spark.createDataFrame([(1, "| A | B |\n|---|---|\n| x | |\ntext")], "doc_id long, text string")
    assert [r["cells"] for r in catalogs.markdown_rows(table).orderBy("line").collect()] == [["A", "B"], ["x", ""]]


def test_page_text(spark):
    html = "<html><title>T</title><script>if (a</b) {}</script><!-- <p>no</p> --><p>Hello\n<b>you</b></p>"
    row = spark.createDataFrame([(html,)], "html string").select(catalogs.page_title(F.col("html")), catalogs.page_text(F.col("html"))).first()
    assert tuple(row) == ("T", "T Hello you")


def test_split_keeps_digits(spark):
    df = spark.createDataFrame([(" 0a ,1b;; 2c 2",)], "t string")
    assert df.select(catalogs.split_technologies(F.col("t"))).first()[0] == ["0a", "1b", "2c 2"]
