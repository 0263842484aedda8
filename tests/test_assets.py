"""Primary images: decided on keys and lengths, fetched afterwards."""

from corpusdeck.operators import assets as A

ASSET = "doc_id long, unit_id int, ord int, format string, content binary"
PAGE = "doc_id long, unit_id int, format string, content binary"


def test_first_asset_with_bytes_else_the_rendered_page(spark):
    rows = [
        (1, 0, 0, "png", None), (1, 0, 1, "jpg", b""), (1, 0, 2, "gif", b"two"), (1, 0, 3, "png", b"three"),
        (1, 1, 0, "png", None), (1, 2, 5, "bmp", b""), (None, 0, 1, None, b"null key"), (2, 0, 1, "a", b"xx"), (2, 0, 1, "b", b"xxx"), (2, 0, 1, "c", b"xxx"), (2, 0, 1, "c", b"xxx"),
    ]
    pages = [(1, 0, "page", b"not needed"), (1, 1, "page", b"stands in"), (7, 0, "page", b"alone"), (7, 0, "page", b"alone"), (8, 0, "page", None), (None, 9, "page", b"nobody's")]
    out = A.primary_image(spark.createDataFrame(rows, ASSET), spark.createDataFrame(pages, PAGE)).collect()
    got = {(x.doc_id, x.unit_id): (x.n_images, x.formats, x.place, x.format, bytes(x.content) if x.content is not None else None) for x in out}
    assert len(out) == len(got)
    assert got == {
        (1, 0): (4, ["png", "jpg", "gif", "png"], 2, "gif", b"two"),
        (1, 1): (2, ["png", "page"], -1, "page", b"stands in"),
        (1, 2): (1, ["bmp"], None, None, None),
        (None, 0): (1, [None], 1, None, b"null key"),
        (2, 0): (4, ["a", "b", "c", "c"], 1, "c", b"xxx"),
        (7, 0): (1, ["page"], -1, "page", b"alone"),
        (None, 9): (1, ["page"], -1, "page", b"nobody's"),
    }
    alone = A.primary_image(spark.createDataFrame(rows, ASSET))
    assert alone.columns == ["doc_id", "unit_id", "n_images", "formats", "place", "format", "content"] and alone.count() == 5
    assert A.primary_image(spark.createDataFrame([], ASSET), spark.createDataFrame([], PAGE)).count() == 0


def test_no_bytes_in_the_deciding_exchange(spark, tmp_path):
    spark.createDataFrame([(i % 5, i % 7, i, "png", b"x" * i) for i in range(100)], ASSET).write.parquet(f"{tmp_path}/a")
    out = A.primary_image(spark.read.parquet(f"{tmp_path}/a"))
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    exchanges = [x for x in plan.split("\n\n") if "Exchange" in x.split("\n")[0] and "Input" in x]
    deciding = [x for x in exchanges if "min#" in x]
    assert deciding and not any("content" in x for x in deciding)
    assert any("content" in x for x in exchanges)  # bytes travel later, for the winners
