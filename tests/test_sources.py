import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import connectors, files, shops


def test_text_csv_keeps_na_and_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,NA\n2,\n3,"x, y"\n')
    got = files.read_text_csv(spark, str(tmp_path / "a.csv"), ["id", "name"]).collect()
    assert [(r["id"], r["name"]) for r in got] == [("1", "NA"), ("2", ""), ("3", "x, y")]


def test_ragged_csv_is_repaired(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,year,name\n1,2012,Shirt\n2,,Shoes, red, size 9\n3,NA,\n4,x,Bag\n")
    got = files.read_ragged_csv(spark, str(tmp_path / "b.csv"), ["id", "year", "name"], ["year"]).orderBy("id").collect()
    assert [(r["id"], r["year"], r["name"], r["repaired"]) for r in got] == [("1", 2012, "Shirt", False), ("2", None, "Shoes, red, size 9", True), ("3", None, None, False), ("4", None, "Bag", False)]


def test_annotations(spark, tmp_path):
    doc = {"images": [{"id": 5, "width": 10, "height": 20, "file_name": "a.jpg"}], "annotations": [{"id": 1, "image_id": 5, "category_id": 2, "attribute_ids": [3, 4], "bbox": [1, 2, 3, 4], "segmentation": [[1]]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, annotations = files.read_annotations(spark, str(tmp_path / "c.json"), "val", kept_masks=0)
    assert images.first()["id"] == "val_5"
    row = annotations.first()
    assert (row["image_id"], row["w"], row["attribute_ids"], row["segmentation"]) == ("val_5", 3.0, [3, 4], None)


def test_picture_names(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "120_3.jpg").write_bytes(b"abc")
    (tmp_path / "s" / "readme.txt").write_bytes(b"x")
    got = {r["set_id"]: r for r in files.scan_pictures(spark, str(tmp_path)).collect()}
    assert got["120"]["place"] == 3 and got["120"]["md5"] == "900150983cd24fb0d6963f7d28e17f72" and None in got


def test_settings_are_strict(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,value\na,1\nb,2.5\n")
    assert files.read_settings(spark, str(tmp_path / "s.csv"), ["a", "b"]) == {"a": 1.0, "b": 2.5}
    with pytest.raises(ValueError, match="missing"):
        files.read_settings(spark, str(tmp_path / "s.csv"), ["a", "b", "c"])
    with pytest.raises(ValueError, match="unknown"):
        files.read_settings(spark, str(tmp_path / "s.csv"), ["a"])


def test_vector_columns_by_number(spark):
    df = spark.createDataFrame([("1", "2", "3"), ("1", "x", "3")], "e0 string, e10 string, e2 string")
    assert [r["embedding"] for r in files.widest_vector(df).collect()] == [[1.0, 3.0, 2.0], None]


def test_shopify_rows_by_colour(spark):
    p = {
        "id": 7, "title": "Tee", "handle": "tee", "options": [{"name": "Taille", "position": 1}, {"name": "Couleur", "position": 2}],
        "images": [{"src": "first", "variant_ids": []}, {"src": "red", "variant_ids": [2]}],
        "variants": [
            {"id": 1, "option1": "S", "option2": "blue", "price": "20.5", "available": False},
            {"id": 2, "option1": "M", "option2": "red", "price": "30", "available": True},
            {"id": 3, "option1": "L", "option2": "red", "price": "25", "available": False},
        ],
    }
    got = {r["shop_colour"]: r for r in shops.shopify_listings(spark.createDataFrame([(json.dumps(p),)], "json string"), "https://s", "B").collect()}
    assert (got["red"]["price_tnd"], got["red"]["sizes"], got["red"]["sizes_in_stock"], got["red"]["in_stock"], got["red"]["image_url"]) == (25.0, ["M", "L"], ["M"], True, "red")
    assert (got["blue"]["in_stock"], got["blue"]["image_url"], got["blue"]["external_id"], got["blue"]["url"]) == (False, "first", "7-blue", "https://s/products/tee")


def test_woocommerce(spark):
    p = {"id": 3, "name": "Robe", "permalink": "u", "images": [{"src": "i"}], "prices": {"price": "129900", "currency_code": "TND", "currency_minor_unit": 3}, "is_in_stock": True, "attributes": [{"name": "Couleur", "terms": [{"name": "noir"}]}]}
    row = shops.woocommerce_listings(spark.createDataFrame([(json.dumps(p),)], "json string"), "B").first()
    assert (row["price_tnd"], row["shop_colour"], row["image_url"]) == (129.9, "noir", "i")
    p["prices"]["currency_code"] = "EUR"
    with pytest.raises(Exception, match="unexpected currency"):
        shops.woocommerce_listings(spark.createDataFrame([(json.dumps(p),)], "json string"), "B").collect()


def test_sitemap(spark):
    xml = "<urlset><url><loc> https://s/p/1?a=1&amp;b=2 </loc></url><url><loc><![CDATA[https://s/p/2]]></loc></url><url><loc>https://s/p/2</loc></url><url><loc>https://s/about</loc></url></urlset>"
    got = shops.sitemap_urls(spark.createDataFrame([(xml,)], "xml string"), keep="/p/")
    assert sorted(r["url"] for r in got.collect()) == ["https://s/p/1?a=1&b=2", "https://s/p/2"]


def test_product_pages_and_rates(spark):
    block = lambda x: f'<html><script type="application/ld+json">{json.dumps(x)}</script></html>'
    product = {"@type": "Product", "name": "Sac", "image": ["a.jpg"], "color": "noir", "offers": [{"price": "12.5", "priceCurrency": "EUR", "availability": "https://schema.org/OutOfStock"}, {"price": 10, "availability": "https://schema.org/InStock"}]}
    rows = [("1", block(product)), ("2", block({"@graph": [{"@type": "WebPage"}, product | {"name": "Two", "offers": {"lowPrice": 3, "priceCurrency": "EUR"}}]})), ("3", block({"@type": "Person"})), ("4", "<html>{broken</html>")]
    got = {r["url"]: r for r in shops.in_dinars(shops.product_pages(spark.createDataFrame(rows, "url string, html string")), spark.createDataFrame([("EUR", 3.4)], "currency string, rate double")).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"]["name"], got["1"]["image_url"], got["1"]["price_tnd"], got["1"]["in_stock"]) == ("Sac", "a.jpg", 34.0, True)
    assert (got["2"]["name"], got["2"]["price"], got["2"]["in_stock"]) == ("Two", 3.0, None)


ITEM_API = {"ref": "0049876", "title": "Robe", "image": "a.jpg", "price": "59.900 TND", "priceDiscounted": "29,90 TND", "color": {"name": "noir"}, "section": {"seoName": "Femme"}, "sizes": {"S": [{"stock": 0}], "M": [{"stock": 2}]}}
PAGE = "https://shop.example.tn/catalogue/femme/robes/robe-longue/0049876-article-robe"


def test_connectors_read_what_only_spark_can_open(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}/in")
    bare = {"ref": "7", "title": "Sac", "image": "b.jpg", "price": None, "sizes": {}}
    (tmp_path / "in/items.jsonl").write_text("\n\n".join(json.dumps(x) for x in ({"url": PAGE, "item": ITEM_API}, {"url": PAGE, "item": bare}, {"url": PAGE, "item": None})))
    got = {r["external_id"]: r for r in connectors.fetch(spark, "s1", "item_api", ["viewfs://store/in/items.jsonl"], base_url="https://shop.example.tn/", brand="Own").collect()}
    assert set(got) == {"0049876", "7"} and got["7"]["in_stock"] is None and got["7"]["availability_level"] == "product" and got["7"]["price_tnd"] is None
    r = got["0049876"]
    assert (r["source_id"], r["price_tnd"], r["gender"], r["shop_colour"], r["sizes_in_stock"], r["in_stock"]) == ("s1", 29.9, "women", "noir", ["M"], True)
    assert sorted(r["sizes"]) == ["M", "S"] and r["image_url"] == "https://shop.example.tn/api/image/get/product/a.jpg"


def test_connectors_dispatch_by_kind(spark, tmp_path):
    one = {"id": 1, "title": "Shirt", "handle": "shirt", "options": [], "images": [{"src": "p.jpg"}], "variants": [{"id": 5, "price": "9.5", "available": True}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(one) + "\n")
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nnot json\n')
    (tmp_path / "c.jsonl").write_text(json.dumps({"xml": "<urlset><url><loc>https://a.b/p</loc></url></urlset>"}))
    shop = connectors.fetch(spark, "s1", "shopify", [str(tmp_path / "a.jsonl")], base_url="https://x.y", brand="X").first()
    assert (shop["source_id"], shop["url"], shop["price_tnd"]) == ("s1", "https://x.y/products/shirt", 9.5)
    assert connectors.fetch(spark, "s2", "sitemap", [str(tmp_path / "c.jsonl")]).first()["url"] == "https://a.b/p"
    assert connectors.fetch(spark, "s3", "snapshot", [str(tmp_path / "a.jsonl")], schema="id long, title string").columns == ["source_id", "id", "title"]
    with pytest.raises(Exception, match="no JSON in .*b.jsonl: not json"):
        connectors.fetch(spark, "s4", "shopify", [str(tmp_path / "b.jsonl")], base_url="").collect()
    with pytest.raises(ValueError, match="kind must be one of"):
        connectors.fetch(spark, "s5", "none", [])


def test_page_parts(spark):
    rows = spark.createDataFrame([(PAGE,), ("https://shop.example.tn/catalogue/femme/12-article-x",), ("https://shop.example.tn/en/catalogue/a%20b/c%2Bd/e/1-article-y?z=1",), ("https://shop.example.tn/about",), ("https://shop.example.tn/1-article-x",)], "url string")
    got = [r["p"] and tuple(r["p"]) for r in rows.select(shops.page_parts(F.col("url")).alias("p")).collect()]
    assert got == [("0049876", "femme", "robes", "robe-longue"), ("12", "femme", None, None), ("1", "a b", "c+d", "e"), None, None]
