"""Shop answers flattened to listings: product JSON of two shop systems, sitemaps and product pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.texts import dinars, section_gender

_PRODUCT = (
    "id long, title string, handle string, options array<struct<name:string,position:int>>, images array<struct<src:string,variant_ids:array<bigint>>>, "
    "variants array<struct<id:bigint,option1:string,option2:string,option3:string,price:string,available:boolean,featured_image:struct<src:string>>>"
)
# Names of colour and size options.
COLOUR_NAMES, SIZE_NAMES = ("color", "colour", "couleur"), ("size", "taille", "pointure")


def _option(v: Column, options: Column, names: tuple[str, ...]) -> Column:
    """A variant's value of the option with one of these names."""
    place = F.get(F.filter(options, lambda o: F.lower(o["name"]).isin(*names)), F.lit(0))["position"]
    return F.when(place == 1, v["option1"]).when(place == 2, v["option2"]).when(place == 3, v["option3"])


def shopify_listings(answers: DataFrame, base_url: str, brand: str, column: str = "json") -> DataFrame:
    """One row for each colour of each product: least price, sizes, those in stock, whether any is, and a picture.

    The picture is the variant's own, else one listed for it, else the product's first. A product without a colour option is
    one row.
    """
    product = answers.select(F.from_json(column, _PRODUCT).alias("p")).select("p.*")
    each = product.withColumn("v", F.explode("variants")).withColumns({"colour": _option(F.col("v"), F.col("options"), COLOUR_NAMES), "size": _option(F.col("v"), F.col("options"), SIZE_NAMES)})
    listed = F.get(F.filter("images", lambda i: F.array_contains(i["variant_ids"], F.col("v.id"))), F.lit(0))["src"]
    picture = F.coalesce(F.col("v.featured_image.src"), listed, F.get("images", 0)["src"])
    return each.groupBy("id", "title", "handle", "colour").agg(
        F.min(F.col("v.price").try_cast("double")).alias("price_tnd"),
        F.array_distinct(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("v.id", "size"))), lambda x: x["size"]))).alias("sizes"),
        F.array_distinct(F.array_compact(F.transform(F.array_sort(F.collect_list(F.when(F.col("v.available"), F.struct("v.id", "size")))), lambda x: x["size"]))).alias("sizes_in_stock"),
        F.bool_or("v.available").alias("in_stock"), F.min_by(picture, F.col("v.id")).alias("image_url"),
    ).select(
        F.concat_ws("-", F.col("id").cast("string"), "colour").alias("external_id"), F.concat(F.lit(base_url + "/products/"), "handle").alias("url"), "title", F.lit(brand).alias("brand"),
        F.col("colour").alias("shop_colour"), "price_tnd", "sizes", "sizes_in_stock", "in_stock", "image_url",
    )


_WOO = (
    "id long, name string, permalink string, images array<struct<src:string>>, prices struct<price:string,currency_code:string,currency_minor_unit:int>, "
    "is_in_stock boolean, attributes array<struct<name:string,terms:array<struct<name:string>>>>"
)


def woocommerce_listings(answers: DataFrame, brand: str, column: str = "json", currency: str = "TND") -> DataFrame:
    """A product a row; prices come in minor units and in one currency, any other stops the run. A colour counts if it is the only one."""
    p = answers.select(F.from_json(column, _WOO).alias("p")).select("p.*")
    terms = lambda names: F.flatten(F.transform(F.filter("attributes", lambda a: F.lower(a["name"]).isin(*names)), lambda a: F.transform(a["terms"], lambda t: t["name"])))
    price = F.when(F.col("prices.currency_code") == currency, F.col("prices.price").try_cast("double") / F.pow(F.lit(10.0), F.col("prices.currency_minor_unit")))
    told = F.when(F.coalesce(F.col("prices.currency_code"), F.lit(currency)) != currency, F.raise_error(F.concat(F.lit("unexpected currency "), F.col("prices.currency_code")))).otherwise(price)
    colours = terms(COLOUR_NAMES)
    return p.select(
        F.col("id").cast("string").alias("external_id"), F.col("permalink").alias("url"), F.col("name").alias("title"), F.lit(brand).alias("brand"),
        F.when(F.size(colours) == 1, F.get(colours, F.lit(0))).alias("shop_colour"), told.cast("double").alias("price_tnd"), terms(SIZE_NAMES).alias("sizes"),
        F.col("is_in_stock").alias("in_stock"), F.get("images", 0)["src"].alias("image_url"),
    )


_ITEM = (
    "ref string, title string, image string, price string, priceDiscounted string, color struct<name:string>, section struct<seoName:string>, "
    "sizes map<string,array<struct<stock:int>>>"
)
# Sections of the item API and whom they are for.
SECTION_GENDERS = {"femme": "women", "homme": "men"}


def page_parts(url: Column) -> Column:
    """(reference, section, group, sub_group) of a product page's address, .../catalogue/<section>/<group>/<sub-group>/<reference>-article-<name>;
    levels that it lacks are null, and so is all of another page."""
    parts = F.transform(F.filter(F.split(F.parse_url(url, F.lit("PATH")), "/"), lambda p: p != ""), lambda p: F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
    at = F.array_position(parts, "catalogue").cast("int")
    last = F.element_at(parts, -1)
    levels = F.slice(parts, at + 1, F.greatest(F.size(parts) - at - 1, F.lit(0)))
    fits = (F.size(parts) > 0) & (at > 0) & last.contains("-article-")
    told = F.struct(F.substring_index(last, "-article-", 1).alias("reference"), *[F.get(levels, F.lit(i)).alias(n) for i, n in enumerate(("section", "group", "sub_group"))])
    return F.when(fits, told)


def api_items(answers: DataFrame, base_url: str, brand: str, column: str = "json") -> DataFrame:
    """A product of a shop's item API a row, its answer under item and its page's address under url: today's price, colour, sizes with and in stock.

    The discounted price counts if there is one; a price in another currency stops the run. Without sizes nothing is known of the stock.
    """
    p = answers.select(F.get_json_object(column, "$.url").alias("url"), F.from_json(F.get_json_object(column, "$.item"), _ITEM).alias("i")).filter("i is not null").select("url", "i.*")
    sizes = F.coalesce("sizes", F.create_map().cast("map<string,array<struct<stock:int>>>"))
    there = F.map_keys(F.map_filter(sizes, lambda _, vs: F.exists(vs, lambda v: v["stock"] > 0)))
    some = F.size(sizes) > 0
    price = F.coalesce(F.nullif("priceDiscounted", F.lit("")), F.col("price"))
    genders = F.create_map(*[F.lit(x) for pair in SECTION_GENDERS.items() for x in pair])
    return p.select(
        F.coalesce("ref", F.lit("")).alias("external_id"), "url", F.coalesce("title", F.lit("")).alias("title"), F.lit(brand).alias("brand"), F.coalesce("color.name", F.lit("")).alias("shop_colour"),
        F.coalesce(genders[F.lower("section.seoName")], F.lit("")).alias("gender"), dinars(price).alias("price_tnd"), F.map_keys(sizes).alias("sizes"), there.alias("sizes_in_stock"),
        F.when(some, F.size(there) > 0).alias("in_stock"), F.concat(F.lit(base_url + "api/image/get/product/"), "image").alias("image_url"), F.when(some, "colour").otherwise("product").alias("availability_level"),
    )


def sitemap_urls(maps: DataFrame, column: str = "xml", keep: str | None = None) -> DataFrame:
    """Distinct addresses of sitemaps, whatever their name space, with whether the map is an index of maps."""
    body = F.regexp_replace(column, r"<!\[CDATA\[(.*?)\]\]>", "$1")
    found = F.regexp_extract_all(body, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    out = maps.select(F.explode(found).alias("url"), F.col(column).contains("<sitemapindex").alias("is_index")).withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&")))
    return (out if keep is None else out.filter(F.col("is_index") | F.col("url").rlike(keep))).dropDuplicates(["url"])


def product_pages(pages: DataFrame, column: str = "html", key: str = "url") -> DataFrame:
    """Products that pages describe in linked data: name, picture, colour, least price of the offers, currency and stock.

    A page's block may be a product, a list, or hold its things under @graph. The first product counts; a page without one
    has no row. Offers under a list, a single offer and an aggregate's lowPrice all count; no statement of stock is null.
    """
    blocks = F.regexp_extract_all(column, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    each = pages.select(key, F.posexplode(blocks).alias("_at", "_json")).withColumn("_v", F.try_parse_json("_json")).filter("_v is not null")
    wide = lambda path: F.try_variant_get("_v", path, "array<variant>")
    things = F.coalesce(wide("$['@graph']"), wide("$"), F.array("_v"))
    flat = each.withColumn("_t", F.explode(things)).withColumn("_type", F.coalesce(F.try_variant_get("_t", "$['@type']", "string"), F.try_variant_get("_t", "$['@type'][0]", "string")))
    products = flat.filter(F.col("_type").isin("Product", "ProductGroup"))
    text = lambda path: F.try_variant_get("_t", path, "string")
    offers = F.coalesce(F.try_variant_get("_t", "$.offers", "array<variant>"), F.array(F.try_variant_get("_t", "$.offers", "variant")))
    prices = F.array_compact(F.transform(offers, lambda o: F.coalesce(F.try_variant_get(o, "$.price", "double"), F.try_variant_get(o, "$.lowPrice", "double"))))
    stock = F.array_compact(F.transform(offers, lambda o: F.try_variant_get(o, "$.availability", "string")))
    told = products.groupBy(key).agg(F.min_by(F.struct(
        text("$.name").alias("name"), F.coalesce(text("$.image[0]"), text("$.image.url"), text("$.image")).alias("image_url"), text("$.color").alias("shop_colour"),
        F.array_min(prices).alias("price"), F.try_variant_get(F.get(offers, F.lit(0)), "$.priceCurrency", "string").alias("currency"),
        F.when(F.size(stock) > 0, F.exists(stock, lambda s: s.endswith("InStock"))).alias("in_stock"),
    ), F.col("_at")).alias("p"))
    return told.select(key, "p.*")


def in_dinars(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows (price, currency) with price_tnd to three digits and the price as it was; a currency without a rate stops the run."""
    joined = rows.join(F.broadcast(rates), "currency", "left")
    missing = F.col("price").isNotNull() & F.col("rate").isNull() & F.col("currency").isNotNull()
    told = F.when(missing, F.raise_error(F.concat(F.lit("no rate for "), "currency"))).otherwise(F.bround(F.col("price") * F.col("rate"), 3))
    return joined.withColumns({"price_tnd": told.cast("double"), "price_original": F.concat_ws(" ", F.col("price").cast("string"), "currency")}).drop("rate")


#: Words for what can be had, and the most maps read in a run.
IN_STOCK, MOST_MAPS = ("in_stock", "low_on_stock"), 50


def stock_summary(stock: Column, sizes: Column) -> Column:
    """(availability, sizes_in_stock, n) of maps number -> availability and number -> size, in the map's order; a number without a
    size stands for itself. Low if all that can be had is low; no stock, or none told, is out of stock."""
    entries = F.map_entries(F.coalesce(stock, F.create_map().cast("map<string,string>")))
    there = F.filter(entries, lambda e: F.lower(e["value"]).isin(*IN_STOCK))
    low = F.forall(there, lambda e: F.lower(e["value"]) == "low_on_stock")
    names = F.transform(there, lambda e: F.coalesce(sizes[e["key"]], e["key"]))
    return F.struct(F.when(F.size(there) == 0, "out_of_stock").when(low, "low_on_stock").otherwise("in_stock").alias("availability"), names.alias("sizes_in_stock"), F.size(there).alias("n"))


def packed_sizes(sizes: Column) -> Column:
    """A map number -> size as number:size|number:size."""
    return F.array_join(F.transform(F.map_entries(sizes), lambda e: F.concat_ws(":", e["key"], e["value"])), "|")


def unpacked_sizes(text: Column) -> Column:
    """The map that packed_sizes wrote: parts without a colon don't count, and of one number the last stands."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).alias("key"), F.regexp_replace(p, "^[^:]*:", "").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def _listed(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: x != "")


def scraped_listings(rows: DataFrame) -> DataFrame:
    """Rows of a scraped catalogue, all text, as listings. Sizes in stock count only where the stock was asked for by colour, that is
    where the colour's own numbers were known; a price that is no number and an unknown availability are null."""
    asked, text = F.coalesce(F.col("availability_from"), F.lit("")), lambda c: F.coalesce(F.col(c), F.lit(""))
    by_colour = text("sku_sizes") != ""
    level = F.when(asked == "stock_api", F.when(by_colour, "colour").otherwise("product")).when(asked == "catalogue", "catalogue").otherwise("")
    return rows.select(
        F.col("id").alias("external_id"), text("url").alias("url"), text("name").alias("title"), text("brand").alias("brand"), text("colour_name").alias("shop_colour"), text("gender").alias("gender"),
        F.col("price").try_cast("double").alias("price_tnd"), _listed(F.col("sizes")).alias("sizes"), F.when(level == "colour", _listed(F.col("sizes_in_stock"))).otherwise(F.array().cast("array<string>")).alias("sizes_in_stock"),
        F.when(F.col("availability").isin(*IN_STOCK), True).when(F.col("availability") == "out_of_stock", False).alias("in_stock"), text("image_url").alias("image_url"), level.alias("availability_level"),
    )


def category_leaves(answers: DataFrame, key: str, column: str = "json", most_depth: int = 8) -> DataFrame:
    """(key, gender, path, node): categories without children in trees of categories, each with its path of names.

    The gender is that of the first ancestor, or the node itself, whose name, sectionName or key names a section. An answer is a
    list of categories; a tree deeper than most_depth stops the run, so no leaf is lost.
    """
    text = lambda path: F.coalesce(F.try_variant_get("_n", path, "string"), F.lit(""))
    named = [F.trim(text("$.name")), text("$.sectionName"), text("$.key")]
    now = answers.select(key, F.explode(F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")).alias("_n"), F.lit(None).cast("string").alias("_g"), F.array().cast("array<string>").alias("_p"))
    leaves = []
    for depth in range(most_depth):
        subs = F.try_variant_get("_n", "$.subcategories", "array<variant>")
        told = now.select(key, "_n", F.coalesce("_g", section_gender(*named)).alias("_g"), F.concat("_p", F.array(named[0])).alias("_p"), subs.alias("_s")).withColumn("_leaf", F.coalesce(F.size("_s"), F.lit(0)) < 1)
        too_deep = F.lit(depth == most_depth - 1) & ~F.col("_leaf")
        path = F.when(too_deep, F.raise_error(F.lit(f"categories deeper than {most_depth}"))).otherwise(F.array_join("_p", " > "))
        kept = told if depth == most_depth - 1 else told.filter("_leaf")
        leaves.append(kept.select(key, F.col("_g").alias("gender"), path.cast("string").alias("path"), F.to_json("_n").alias("node")))
        now = told.filter("not _leaf").select(key, F.explode("_s").alias("_n"), "_g", "_p")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def next_maps(found: DataFrame, seen: DataFrame, most: int = MOST_MAPS) -> DataFrame:
    """The maps to read next of an index's addresses: those not seen, product ones first, as many as the run's limit leaves."""
    left = most - seen.select("url").distinct().count()
    fresh = found.filter("is_index is not null").join(seen.select("url"), "url", "left_anti")
    first = F.contains(F.lower(F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))), F.lit("product"))
    return fresh.orderBy(F.desc(first), "url").limit(max(left, 0))
