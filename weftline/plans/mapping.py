"""Rule-table queries over parts and customers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import mapping as op
from weftline.plans.bind import CATEGORIES, COLOURS, ITEMS_SQL, PATTERNS, items
from weftline.plans.registry import query
from weftline.session import table

#: The pattern that a word in a name stands for, by priority, and the colour group of a word.
KEYWORDS = (("striped", "striped"), ("checked", "checked"), ("small", "printed"), ("blue", "solid"), ("red", "solid"), ("large", "floral"))
GROUPS = {"red": "warm", "blue": "cool", "green": "cool", "black": "neutral"}



def rules(spark, rows, shape):
    return F.broadcast(spark.createDataFrame(list(rows), shape))


@query("WITH n AS (SELECT split_part(p_name, ' ', 1) AS value FROM part) SELECT DISTINCT value FROM n WHERE value NOT IN ('red', 'blue', 'green', 'black')")
def rule_coverage_missing(spark, d):
    words = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))
    return op.uncovered(words, "word", rules(spark, GROUPS.items(), "word string, grp string"), "word")


@query("WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS word FROM part) SELECT p_partkey, word, CASE word WHEN 'red' THEN 'warm' WHEN 'blue' THEN 'cool' WHEN 'green' THEN 'cool' WHEN 'black' THEN 'neutral' END AS grp FROM n")
def rule_map(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))
    return op.map_values(words, rules(spark, GROUPS.items(), "rule string, grp string"), "word", "rule")


@query("SELECT DISTINCT p_type AS value FROM part WHERE p_type NOT IN ('', 'STANDARD', 'SMALL', 'MEDIUM')")
def domain_violations(spark, d):
    return op.outside_domain(table(spark, d, "part"), "p_type", ["STANDARD", "SMALL", "MEDIUM"])


@query("SELECT p_partkey, p_name, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(p_name, '(?i)\\b{w}\\b') THEN '{v}' END" for w, v in KEYWORDS) + ") AS pattern FROM part")
def keyword_pattern(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", op.first_keyword(F.col("p_name"), KEYWORDS).alias("pattern"))


@query("""SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL WHEN p_type = 'PROMO' AND regexp_matches(p_name, '(?i)\\bgadget\\b') THEN 'gift'
  WHEN regexp_matches(p_name, '(?i)\\bwidget\\b') THEN 'tool' ELSE lower(p_type) END AS category FROM part""")
def rule_override_ordered(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    steps = [(op.has_word(name, "widget"), F.lit("tool")), ((kind == "PROMO") & op.has_word(name, "gadget"), F.lit("gift")), (F.col("p_size") > 45, F.lit(None))]
    return table(spark, d, "part").select("p_partkey", op.override(F.lower(kind), steps).alias("category"))


@query("""SELECT p_partkey, CASE WHEN p_size = 7 THEN 'seven' WHEN p_brand = 'Brand#13' THEN 'thirteen' WHEN p_type = 'ECONOMY' THEN 'cheap' ELSE 'other' END AS sub FROM part""")
def rule_override_by_column(spark, d):
    """Each rule names the column that it looks at."""
    steps = (("p_type", "ECONOMY", "cheap"), ("p_brand", "Brand#13", "thirteen"), ("p_size", 7, "seven"))
    return table(spark, d, "part").select("p_partkey", op.override(F.lit("other"), [(F.col(c) == v, F.lit(to)) for c, v, to in steps]).alias("sub"))


@query("""WITH l AS (SELECT p_type AS category, max(p_size) AS max_items, CASE p_partkey % 5 WHEN 0 THEN 'men' WHEN 1 THEN 'women' ELSE '' END AS gender, min(p_partkey) AS line FROM part GROUP BY ALL),
g AS (SELECT * FROM (VALUES ('men'), ('women'), ('')) t(audience)),
r AS (SELECT audience, l.*, row_number() OVER (PARTITION BY audience, category ORDER BY gender <> '' DESC, line DESC) AS turn FROM l JOIN g ON gender IN ('', audience))
SELECT audience, category, max_items, gender FROM r WHERE turn = 1""")
def rule_override_gender(spark, d):
    """The largest size of each type as a limit, told for all and for men and women apart, of which the latter win."""
    gender = F.when(F.col("p_partkey") % 5 == 0, "men").when(F.col("p_partkey") % 5 == 1, "women").otherwise("")
    limits = table(spark, d, "part").groupBy(F.col("p_type").alias("category"), gender.alias("gender")).agg(F.max("p_size").alias("max_items"), F.min("p_partkey").alias("line"))
    parts = [op.gendered(limits, ["category"], g, "line").select(F.lit(g).alias("audience"), "category", "max_items", "gender") for g in ("men", "women", "")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {ITEMS_SQL} SELECT item_id, coalesce(colour, CASE WHEN pattern_conf >= 0.7 THEN sub_category END) AS value,
  CASE WHEN colour IS NOT NULL THEN 'label' WHEN pattern_conf >= 0.7 AND sub_category IS NOT NULL THEN 'estimate' ELSE 'unknown' END AS value_source FROM items""")
def coalesce_provenance(spark, d):
    return op.with_provenance(items(spark, d), "colour", "sub_category", "pattern_conf", 0.7).select("item_id", "value", "value_source")


@query("SELECT p_name, count(*) AS copies FROM part GROUP BY p_name HAVING count(DISTINCT coalesce(p_brand, '')) > 1 OR count(DISTINCT coalesce(p_type, '')) > 1")
def conflict_pictures(spark, d):
    return op.conflicting(table(spark, d, "part"), "p_name", ["p_brand", "p_type"])


@query("""SELECT * FROM (SELECT p_partkey, p_name, p_brand FROM part) SEMI JOIN (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) = 1 AND count(DISTINCT p_type) = 1) USING (p_name)""")
def without_conflicts(spark, d):
    parts = table(spark, d, "part")
    return parts.join(op.conflicting(parts, "p_name", ["p_brand", "p_type"]), "p_name", "left_anti").select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey FROM part WHERE p_size <= 40 AND (p_brand <> 'Brand#11' OR p_brand IS NULL)")
def keep_by_rule(spark, d):
    """Rows whose type is kept and whose usage is not refused: an unknown usage passes."""
    return table(spark, d, "part").filter((F.col("p_size") <= 40) & ~F.col("p_brand").eqNullSafe("Brand#11")).select("p_partkey")


@query(f"""WITH {ITEMS_SQL} SELECT item_id, CASE WHEN coverage >= 4 AND kw IS NOT NULL THEN kw ELSE pattern END AS pattern FROM (
  SELECT *, CASE WHEN regexp_matches(name, '(?i)\\bblue\\b') THEN 'printed' WHEN regexp_matches(name, '(?i)\\bred\\b') THEN 'striped' END AS kw FROM items)""")
def keyword_if_unclear(spark, d):
    """A word in the name counts only where the rule says that the label is unclear."""
    word = op.first_keyword(F.col("name"), (("blue", "printed"), ("red", "striped")))
    return items(spark, d).select("item_id", F.when((F.col("coverage") >= 4) & word.isNotNull(), word).otherwise(F.col("pattern")).alias("pattern"))


@query("""SELECT 'c-' || c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS type FROM customer
UNION ALL SELECT 'p-' || p_partkey, p_name, NULL, p_type FROM part""")
def align_schemas(spark, d):
    """Tables of different columns as one: what a source lacks is null."""
    people = table(spark, d, "customer").select(F.concat(F.lit("c-"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    parts = table(spark, d, "part").select(F.concat(F.lit("p-"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return people.unionByName(parts, allowMissingColumns=True)


@query(f"""WITH {ITEMS_SQL} SELECT item_id, concat_ws('|', CASE WHEN NOT (colour IS NOT NULL) THEN 'colour' END,
  CASE WHEN NOT (pattern_conf >= 0.3) THEN 'confidence' END, CASE WHEN NOT (sub_category <> 'tie' OR category = 'accessory') THEN 'parent' END,
  CASE WHEN NOT (coverage BETWEEN 1 AND 4) THEN 'coverage' END) AS errors FROM items""")
def row_error_list(spark, d):
    checks = {
        "colour": F.col("colour").isNotNull(), "confidence": F.col("pattern_conf") >= 0.3,
        "parent": (F.col("sub_category") != "tie") | (F.col("category") == "accessory"), "coverage": F.col("coverage").between(1, 4),
    }
    return items(spark, d).select("item_id", F.array_join(op.row_errors(checks), "|").alias("errors"))


#: Words of an audience and the gender that they name.
AUDIENCE = {"AUTOMOBILE": "men", "HOUSEHOLD": "women", "BUILDING": "men", "FURNITURE": "unisex"}


@query("SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'men' WHEN 'HOUSEHOLD' THEN 'women' WHEN 'BUILDING' THEN 'men' WHEN 'FURNITURE' THEN 'unisex' END, CASE WHEN c_nationkey < 5 THEN 'women' END, 'unisex') AS gender FROM customer")
def gender_fallback(spark, d):
    """What the label says, else what the second table says, else unisex."""
    from weftline.functions.exprs import looked_up

    return table(spark, d, "customer").select("c_custkey", F.coalesce(looked_up(F.col("c_mktsegment"), AUDIENCE), F.when(F.col("c_nationkey") < 5, "women"), F.lit("unisex")).alias("gender"))


@query("SELECT lower(split_part(p_name, ' ', 1)) AS term, count(DISTINCT p_type) AS meanings FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def term_conflicts(spark, d):
    """Terms that would mean more than one thing."""
    return table(spark, d, "part").groupBy(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term")).agg(F.countDistinct("p_type").alias("meanings")).filter("meanings > 1")


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT category, colour, pattern, coverage * 10 + item_id % 3 AS priority, item_id FROM items)
SELECT category, arg_min(coalesce(pattern, ''), (priority, item_id)) AS pattern, min(coverage) AS coverage, array_to_string(list_sort(list_distinct(list(colour) FILTER (colour IS NOT NULL))), '|') AS colours FROM (SELECT a.*, i.coverage FROM a JOIN items i USING (item_id)) GROUP BY category""")
def min_priority_pattern(spark, d):
    """Of each group the value of the lowest priority, an empty one included; the lowest coverage; and the sorted set."""
    priority = F.struct((F.col("coverage") * 10 + F.col("item_id") % 3).alias("p"), "item_id")
    return items(spark, d).groupBy("category").agg(
        F.min_by(F.coalesce("pattern", F.lit("")), priority).alias("pattern"), F.min("coverage").alias("coverage"), F.array_join(F.array_sort(F.collect_set("colour")), "|").alias("colours")
    )


@query(f"""WITH {ITEMS_SQL}, subs AS (SELECT brand, category, CASE WHEN count(DISTINCT sub_category) = 1 THEN min(sub_category) END AS sub FROM items GROUP BY brand, category)
SELECT brand, category, sub, sub IS NULL AS unknown FROM subs""")
def one_distinct_or_unknown(spark, d):
    """A refinement counts only if all evidence agrees; several values leave it unknown."""
    agreed = F.when(F.countDistinct("sub_category") == 1, F.min("sub_category"))
    return items(spark, d).groupBy("brand", "category").agg(agreed.alias("sub")).withColumn("unknown", F.col("sub").isNull())


@query(f"""WITH {ITEMS_SQL} SELECT item_id, row_number() OVER (PARTITION BY category, coalesce(colour, '') ORDER BY item_id) > 1 AS is_copy, count(*) OVER (PARTITION BY category, coalesce(colour, '')) AS copies FROM items""")
def duplicate_copies(spark, d):
    """A copy is a row that isn't its group's least: an aggregate of each group, joined back, so no group is ordered."""
    rows = items(spark, d).select("item_id", "category", F.coalesce("colour", F.lit("")).alias("colour"))
    groups = rows.groupBy("category", "colour").agg(F.min("item_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return rows.join(groups, ["category", "colour"]).select("item_id", (F.col("item_id") > F.col("first")).alias("is_copy"), "copies")
