"""Text and page queries over documents, pages and conversations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import texts as fn
from weftline.functions.exprs import fnv1a32, set_key
from weftline.operators import quiz
from weftline.plans.registry import query
from weftline.session import table

_FOLD = f"regexp_replace(translate(lower(coalesce(text, '')), '{fn.ACCENTED}{fn.ARABIC_FROM}', '{fn.PLAIN}{fn.ARABIC_TO[:2]}''' ), '[\\x{{300}}-\\x{{36f}}\\x{{64b}}-\\x{{652}}\\x{{640}}]', '', 'g')"
_IN = lambda ws: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"""WITH w AS (SELECT doc_id, lower(coalesce(text, '')) AS low, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, length(regexp_replace(text, '[^\\pL]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\x{{600}}-\\x{{6ff}}]', '', 'g')) AS arabic,
  len(list_filter(regexp_extract_all(low, '[a-zàâçéèêëîïôûùüÿœ'']+'), lambda x: x IN {_IN(fn.FR_WORDS)})) + 2 * len(regexp_extract_all(low, '{fn.FRENCH_ACCENTS}')) AS fr,
  len(list_filter(regexp_extract_all(low, '[a-zàâçéèêëîïôûùüÿœ'']+'), lambda x: x IN {_IN(fn.EN_WORDS)})) AS en FROM w)
SELECT doc_id, CASE WHEN letters = 0 THEN 'unknown' WHEN arabic / letters > 0.3 THEN 'ar' WHEN fr = 0 AND en = 0 THEN 'unknown' WHEN fr > en THEN 'fr' ELSE 'en' END AS lang FROM c""")
def lang_detect(spark, d):
    return docs(spark, d).select("doc_id", fn.detect_language(F.col("text")).alias("lang"))


@query(f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all({_FOLD}, '[\\pL\\pN]+(?:[''-][\\pL\\pN]+)*'), lambda x: regexp_replace(x, '^[ld]''', '')) AS w FROM documents)
SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, sha256(array_to_string(w, ' ')) AS digest FROM w""")
def text_words(spark, d):
    found = fn.words(fn.fold(F.col("text")))
    return docs(spark, d).withColumn("w", found).select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("digest"))


@query(f"WITH f AS (SELECT doc_id, {_FOLD} AS t FROM documents) SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, '\\b{b}') THEN '{b}' END" for b in fn.BRANDS) + ") AS brand FROM f")
def brand_claim(spark, d):
    return docs(spark, d).select("doc_id", fn.claimed_brand(fn.fold(F.col("text"))).alias("brand"))


@query()
def condition_grade(spark, d):
    """Lookarounds keep this from SQL; the tests hold it against plain Python."""
    folded = docs(spark, d).select("doc_id", fn.fold(F.col("text")).alias("t"))
    return folded.select("doc_id", fn.undenied(F.col("t")).alias("t")).select("doc_id", fn.graded(F.col("t")).alias("condition"))


#: Phrases of the generated tables and what they stand for in a search.
TERMS = {"de la": "from", "en la": "in", "que": "what", "der": "one", "los": "they", "de la que": "whose", "die": "those"}


@query()
def query_terms(spark, d):
    """Each turn of a conversation as a picture search: phrases by the longest first, which is a fold and not SQL."""
    said = table(spark, d, "conversations").withColumn("w", fn.words(fn.fold(F.coalesce("text", F.lit("")))))
    return said.select("conv_id", "turn", fn.photo_query(F.col("w"), TERMS).alias("asked"))


@query("""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS links, regexp_extract(html, '(?i)<html[^>]*\\slang="([a-z-]+)"', 1) AS lang,
  array_to_string(list_distinct(list_sort(regexp_extract_all(html, '(?i)<h([1-6])[\\s>]', 1))), '') AS levels FROM pages""")
def page_title_links(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href=")).cast("long").alias("links"),
        F.regexp_extract(html, r'(?i)<html[^>]*\slang="([a-z-]+)"', 1).alias("lang"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])[\s>]"), F.lit(1)))), "").alias("levels"),
    )


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) || coalesce(nullif(regexp_extract(url, '(\\?[^#]*)', 1), ''), '') AS page FROM pages")
def page_ids(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), fn.page_id(url).alias("page"))


@query("SELECT o_orderkey, CASE WHEN length(whole) > 3 THEN whole[:-4] || '.' || whole[-3:] ELSE whole END || ',' || cents || ' TND' AS shown, round((whole || '.' || cents)::DOUBLE, 2) AS price FROM (SELECT o_orderkey, (floor(o_totalprice)::BIGINT % 1000000)::VARCHAR AS whole, lpad((o_orderkey % 100)::VARCHAR, 2, '0') AS cents FROM orders)")
def dinar_prices(spark, d):
    whole = (F.floor("o_totalprice") % 1000000).cast("string")
    grouped = F.when(F.length(whole) > 3, F.concat(F.substr(whole, F.lit(1), F.length(whole) - 3), F.lit("."), F.right(whole, F.lit(3)))).otherwise(whole)
    shown = F.concat(grouped, F.lit(","), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit(" TND"))
    return table(spark, d, "orders").select("o_orderkey", shown.alias("shown")).withColumn("price", F.round(fn.dinars(F.col("shown")), 2))


@query("SELECT conv_id, turn, CASE WHEN best = 0 THEN NULL WHEN a = best THEN 'stylist' WHEN b = best THEN 'seller' ELSE 'analyst' END AS agent FROM (SELECT *, greatest(a, b, c) AS best FROM (SELECT conv_id, turn, contains(lower(text), 'the')::INT + contains(lower(text), 'wear')::INT AS a, contains(lower(text), ' de ')::INT + contains(lower(text), 'price')::INT AS b, contains(lower(text), 'ing')::INT + contains(lower(text), ' der ')::INT AS c FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)))")
def keyword_router(spark, d):
    agents = {"stylist": ("the", "wear"), "seller": (" de ", "price"), "analyst": ("ing", " der ")}
    return table(spark, d, "conversations").select("conv_id", "turn", fn.route(F.coalesce("text", F.lit("")), agents).alias("agent"))


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, concat_ws('|', CASE WHEN length(text) > 400 THEN 'too_long' END, CASE WHEN len(regexp_extract_all(text, '\\?')) > 1 THEN 'questions' END, CASE WHEN regexp_matches(text, '(?i)\\bthat\\b') THEN 'forbidden' END, CASE WHEN role = 'assistant' AND text = '' THEN 'empty' END) AS fails FROM c""")
def quiz_scoring(spark, d):
    """The checks that an answer fails, in order."""
    text = F.coalesce("text", F.lit(""))
    fails = F.concat_ws("|", F.when(F.length(text) > 400, "too_long"), F.when(F.regexp_count(text, F.lit(r"\?")) > 1, "questions"), F.when(text.rlike(r"(?i)\bthat\b"), "forbidden"), F.when((F.col("role") == "assistant") & (text == ""), "empty"))
    return table(spark, d, "conversations").select("conv_id", "turn", fails.alias("fails"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, conv_id % 5 AS kind, turn % 3 = 0 AS handed FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, coalesce(CASE WHEN conv_id % 7 = 6 THEN 'http 500' ELSE nullif(concat_ws('|', CASE WHEN trim(text) = '' THEN 'empty answer' END, CASE WHEN turn % 4 = 1 THEN 'invented piece numbers [' || (conv_id + 1000000) || ']' END,
  CASE WHEN kind = 0 AND turn % 2 = 0 THEN 'expected no tool, called [search]' END, CASE WHEN kind = 1 AND turn % 2 = 0 THEN 'called forbidden tool search' END,
  CASE WHEN kind = 2 AND regexp_matches(text, '(?is)\\bthat\\b') THEN 'answer matches forbidden pattern \\bthat\\b' END, CASE WHEN kind = 3 AND handed THEN 'handed over, expected no handoff' END,
  CASE WHEN kind = 4 AND len(regexp_extract_all(text, '[?]')) > 0 THEN len(regexp_extract_all(text, '[?]')) || ' question marks, at most 0' END), '') END, '') AS fails FROM c""")
def quiz_checks(spark, d):
    """Assistant turns as answers, scored by what the case of their conversation asks for."""
    talk = table(spark, d, "conversations")
    kind = F.col("conv_id") % 5
    checks = {
        "tools_any": F.lit(None), "no_tools": F.when(kind == 0, True), "forbid_tools": F.when(kind == 1, F.array(F.lit("search"))), "min_pieces": F.lit(None), "max_pieces": F.lit(None), "forbid_pieces": F.lit(None),
        "reply_lang": F.lit(None), "forbid_patterns": F.when(kind == 2, F.array(F.lit(r"\bthat\b"))), "handoff": F.when(kind == 3, False), "max_questions": F.when(kind == 4, 0),
    }
    types = dict(c.split(" ", 1) for c in quiz.CHECKS.split(", "))
    cases = talk.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("id"), F.lit("wear 7").alias("message"), F.struct(*[c.cast(types[n]).alias(n) for n, c in checks.items()]).alias("checks"))
    answers = talk.filter("role = 'assistant'").select(
        F.col("conv_id").cast("string").alias("id"), "conv_id", "turn", F.when(F.col("conv_id") % 7 == 6, 500).otherwise(200).alias("status"), F.col("text").alias("answer"),
        F.when(F.col("turn") % 2 == 0, F.array(F.lit("search"))).alias("tools"), (F.col("turn") % 3 == 0).alias("handoff"),
        F.when(F.col("turn") % 4 == 1, F.array((F.col("conv_id") + 1000000).cast("int"))).alias("unknown_refs"), F.lit(None).cast("array<map<string,string>>").alias("pieces"),
    )
    return quiz.scored(answers, cases).select("conv_id", "turn", F.array_join("fails", "|").alias("fails"))


@query(r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || ' {' || turn || '} or {' || (conv_id % 9 + 20) || '} , {' || (conv_id % 3 + 40) || '}.' AS text, conv_id % 9 + 20 AS b, conv_id % 3 + 40 AS e FROM conversations),
k AS (SELECT *, turn % 2 = 0 AS known, conv_id % 3 = 1 AS typed FROM c),
r AS (SELECT *, replace(replace(replace(text, '{' || turn || '}', CASE WHEN known THEN '<' || turn || '>' ELSE '' END), '{' || b || '}', ''), '{' || e || '}', CASE WHEN typed THEN e::VARCHAR ELSE '' END) AS t FROM k)
SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace(replace(t, '<' || turn || '>', '{' || turn || '}'), '[ \t]{2,}', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g'), '^\s+|\s+$', '', 'g')) AS text, CASE WHEN known THEN [turn::BIGINT] ELSE []::BIGINT[] END AS used,
  list_distinct(list_concat(CASE WHEN NOT known THEN [turn::BIGINT] ELSE []::BIGINT[] END, [b::BIGINT])) <> [] AS dropped, CASE WHEN typed THEN [e::BIGINT] ELSE []::BIGINT[] END AS echoed FROM r""")
def placeholder_texts(spark, d):
    """Turns that name three pieces: one that may be known, one that nobody knows, and one whose number the user may have typed."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" {"), F.col("turn").cast("string"), F.lit("} or {"), (F.col("conv_id") % 9 + 20).cast("string"), F.lit("} , {"), (F.col("conv_id") % 3 + 40).cast("string"), F.lit("}."))
    known = F.when(F.col("turn") % 2 == 0, F.array(F.col("turn").cast("int")))
    told = table(spark, d, "conversations").select("conv_id", "turn", fn.resolve_placeholders(text, known, F.lit("not 41")).alias("t"))
    return told.select("conv_id", "turn", F.sha2(F.col("t.text").cast("binary"), 256).alias("text"), F.col("t.used").alias("used"), (F.size("t.unknown") > 0).alias("dropped"), F.col("t.echoed").alias("echoed"))


@query("SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS ref FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations)")
def reference_ledger(spark, d):
    """Numbers dealt to what a conversation names, in the order in which it is first named."""
    first = F.min("turn").over(Window.partitionBy("conv_id", "role"))
    return table(spark, d, "conversations").select("conv_id", "turn", first.alias("first")).withColumn("ref", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first"))).drop("first")


@query("""WITH RECURSIVE k AS (SELECT l_orderkey AS outfit_id, array_to_string(list_sort(list_distinct(list(l_partkey::VARCHAR))), '|') AS key FROM lineitem GROUP BY 1),
h(outfit_id, key, i, h) AS (SELECT outfit_id, key, 0, 2166136261::BIGINT FROM k UNION ALL SELECT outfit_id, key, i + 1, ((xor(h, ascii(key[i + 1])::BIGINT))::HUGEINT * 16777619 % 4294967296)::BIGINT FROM h WHERE i < length(key))
SELECT outfit_id, key AS outfit_key, h AS serial FROM h WHERE i = length(key)""")
def group_serial(spark, d):
    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("outfit_id")).agg(set_key(F.collect_set(F.col("l_partkey").cast("string"))).alias("outfit_key"))
    return sets.withColumn("serial", fnv1a32(F.col("outfit_key")))


@query("""SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Africa/Tunis', '%Y-%m-%d') AS day, CASE WHEN value >= 24 THEN 'summer' WHEN value < 14 THEN 'winter' ELSE 'mid-season' END AS season FROM events""")
def local_day_season(spark, d):
    """The day in Tunis and the season that a felt temperature stands for."""
    season = F.when(F.col("value") >= 24, "summer").when(F.col("value") < 14, "winter").otherwise("mid-season")
    return table(spark, d, "events").select("event_id", F.date_format(F.from_utc_timestamp("ts", "Africa/Tunis"), "yyyy-MM-dd").alias("day"), season.alias("season"))


@query(r"""SELECT p_partkey, CASE WHEN length(c) <= 24 THEN c ELSE substring(c, 1, 23) || '…' END AS cell FROM (SELECT p_partkey, replace(trim(regexp_replace(p_name || ' | ' || p_brand, '\s+', ' ', 'g')), '|', '\|') AS c FROM part)""")
def table_cells(spark, d):
    """Names and brands as cells of a table."""
    return table(spark, d, "part").select("p_partkey", fn.cell(F.concat_ws(" | ", "p_name", "p_brand"), 24).alias("cell"))
