"""Secret scans over an incremental ledger of text versions, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import exists, new_path, settle, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; one whose group is under least characters falls.

    The group ends where the match ends; masking takes it alone. sql is the pattern for engines without look-around.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    sql: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: A private key goes to its END, or where that is missing to the end of its headers and base64 lines (quoted, indented or with
#: breaks written as \n). Groups are possessive, as Java recurses into others once a repeat. The SQL form differs in one case: of
#: a key without END it takes a last line of under 16 characters only if that ends in "=".
_BREAK = r"""(?:[\s"',+>|*#]|\\[nrt])"""
_NAMES = r"(?:Proc-Type|DEK-Info|Key-Info|Content-Domain|Version|Comment)"
_BEGIN, _END = (rf"-----{w} (?:[A-Z]+ )*PRIVATE KEY-----" for w in ("BEGIN", "END"))
_PEM = (
    rf"{_BEGIN}(?:[^-]*+(?:-(?!----)[^-]*+)*+{_END}"
    rf"""|(?:{_BREAK}*+{_NAMES}: ?(?:[^\n\\]|\\(?!n))*+)*+(?:{_BREAK}*+[A-Za-z0-9+/=]{{16,}}+)*+(?:{_BREAK}++[A-Za-z0-9+/=]{{1,15}}+(?=[ \t]*+(?:\z|[\r\n"'\\])))?+)"""
)
_PEM_SQL = (
    rf"{_BEGIN}(?:(?:-{{0,4}}[^-])*{_END}"
    rf"|(?:{_BREAK}*{_NAMES}: ?(?:[^\n\\]|\\[^n])*)*(?:{_BREAK}*[A-Za-z0-9+/=]{{16,}})*(?:{_BREAK}+[A-Za-z0-9+/]{{1,14}}=+)?)"
)
#: Further kinds, listed after the base ones.
MORE_RULES = (
    Rule("pem", _PEM, version=2, sql=_PEM_SQL),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Copies of one text may be a third of all paths: they are dealt so many ways where findings meet them.
SALTS = 32
#: Code points of a page: a piece of a text is cut from the pages that it touches, not from the start of the text.
PAGE = 1024


def blob_of(text: Column) -> Column:
    """The address of a text: its SHA-256; null and empty text share one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _cuts(rule: Rule, text: Column) -> Column:
    """Null without a match; else how long each gap before a match, each match and its secret are."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    own = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.length
    return F.when(
        text.rlike(rule.pattern),
        F.struct(
            F.lit(rule.key).alias("rule"),
            F.arrays_zip(
                F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
                F.transform(matches, F.length).alias("len"),
                F.transform(matches, own).alias("own"),
            ).alias("cuts"),
        ),
    )


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Spans (start, rank, end, kind, hide; code points, end exclusive) of blobs (blob, text, pending) that have any.

    hide is where the secret itself starts; it goes to the end.
    Only rules whose key is in pending are tried. A text is cut at its matches once a rule; running sums over the cuts
    give the spans, in one group a text, so a text with a million matches costs time in proportion.
    """
    found = F.array_compact(F.array(*[F.when(F.array_contains("pending", r.key), _cuts(r, F.col("text"))) for r in rules]))
    ranks = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least")))])
    along = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        blobs.select("blob", F.explode(found).alias("f"))
        .select("blob", F.col("f.rule").alias("rule"), F.posexplode("f.cuts").alias("pos", "cut"))
        .filter("cut.len is not null")
        .withColumn("end", F.sum(F.col("cut.gap") + F.col("cut.len")).over(along))
        .filter(F.col("cut.own") >= ranks[F.col("rule")]["least"])
        .select("blob", "rule", F.struct(
            (F.col("end") - F.col("cut.len")).alias("start"), ranks[F.col("rule")]["rank"].alias("rank"), F.col("end"), ranks[F.col("rule")]["kind"].alias("kind"),
            (F.col("end") - F.col("cut.own")).alias("hide"),
        ).alias("span"))
    )


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """One row (blob, text, pending) for each distinct text of versions that the ledger lacks for any rule version."""
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.withColumn("pending", wanted)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    return (
        blobs.join(seen, "blob", "left")
        .withColumn("pending", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        .filter(F.size("pending") > 0)
        .select("blob", "text", "pending")
    )


def extend_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger's new rows for versions (any columns with text): (blob, rule, spans), a row for each pair scanned now.

    Append them to the ledger; versions seen before cost a hash and no scan, and a new rule version scans its rule only.
    """
    todo = unseen_blobs(versions.select(blob_of(F.col("text")).alias("blob"), text_of().alias("text")), ledger, rules)
    found = scan_blobs(todo, rules).groupBy("blob", "rule").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    pairs = todo.select("blob", F.explode("pending").alias("rule"))
    return pairs.join(found, ["blob", "rule"], "left").withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)))


def grow_ledger(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger stored at path, after what versions hold and it lacks has been scanned and appended.

    The first call makes it. A run that fails appends nothing and can be run again; versions and rule versions that are in
    the ledger are not scanned. One writer at a time: two at once would each append what both lack.
    """
    spark = versions.sparkSession
    stored = spark.read.parquet(path) if exists(spark, path) else None
    extend_ledger(versions, stored, rules).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _found(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, spans) of the blobs in which the ledger has any span of rules."""
    current = ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    return current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def _meet(versions: DataFrame, found: DataFrame) -> DataFrame:
    """(row, blob, and found's columns, null where found lacks the blob): versions' columns are inside row, so that no name clashes.

    Each blob of found is dealt SALTS ways to meet the copies of a text, which may be very many. Both sides are shuffled: found
    grows with the corpus, and its estimated size leaves out the salts, so Spark's own choice would broadcast far over its threshold.
    """
    paths = versions.select(F.struct("*").alias("row"), blob_of(F.col("text")).alias("blob"), F.pmod(F.xxhash64(*versions.columns), F.lit(SALTS)).cast("int").alias("salt"))
    return paths.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["blob", "salt"], "left").drop("salt")


def findings_by_path(versions: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """versions with blob and spans (array, empty if clean): what the ledger and a scan of the rest say of each path.

    Copies of a text are scanned once and share its findings; each row of versions comes back once, with its columns, but
    for own columns called blob or spans, which are replaced. Null text is empty text; an empty table gives none. A text's
    matches are one group, however long it is. Spans of one start go by the order of rules.
    """
    own = extend_ledger(versions, ledger, rules)
    whole = own if ledger is None else own.unionByName(ledger.select(*own.columns))
    return _with_spans(versions, whole, rules)


def _with_spans(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    found = _found(ledger, rules)
    none = F.array().cast(found.schema["spans"].dataType)
    kept = [f"row.`{c}`" for c in versions.columns if c not in ("blob", "spans")]
    return _meet(versions, found).select(*kept, "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _stretches(found: DataFrame) -> DataFrame:
    """(blob, kept, tail): the stretches (from, to) before each masked one, and where the last masked one ends.

    Overlapping and touching secrets are masked as one.
    """
    before = Window.partitionBy("blob").orderBy("span.hide", "span.end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("blob", F.explode("spans").alias("span")).withColumn("before", F.coalesce(F.max("span.end").over(before), F.lit(-1)))
    kept = F.when(F.col("span.hide") > F.col("before"), F.struct(F.greatest("before", F.lit(0)).alias("from"), F.col("span.hide").alias("to")))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(kept)).alias("kept"), F.max("span.end").alias("tail"))


def masked(text: Column, kept: Column, tail: Column, mask: str) -> Column:
    """text of which the stretches kept and what follows tail stay, with mask after each stretch; in time linear in the text."""

    def piece(pages: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PAGE).cast("int")
        near = F.array_join(F.slice(pages, first + 1, F.floor(end / PAGE).cast("int") - first + 1), "")
        return F.substr(near, (start - first * PAGE + 1).cast("int"), (end - start).cast("int"))

    pages = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0))
    cut = F.transform(F.array(pages), lambda ps: F.concat(
        F.array_join(F.transform(kept, lambda k: F.concat(piece(ps, k["from"], k["to"]), F.lit(mask))), ""), piece(ps, tail, F.length(text)),
    ))
    return cut[0]


def mask_found(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None, mask: str = "[REDACTED]") -> DataFrame:
    """docs, with its columns, whose texts with findings are masked and n_chars, if there, set anew.

    The spans of the ledger say what is masked: of an assignment its value, of a private key the whole key, else the match.
    Without a ledger, docs are scanned first. Null and clean texts and all other columns stay as they are; copies of a row come
    back each, an empty table empty. The ledger must cover docs.
    """
    whole = settle(extend_ledger(docs, None, rules), "ledger") if ledger is None else ledger
    met = _meet(docs, settle(_stretches(_found(whole, rules)), "stretches"))
    swap = {"text": F.when(F.col("tail").isNull(), F.col("row.text")).otherwise(masked(F.col("row.text"), F.col("kept"), F.col("tail"), mask))}
    met = met.select("row", "tail", swap["text"].alias("text"))
    if "n_chars" in docs.columns:
        swap["n_chars"] = F.when(F.col("tail").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    swap["text"] = F.col("text")
    return met.select(*[swap[c].alias(c) if c in swap else F.col(f"row.`{c}`") for c in docs.columns])


def op1_secret_scans(spark, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    """Counts and spans of secrets of each document, from the ledger at ledger_path once it covers the documents.

    Without a path a new ledger is made in the shared folder, so all texts are unseen; with one, only what it lacks is scanned.
    Null text is empty; copies of a row come back each; no row is dropped.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = grow_ledger(docs, ledger_path or new_path(spark, "ledger"))
    rows = _with_spans(docs, ledger, RULES)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [count_of(r.kind) for r in RULES]
    return rows.select("doc_id", *counts[:3], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *counts[3:])


def _scan_sql(rank: int, rule: Rule) -> str:
    """Spans of one rule in DuckDB, cut and summed as scan_blobs() does."""
    quoted = (rule.sql or rule.pattern).replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, stop - len AS start, stop FROM (
      SELECT doc_id, m, length(m) AS len, sum(length(gap) + length(m)) OVER (PARTITION BY n ORDER BY pos) AS stop FROM (
        SELECT doc_id, n, unnest(regexp_extract_all(text, '{quoted}')) AS m, unnest(regexp_split_to_array(text, '{quoted}')) AS gap, generate_subscripts(regexp_split_to_array(text, '{quoted}'), 1) AS pos
        FROM docs WHERE regexp_matches(text, '{quoted}')) WHERE m IS NOT NULL)
      WHERE length(regexp_extract(m, '{quoted}', {rule.group})) >= {rule.least}"""


OP1_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
spans AS ({" UNION ALL ".join(_scan_sql(i, r) for i, r in enumerate(RULES))}),
listed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < {len(BASE_RULES)}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed USING (doc_id)
"""
