"""Scoring of answers against labelled cases: each kind of check is one expression, and a case's data says which count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.texts import detect_language

#: What a case may ask for; what it leaves out is null and isn't checked.
CHECKS = (
    "tools_any array<string>, no_tools boolean, forbid_tools array<string>, min_pieces int, max_pieces int, forbid_pieces array<map<string,string>>, "
    "reply_lang string, forbid_patterns array<string>, handoff boolean, max_questions int"
)
CASES = f"id string, split string, message string, expected string, acceptable_agents array<string>, checks struct<{CHECKS.replace(' ', ':').replace(',:', ',')}>"


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))


def _when(fails: Column, *text: Column | str) -> Column:
    """One line where fails, none where not or unknown."""
    return F.when(F.coalesce(fails, F.lit(False)), F.array(F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))).otherwise(F.array().cast("array<string>"))


def _each(values: Column, fails: Callable[[Column], Column], text: Callable[[Column], Column]) -> Column:
    """A line for each of a case's values that fails."""
    return F.coalesce(F.transform(F.filter(values, lambda v: F.coalesce(fails(v), F.lit(False))), text), F.array().cast("array<string>"))


def _matches(piece: Column, rule: Column) -> Column:
    return F.forall(F.map_entries(rule), lambda e: F.lower(F.coalesce(piece[e["key"]], F.lit(""))) == F.lower(e["value"]))


def _counted(text: Column, what: str) -> Column:
    return F.regexp_count(text, F.lit(what))


def failed_checks() -> Column:
    """The lines of all checks that fail, in a fixed order, from the columns status, answer, message, tools, handoff, unknown_refs, pieces and checks.

    An answer that didn't come (status not 200) fails by that alone. An empty answer, and piece numbers that no tool showed, always fail: numbers
    that stand in the message are an echo, the rest is made up.
    """
    check = lambda name: F.col(f"checks.{name}")
    answer, tools = F.coalesce("answer", F.lit("")), F.coalesce("tools", F.array().cast("array<string>"))
    pieces = F.coalesce("pieces", F.array().cast("array<map<string,string>>"))
    called = F.when(F.size(tools) > 0, _list(tools)).otherwise("no tool")
    typed = F.transform(F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda n: n.try_cast("bigint"))
    refs = F.transform(F.coalesce("unknown_refs", F.array().cast("array<int>")), lambda n: n.cast("bigint"))
    echoed = F.filter(refs, lambda r: F.array_contains(typed, r))
    invented = F.filter(refs, lambda r: ~F.array_contains(typed, r))
    told = detect_language(answer)
    questions = _counted(answer, r"[?؟]")
    lines = [
        _when(F.trim(answer) == "", "empty answer"),
        _when(F.size(invented) > 0, "invented piece numbers ", _list(invented)),
        _when(F.size(echoed) > 0, "wrote the user's number(s) ", _list(echoed), " as pieces"),
        _when(~F.arrays_overlap(check("tools_any"), tools), "expected one of ", _list(check("tools_any")), ", called ", called),
        _when(check("no_tools") & (F.size(tools) > 0), "expected no tool, called ", called),
        _each(check("forbid_tools"), lambda t: F.array_contains(tools, t), lambda t: F.concat(F.lit("called forbidden tool "), t)),
        _when(F.size(pieces) < check("min_pieces"), "showed ", F.size(pieces).cast("string"), " pieces, expected at least ", check("min_pieces").cast("string")),
        _when(F.size(pieces) > check("max_pieces"), "showed ", F.size(pieces).cast("string"), " pieces, expected at most ", check("max_pieces").cast("string")),
        _each(check("forbid_pieces"), lambda rule: F.exists(pieces, lambda p: _matches(p, rule)), lambda rule: F.concat(F.lit("showed a piece matching "), F.to_json(rule))),
        _when(told != check("reply_lang"), "answered in ", told, ", expected ", check("reply_lang")),
        _each(check("forbid_patterns"), lambda p: F.regexp_like(answer, F.concat(F.lit("(?is)"), p)), lambda p: F.concat(F.lit("answer matches forbidden pattern "), p)),
        _when(check("handoff") & ~F.coalesce("handoff", F.lit(False)), "expected a handoff"),
        _when(~check("handoff") & F.coalesce("handoff", F.lit(False)), "handed over, expected no handoff"),
        _when(questions > check("max_questions"), questions.cast("string"), " question marks, at most ", check("max_questions").cast("string")),
    ]
    failed = F.array(F.concat(F.lit("http "), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
    return F.when(F.col("status").eqNullSafe(200), F.concat(*lines)).otherwise(failed)


def scored(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """answers (id, status, answer, tools, handoff, unknown_refs, pieces) of known cases with the case's message and fails (an array; none: passed)."""
    own = cases.select("id", F.col("message"), "checks")
    return answers.drop("message", "checks").join(own, "id").withColumn("fails", failed_checks()).drop("checks")
