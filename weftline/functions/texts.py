"""Text functions as expressions: folding, words, query terms, languages, brands, conditions, prices and placeholders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented Latin letters and what they fold to, and two Arabic letters that are mixed up.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
ARABIC_FROM, ARABIC_TO = "ىة’", "يه'"
ARTICLES = ("a", "an", "the", "le", "la", "les", "un", "une", "des")
FR_WORDS = (
    "le", "la", "les", "un", "une", "des", "et", "est", "tu", "ton", "ta", "tes", "avec", "pour", "pas", "que", "qui", "je", "de", "du", "dans", "sur", "ce", "cette",
    "vous", "votre", "mais", "ou", "aussi", "bien", "très", "tenue", "porter", "jupe", "robe", "veste", "chaussures", "aujourd'hui",
)
EN_WORDS = (
    "the", "a", "an", "and", "is", "you", "your", "with", "for", "not", "that", "it", "to", "of", "in", "on", "this", "are", "can", "what", "today", "wear", "skirt",
    "dress", "jacket", "shoes", "would",
)
FRENCH_ACCENTS = "[àâçéèêëîïôûùüœ]"
BRANDS = (
    "nike", "adidas", "zara", "h&m", "lacoste", "louis vuitton", "gucci", "chanel", "dior", "prada", "guess", "tommy", "ralph lauren", "puma", "new balance", "levi",
    "north face", "stone island", "mango", "bershka", "pull&bear", "massimo dutti", "michael kors", "calvin klein", "hugo boss", "versace", "balenciaga", "jordan",
    "converse", "vans", "timberland", "skechers", "reebok", "fila", "kappa", "under armour", "longchamp",
)
# Fixed value: words by which an ad claims that its brand is real.
ORIGINAL = r"\b(original(e|es|s)?|authentique(s)?|orijinal|vrai(e|es|s)?|100 ?%)"
# What a condition is told by, first match first, once what denies a fault is gone.
DENIED = r"(aucun(e)?|sans|pas de|zero|0|ni)\s+(\w+\s+){0,2}(defauts?|taches?|trous?|rayures?|egratinures?)"
NOT_WORN = r"porte[- ](cles?|monnaie|cartes?|feuilles?|documents?)"
CONDITIONS = (
    ("defect", r"\b(defauts?|taches?|tache[es]?|trous?|troue[es]?|dechire[es]?|decolore[es]?|delave[es]?|abime[es]?|reprise|egratinures?|rayures?)\b"),
    ("new_tags", r"(avec (l'|les |une |des |son |sa )?etiquettes?|jamais (porte|utilise|mis)e?s?|never worn|with tags|sous emballage|dans (sa|son) (boite|emballage)|avec (son|sa) (boite|packaging))"),
    ("like_new", r"(comme neu(f|fs|ve|ves)|presque neu(f|fs|ve|ves)|quasi neu(f|fs|ve|ves)|tres bon(ne)? etat|excellent etat|etat impeccable|impeccable|(porte|utilise|mis)e?s? (une seule|une|1|deux|2)( seule)? fois|(tres|trop) peu(x)? (porte|utilise)|peu (porte|utilise)|a peine (porte|utilise)|(porte|utilise)e?s? (2|deux) ou (3|trois))"),
    ("new", r"(\betat neuf\b|\bneu(f|fs|ve|ves)\b|\bbrand new\b|\bjdid(a)?\b|جديد)"),
    ("good", r"(\bbon(ne)? etat\b|\bndhif(a)?\b|نظيف)"),
    ("used", r"((?<![a-z-])(porte|utilise)(e|es|s)?(?![-a-z])(?! a la main| a l'epaule| a l epaule)|\buse(e|es|s)?\b|\bmest3mel\b|\bmsta3mel\b|مستعمل|\bused\b|\busage\b)"),
)
#: Of each of these patterns, plain parts of which every match holds one.
DENIED_PARTS = ("defaut", "tache", "trou", "rayure", "egratinure")
CONDITION_PARTS = {
    "defect": ("defaut", "tache", "trou", "dechire", "decolore", "delave", "abime", "reprise", "egratinure", "rayure"),
    "new_tags": ("etiquette", "jamais ", "never worn", "with tags", "emballage", "boite", "packaging"),
    "like_new": ("neuf", "neuve", " etat", "impeccable", " fois", "peu porte", "peu utilise", "peux porte", "peux utilise", "a peine ", " ou "),
    "new": ("neuf", "neuve", "brand new", "jdid", "جديد"),
    "good": (" etat", "ndhif", "نظيف"),
    "used": ("porte", "utilise", "use", "mest3mel", "msta3mel", "مستعمل", "usage"),
}

#: Words of section names.
GENDER_WORDS = {
    "women": ("woman", "women", "femme", "femmes", "mujer", "ella", "نساء", "امرأة"),
    "men": ("man", "men", "homme", "hommes", "hombre", "él", "رجال", "رجل"),
}


def fold(text: Column) -> Column:
    """Lower case without Latin accents, Arabic marks or the stretching line; œ and ligatures stay: see fold_all."""
    out = F.translate(F.lower(text), ACCENTED + ARABIC_FROM, PLAIN + ARABIC_TO)
    return F.regexp_replace(out, "[̀-ًͯ-ْـ]", "")


@F.pandas_udf(T.StringType())
def fold_all(texts: pd.Series) -> pd.Series:
    """The full fold by compatibility decomposition, for the scripts that a table can't list."""
    table = str.maketrans(dict(zip(ARABIC_FROM, ARABIC_TO, strict=True)) | {"ـ": None})

    def one(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)).translate(table)

    return texts.map(one, na_action="ignore")


def words(folded: Column) -> Column:
    """Words of a folded text, with inner apostrophes and hyphens; the French elisions l' and d' go."""
    found = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+(?:['\-][\p{L}\p{N}]+)*"), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, "^[ld]'", ""))


def in_english(tokens: Column, terms: dict[str, str], longest: int = 4) -> Column:
    """tokens with known phrases, longest first, in English, articles gone: a left fold that skips what a phrase has taken."""
    table = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("skip"))

    def step(state: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<en:string,n:int>")
        for n in range(1, longest + 1):
            phrase = F.when(i + n <= F.size(tokens) + 1, F.array_join(F.slice(tokens, i, n), " "))
            bare = F.when(phrase.startswith("ال"), F.substr(phrase, F.lit(3)))
            english = F.coalesce(table[phrase], table[bare])
            found = F.when(english.isNotNull(), F.struct(english.alias("en"), F.lit(n).alias("n"))).otherwise(found)
        token = F.element_at(tokens, i)
        plain = F.when(token.isin(*ARTICLES, "ال"), state["kept"]).otherwise(F.concat(state["kept"], F.array(token)))
        taken = F.struct(F.concat(state["kept"], F.array(found["en"])).alias("kept"), (found["n"] - 1).alias("skip"))
        left = F.struct(plain.alias("kept"), F.lit(0).alias("skip"))
        skipped = F.struct(state["kept"].alias("kept"), (state["skip"] - 1).alias("skip"))
        return F.when(state["skip"] > 0, skipped).when(found.isNotNull(), taken).otherwise(left)

    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))
    kept = F.aggregate(places, start, step)["kept"]
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def photo_query(tokens: Column, terms: dict[str, str]) -> Column:
    """What the picture search is asked for; empty for no words."""
    return F.when(F.size(tokens) > 0, F.concat(F.lit("a photo of "), F.array_join(in_english(tokens, terms), " "))).otherwise("")


def detect_language(text: Column) -> Column:
    """ar from 30 % Arabic letters on, else fr or en by stop words (French accents count double), else unknown."""
    count = lambda of, pattern: F.regexp_count(of, F.lit(pattern))
    letters, arabic = count(text, r"\p{L}"), count(text, "[؀-ۿ]")
    low = F.lower(text)
    inside = "[a-zàâçéèêëîïôûùüÿœ']"
    whole = lambda names: f"(?<!{inside})(?:{'|'.join(names)})(?!{inside})"
    fr, en = count(low, whole(FR_WORDS)) + 2 * count(low, FRENCH_ACCENTS), count(low, whole(EN_WORDS))
    return F.when(letters == 0, "unknown").when(arabic / letters > 0.3, "ar").when((fr == 0) & (en == 0), "unknown").when(fr > en, "fr").otherwise("en")


def claimed_brand(folded: Column) -> Column:
    """The first brand of the list that starts at a word; null for none."""
    return F.coalesce(*[F.when(folded.rlike(rf"\b{b}"), F.lit(b)) for b in BRANDS])


def claims_original(folded: Column) -> Column:
    """Whether a folded text says that the piece is an original."""
    return folded.rlike(ORIGINAL)


def _names_one(text: Column, parts: tuple[str, ...]) -> Column:
    out = text.contains(parts[0])
    for p in parts[1:]:
        out |= text.contains(p)
    return out


def undenied(folded: Column) -> Column:
    """A folded text without what denies a fault and without names of things that are no worn clothes."""
    told = F.when(_names_one(folded, DENIED_PARTS), F.regexp_replace(folded, DENIED, " ")).otherwise(folded)
    return F.when(folded.contains("porte"), F.regexp_replace(told, NOT_WORN, " ")).otherwise(told)


def graded(told: Column) -> Column:
    """The condition that a text of undenied() tells. A pattern is only searched for where one of its parts stands."""
    out = F.lit("no mention")
    for name, pattern in reversed(CONDITIONS):
        out = F.when(_names_one(told, CONDITION_PARTS[name]) & told.rlike(pattern), name).otherwise(out)
    return out


def condition(folded: Column) -> Column:
    return graded(undenied(folded))


def dinars(text: Column, strict: bool = True) -> Column:
    """The number in a price like 1.299,99 TND, 59.900 TND or 59.9 DT: with a comma, dots part thousands, else the dot is the decimal point.

    Null for no text or no number. A price in another currency is never guessed: it stops the query, or is null unless strict.
    """
    ours = F.upper(text).rlike("TND|DT")
    value = F.regexp_extract(text, r"([0-9.,]+)", 1)
    number = F.when(F.instr(value, ",") > 0, F.regexp_replace(F.regexp_replace(value, r"\.", ""), ",", ".")).otherwise(value)
    other = F.raise_error(F.concat(F.lit("not a price in dinars: "), text)).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.coalesce(text, F.lit("")) == "", None).when(~ours, other).when(value != "", number.try_cast("double"))


def page_id(url: Column) -> Column:
    """Path and query of an address."""
    query = F.parse_url(url, F.lit("QUERY"))
    return F.concat(F.parse_url(url, F.lit("PATH")), F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""))


def resolve_placeholders(text: Column, known: Column, message: Column | None = None) -> Column:
    """(text, used, unknown, echoed): text in which {n} stays if n is known, becomes plain n if it stands in the user's message, and is dropped otherwise.

    The lists are in order of first appearance, without repeats. Where something was dropped, the gaps are tidied: runs of blanks become one, and
    none is left before a point, comma, colon, question or exclamation mark.
    """
    typed = F.transform(F.regexp_extract_all(F.coalesce(message, F.lit("")) if message is not None else F.lit(""), F.lit("[0-9]+"), F.lit(0)), lambda n: n.try_cast("bigint"))
    own = F.transform(F.coalesce(known, F.array().cast("array<int>")), lambda k: k.cast("bigint"))
    parts = F.split(text, r"\{[0-9]+\}", -1)
    refs = F.transform(F.regexp_extract_all(text, F.lit(r"\{([0-9]+)\}"), F.lit(1)), lambda n: n.try_cast("bigint"))
    of = lambda kind: F.array_distinct(F.filter(refs, kind))
    is_known, is_typed = lambda r: F.array_contains(own, r), lambda r: F.array_contains(typed, r)
    used, echoed = of(is_known), of(lambda r: ~is_known(r) & is_typed(r))
    unknown = of(lambda r: F.coalesce(~is_known(r) & ~is_typed(r), F.lit(True)))
    shown = F.transform(refs, lambda r: F.when(is_known(r), F.concat(F.lit("{"), r.cast("string"), F.lit("}"))).when(is_typed(r), r.cast("string")).otherwise(""))
    whole = F.array_join(F.zip_with(parts, shown, lambda p, k: F.concat(p, F.coalesce(k, F.lit("")))), "")
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, "[ \\t]{2,}", " "), r"\s+([.,;:!?])", "$1"), r"^\s+|\s+$", "")
    return F.struct(F.when(F.size(unknown) > 0, tidy).otherwise(whole).alias("text"), used.alias("used"), unknown.alias("unknown"), echoed.alias("echoed"))


def route(text: Column, agents: dict[str, tuple[str, ...]]) -> Column:
    """The agent with most of its keywords in the text, the first of equals; null without a hit."""
    low = F.lower(text)
    hits = {a: sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in ws), F.lit(0)) for a, ws in agents.items()}
    best = F.greatest(*hits.values(), F.lit(0))
    return F.when(best > 0, F.coalesce(*[F.when(h == best, F.lit(a)) for a, h in hits.items()]))


def cell(text: Column, most: int | None = None) -> Column:
    """text as one cell of a table: white space runs as one space, bars escaped, and an ellipsis where it is over most characters."""
    one = F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    return one if most is None else F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most - 1), F.lit("…")))


def section_gender(*texts: Column) -> Column:
    """Whose section the first telling text names, by whole words; null if none does."""
    told = lambda t: F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}_]+")
    has = lambda t, g: F.arrays_overlap(told(t), F.array(*[F.lit(w) for w in GENDER_WORDS[g]]))
    return F.coalesce(*[F.when(has(t, g), F.lit(g)) for t in texts for g in GENDER_WORDS])
