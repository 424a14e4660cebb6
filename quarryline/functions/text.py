"""Text functions as Columns: normal forms, tokens, shapes and entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists.
INDEX_STOP = "the and for that with from this are was were you your into what where which how why never exists exist que para por con del las los una uno como qué cómo".split()
KEYWORD_STOP = "el la los las un una y o que de en es a al del con por para este ese eso como pero".split()
SCOUT_STOP = "el la los las un una y o que de en es a al del con por para como pero cual cuál the and for are with this".split()

FUNCTION_WORDS = (
    "a an the this that these those of in on at to from by for with without about into over under between and or but nor so yet as is are was were be been being it its they them their his her our your "
    "my we you he she i not no if then than un una el la los las de en por para con sin sobre entre y o pero como es son era eran ser este esa eso estos esas su sus mi tu nuestro se lo le les del al que"
).split()


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lower_spaced(s: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def upper_spaced(s: Column) -> Column:
    """Upper case, white space collapsed, punctuation kept."""
    return F.trim(F.regexp_replace(F.upper(s), r"\s+", " "))


def upper_tokens_text(s: Column) -> Column:
    """Upper case, every run of other than letters, digits and underscore as one space."""
    return F.trim(F.regexp_replace(F.upper(s), r"[^\p{L}\p{Nd}_]+", " "))


def words(s: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{Nd}]+"), 0)


def spaced_words(s: Column) -> Column:
    """The same words as one text, with single spaces between; one may stand before the first and after the last."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]+", " ")


def tokens(s: Column) -> Column:
    """All index terms of a text, distinct: words of three characters or more that aren't stop words."""
    return F.array_except(F.filter(words(s), lambda w: F.length(w) >= 3), literals(INDEX_STOP))


def model_family(model: Column) -> Column:
    """DEEPSEEK, QWEN, LIQUID_AI or UNKNOWN, by what an id contains."""
    m = F.lower(F.trim(model))
    has = lambda *names: F.coalesce(m.rlike("|".join(names)), F.lit(False))
    return F.when(has("deepseek"), "DEEPSEEK").when(has("qwen"), "QWEN").when(has("liquid", "lfm"), "LIQUID_AI").otherwise("UNKNOWN")


def transport_condition(raw: Column, compatibility: Column) -> Column:
    """How a model was reached: by names of the direct and the mediated way; without a name directly if a compatibility is known; other names stay."""
    v, known = F.upper(F.trim(F.coalesce(raw, F.lit("")))), F.trim(F.coalesce(compatibility, F.lit(""))) != ""
    return (
        F.when(v.isin("", "AUTO"), F.when(known, "DIRECT_IMAGE_API").otherwise("UNKNOWN")).when(v.isin("DIRECT", "DIRECT_IMAGE", "DIRECT_IMAGE_API", "NATIVE_API"), "DIRECT_IMAGE_API")
        .when(v.isin("PLATFORM", "PLATFORM_MEDIATED", "WEB", "APP"), "PLATFORM_MEDIATED").otherwise(v)
    )


def has_tokens(s: Column, need: list[str]) -> Column:
    """Whether all needed tokens are among the text's."""
    return F.size(F.array_except(literals(need), F.split(upper_tokens_text(s), " "))) == 0


def has_groups(s: Column, groups: list[list[str]]) -> Column:
    """Whether the text contains one phrase of each group."""
    n = upper_tokens_text(s)
    out = F.lit(True)
    for group in groups:
        any_ = F.lit(False)
        for phrase in group:
            any_ = any_ | F.contains(n, F.lit(phrase))
        out = out & any_
    return out


def keywords(s: Column, least: int = 4, stop: list[str] = KEYWORD_STOP, marks: str = ".,;:!?()[]{}\"'") -> Column:
    """Distinct lower-case words of more than `least` bytes, stripped of marks."""
    words = F.transform(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != ""), lambda w: F.btrim(w, F.lit(marks)))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.octet_length(w) > least)), literals(stop))


def repetition_shape(line: Column) -> Column:
    """Digits as #, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"[0-9]", "#"), r"\s+", " "))


def degenerate(s: Column, last: int = 16) -> Column:
    """Whether the last lines that aren't blank are all of one shape."""
    lines = F.filter(F.transform(F.split(s, "\n"), repetition_shape), lambda x: x != "")
    return (F.size(lines) >= last) & (F.size(F.array_distinct(F.slice(lines, -last, last))) == 1) if last else F.lit(False)


def without_tags(html: Column) -> Column:
    """Text between tags, the five named references decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def years(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"\b[12][0-9]{3}\b"), 0)


def numbers(s: Column) -> Column:
    """Numbers that aren't years."""
    return F.filter(F.regexp_extract_all(s, F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"), 0), lambda x: ~x.rlike(r"^[12][0-9]{3}$"))


def acronyms(s: Column) -> Column:
    """Words of two capital letters A-Z or more."""
    return F.filter(F.split(s, r"[^\p{L}\p{Nd}_]+"), lambda w: w.rlike("^[A-Z]{2,}$"))


def question_class(s: Column) -> Column:
    """comparison before definition before process before factual_detail before general."""
    q = F.ltrim(F.lower(s), F.lit("¿¡\"' "))
    comparison = q.rlike(r"compare|comparison|relationship|relaci[óo]n| vs |( vs\.)|difference|diferencia")
    definition = q.rlike(r"^(what is|what are|qué es|que es|define)")
    process = q.rlike(r"^(how |cómo|como |why |por qué|por que)| (how|cómo|como|why|por qué|por que) ")
    factual = (F.size(years(s)) > 0) | (F.size(numbers(s)) > 0)
    return F.when(comparison, "comparison").when(definition, "definition").when(process, "process").when(factual, "factual_detail").otherwise("general")


def hedged_confidence(s: Column) -> Column:
    q = F.lower(s)
    unsure = F.contains(q, F.lit("no sé")) | (F.contains(q, F.lit("no estoy")) & F.contains(q, F.lit("seguro")))
    return F.when(unsure, 0.4).when(q.rlike("seguro|definitivamente"), 0.9).when(q.rlike("probablemente|parece"), 0.6).otherwise(0.7)


def passages(s: Column, least: int = 15) -> Column:
    """Sentences of `least` bytes or more."""
    return F.filter(F.transform(F.split(s, r"\."), lambda p: F.trim(p)), lambda p: F.octet_length(p) >= least)


def token_estimate(s: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return ((F.octet_length(s) + 3) / 4).cast("long")


def slug(s: Column) -> Column:
    """Lower-case letters and digits, all else as single dashes."""
    return F.btrim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]+", "-"), F.lit("-"))


def block_kind(s: Column) -> Column:
    """whitespace, heading, equation, code, table or text, by the block's symbols."""
    body = F.trim(s)
    lines = F.split(body, "\n")
    first = F.trim(lines[0])
    letters = F.regexp_count(first, F.lit(r"\p{L}"))
    shout = (F.length(first) >= 2) & (letters > 0) & (F.regexp_count(first, F.lit(r"\p{Lu}")) * 100 >= letters * 70)
    heading = (F.octet_length(first) <= 90) & (shout | first.rlike("^(Chapter|CHAPTER) "))
    maths = F.regexp_count(body, F.lit(r"[=+*/^<>≤≥∑∫√]"))
    wide = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("    "))))
    code = F.regexp_count(body, F.lit(r"[{}\[\]();_]")) + F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]{4}")))
    return (
        F.when(body == "", "whitespace").when(heading, "heading").when((maths > 12) & (maths * 20 > F.length(body)), "equation")
        .when(code > F.size(lines) * 2, "code").when(wide >= 2, "table").otherwise("text")
    )


def triples(w: Column) -> Column:
    """All runs of three words of an array, in order."""

    def runs(a: Column) -> Column:
        rest = lambda n: F.slice(a, F.lit(n), F.greatest(F.size(a), F.lit(1)))
        # three copies of the words, each one word on: every word is taken out of the text once a copy
        zipped = F.arrays_zip(a.alias("a"), rest(2).alias("b"), rest(3).alias("c"))
        return F.filter(F.transform(zipped, lambda x: F.when(x["c"].isNotNull(), F.concat_ws(" ", x["a"], x["b"], x["c"]))), lambda x: x.isNotNull())

    # as the one element of an array the words are made once, and not for each place where they are used
    return F.get(F.transform(F.array(w), runs), F.lit(0))


def trigrams(s: Column) -> Column:
    """Distinct runs of three lower-case words."""
    return F.array_distinct(triples(words(s)))
