"""Licence families of paragraphs (operator 3), by DataFrame and SQL functions only.

A multinomial logistic regression over the words, pairs and triples of words of a paragraph gives each family, and an
unknown class, a chance. Each line of a text is a paragraph; lines in a row, up to a blank one, are one paragraph more, so that hard-wrapped
texts are found, with the marks of comments at their lines' starts left out. It is fitted to notices made of the families' names and paragraphs, and to
paragraphs that license nothing: written ones, and up to some NEGATIVES of the table's own that hold a word of the
notices but share nothing with any template. A family is reported if its chance reaches the threshold, which is
calibrated on notices and paragraphs left out of the fit, and if the comparison with the family's templates confirms it: the
share of one template's distinctive word triples, or pairs in short notices, that the paragraph contains. A bare name confirms only a line that is little more
than the name, or has a word of licensing or a mark that sets names off, so that a mention is none; wrapped lines are confirmed by paragraphs of a licence's text alone, and
then stand for the lines in them that hold the family's name, unless one holds a whole paragraph by itself.
The weights' n-grams each contain a word of the templates that is no stop word, so paragraphs without any such word are unknown; they
are passed over before n-grams are made. Null and empty texts have no paragraph. Texts are read whole; lines, and rows of lines, are paragraphs however
long. Repeated rows are reported each; of families of equal chance the first by name holds. An empty table gives an empty result;
columns beside doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import written
from quarryline.llm.neardup import few
from quarryline.llm.license_texts import FRAMES, NAMES, PARAGRAPHS, UNKNOWN

# Words that are no sign of a licence by themselves.
STOP = (
    "a about above after all along an and any are as at be been before but by can com do during each either for from had has have he her him his i if in "
    "into is it its kind last least may me met more must my name names neither new no nor not of off on one or order other our out over own she should "
    "so some such than that the their them then there these they this those to under until up use used using version was we were what when where "
    "which while who whom with without work you your"
).split()

#: Names that say nothing without a word of licensing before them.
BARE = ("MIT", "ISC")

#: Paragraphs of the table that the unknown class learns from, about.
NEGATIVES = 2_000

#: Words that make a licence's name a notice.
CUES = "licensed released distributed available subject terms under uses see spdx identifier dedicated redistribute governed".split()
#: Marks that set a name off from what is around it.
MARKS = r"[\[\]{}*_|#<>]"
#: Words that a line may have beside a licence's name and be a notice without any of them.
BESIDE = 2
#: A template of so many words or more is a paragraph of a licence's text.
LONG = 12
#: What begins the lines of a comment.
LEADER = r"^[ \t]*(?://+|/\*+|\*+/?|#+|;+|--+|%+|>+|\.\.)?[ \t]*|[ \t]*\*/[ \t]*$"

#: Confirmation: the least share of a template's triples (pairs in short notices).
CONFIRM = 0.6


def words(text: Column) -> Column:
    """Lower-case words; what joins the parts of a name like CC-BY-4.0 separates words, the dot of 4.0 doesn't."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.+]+|\.(?=\s|$|[^\p{N}])", " "), " "), lambda w: w != "")


def grams(w: Column, n: int) -> Column:
    return F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(w, i, n), " "))


def features(w: Column) -> Column:
    """Distinct words, pairs and triples."""
    return F.array_distinct(F.concat(w, grams(w, 2), grams(w, 3)))


def examples(spark: SparkSession) -> DataFrame:
    """family, text, fold of the training paragraphs; every fifth is left for calibration."""
    rows = []
    for family, names in NAMES.items():
        notices = [f.format(n).replace("the the ", "the ").replace("the The ", "The ").replace("the a ", "a ") for f in FRAMES for n in names if f != "{}" or n not in BARE]
        rows += [(family, t) for t in [*dict.fromkeys(notices), *PARAGRAPHS.get(family, []) * 4]]
    rows += [("unknown", t) for t in UNKNOWN] + [("unknown", f.format(x)) for f in FRAMES for x in ("these conditions", "the usual terms", "contract", "pressure", "a new name")]
    return spark.createDataFrame([(f, t, i % 5) for i, (f, t) in enumerate(rows)], "family string, text string, fold int")


def signs_of(known: DataFrame) -> list[str]:
    """The words of the families' training paragraphs that are a sign of a licence."""
    w = known.where("family <> 'unknown'").select(F.explode(words(F.col("text"))).alias("w"))
    return [r["w"] for r in w.distinct().where(~F.col("w").isin(STOP)).orderBy("w").collect()]


def negatives(rows: DataFrame, most: int = NEGATIVES) -> DataFrame:
    """(family, fold, grams) of some rows (row, grams) without any n-gram of a template; the same rows at every run on the same table."""
    n = rows.count()
    mark = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    some = rows.where(mark < int(min(1.0, most / max(n, 1)) * (1 << 30))).select("row", "grams", (mark % 5).cast("int").alias("fold"))
    like = some.select("row", F.explode("grams").alias("gram")).join(F.broadcast(templates(rows.sparkSession).select("gram")), "gram").select("row")
    return some.join(like, "row", "left_anti").select(F.lit("unknown").alias("family"), "fold", "grams")


@dataclass(frozen=True)
class Model:
    weights: DataFrame  # (gram, w): a weight for each family
    families: list[str]
    intercepts: list[float]
    threshold: float  # the chance from which on a family is taken


def trained(spark: SparkSession, signs: list[str], unknown: DataFrame | None = None) -> Model:
    """Fitted to the examples and to unknown (family, fold, grams)."""
    sign = F.array(*[F.lit(s) for s in signs])
    known = examples(spark).select("family", "fold", features(words(F.col("text"))).alias("grams"))
    known = known if unknown is None else known.unionByName(unknown)
    known = known.withColumn("grams", F.filter("grams", lambda g: F.arrays_overlap(F.split(g, " "), sign)))
    families = sorted({*NAMES, "unknown"})
    labels = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    # some thousands of short rows, a bounded table: one partition keeps the optimiser's many small jobs short
    known = written(known.select("family", "fold", "grams", labels.cast("double").alias("label")).coalesce(1), "examples")
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 16, minDF=2).fit(known)
    model = LogisticRegression(regParam=2e-4, maxIter=60, family="multinomial", standardization=False).fit(counter.transform(known.where("fold <> 4")))
    weight = model.coefficientMatrix.toArray()
    rows = [(g, [float(x) for x in weight[:, j]]) for j, g in enumerate(counter.vocabulary) if abs(weight[:, j]).max() > 1e-3]
    fitted = Model(spark.createDataFrame(rows, "gram string, w array<double>"), families, [float(x) for x in model.interceptVector], 0.0)
    # the calibration fold: above all unknown paragraphs' best family, below nearly all right families
    left = known.where("fold = 4").select(F.monotonically_increasing_id().alias("row"), F.col("family").alias("truth"), "grams")
    left = written(left, "calibration")
    chances = probabilities(left, fitted, "truth")
    of = lambda family: F.element_at("chances", F.array_position(F.array(*[F.lit(f) for f in families]), family).cast("int"))
    low = chances.where("truth = 'unknown'").agg(F.max(F.array_max(F.filter("chances", lambda c, i: i != families.index("unknown"))))).first()[0] or 0.0
    high = chances.where("truth <> 'unknown'").agg(F.percentile(of(F.col("truth")), F.lit(0.05))).first()[0] or 1.0
    return replace(fitted, threshold=max(0.5, min((low + high) / 2, high)) if high > low else max(0.5, low))


def probabilities(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(row, *keep, chances) of every row (row, grams, *keep): the softmax of the families' sums of weights.

    A row's n-grams lie together, so its sums are whole before they are shuffled.
    """
    each = rows.select("row", *keep, F.explode("grams").alias("gram")).join(F.broadcast(model.weights), "gram", "left")
    sums = [F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(model.families))]
    z = F.array(*[F.col(f"s{i}") + F.lit(b) for i, b in enumerate(model.intercepts)])
    own = each.groupBy("row", *keep).agg(*sums).select("row", *keep, z.alias("z"))
    e = own.select("row", *keep, F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    return e.select("row", *keep, F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("chances"))


def templates(spark: SparkSession) -> DataFrame:
    """(gram, template, family, many): word triples of the paragraphs, pairs of names of two words or more, and single names."""
    rows = [(f, t) for f, ps in PARAGRAPHS.items() for t in ps] + [(f, n) for f, ns in NAMES.items() for n in ns if n not in BARE]
    rows += [(f, f"{lead} {n}") for f, ns in NAMES.items() for n in ns if n in BARE for lead in ("under", "license", "licensed", "identifier")]
    made = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(dict.fromkeys(rows))], "template int, family string, text string").withColumn("w", words(F.col("text")))
    lead = F.when(F.col("w")[0].isin("the", "a"), F.slice("w", 2, F.size("w") - 1)).otherwise(F.col("w"))
    made = made.withColumn("w", lead)
    own = F.array_distinct(F.when(F.size("w") >= LONG, grams(F.col("w"), 3)).when(F.size("w") >= 2, grams(F.col("w"), 2)).otherwise(F.col("w")))
    return made.select("template", "family", F.size("w").alias("length"), F.size(own).alias("many"), F.explode(own).alias("gram"))


def paragraphs(texts: DataFrame) -> DataFrame:
    """(doc_id, paragraph, lines, w, marked): the words of each line of texts (doc_id, text), and of each row of two lines or more up to a blank one.

    paragraph is the place of its first line, from 0; lines how many it has; marked whether a line has marks that set a name off.
    """
    bare = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, LEADER, ""))
    own = texts.select("doc_id", F.split("text", "\n").alias("lines"), bare.alias("bare"))
    each = own.select("doc_id", F.posexplode("lines").alias("paragraph", "line")).select("doc_id", "paragraph", F.lit(1).alias("lines"), words(F.col("line")).alias("w"), F.col("line").rlike(MARKS).alias("marked"))
    start = F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("out"), F.lit(0).alias("place"), F.lit(0).alias("head"), F.lit(0).alias("n"))
    ends = lambda s: F.when(s["n"] > 1, F.array_append(s["out"], F.struct(s["head"].alias("at"), s["n"].alias("n")))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        blank = F.trim(x) == ""
        return F.struct(
            F.when(blank, ends(s)).otherwise(s["out"]).alias("out"), (s["place"] + 1).alias("place"), F.when(blank | (s["n"] > 0), F.when(blank, s["place"] + 1).otherwise(s["head"])).otherwise(s["place"]).alias("head"), F.when(blank, 0).otherwise(s["n"] + 1).alias("n"),
        )

    runs = own.select("doc_id", "bare", F.explode(F.aggregate("bare", start, step, ends)).alias("r"))
    joined = runs.select("doc_id", F.col("r.at").alias("paragraph"), F.col("r.n").alias("lines"), words(F.array_join(F.slice("bare", F.col("r.at") + 1, F.col("r.n")), " ")).alias("w"), F.lit(False).alias("marked"))
    return each.unionByName(joined)


def licence_paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, paragraph (the place of its first line among the text's lines, from 0), lines, family, chance and match of every confirmed paragraph."""
    spark = documents.sparkSession
    signs = signs_of(examples(spark))
    sign = F.array(*[F.lit(s) for s in signs])
    # a text's words are those of its lines, so texts without any sign have no line with one
    texts = documents.select(F.monotonically_increasing_id().alias("text_row"), "doc_id", "text").where(F.arrays_overlap(words(F.col("text")), sign))
    found = paragraphs(texts.select(F.struct("text_row", "doc_id").alias("doc_id"), "text")).where(F.arrays_overlap("w", sign))
    cue = F.col("marked") | F.arrays_overlap("w", F.array(*[F.lit(c) for c in CUES]))
    rows = found.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id.text_row").alias("text_row"), F.col("doc_id.doc_id").alias("doc_id"), F.col("paragraph").cast("long").alias("paragraph"), F.col("lines").cast("long").alias("lines"),
        F.size("w").alias("n_words"), cue.alias("cue"), features(F.col("w")).alias("grams"),
    )
    rows = written(rows, "paragraphs")
    model = trained(spark, signs, negatives(rows.where("lines = 1").select("row", "grams")))
    keep = ["text_row", "doc_id", "paragraph", "lines", "n_words", "cue"]
    best = probabilities(rows, model, *keep).withColumn("chance", F.array_max("chances"))
    best = best.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in model.families]), F.array_position("chances", F.col("chance")).cast("int")))
    best = written(best.where((F.col("family") != "unknown") & (F.col("chance") >= model.threshold)).select("row", *keep, "family", "chance"), "likely")
    shared = rows.select("row", "grams").join(few(best.select("row", "family", "lines", "n_words", "cue")), "row").select("row", "family", "lines", "n_words", "cue", F.explode("grams").alias("gram")).join(F.broadcast(templates(spark)), ["gram", "family"])
    notice = (F.col("length") >= LONG) | ((F.col("lines") == 1) & (F.col("cue") | (F.col("n_words") - F.col("length") <= BESIDE)))
    each = shared.where(notice).groupBy("row", "template", "many", "length").count().select("row", (F.col("count") / F.col("many")).alias("m"), (F.col("length") >= LONG).alias("long"))
    match = each.where(F.col("m") >= CONFIRM).groupBy("row").agg(F.max("m").alias("match"), F.bool_or("long").alias("long"))
    sure = written(best.join(match, "row"), "confirmed")
    # a line that holds a whole paragraph goes before the lines it stands in, these before a line with no more than the name
    inner = sure.where("lines = 1").select(F.col("row").alias("line_row"), F.col("text_row").alias("t"), F.col("family").alias("f"), F.col("paragraph").alias("p"), F.col("long").alias("l"))
    has = (F.col("text_row") == F.col("t")) & (F.col("family") == F.col("f")) & (F.col("p") >= F.col("paragraph")) & (F.col("p") < F.col("paragraph") + F.col("lines"))
    outer = sure.where("lines > 1").join(inner.where("l"), has, "left_anti")
    within = inner.join(outer.select("text_row", "family", "paragraph", "lines"), has).select(F.col("line_row").alias("row"))
    every = outer.unionByName(sure.where("lines = 1").join(within.distinct(), "row", "left_anti"))
    return every.select("doc_id", "paragraph", "lines", "family", F.round("chance", 4).alias("chance"), F.round("match", 4).alias("match"))
