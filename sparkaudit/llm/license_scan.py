"""License scan by a trained paragraph classifier, with DataFrame functions only.

A paragraph is a line, in windows of 64 words where it is longer.  Its sparse
features are word 1- to 3-grams; a multinomial logistic regression tells the
licence families and ``unknown`` apart.  It is trained on notices of each
family, on pieces of them, on sentences that only sound alike, and on all paragraphs
of the corpus, without those that name a known licence or cover most
of a notice: paragraphs without a feature are all alike, so one row of their number's weight stands for them.  Probabilities count as a licence beyond a threshold calibrated
on paragraphs left out of training; a prediction is confirmed if the paragraph
shares enough 3-grams with a notice of that family (of as many words as the
shorter one has, where that is one or two words).

Features that the corpus has often outside notices are no features, nor are
those whose words it all has often; each remaining one is kept under its rarest
word.  These shares are counted over all paragraphs of all documents.  A
paragraph without any of these words has no feature, so its answer is the intercept's, unknown: one pattern of these
words decides, with the same result, which paragraphs are looked at.

Defined cases: null and empty texts have no licence; repeated rows get equal
results; an empty table gives an empty result; further columns are not read;
``doc_id`` identifies a text; rows without one are told apart by their text, so equal texts share an answer.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed
from sparkaudit.llm.license_texts import FAMILIES, IDENTIFIERS, OTHERS, PHRASES, TAGS

WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
WINDOW, STRIDE = 64, 32
#: All paragraphs of the corpus weigh as so many sentences that only sound alike, at most.
CORPUS_WEIGHT = 3_000.0
#: Training rows of a task.
TASK_ROWS = 50_000
#: Nothing is learned from a sample of the corpus; a test sets this to show that shares don't depend on it.
SAMPLE_DOCS = None
#: A feature that more of all paragraphs of the corpus have is none.
MOST_COMMON = 0.005
#: Each family weighs the same in training, however many notices it has, and ``unknown`` so many times that.
UNKNOWN_WEIGHT = 3.0
PIECE = 8            # words of a piece of a notice
CONFIRM = 0.5        # share of the smaller side's n-grams that a notice and a paragraph have in common
#: Paragraphs of one or two words are compared with notices of so many words at most, which are names.
NAME_WORDS = 4
#: Weight in training of notices of at most NAME_WORDS words, whose few features decide alone.
NAME_WEIGHT = 4.0
REGULARISATION = 1e-4
LEAST_PROBABILITY = 0.5
UNKNOWN = "unknown"


class Model(NamedTuple):
    weights: DataFrame       # gram, w: a weight for each class
    intercepts: list[float]
    classes: list[str]       # the last is UNKNOWN
    threshold: float         # least probability of a licence
    words: list[str]         # every feature has one of these
    notices: DataFrame       # gram, of (3, or the words of shorter paragraphs), family, notice, size


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def grams_of(words: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct word n-grams."""
    def of(n):
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(
            starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def _rows(spark: SparkSession, values: list[tuple], names: list[str]) -> DataFrame:
    """A small table from literals."""
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in values]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice, text)."""
    return _rows(spark, [(family, i, text) for i, (family, text) in enumerate(notice_texts())], ["family", "notice", "text"])


def notice_texts() -> list[tuple[str, str]]:
    """(family, text)."""
    named = [(family, p.format(n)) for family, ids in IDENTIFIERS.items() for n in ids for p in TAGS]
    return named + [(family, text) for family, (names, sentences) in FAMILIES.items()
                    for text in [p.format(n) for n in names for p in PHRASES] + list(sentences)]


def notice_grams(sizes: tuple[int, ...] = (1, 2, 3)) -> list[set[str]]:
    """Distinct word n-grams of each notice."""
    found = []
    for _, text in notice_texts():
        words = re.findall(WORD, text.lower())
        found.append({" ".join(words[i:i + n]) for n in sizes for i in range(len(words) - n + 1)})
    return found


def grams_among(words: Column, wanted: list[str]) -> Column:
    """Those of the distinct word n-grams of non-empty ``words`` that are ``wanted``; only looked for where one begins."""
    first, sizes = sorted({g.split(" ")[0] for g in wanted}), sorted({len(g.split(" ")) for g in wanted})
    at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(first))
    grams = F.flatten(F.transform(at, lambda i: F.array(*[F.array_join(F.slice(words, i, F.lit(n)), " ") for n in sizes])))
    return F.array_distinct(F.filter(grams, lambda g: g.isin(wanted)))


def is_notice(words: Column, hits: Column | None = None) -> Column:
    """Whether non-empty ``words`` contain a known name or cover most of a notice: CONFIRM of the smaller side's
    3-grams, or of two words all.  ``hits``: the notices' n-grams among the words, where they are known already."""
    hits = grams_among(words, sorted(set().union(*notice_grams()))) if hits is None else hits
    names = sorted({" ".join(re.findall(WORD, n.lower())) for of_family, _ in FAMILIES.values() for n in of_family})
    short, long = ([n for n in names if (n.count(" ") > 2) == x] for x in (False, True))
    named = F.exists(hits, lambda g: g.isin(short))  # names are notices too, so their n-grams are among the hits
    if long:
        begun = F.exists(hits, lambda g: g.isin([" ".join(n.split(" ")[:3]) for n in long]))
        named = named | (begun & (F.size(grams_among(words, long)) > 0))
    pairs = sorted(set().union(*notice_grams((2,))))
    each = sorted({tuple(sorted(g)) for g in notice_grams((3,)) if g})
    known = F.array(*[F.array(*[F.lit(g) for g in grams]) for grams in each])
    all_of = sorted(set().union(*each))
    # arrays of one element: what they hold is evaluated once and not for each notice
    covers = F.exists(F.array(F.filter(hits, lambda g: g.isin(all_of))), lambda found: (F.size(found) > 0) & F.exists(
        F.array(F.size(grams_of(words, (3,)))), lambda n: F.exists(known, lambda grams: F.size(
            F.array_intersect(found, grams)) >= CONFIRM * F.least(n, F.size(grams)))))
    return named | ((F.size(words) == 2) & F.array_join(words, " ").isin(pairs)) | covers


def paragraphs(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(doc_id, line, part, words); only of lines with one of ``words``, if given."""
    text = F.lower(F.coalesce("text", F.lit("")))
    some = docs.select("doc_id", text.alias("text"))
    if words is not None:
        some = some.where(F.col("text").rlike(pattern(words)))
    lines = some.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    if words is not None:
        lines = lines.where(F.col("text").rlike(pattern(words)))
    # a test of the text: one of the words would be pushed below them and split every line twice
    found = lines.where(F.col("text").rlike("[a-z0-9]")).select("doc_id", "line", words_of(F.col("text")).alias("words"))
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - WINDOW) / STRIDE)).cast("int")
    return (found.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
            .select("doc_id", "line", "part", F.slice("words", F.col("part") * STRIDE + 1, F.lit(WINDOW)).alias("words")))


def pattern(words: list[str]) -> str:
    """A pattern that finds any of the words whole; alternatives go by first letters, so few are tried."""
    tree: dict[str, dict[str, list[str]]] = {}
    for w in sorted(words):
        tree.setdefault(w[0], {}).setdefault(w[1:2], []).append(w[2:])
    escape = "\\Q{}\\E".format
    branches = []
    for a, inner in tree.items():
        second = [escape(b) + ("(?:" + "|".join(escape(r) if r else "" for r in sorted(rest, key=len, reverse=True)) + ")"
                               if any(rest) else "") if b else "" for b, rest in inner.items()]
        branches.append(escape(a) + "(?:" + "|".join(sorted(second, key=len, reverse=True)) + ")")
    return "(?<![a-z0-9])(?:" + "|".join(branches) + ")(?![a-z0-9])"


def kept_out(words: Column) -> Column:
    """Whether a paragraph of the corpus is left out of training, for the calibration."""
    return F.pmod(F.xxhash64(F.lit(2), words), F.lit(4)) == 0


def training_rows(docs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(family, words, of_corpus, kept_out): notices, their pieces, look-alikes and the corpus, all paragraphs or ``parts``."""
    spark = docs.sparkSession
    known = notices(spark).select("family", words_of(F.col("text")).alias("words"))
    piece = known.where(F.size("words") > PIECE).select("family", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - PIECE + 1), lambda i: F.slice("words", i, F.lit(PIECE)))).alias("words"))
    other = _rows(spark, [(t,) for t in OTHERS], ["text"]).select(
        F.lit(UNKNOWN).alias("family"), words_of(F.col("text")).alias("words"))
    # a notice in the corpus is no example of unknown
    corpus = ((paragraphs(docs) if parts is None else parts).where(~is_notice(F.col("words")))
              .select(F.lit(UNKNOWN).alias("family"), "words"))
    rows = known.union(piece).union(other).withColumn("of_corpus", F.lit(False)).union(
        corpus.withColumn("of_corpus", F.lit(True)))
    return rows.withColumn("kept_out", F.col("of_corpus") & kept_out(F.col("words")))


def background(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """((gram, share), n, n_kept_out): how many of all paragraphs that are no notices have each gram of the notices;
    their number, and that of those left out of training."""
    wanted, every, out = sorted(set().union(*notice_grams())), "", "\n"
    hits = F.col("hits")  # a projection of its own: looked up once a paragraph, for the test and for the counts
    found = paragraphs(docs).select("words", grams_among(F.col("words"), wanted).alias("hits"))
    marks = F.when(kept_out(F.col("words")), F.array(F.lit(every), F.lit(out))).otherwise(F.array(F.lit(every)))
    grams = F.when(is_notice(F.col("words"), hits), F.array().cast("array<string>")).otherwise(F.concat(marks, hits))
    counts = checkpointed(found.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    totals = {r.gram: r.n for r in counts.where(F.col("gram").isin(every, out)).collect()}
    shares = counts.where(~F.col("gram").isin(every, out)).select("gram", (F.col("n") / F.lit(totals.get(every, 0) or 1)).alias("share"))
    return shares, totals.get(every, 0), totals.get(out, 0)


def background_shares(docs: DataFrame) -> DataFrame:
    """(gram, share) of ``background``."""
    return background(docs)[0]


def feature_parts(docs: DataFrame, words: list[str]) -> DataFrame:
    """The paragraphs that may have a feature, written once."""
    return checkpointed(paragraphs(docs, words).dropDuplicates(["doc_id", "line", "part"]))


def train(docs: DataFrame) -> Model:
    return train_on_all(docs)[0]


def train_on_all(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the paragraphs that may have a feature."""
    spark = docs.sparkSession
    shares, n_corpus, n_out = background(docs)
    known = notices(spark).select(F.explode(grams_of(words_of(F.col("text")))).alias("gram")).distinct()
    rare = known.join(shares, "gram", "left").fillna(0.0, ["share"]).where(F.col("share") <= MOST_COMMON)
    # of each feature's words the one that the corpus has least; a feature of common words is none
    features = checkpointed(
        rare.select("gram", F.explode(F.split("gram", " ")).alias("word"))
        .join(shares.select(F.col("gram").alias("word"), F.col("share").alias("often")), "word", "left")
        .groupBy("gram").agg(F.min(F.struct(F.coalesce("often", F.lit(0.0)).alias("often"), -F.length("word"), "word")).alias("x"))
        .where(F.col("x.often") <= MOST_COMMON).select("gram", "x.word"))
    words = [r.word for r in features.select("word").distinct().orderBy("word").collect()]
    vocabulary = [r.gram for r in features.select("gram").orderBy("gram").collect()]
    classes = [*sorted(FAMILIES), UNKNOWN]
    parts = feature_parts(docs, words)
    rows = checkpointed(training_rows(docs, parts).withColumn("grams", grams_of(F.col("words"))))
    seen = rows.agg(F.count(F.lit(1)), F.count_if(F.col("of_corpus") & ~F.col("kept_out")), F.count_if("kept_out")).first()
    # what no part shows has no feature; a corpus of many paragraphs doesn't outweigh the look-alikes
    bare, bare_out = max(0, n_corpus - n_out - seen[1]), max(0, n_out - seen[2])
    scale = min(1.0, CORPUS_WEIGHT / max(1, bare + seen[1]))
    index = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))]), F.col("family"))
    alike = spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("words"),
                                  F.array().cast("array<string>").alias("grams"), F.lit(scale * bare).alias("times"))
    learned = rows.where("not kept_out").select("family", "words", "grams", F.when(
        F.col("of_corpus"), F.lit(scale)).otherwise(F.lit(1.0)).alias("times")).union(alike)
    own = F.col("times") * F.when((F.col("family") != UNKNOWN) & (F.size("words") <= NAME_WORDS), F.lit(NAME_WEIGHT)).otherwise(F.lit(1.0))
    sizes = learned.groupBy("family").agg(F.sum(own).alias("n"))
    weight = F.when(F.col("family") == UNKNOWN, F.lit(UNKNOWN_WEIGHT)).otherwise(F.lit(1.0)) * own / F.col("n")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True).transform(
        learned.join(F.broadcast(sizes), "family").select("grams", index.alias("label"), weight.alias("weight")))
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=REGULARISATION, maxIter=60,
                                standardization=False).fit(
        checkpointed(vectors.select("label", "weight", "features").coalesce(1 + seen[0] // TASK_ROWS)))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray().tolist()
    weights = _table(spark, [(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(vocabulary)],
                     "gram string, w array<double>")
    if len(intercepts) < len(classes):  # without a corpus the last class may have no example
        raise ValueError("a class has no training example")
    model = Model(weights, intercepts, classes, LEAST_PROBABILITY, words, checkpointed(notices_by_gram(spark)))
    # calibration: at most one in a thousand of the corpus paragraphs left out passes for a licence
    out = rows.where("kept_out").select(F.monotonically_increasing_id().alias("doc_id"), F.lit(0).alias("line"),
                                        F.lit(0).alias("part"), "words")
    return model._replace(threshold=max(LEAST_PROBABILITY, passed_by(checkpointed(out), model, without=bare_out))), parts


def passed_by(parts: DataFrame, model: Model, share: float = 0.001, without: int = 0) -> float:
    """The probability that this share of all ``parts`` exceed, and of so many others ``without`` a feature; those have 0."""
    found = classify(parts, model).groupBy("probability").agg(F.count(F.lit(1)).alias("n"))
    found = checkpointed(found)
    rest = parts.count() + without - (found.agg(F.sum("n")).first()[0] or 0)
    every = found.union(parts.sparkSession.range(1).select(F.lit(0.0), F.lit(rest).cast("long")).where(F.lit(rest > 0)))
    return every.agg(F.percentile("probability", 1 - share, F.col("n"))).first()[0] or 0.0


def _table(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def classify(parts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, part, family, probability) of paragraphs that have a feature; the family may be UNKNOWN.

    ``probability`` is that of the likeliest licence family.
    """
    n = len(model.classes)
    logit = (parts.select("doc_id", "line", "part", F.explode(grams_of(F.col("words"))).alias("gram"))
             .join(F.broadcast(model.weights), "gram").groupBy("doc_id", "line", "part")
             .agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)]))
    z = [F.col(f"z{i}") + F.lit(model.intercepts[i]) for i in range(n)]
    top = F.greatest(*z)
    share = F.array(*[F.struct((F.exp(x - top)).alias("p"), F.lit(c).alias("family")) for x, c in zip(z, model.classes)])
    best = F.array_max(F.slice(share, 1, n - 1))
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    return logit.select("doc_id", "line", "part", best["family"].alias("family"), (best["p"] / total).alias("probability"))


def notices_by_gram(spark: SparkSession) -> DataFrame:
    """(gram, of, family, notice, size): what paragraphs of 1, 2 and 3 or more words (``of``) are compared with.

    The grams have ``of`` words, or as many as a shorter notice has; ``size`` is their number.
    """
    known = notices(spark).select("family", "notice", words_of(F.col("text")).alias("words"))
    each = [known.where(F.size("words") <= NAME_WORDS) if of < 3 else known for of in (1, 2, 3)]
    grams = [F.coalesce(*[F.when(F.size("words") >= n, grams_of(F.col("words"), (n,))) for n in range(of, 0, -1)])
             for of in (1, 2, 3)]
    found = [rows.select("family", "notice", F.lit(of).alias("of"), g.alias("grams"))
             for of, rows, g in zip((1, 2, 3), each, grams, strict=True)]
    return found[0].union(found[1]).union(found[2]).select(
        F.explode("grams").alias("gram"), "of", "family", "notice", F.size("grams").alias("size"))


def compare(parts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, part, family, similarity): the best notice of each family that shares a gram.

    Grams are 3-grams, or of as many words as the shorter of paragraph and notice has.
    """
    def sized(n):
        return F.transform(F.array(grams_of(F.col("words"), (n,))), lambda g: F.struct(F.size(g).alias("n"), g.alias("grams")))

    own = parts.select("doc_id", "line", "part", F.least(F.size("words"), F.lit(3)).alias("of"),
                       F.explode(F.concat(*[sized(n) for n in (1, 2, 3)])).alias("s"))
    return (own.select("doc_id", "line", "part", "of", F.col("s.n").alias("n"), F.explode("s.grams").alias("gram"))
            .join(F.broadcast(model.notices), ["gram", "of"]).groupBy("doc_id", "line", "part", "family", "notice")
            .agg((F.count(F.lit(1)) / F.least(F.first("n"), F.first("size"))).alias("similarity"))
            .groupBy("doc_id", "line", "part", "family").agg(F.max("similarity").alias("similarity")))


def findings(parts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, part, family, probability, similarity, confirmed) of the ``feature_parts`` that name a licence."""
    named = classify(parts, model).where(F.col("probability") >= model.threshold).alias("a")
    same = compare(parts, model).alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.line") == F.col("b.line")) & (
        F.col("a.part") == F.col("b.part")) & (F.col("a.family") == F.col("b.family"))
    similarity = F.coalesce("similarity", F.lit(0.0))
    return named.join(same, on, "left").select(
        "a.doc_id", "a.line", "a.part", "a.family", F.round("probability", 4).alias("probability"),
        F.round(similarity, 4).alias("similarity"), (similarity >= CONFIRM).alias("confirmed"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document: licences (confirmed families), suspected (others that the classifier names), n_paragraphs
    (paragraphs that name one), probability (the highest)."""
    key = F.coalesce("doc_id", F.xxhash64(F.lit("text"), F.coalesce("text", F.lit(""))))
    docs = docs.select(F.col("doc_id").alias("given_id"), key.alias("doc_id"), "text")
    model, parts = train_on_all(docs.drop("given_id"))
    found = findings(parts, model).groupBy(F.col("doc_id").alias("found_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("sure"),
        F.array_sort(F.collect_set("family")).alias("named"),
        F.countDistinct("line").alias("n_paragraphs"), F.max("probability").alias("probability"))
    return docs.select("given_id", "doc_id").join(found, F.col("doc_id") == F.col("found_id"), "left").select(
        F.col("given_id").alias("doc_id"), F.coalesce(F.array_join("sure", ","), F.lit("")).alias("licenses"),
        F.coalesce(F.array_join(F.array_except("named", "sure"), ","), F.lit("")).alias("suspected"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"))
