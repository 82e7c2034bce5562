"""Secret scans with false positives removed by a random forest (DataFrame operations only).

Words that may hold a secret are found by a pattern, described by features, and judged by a
forest of ``pyspark.ml`` trained from labelled findings: the candidate's length, its character
classes and the transitions between them, how much of its letters a dictionary covers, its
path and the words around it.  The dictionary is counted over all texts: the words of letters
that at least ``min_share`` of the documents hold, and two of them.

Labelled findings are rows (word, before2, before, after, path, label); pass a table of reviewed
findings where there is one.  Else the forest learns from two bounded sets: ``rows`` findings
made from the templates below (6000), and at most ``train_rows`` of the corpus's own candidates
for each label (2000, those of smallest hash) on which the ``weak_labels`` agree.

Defined cases: a null or empty text has no candidates; a null path counts as none; repeated
rows yield their findings each; candidates of any length are judged whole; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, join_counted, staged

#: A word is a candidate if it holds a digit and a run of 12 such characters, or assigns to a telling name.
RUN = r"[A-Za-z0-9+/_.@:-]{12}"
NAMED = r"(?i)(?:passw|pwd|secret|token|api_?key)[^\s=:]*[=:]\S{4}"
#: Fixed words that announce a secret.
TELLING = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api.?key|access.?key|credential|bearer|auth)"
HARMLESS = r"(?i)(commit|sha|hash|digest|checksum|uuid|guid|version|phone|call|mail|card|example|sample|placeholder|id)"
FEATURES = [
    "length", "core_length", "digits", "uppers", "lowers", "hexes", "others", "distinct", "lower_digit", "digit_lower", "upper_digit", "upper_lower",
    "longest_letters", "coverage", "telling_name", "telling_before", "harmless_before", "assigned", "mail", "address", "dashes", "slashes", "known_prefix",
    "path_test", "path_depth", "after_telling",
]


def _share(word: Column, pattern: str) -> Column:
    return F.regexp_count(word, F.lit(pattern)) / F.greatest(F.length(word), F.lit(1))


def core(word: Column) -> Column:
    """The value of an assignment without its quotes."""
    return F.regexp_replace(F.regexp_replace(word, r"^[A-Za-z_-]{2,}[=:]+", ""), "^[\"'`(<\\[]+|[\"'`)>\\],;.]+$", "")


def pieces(word: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(word), F.lit(r"([a-z]{3,})"), 1)


def with_features(found: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """``found`` (word, before2, before, after, path and a unique ``key``) with all of ``FEATURES``."""
    words = staged(found.select(key, F.explode(pieces(core(F.col("word")))).alias("piece")), "secret-pieces")
    # Each distinct piece meets the dictionary once; frequent ones ("https") then come back by broadcast.
    met = words.groupBy("piece").agg(F.count("*").alias("n")).join(dictionary.select(F.col("term").alias("piece")), "piece").withColumn("hit", F.lit(1))
    known = join_counted(words, staged(met, "secret-known"), ["piece"], "n", words.count(), "left")
    covered = known.groupBy(key).agg(F.sum(F.when(F.col("hit") == 1, F.length("piece")).otherwise(0)).alias("covered"))
    c, before = F.col("core"), F.concat_ws(" ", F.coalesce("before2", F.lit("")), F.coalesce("before", F.lit("")))
    letters = F.greatest(F.regexp_count(c, F.lit("[A-Za-z]")), F.lit(1))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), 1), lambda x: F.length(x)))
    made = {
        "length": F.length("word").cast("double"), "core_length": F.length(c).cast("double"),
        "digits": _share(c, "[0-9]"), "uppers": _share(c, "[A-Z]"), "lowers": _share(c, "[a-z]"), "hexes": _share(c, "[0-9a-f]"), "others": _share(c, "[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.length(c), F.lit(1)),
        "lower_digit": _share(c, "[a-z](?=[0-9])"), "digit_lower": _share(c, "[0-9](?=[a-z])"), "upper_digit": _share(c, "[A-Z](?=[0-9])"), "upper_lower": _share(c, "[A-Z](?=[a-z])"),
        "longest_letters": F.coalesce(longest, F.lit(0)).cast("double"),
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / letters,
        "telling_name": flag(F.col("word").rlike(TELLING + r"\S*[=:]")), "telling_before": flag(before.rlike(TELLING)), "harmless_before": flag(before.rlike(r"(?:^| )" + HARMLESS)),
        "assigned": flag(before.rlike(r"[=:]$") | F.col("word").rlike(r"^[A-Za-z_-]{2,}[=:]")),
        "mail": flag(c.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]+")), "address": flag(c.rlike(r"^[0-9.:+()-]+$")),
        "dashes": F.regexp_count(c, F.lit("-")).cast("double"), "slashes": F.regexp_count(c, F.lit("/")).cast("double"),
        "known_prefix": flag(c.rlike(r"^(AKIA[0-9A-Z]{16}$|gh[pousr]_|xox[abp]-|sk_live_|AIza)")),
        "path_test": flag(F.col("path").rlike(r"(?i)(test|example|sample|fixture|doc)")), "path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
        "after_telling": flag(F.col("after").rlike(TELLING)),
    }
    return found.join(covered, key, "left").withColumn("core", core(F.col("word"))).withColumns({k: v.cast("double") for k, v in made.items()}).drop("covered", "core")


def dictionary_of(docs: DataFrame, text_col: str = "text", min_share: float = 0.0005) -> DataFrame:
    """Words of letters found in at least ``min_share`` of the texts (and in two), counted over all of them."""
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(r"\b([a-z]{3,})\b"), 1))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= max(2.0, min_share * docs.count())).select("term")


def weak_labels(featured: DataFrame) -> DataFrame:
    """``featured`` rows with a ``label`` on which several labellers agree: none speaks against it, and for a secret two speak for it.

    For: announced or named as a secret; of a known prefix; many digits and changes of class with
    few known words.  Against: mail and number shapes, announced as harmless, made of known words, a path.
    """
    f = F.col
    told = (f("telling_name") + f("telling_before") > 0) & (f("assigned") > 0)
    mixed = (f("coverage") < 0.2) & (f("core_length") >= 12) & (f("lower_digit") + f("digit_lower") + f("upper_digit") > 0.15) & (f("distinct") > 0.2)
    votes = lambda *tests: sum((x.cast("int") for x in tests), F.lit(0))
    yes = votes(told, f("known_prefix") > 0, mixed, f("assigned") > 0)
    no = votes(f("mail") > 0, f("address") > 0, (f("harmless_before") > 0) & ~told, (f("coverage") >= 0.6) & (f("digits") < 0.3), (f("slashes") >= 2) & (f("assigned") == 0))
    return featured.withColumn("label", F.when((yes >= 2) & (no == 0), 1).when((no > 0) & (yes == 0), 0)).where("label is not null")


def labelled_findings(spark: SparkSession, dictionary: DataFrame, rows: int = 6000, seed: int = 5) -> DataFrame:
    """A fixed training set of ``rows`` rows; its plain words are taken from the dictionary's first 64."""
    plain = [r.term for r in dictionary.orderBy("term").limit(64).collect()] or ["word", "note", "line"]
    words = F.array(*[F.lit(w) for w in plain])
    base = spark.range(rows, numPartitions=2)
    draw = lambda k: F.xxhash64("id", F.lit(seed), F.lit(k))
    pick = lambda options, k: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(draw(k), F.lit(len(options))) + 1).cast("int"))
    word = lambda k: F.element_at(words, (F.pmod(draw(k), F.lit(len(plain))) + 1).cast("int"))
    hexes = F.sha2(draw(1).cast("string"), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(F.sha2(draw(2).cast("string"), 512))), "[+/=]", "x")
    capitals = F.upper(F.translate(base64, "0189", "2345"))
    digits = lambda k, n: F.lpad(F.pmod(draw(k), F.lit(10**n)).cast("string"), n, "7")
    name = pick(["password", "passwd", "secret", "pwd", "api_key"], 3)
    kinds = [  # label, word, before2, before
        (1, F.concat(F.lit('"'), F.substring(hexes, 1, 40), F.lit('"')), pick(["token", "secret", "api_key"], 4), F.lit("=")),
        (1, F.concat(name, F.lit("="), F.substring(hexes, 1, 18)), word(10), word(11)),
        (1, F.concat(F.lit("AKIA"), F.substring(capitals, 1, 16)), word(10), word(11)),
        (1, F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)), word(10), word(11)),
        (1, F.concat(name, F.lit("="), F.substring(base64, 3, 24)), word(10), word(11)),
        (1, F.concat(F.lit('"'), F.substring(base64, 5, 32), F.lit('"')), pick(["token", "secret", "password"], 4), pick([":", "="], 5)),
        (0, F.concat(word(12), F.lit("."), digits(6, 2), F.lit("@mail"), digits(7, 1), F.lit(".example.com")), word(10), word(11)),
        (0, digits(6, 16), word(10), word(11)),
        (0, F.concat(F.lit("555-"), digits(6, 4), F.lit("-"), digits(7, 6)), F.lit("+1"), F.concat(F.lit("("), digits(8, 3), F.lit(")"))),
        (0, F.concat_ws(".", digits(6, 2), digits(7, 3), digits(8, 3), digits(9, 2)), word(10), word(11)),
        (0, F.substring(hexes, 1, 40), pick(["commit", "sha", "digest"], 4), word(11)),
        (0, F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), word(10), pick(["id", "uuid", "guid"], 5)),
        (0, F.concat(word(12), word(13), word(14), word(15), digits(6, 1)), word(10), word(11)),
        (0, F.concat(name, F.lit("="), word(12), word(13)), word(10), word(11)),
        (0, F.concat(name, F.lit("="), pick(["changeme", "example", "placeholder", "yourpassword", "xxxxxxxx"], 6)), word(10), word(11)),
        (0, F.concat(F.lit("https://"), word(12), F.lit(".example.com/"), word(13), F.lit("/"), digits(6, 4)), word(10), word(11)),
        (0, F.concat(word(12), F.lit("_"), word(13), F.lit("_v"), digits(6, 1), F.lit("."), digits(7, 2)), word(10), word(11)),
        (0, F.concat(F.lit("20"), digits(6, 2), F.lit("-0"), digits(7, 1), F.lit("-1"), digits(8, 1), F.lit("T"), digits(9, 2), F.lit(":00:00")), word(10), word(11)),
    ]
    rows_of = F.array(*[F.struct(F.lit(label).alias("label"), w.alias("word"), b2.alias("before2"), b1.alias("before")) for label, w, b2, b1 in kinds])
    made = base.withColumn("_f", F.element_at(rows_of, (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int")))
    return made.select("id", "_f.*", word(16).alias("after"), pick(["src1", "src2", "src3", "web/docs/a", "app/config"], 17).alias("path"))


def train(featured: DataFrame, trees: int = 24, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    """A forest of ``featured`` rows with a ``label``: a bounded set, in a fixed order, so that reruns agree."""
    data = featured.select(*FEATURES, F.col("label").cast("double").alias("label")).orderBy(*FEATURES, "label").coalesce(1)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=1.0, maxMemoryInMB=64).fit(assembled)


def is_candidate(word: Column) -> Column:
    """Each pattern takes time in proportion to the word; words may be of any length."""
    return (word.rlike("[0-9]") & word.rlike(RUN)) | word.rlike(NAMED)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, at, word, before2, before, after, path): ``at`` is the word's number in the text."""
    words = docs.where(is_candidate(F.col(text_col))).select(
        F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("path"), F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), 1).alias("_w")
    )
    # The neighbours are taken before the candidates part from their text.
    near = lambda i, k: F.get("_w", i + k)
    numbered = F.transform("_w", lambda w, i: F.struct(w.alias("word"), i.cast("long").alias("at"), F.when(i > 1, near(i, -2)).alias("before2"), F.when(i > 0, near(i, -1)).alias("before"), near(i, 1).alias("after")))
    return words.select("_id", "path", F.explode(F.filter(numbered, lambda x: is_candidate(x["word"]))).alias("_c")).select("_id", "_c.*", "path")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5, min_share: float = 0.0005, train_rows: int = 2000) -> DataFrame:
    """(id, at, word, before, after, path, score) of the candidates that the forest takes for secrets."""
    spark = docs.sparkSession
    dictionary = staged(dictionary_of(docs, text_col, min_share), "secret-dictionary")
    found = staged(candidates(docs, id_col, text_col, path_col).withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")
    featured = staged(with_features(found, dictionary, "_row"), "secret-features")
    if labelled is not None:
        learned = with_features(labelled.withColumn("id", F.monotonically_increasing_id()), dictionary, "id").select(*FEATURES, "label")
    else:
        learned = with_features(labelled_findings(spark, dictionary), dictionary, "id").select(*FEATURES, "label")
        own = staged(weak_labels(featured).select(*FEATURES, "label", F.xxhash64("word", "before2", "before", "_id", "at").alias("_h")), "secret-labels")
        for label in (0, 1):
            learned = learned.unionAll(own.where(F.col("label") == label).orderBy("_h", *FEATURES).limit(train_rows).select(*FEATURES, "label"))
    model = train(staged(learned, "secret-training"))
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured))
    score = vector_to_array("probability")[1]
    return judged.select(F.col("_id").alias(id_col), "at", "word", "before", "after", "path", score.alias("score")).where(F.col("score") >= threshold)
