"""Secret scans: candidate strings in whole texts, judged by a random forest trained on labelled findings.

Everything after the fit is one projection: candidates and the text between them are cut out by one pattern, features are Column
expressions over each candidate and its neighbours, and the fitted trees are written as CASE expressions. Nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: A run of 16 or more key characters, wherever it starts; '=' is padding at its end unless a value follows.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_\-]))?"
#: Characters looked at on either side.
NEIGHBOURS = 40
MASK = "[SECRET]"
THRESHOLD = 0.5
#: Bound of the sample of labelled findings that the forest is fitted on.
LABELLED = 3600
KINDS = 36
TREES, DEPTH = 15, 6

# Words whose letters speak against a random string.
DICTIONARY = (
    "about account action address after array base build cache change check class client code column commit config content count create "
    "data date default delete demo digest document download dummy error event example field file find first format from function get group "
    "handler hash header hello image index info input insert item java key label language last layer length level line list load local log main "
    "make manager map max message method model module name node null number object open option order output page parse path placeholder point "
    "process public query random read record remove report request reset result return sample search select send server service session set size "
    "source start state status string system table target test text that the this time title token tree type update upload user value version "
    "view with world write your"
).split()
# Parts of words that are in no dictionary.
SYLLABLES = "an ba der ent fer go hun in ka lich ment mon ner ol pre ra ri schaft sel stra ti tion tu ung ver vo".split()
# Neighbouring words for and against a secret.
FOR_WORDS = "token|secret|passw|pwd|credential|auth|bearer|api[_ -]?key|access[_ -]?key|private[_ -]?key|signature"
AGAINST_WORDS = "sha1|sha256|sha512|md5|checksum|digest|commit|etag|uuid|guid|build|version|card|account|invoice|order|isbn|phone"
PATH_AGAINST = "(^|[^a-z])(tests?|testing|examples?|fixtures?|samples?|mocks?|docs?)([^a-z]|$)"

FEATURES = ["length", "digits", "upper", "hexed", "switches", "vowelled", "likely", "distinct", "dictionary", "near_for", "near_against", "assigned", "quoted", "path_against", "slashes"]


#: Classes of characters between which transitions are counted: letters whatever their case, any digit, any other.
CLASSES = "abcdefghijklmnopqrstuvwxyz0#"


@dataclass(frozen=True)
class Model:
    """A forest, and the log2 probabilities of transitions between CLASSES, row by row."""

    forest: RandomForestClassificationModel
    transitions: tuple[float, ...]


def _pairs(text: Column) -> Column:
    """The transition from each character of a text to the next, as an index into a table of CLASSES by CLASSES."""
    n = len(CLASSES)
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", "#")
    codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(CLASSES)) - 1)
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * n + b)


def learn_transitions(texts: Column, findings: DataFrame) -> tuple[float, ...]:
    """How likely each class follows each other in running text, from the text around labelled findings; unseen pairs count as half."""
    n, counts = len(CLASSES), {}
    for r in findings.select(F.explode(_pairs(texts)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect():  # n * n rows at most
        counts[r["pair"]] = r["n"]
    rows = [[counts.get(a * n + b, 0) + 0.5 for b in range(n)] for a in range(n)]
    return tuple(round(math.log2(x / sum(row)), 6) for row in rows for x in row)


def features(value: Column, left: Column, right: Column, path: Column, transitions: tuple[float, ...]) -> list[Column]:
    """Length, character classes and transitions, dictionary coverage, neighbouring words and path of a candidate."""
    table = F.split(F.lit(" ".join(map(repr, transitions))), " ").cast("array<double>")
    n, low = F.length(value), F.lower(value)
    share = lambda pattern, of=value: F.regexp_count(of, F.lit(pattern)) / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    covered = n - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return [
        n.cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("upper"),
        share("[0-9a-f]", low).alias("hexed"),
        share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])").alias("switches"),
        share("[bcdfghjklmnpqrstvwxyz][aeiou]", low).alias("vowelled"),
        (F.aggregate(_pairs(value), F.lit(0.0), lambda total, pair: total + F.get(table, pair)) / F.greatest(n - 1, F.lit(1))).alias("likely"),
        (F.size(F.array_distinct(F.split(low, ""))) / F.least(n, F.lit(36))).alias("distinct"),
        (covered / n).alias("dictionary"),
        flag(left.rlike(f"(?i)({FOR_WORDS})")).alias("near_for"),
        flag(left.rlike(f"(?i)({AGAINST_WORDS})")).alias("near_against"),
        flag(left.rlike(r"[=:]\s*[\"'`]?$")).alias("assigned"),
        flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")).alias("quoted"),
        flag(path.rlike(f"(?i)({PATH_AGAINST})")).alias("path_against"),
        share("/").alias("slashes"),
    ]


def _listed(texts: list[str]) -> Column:
    """An array of texts, as one literal."""
    return F.split(F.lit("\x1f".join(texts)), "\x1f")


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """(value, left, right, path, label): findings with known labels, made by rule. Of every 36 kinds, 18 are secrets, but none under the one path in four for tests and examples."""
    h = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), F.col("id").cast("string")), 256)
    b64 = lambda salt: F.translate(F.base64(F.unhex(h(salt))), "=", "")
    word = lambda i: F.element_at(_listed(DICTIONARY), (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    name = F.element_at(_listed(["token", "api_key", "secret", "password", "access_key", "auth"]), (F.pmod(F.xxhash64("id"), F.lit(6)) + 1).cast("int"))
    put = F.element_at(_listed([" = \"", ": \"", "=", "='", " = "]), (F.pmod(F.xxhash64("id", F.lit("p")), F.lit(5)) + 1).cast("int"))
    quote = F.regexp_extract(put, "[\"']", 0)
    camel = F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.pmod("id", F.lit(97)).cast("string"), F.initcap(word(4)))
    snake = F.concat_ws("_", word(1), word(2), word(3), F.pmod("id", F.lit(9)).cast("string"), word(5))
    digits = F.substring(F.regexp_replace(F.concat(h("a"), h("b"), h("c")), "[a-f]", ""), 1, 16)
    uuid = F.regexp_replace(F.substring(h("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    letters = F.regexp_replace(F.concat(b64("l"), b64("m"), b64("n")), "[^A-Za-z]", "")
    made = lambda i: F.concat(*[F.element_at(_listed(SYLLABLES), (F.pmod(F.xxhash64("id", F.lit(f"{i}-{j}")), F.lit(len(SYLLABLES))) + 1).cast("int")) for j in range(4)])
    ruler = F.repeat(F.element_at(_listed(["-", "_", "/", "x", "+"]), (F.pmod(F.xxhash64("id", F.lit("r")), F.lit(5)) + 1).cast("int")), 40)
    setting = F.concat(F.upper(F.concat_ws("_", word(4), name)), F.lit("="))
    parameter = F.concat(F.lit("https://example.com/"), word(4), F.lit("?"), name, F.lit("="))
    plain = F.concat(word(4), F.element_at(_listed(["=", ": ", " = \"", "=\""]), (F.pmod(F.xxhash64("id", F.lit("q")), F.lit(4)) + 1).cast("int")))
    assign, other = F.concat(name, put), F.concat(word(7), F.lit(" "), word(8), F.lit(" "))
    kinds = [
        (F.substring(h("x"), 1, 40), assign, quote, 1), (F.substring(b64("x"), 1, 32), assign, quote, 1), (h("x"), assign, quote, 1),
        (F.upper(F.substring(h("x"), 1, 40)), F.upper(assign), quote, 1), (F.substring(b64("y"), 1, 20), assign, quote, 1), (F.substring(h("z"), 1, 32), F.concat(other, F.lit("Bearer ")), F.lit(""), 1),
        (h("s"), F.concat(F.lit("sha256: "), F.lit("")), F.lit(""), 0), (F.substring(h("c"), 1, 40), F.lit("commit "), F.lit(""), 0), (uuid, F.concat(other, F.lit("id: ")), F.lit(""), 0),
        (digits, other, F.lit(" "), 0), (digits, F.lit("card number: "), F.lit("."), 0), (camel, other, F.lit("("), 0), (snake, F.concat(other, F.lit("= ")), F.lit(";"), 0),
        (F.concat(F.lit("your_"), snake), assign, quote, 0), (F.concat_ws("/", word(1), word(2), word(3), F.pmod("id", F.lit(31)).cast("string"), word(4)), F.lit("https://example.com/"), F.lit(" "), 0),
        (F.concat(word(1), F.lit("-example-"), F.lit("0123456789")), assign, quote, 0),
        (F.substring(letters, 1, 32), assign, quote, 1), (F.lower(F.substring(letters, 1, 24)), assign, quote, 1), (F.concat(F.substring(letters, 1, 70), F.substring(h("x"), 1, 6)), assign, quote, 1),
        (F.substring(h("e"), 1, 40), setting, F.lit(""), 1), (F.substring(b64("e"), 1, 40), setting, F.lit(""), 1), (F.substring(letters, 1, 40), setting, F.lit(""), 1),
        (F.substring(h("v"), 1, 32), parameter, F.lit("&page=2"), 1), (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64("v"), "[+/]", ""), 1, 36)), setting, F.lit(""), 1),
        (F.concat(word(1), word(2), word(3), word(4), word(5)), other, F.lit(""), 0), (F.concat(made(1), made(2)), other, F.lit(","), 0), (F.concat_ws("/", made(1), made(2), made(3)), F.concat(other, F.lit("/")), F.lit(""), 0),
        (F.upper(F.concat_ws("_", word(1), name, word(2), F.lit("key"), word(3))), F.lit("export "), F.lit("="), 0), (F.concat_ws("-", made(1), word(2), made(3)), plain, F.lit("\""), 0), (ruler, F.concat(other, F.lit("\n")), F.lit("\n"), 0),
        (F.concat_ws("_", word(1), made(2), word(3), word(4)), assign, quote, 0), (h("s"), F.element_at(_listed(["sha256=", "etag=", "commit=", "checksum=", "md5="]), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")), F.lit(""), 0),
        (F.concat(F.lit("eyJ"), F.substring(b64("j"), 1, 33)), F.concat(other, F.lit("Authorization: Bearer ")), F.lit("."), 1), (F.substring(b64("k"), 1, 43), F.concat(assign, F.lit("eyJ"), F.substring(b64("j"), 1, 20), F.lit(".")), F.lit("."), 1),
        (F.substring(F.concat(b64("f"), b64("g")), 1, 64), F.lit("-----BEGIN PRIVATE KEY-----\n"), F.concat(F.lit("\n"), F.substring(b64("o"), 1, 30)), 1), (F.substring(F.concat(b64("f"), b64("g")), 1, 64), F.concat(F.substring(b64("o"), 1, 40), F.lit("\n")), F.concat(F.lit("\n"), F.substring(b64("q"), 1, 30)), 1),
    ]
    assert len(kinds) == KINDS
    paths = ["src/app.py", "config/prod.env", "lib/auth.go", "", "web", "deploy/values.yaml", "tests/test_auth.py", "examples/demo.env", "docs/setup.md", "spec/fixtures/keys.json", "src/mock/client.ts", "data/sample.cfg"]
    drawn = F.pmod(F.xxhash64("id", F.lit("path")), F.lit(24))
    against, path = drawn >= 18, F.element_at(_listed(paths), F.when(drawn < 18, drawn % 6).otherwise(drawn - 12).cast("int") + 1)
    rows = spark.range(n).select("id", F.pmod("id", F.lit(KINDS)).alias("kind"))
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) if isinstance(k[i], int) else k[i] for k in kinds]), (F.col("kind") + 1).cast("int"))
    return rows.select(pick(0).alias("value"), F.concat(other, pick(1)).alias("left"), F.concat(pick(2), F.lit(" "), word(9)).alias("right"), path.alias("path"), F.when(against, 0).otherwise(pick(3)).alias("label"))


def fit(findings: DataFrame, bound: int = 4 * LABELLED) -> Model:
    """Transitions and a forest from at most `bound` labelled findings (value, left, right, path, label)."""
    findings = written(findings.where("label is not null and value <> ''").select("value", "left", "right", "path", "label").limit(bound))
    transitions = learn_transitions(F.concat_ws(" ", "left", "right"), findings)
    columns = features(F.col("value"), F.col("left"), F.col("right"), F.col("path"), transitions)
    rows = findings.select(*columns, F.col("label").cast("double").alias("label"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    return Model(RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=7, subsamplingRate=0.9).fit(vectors), transitions)


def _case(node, name: str) -> str:
    """A tree as a CASE expression; name(i) is the column of feature i."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / max(1e-12, sum(stats)):.6f}D"
    split = node.split()
    return f"CASE WHEN {name}.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {_case(node.leftChild(), name)} ELSE {_case(node.rightChild(), name)} END"


def score(model: Model, name: str) -> str:
    """SQL for the forest's mean leaf probability, over a struct column of that name."""
    trees = [_case(t._call_java("rootNode"), name) for t in model.forest.trees]
    return f"({' + '.join(trees)}) / {len(trees)}D"


#: Sizes are summed up within so many of them, and these sums one after another.
STRETCH = 128


def _stretches(sizes: Column) -> Column:
    """The sum of the sizes before each stretch of them."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size(sizes)
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(blocks, lambda b: total(F.slice(sizes, b * STRETCH + 1, F.lit(STRETCH))))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    return F.aggregate(sums, nothing, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])


def scan(docs: DataFrame, model: Model, text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD, names: tuple[str, str] = ("findings", "redacted")) -> DataFrame:
    """All columns of docs plus `findings` and `redacted`, or what names calls them: names that docs must not have. Other columns may have
    any name.

    findings: every candidate of the whole text as (start from 0 in characters, length, score, secret), in order; secret means a score
    of threshold or more. redacted: the text with each secret replaced by [SECRET]; null stays null with no findings, as an empty text
    has none. Repeated rows have the same result each, an empty table has none. Work grows with a text's length, however many
    candidates it has.
    """
    if set(names) & set(docs.columns):
        raise ValueError(f"docs must not have columns named {' or '.join(names)}")
    text, path = F.col(text_col), F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    safe = F.coalesce(text, F.lit(""))
    values, pieces = F.regexp_extract_all(safe, F.lit(CANDIDATE), F.lit(0)), F.split(safe, CANDIDATE, -1)
    # the caller's columns travel in one of their own, so that their names can't meet the names below
    cut = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text.alias("__text"), path.alias("__path"), values.alias("__v"), pieces.alias("__p"))
    text, path = F.col("__text"), F.col("__path")
    cut = cut.withColumn("__p", F.when(F.size("__v") > 0, F.col("__p")).otherwise(F.array(F.coalesce(text, F.lit("")))))
    # a name of 16 and more characters is a candidate too, and belongs to what is left of its value
    before = lambda i: F.concat(F.coalesce(F.get("__p", i - 2), F.lit("")), F.coalesce(F.get("__v", i - 2), F.lit("")), F.element_at("__p", i))
    around = F.transform(
        F.when(F.size("__v") > 0, F.sequence(F.lit(1), F.size("__v"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.element_at("__v", i).alias("value"), F.right(before(i), F.lit(NEIGHBOURS)).alias("left"), F.left(F.element_at("__p", i + 1), F.lit(NEIGHBOURS)).alias("right"), F.length(F.element_at("__p", i)).alias("gap")),
    )
    cut = cut.withColumn("__a", around)
    cut = cut.withColumn("__f", F.transform("__a", lambda a: F.struct(*features(a["value"], a["left"], a["right"], path, model.transitions))))
    cut = cut.withColumn("__s", F.expr(f"transform(__f, c -> {score(model, 'c')})"))
    cut = cut.withColumns({"__sizes": F.transform("__a", lambda a: (a["gap"] + F.length(a["value"])).cast("long")), "__gaps": F.transform("__a", lambda a: a["gap"].cast("long"))})
    cut = cut.withColumn("__before", _stretches(F.col("__sizes")))
    block = lambda i: F.floor(i / STRETCH).cast("int")
    start = lambda i: F.get("__before", block(i)) + F.aggregate(F.slice("__sizes", block(i) * STRETCH + 1, i % STRETCH), F.lit(0).cast("long"), lambda a, x: a + x) + F.get("__gaps", i)
    found = F.transform(
        "__a", lambda a, i: F.struct(start(i).cast("int").alias("start"), F.length(a["value"]).alias("length"), F.round(F.get("__s", i), 6).alias("score"), (F.get("__s", i) >= threshold).alias("secret"))
    )
    masked = F.zip_with("__p", F.zip_with("__v", "__s", lambda v, s: F.when(s >= threshold, F.lit(MASK)).otherwise(v)), lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    redacted = F.when(text.isNull(), text).when(F.exists("__s", lambda s: s >= threshold), F.array_join(masked, "")).otherwise(text)
    return cut.select(*[F.col(f"__row.`{c}`") for c in docs.columns], found.alias(names[0]), redacted.alias(names[1]))
