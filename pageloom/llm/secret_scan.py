"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything on the main path is column expressions and Spark ML: candidates
are cut out of lines by regular expressions, measured by built-in functions
and judged by a forest trained on labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

NAMES = r"(?i:passwords?|passwd|pwd|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|credentials?|auth)"
ASSIGNED = NAMES + r"[\"']?\s{0,3}(?:=>|:=|[=:])\s{0,3}[\"'`]?"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
CANDIDATE = rf"{ASSIGNED}[^\s\"'`<>,;]{{6,}}+|{RUN}"
NEAR = 48  # characters on either side that count as neighbouring words
MARK = "[SECRET]"

# Words that secrets are seldom made of; their letter pairs are the transitions of written language.
DICTIONARY = (
    "about access account action active address admin after again allow answer application archive array article "
    "background backup banner before block border branch build button cache category change channel check child class "
    "client cloud code column command comment common company component config content context control cookie country "
    "create current custom data database date debug default delete description design detail develop device dialog "
    "directory display document domain download dummy element email enable engine entry error event example export "
    "feature field file filter first folder footer form format frame function generate global group handler header height "
    "here home host image import index information insert install integer interface internal item journal label language "
    "layout length level library license line link list local location login machine main manager master media member "
    "menu message method model module name navigation network node number object option order package page panel parent "
    "password path people person placeholder please point policy position private process product profile project "
    "property public python query random range record release remote replace report request resource response result "
    "return sample schema screen script search secret section select server service session setting share simple site "
    "source space special staging start state static status storage string style submit support switch system table "
    "target task template test text theme thread time title token tool tree type update upload user value version video "
    "view width window word wrapper write your"
).split()
PAIRS = sorted({word[i : i + 2] for word in DICTIONARY for i in range(len(word) - 1)})

FEATURES = (
    "length", "digits", "capitals", "others", "turns", "written", "dictionary", "variety", "repeats", "hexadecimal",
    "test_path", "config_path", "named", "assigned", "quoted", "disclaimed", "identifies",
)


def candidates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """(id, path, line, nth, secret, before, after): every candidate of every line.

    ``line`` counts from 1, ``nth`` is the candidate's number in the line,
    ``before`` and ``after`` are what stands next to it up to the candidates
    on either side. Runs of letters alone are candidates only when assigned.
    """
    lines = F.transform(
        F.split(whole_text(text_col), "\n"),
        lambda line, i: F.struct(
            (i + 1).alias("line"), line.alias("whole"), F.regexp_extract_all(line, F.lit(CANDIDATE), F.lit(0)).alias("found")
        ),
    )
    rows = documents.select(
        F.col(id_col).alias("id"),
        F.coalesce(path if path is not None else F.lit(""), F.lit("")).alias("path"),
        F.explode(F.filter(lines, lambda x: F.size(x["found"]) > 0)).alias("x"),
    )
    rows = rows.select("id", "path", "x.line", "x.found", F.split("x.whole", CANDIDATE, -1).alias("parts"))
    prefix = rf"^{ASSIGNED}"
    each = F.transform(
        "found",
        lambda match, i: F.struct(
            (i + 1).alias("nth"),
            F.regexp_replace(match, prefix, "").alias("secret"),
            F.concat(F.get("parts", i), F.regexp_extract(match, prefix, 0)).alias("before"),
            F.get("parts", i + 1).alias("after"),
        ),
    )
    rows = rows.select("id", "path", "line", F.explode(each).alias("c")).select("id", "path", "line", "c.*")
    rows = rows.withColumns({"before": F.right("before", F.lit(NEAR)), "after": F.left("after", F.lit(NEAR))})
    return rows.filter(F.rlike("secret", F.lit("[0-9]")) & F.rlike("secret", F.lit("[A-Za-z]")) | F.rlike("before", F.lit(f"{ASSIGNED}$")))


def measures() -> Column:
    """``FEATURES`` of a candidate row as an array of doubles."""
    secret, low = F.col("secret"), F.lower("secret")
    size = F.greatest(F.length(secret), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(secret, F.lit(pattern)) / size

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    pairs = F.filter(
        F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(low, i, 2)), lambda p: p.rlike("^[a-z]{2}$")
    )
    common = F.array(*[F.lit(p) for p in PAIRS])
    written = F.size(F.filter(pairs, lambda p: F.array_contains(common, p))) / F.greatest(F.size(pairs), F.lit(1))
    plain = F.length(F.regexp_replace(low, "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)), ""))
    near = F.concat_ws(" ", "before", "after")
    values = (
        F.length(secret).cast("double"),
        share("[0-9]"),
        share("[A-Z]"),
        share("[^A-Za-z0-9]"),
        share("[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])"),
        written,
        1 - plain / size,
        F.size(F.array_distinct(F.split(secret, ""))) / size,
        flag(secret.rlike(r"(.)\1{3,}")),
        flag(secret.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        flag(F.lower("path").rlike("test|spec|mock|fixture|example|sample|docs?(?:/|$)|vendor")),
        flag(F.lower("path").rlike(r"\.env|\.ya?ml|\.ini|\.conf|\.pem|\.properties|config|settings|secret")),
        flag(F.col("before").rlike(rf"{NAMES}|(?i:bearer|private)")),
        flag(F.col("before").rlike(r"(?:=>|:=|[=:])\s*[\"'`]?$")),
        flag(F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")),
        flag(F.lower(near).rlike("example|sample|dummy|placeholder|changeme|your|fake|redacted")),
        flag(F.lower(F.col("before")).rlike("commit|sha-?[0-9]|md5|checksum|digest|hash|uuid|guid|integrity|etag|revision|version|isbn|phone|card|http|path|class|href")),
    )
    return F.array(*[v.cast("double") for v in values])


# (label, path, line with {} for the value, value): h hexadecimal, b base 64, w words, d digits, u UUID, x filler.
_FINDINGS = (
    (1, "src/app.py", 'token = "{}"', "h40"), (1, "", 'of and token = "{}" with it', "h40"),
    (1, "notes.txt", "the token: {} was sent", "h32"), (1, "deploy/.env", "API_KEY={}", "b32"),
    (1, "config/settings.yml", "secret_key: '{}'", "b40"), (1, "src/db.go", 'password := "{}"', "b16"),
    (1, "", 'api_key = "{}"', "h32"), (1, "", "password: {}", "b16"), (1, "run.sh", "export ACCESS_TOKEN={}", "b40"),
    (1, "client.js", "Authorization: Bearer {}", "b40"), (1, "", 'aws_secret_access_key = "{}"', "b40"),
    (1, "", "use {} as the secret", "pb36"), (1, "src/git.py", 'url = "{}"', "pb36"), (1, "", "auth: {}", "h64"),
    (1, "", 'word word secret="{}"', "b24"), (1, "", "key {} end", "pb36"),
    (0, "", "commit {}", "h40"), (0, "src/app.py", "see commit {} for more", "h40"), (0, "", "sha256: {}", "h64"),
    (0, "a.html", 'integrity="sha384-{}"', "b64"), (0, "", "checksum {} ok", "h32"), (0, "", "md5 = {}", "h32"),
    (0, "", "uuid {}", "u"), (0, "src/x.py", 'id = "{}"', "u"), (0, "", 'token = "{}"', "w24"),
    (0, "readme.md", "password = {}", "w16"), (0, "a.css", 'class="{}"', "w30"), (0, "src/a.ts", "import {}", "w40"),
    (0, "", "card {} paid", "d16"), (0, "", "call {} now", "d16"), (0, "", 'token = "{}"', "x20"),
    (0, "", "api_key={}", "x32"), (0, "tests/fixtures/a.py", 'token = "{}"', "h40"),
    (0, "docs/example.md", "example api_key={}", "b32"), (0, "", "http://host/{}", "w40"),
    (0, "", "path {}", "w40"), (0, "", "version {} build", "h16"), (0, "", "revision {}", "h40"),
    (0, "", "{} is a long name", "w30"), (0, "", "token: {}", "l9"), (0, "", "the password: {}", "l12"),
)


def labelled_findings(spark: SparkSession, each: int = 60) -> DataFrame:
    """(path, text, label): ``each`` lines per template, with values drawn by a hash of the row's number.

    The table is made by a rule, so that it needs no file; findings labelled
    elsewhere may be passed to ``train_forest`` instead, in the same columns.
    """
    shapes = F.array(
        *[
            F.struct(F.lit(a).alias("label"), F.lit(b).alias("path"), F.lit(c).alias("line"), F.lit(d).alias("kind"))
            for a, b, c, d in _FINDINGS
        ]
    )
    rows = spark.range(0, len(_FINDINGS) * each, 1, 2).select(
        "id", F.get(shapes, F.pmod("id", F.lit(len(_FINDINGS))).cast("int")).alias("f")
    )
    rows = rows.select("id", "f.*", F.regexp_extract("kind", "[0-9]+", 0).try_cast("int").alias("n"))
    digest = F.sha2(F.col("id").cast("string"), 512)
    dense = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    words = F.array(*[F.lit(w) for w in DICTIONARY])

    def drawn(salt: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(DICTIONARY))).cast("int"))

    phrase = F.concat_ws("_", *[drawn(i) for i in range(8)], F.pmod("id", F.lit(97)).cast("string"))
    letters = F.translate(F.concat(drawn(11), drawn(12), drawn(13)), "_", "")
    value = (
        F.when(F.col("kind").startswith("pb"), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(dense, "[+/]", ""), 1, 36)))
        .when(F.col("kind").startswith("h"), F.expr("substring(sha2(cast(id as string), 512), 1, n)"))
        .when(F.col("kind").startswith("b"), F.left(dense, F.col("n")))
        .when(F.col("kind").startswith("w"), F.concat(F.left(phrase, F.col("n")), F.lit("_1")))
        .when(F.col("kind").startswith("l"), F.left(letters, F.col("n")))
        .when(F.col("kind").startswith("d"), F.left(F.translate(digest, "abcdef", "123456"), F.col("n")))
        .when(F.col("kind").startswith("x"), F.concat(F.lit("a1"), F.expr("repeat(substring('xX0*', 1 + cast(id % 3 as int), 1), n)")))
        .otherwise(F.regexp_replace(F.left(digest, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    )
    text = F.concat(F.split_part("line", F.lit("{}"), F.lit(1)), value, F.split_part("line", F.lit("{}"), F.lit(2)))
    return rows.select("id", "path", text.alias("text"), "label")


def train_forest(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    """A forest fitted to labelled findings (id, path, text, label).

    Every candidate of a finding's text takes its label; the table is bounded
    by its maker, not by the corpus.
    """
    marked = findings.select("id", "label").withColumn("label", F.col("label").cast("double"))
    rows = candidates(findings, "id", "text", F.col("path")).join(marked, "id")
    rows = rows.select(array_to_vector(measures()).alias("features"), "label")
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(rows)
    return fitted.copy()  # without the training summary, which tasks cannot carry


def scan_secrets(
    documents: DataFrame,
    forest: RandomForestClassificationModel,
    threshold: float = 0.5,
    path: Column | None = None,
) -> DataFrame:
    """(doc_id, path, line, nth, secret, score) of the candidates that the forest accepts.

    Null and empty texts have no findings, a null path counts as empty; a
    repeated document repeats its findings. Nothing is shuffled.
    """
    rows = candidates(documents, "doc_id", "text", path).withColumn("features", array_to_vector(measures()))
    judged = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return judged.filter(F.col("score") >= threshold).select(
        F.col("id").alias("doc_id"), "path", "line", "nth", "secret", "score"
    )


def redact_secrets(documents: DataFrame, forest: RandomForestClassificationModel, path: Column | None = None) -> DataFrame:
    """``documents`` with every finding in a text replaced by ``[SECRET]``
    wherever it stands in that text; ``n_chars``, if there is one, follows.

    Each row is masked by the findings of its own text and path, also rows that
    share an id or have none; equal rows are masked alike. Null and empty texts
    and all other columns stay as they are, whatever their names.
    """
    place = F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    # rows with one key have the same text and path: it stands for an id in the findings
    key = F.struct(F.xxhash64("doc_id", text, place).alias("hash"), F.xxhash64(F.lit(1), text).alias("text"), F.length(text).alias("length"))
    marked = documents.select(F.struct("*").alias("row"), key.alias("key"), place.alias("place"))
    texts = marked.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"), "place")
    found = scan_secrets(texts, forest, path=F.col("place")).groupBy("doc_id").agg(F.collect_set("secret").alias("found"))
    joined = marked.join(found, F.col("key") == F.col("doc_id"), "left")
    longest_first = F.array_sort(
        "found", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).otherwise(1)
    )
    clean = F.aggregate(longest_first, F.col("row.text"), lambda text, secret: F.replace(text, secret, F.lit(MARK)))
    masked = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(clean)
    out = joined.select("row", "found", masked.alias("masked"))
    columns = {c: F.col("row")[c] for c in documents.columns} | {"text": F.col("masked")}
    if "n_chars" in columns:
        counted = F.length("masked").cast(documents.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("found").isNull(), columns["n_chars"]).otherwise(counted)
    return out.select(*[value.alias(name) for name, value in columns.items()])
