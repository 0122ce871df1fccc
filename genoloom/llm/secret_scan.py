"""Secret scan: patterns propose, a random forest trained from labelled findings removes false positives.

Native operations only: DataFrame functions and Spark's own forest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators.lineage import written

#: What a candidate looks like, by kind; none has an upper length. Tokens with a prefix of their own,
#: whole private keys (without an end: the header and the lines of key characters that follow), and long runs.
PREFIXED = {
    "private_key": r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=\s:,.\\-]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\r\n\\]*)",
    "aws_key": r"(?:AKIA|ASIA)[0-9A-Z]{16,}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{36,}",
    "github_pat": r"github_pat_[0-9A-Za-z_]{22,}",
    "gitlab_token": r"glpat-[0-9A-Za-z_-]{20,}",
    "slack_token": r"xox[abeoprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35,}",
    "npm_token": r"npm_[0-9A-Za-z]{36,}",
    "jwt": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
}
LONG = {
    "hex": r"[0-9a-fA-F]{32,}",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "base64": r"[A-Za-z0-9+/_-]{32,}={0,2}",
}
#: A name that introduces a secret, with what stands between it and the value.
NAMED = r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|credentials?|private[_-]?key)[A-Za-z0-9_]{0,20}[\"']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}[\"'`]?"
#: A value so introduced: 8 characters or more, a digit among them.
VALUE = r"(?=[^\s\"'`<>(){}\[\],;]*[0-9])[^\s\"'`<>(){}\[\],;]{8,}"
#: A long run starts where no character of its own class stands before, and holds a digit.
ANY = (
    rf"(?<![0-9A-Za-z_+])(?:{'|'.join(PREFIXED.values())})(?![0-9A-Za-z_])"
    rf"|{NAMED}{VALUE}"
    rf"|(?<![0-9A-Za-z_+/-])(?=[A-Za-z0-9+/_-]*[0-9]){LONG['base64']}(?![0-9A-Za-z_])"
)
KINDS = PREFIXED | LONG

#: Words that placeholders and ordinary identifiers are made of.
DICTIONARY = [
    "example", "sample", "test", "your", "token", "secret", "password", "changeme", "placeholder", "insert", "here", "dummy", "fake", "demo",
    "access", "value", "string", "default", "config", "service", "account", "user", "client", "server", "public", "private", "data", "name",
    "index", "table", "column", "request", "response", "handler", "manager", "factory", "version", "release", "module", "package", "abcdef", "12345", "xxxx", "0000",
    "build", "source", "main", "java", "http", "www", "com", "org", "static", "image", "content", "library", "include", "resource", "target", "report", "message",
    "event", "object", "model", "query", "store", "cache", "local", "remote", "login", "admin", "welcome", "qwerty", "letmein", "hello", "number", "field", "key", "file", "path", "date", "time", "list",
]
#: Words before a secret, and before a number that only looks like one.
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|apikey|access.?key|credential|auth|bearer|private)"
OTHER_WORDS = r"(?i)(commit|\bsha\d*|md5|checksum|digest|hash|uuid|guid|etag|revision|\bbuild\b|fingerprint|integrity|trace.?id|request.?id|correlation)"
#: Parts of a path or source name (whole words) that hold examples rather than live settings.
EXAMPLE_PATHS = r"(?i)(?<![a-z])(tests?|examples?|samples?|fixtures?|docs?|mocks?|demos?)(?![a-z])"
#: Characters of text before a candidate that count as its neighbourhood.
NEAR = 40
#: A long value is read in pieces, none of which cuts a run of letters of one case.
PIECE = r"(?s).{1,4096}(?:(?<=[a-z])[a-z]*+|(?<=[A-Z])[A-Z]*+|)"

FEATURES = ["size", "digits", "upper", "other_chars", "kinds", "steps", "words", "run", "named", "other", "assigned", "slash", "slashes", "dashes", "example_path", "own_prefix", "key_block"]


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The forest's inputs: length, shares and transitions of character classes, distinct characters, share
    covered by dictionary words, longest run of letters of one case, what stands around the candidate and where it
    comes from; all of whole values, whatever their length."""
    size = F.length(value).cast("double")
    n = F.greatest(size, F.lit(1.0))
    covered = F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    steps = F.regexp_count(value, F.lit(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"))
    pieces = F.regexp_extract_all(value, F.lit(PIECE), F.lit(0))
    distinct = F.aggregate(pieces, F.array().cast("array<string>"), lambda seen, p: F.array_union(seen, F.split(p, "")))
    runs = lambda p: F.transform(F.regexp_extract_all(p, F.lit("[a-z]+|[A-Z]+"), F.lit(0)), F.length)
    found = {
        "size": size,
        "digits": F.regexp_count(value, F.lit("[0-9]")) / n,
        "upper": F.regexp_count(value, F.lit("[A-Z]")) / n,
        "other_chars": F.regexp_count(value, F.lit("[^0-9A-Za-z]")) / n,
        "kinds": F.size(distinct) / F.least(n, F.lit(40.0)),
        "steps": steps / n,
        "words": 1 - covered / n,
        "run": F.array_max(F.transform(pieces, lambda p: F.array_max(runs(p)))),
        "named": before.rlike(SECRET_WORDS),
        "other": before.rlike(OTHER_WORDS),
        "assigned": before.rlike(r"[=:]>?\s*[\"'`]?$"),
        "slash": before.rlike(r"[/\\]$") | after.rlike(r"^[/\\.]"),
        "slashes": F.regexp_count(value, F.lit("/")) / n,
        "dashes": F.regexp_count(value, F.lit("[-_.]")) / n,
        "example_path": path.rlike(EXAMPLE_PATHS),
        "own_prefix": value.rlike(rf"^(?:{'|'.join(PREFIXED.values())})$"),
        "key_block": value.rlike("^-----BEGIN") & (size >= 200),
    }
    return [F.coalesce(found[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES]


def labelled_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """Labelled findings made by rule (``rows`` of them, a fixed bound): value, before, after, path, label.

    Twenty kinds in turn: live keys with their own prefix, keys in blocks, random values of many alphabets and lengths
    that a secret's name introduces; and what scanners mistake for either: placeholders, words, digests, identifiers,
    paths and addresses, counters, dates.
    """
    base = spark.range(rows).select(
        "id", F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256).alias("h"), (F.col("id") % 20).alias("k"), F.floor(F.col("id") / 20).alias("n")
    )
    digest_of = lambda salt: F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.col("h"), F.lit(salt)), 512))), "[=\r\n]", "")
    # over 600 characters of base64 a row; written, so that what follows reads columns instead of repeating their making
    base = written(base.withColumn("raw", F.concat(*map(digest_of, "abcdefgh"))).withColumn("hexes", F.concat("h", F.sha2("h", 256))), "findings")
    raw, hexes, key, n = F.col("raw"), F.col("hexes"), F.col("k"), F.col("n")
    mixed, url = F.translate(raw, "+/", "aQ"), F.translate(raw, "+/", "-_")
    upper = F.upper(F.translate(raw, "abcdefghijklmnopqrstuvwxyz+/", "QWERTYUIOPASDFGHJKLZXCVBNMAQ"))
    pick = lambda items, step=1: F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.col("n") * step + F.col("k"), F.lit(len(items))) + 1).cast("int"))
    word = lambda k: pick(DICTIONARY, 7 + 2 * k)
    prose = pick(["the values of ", "and then with ", "for it was ", "\n", " in the ", "of, ", "", "so that "])
    name = pick(["token = \"", "api_key: ", "password=", "secret_key = '", "Authorization: Bearer ", "access_token=\"", "AWS_SECRET_ACCESS_KEY=", "\"client_secret\": \"", "DB_PASSWORD: "], 5)
    digest = pick(["commit ", "sha256: ", "md5 = ", "checksum ", "etag: \"", "build ", "digest=", "uuid ", "request_id=", "sha512-"], 3)
    cut = lambda text, least, most: F.substring(text, F.lit(1), (F.pmod(F.xxhash64("h"), F.lit(most - least + 1)) + least).cast("int"))
    prefix = pick(["ghp_", "sk_live_", "xoxb-", "AIza", "github_pat_", "npm_", "glpat-"])
    symbols = F.translate(cut(raw, 9, 16), "abcdeABCDE", "!#$%^&*?@~")
    block = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.regexp_replace(F.concat(raw, F.reverse(raw)), "(.{64})", "$1\n"), F.lit("\n-----END RSA PRIVATE KEY-----"))
    uuid = F.concat_ws("-", *[F.substring("h", x, y) for x, y in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    value = (
        F.when(key.isin(0, 1), F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)))
        .when(key == 2, cut(hexes, 32, 128))
        .when(key == 3, cut(raw, 32, 120))
        .when(key == 4, F.concat(prefix, cut(mixed, 36, 90)))
        .when(key == 5, cut(mixed, 10, 40))
        .when(key == 6, F.concat(F.substring(raw, 1, 86), F.lit("==")))
        .when(key == 7, symbols)
        .when(key == 8, F.when(n % 2 == 0, block).otherwise(F.concat(F.lit("eyJ"), F.substring(url, 1, 20), F.lit("."), F.substring(url, 30, 60), F.lit("."), F.substring(url, 100, 43))))
        .when(key == 9, cut(url, 32, 64))
        .when(key == 10, F.rpad(F.concat(F.lit("AKIA"), F.upper(F.concat(word(1), word(2)))), 20, "EXAMPLE0"))
        .when(key == 11, F.when(n % 3 == 0, cut(hexes, 32, 128)).when(n % 3 == 1, F.substring("h", 1, 40)).otherwise(F.substring("h", 1, 32)))
        .when(key == 12, F.rpad(F.concat(word(1), F.lit("_"), word(2), F.lit("_"), word(3), F.lit("_"), word(4), F.lit("1")), 36, "x0"))
        .when(key == 13, F.rpad(F.concat((n % 10).cast("string"), F.lit("0")), 32, "0123456789"))
        .when(key == 14, F.when(n % 2 == 0, F.rpad(word(1), 40, "xxxx1")).otherwise(F.concat(word(1), F.lit("123"), word(2))))
        .when(key == 15, F.substring("h", 1, 40))
        .when(key == 16, F.concat(word(1), F.lit("/"), word(2), F.lit("/"), word(3), F.lit("-"), (n % 97).cast("string"), F.lit("/"), word(4), F.lit("_"), word(5)))
        .when(key == 17, F.when(n % 3 == 0, F.lit("-----BEGIN PRIVATE KEY-----")).otherwise(uuid))
        .when(key == 18, F.concat_ws("-", word(1), word(2), word(3), word(4), F.concat(F.lit("v"), (n % 31).cast("string")), word(5)))
        .otherwise(F.when(n % 2 == 0, F.concat(F.lit("20"), (n % 30 + 10).cast("string"), F.lit("-01-12T10:0"), (n % 10).cast("string"))).otherwise(F.concat(F.lit("https://"), word(1), F.lit("."), word(2), F.lit("/"), (n % 1000).cast("string"))))
    )
    before = (
        F.when(key.isin(0, 4), F.concat(prose, name)).when(key.isin(1, 8), prose).when(key.isin(2, 3, 5, 6, 7, 9, 10, 14, 19), F.concat(prose, name))
        .when(key == 11, F.concat(prose, digest)).when(key == 12, name).when(key.isin(13, 16, 18), prose)
        .when(key == 17, F.when(n % 2 == 0, F.concat(prose, digest)).otherwise(prose)).otherwise(F.concat(prose, F.lit("see /objects/")))
    )
    path = F.when((key >= 10) & (n % 3 == 0), F.lit("tests/fixture")).otherwise(pick(["src1", "docker/run", "latest", "config/app"]))
    return base.select(value.alias("value"), F.right(before, F.lit(NEAR)).alias("before"), F.when(n % 2 == 0, '"').otherwise(" ").alias("after"), path.alias("path"), (key < 10).cast("double").alias("label"))


def train_forest(findings: DataFrame, trees: int = 32, depth: int = 8) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, before, after, path, label)."""
    rows = findings.select("label", *features(F.col("value"), F.col("before"), F.col("after"), F.col("path")))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=5).fit(rows)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, n, value, before, after, path): every candidate of each whole text, numbered from 1. A name that
    introduces a value belongs to what stands before it."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path")).filter(F.col("text").rlike(ANY))
    found = rows.select("id", "path", F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)).alias("values"), F.split("text", ANY).alias("between"))
    one = F.transform("values", lambda v, k: F.struct(v.alias("whole"), F.right(F.get("between", k), F.lit(NEAR)).alias("left"), F.left(F.get("between", k + 1), F.lit(8)).alias("after")))
    rows = found.select("id", "path", F.posexplode(one).alias("k", "c")).select("id", (F.col("k") + 1).cast("long").alias("n"), "c.*", "path")
    name = F.regexp_extract("whole", f"^(?:{NAMED})", 0)
    return rows.withColumn("name", name).select("id", "n", F.expr("substring(whole, length(name) + 1)").alias("value"), F.right(F.concat("left", "name"), F.lit(NEAR)).alias("before"), "after", "path")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", model: RandomForestClassificationModel | None = None, at_least: float = 0.5) -> DataFrame:
    """One row per candidate: id, n (its number in the text), kind, value, before (text that it follows), score
    (the forest's share for a secret, rounded to 6 places) and is_secret (score >= ``at_least``, so a tie of the
    forest's votes is a secret).

    Null and empty texts have no candidates; a repeated row's candidates are repeated; null ids stay; an empty table
    gives an empty result; columns of other names are ignored. Without ``model``, one is trained from
    :func:`labelled_findings`. Whole texts and values of any length, one pass, no shuffle of texts.
    """
    model = model or train_forest(labelled_findings(df.sparkSession))
    rows = candidates(df, id_col, text_col, path_col)
    kind = reduce(lambda rest, kv: F.when(F.col("value").rlike(f"^(?:{kv[1]})$"), kv[0]).otherwise(rest), reversed(KINDS.items()), F.lit("named"))
    rows = rows.select("id", "n", kind.alias("kind"), "value", "before", *features(F.col("value"), F.col("before"), F.col("after"), F.col("path")))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))
    score = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scored.select(F.col("id").alias(id_col), "n", "kind", "value", "before", score.alias("score"), (score >= at_least).alias("is_secret"))


def mask_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", model: RandomForestClassificationModel | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``df`` with each secret of its texts replaced by ``mask``, whole and wherever it stands in that text; other rows
    and columns stay as they are (a column may have any name but two that start with ``__secret_scan``).

    Null and empty texts, null ids and repeated rows stay as rows of their own. Only rows with a candidate (found by
    the same pattern) are shuffled, keyed by a 256-bit hash of their text and path; all others pass by.
    """
    key, values_col = "__secret_scan_key", "__secret_scan_values"
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    hit = F.coalesce(F.col(text_col).rlike(ANY), F.lit(False))
    rows = df.filter(hit).withColumn(key, F.sha2(F.concat(F.col(text_col), F.lit("\0"), path), 256))
    asked = rows.select(F.col(key).alias("id"), F.col(text_col).alias("text"), path.alias("path"))
    found = scan_secrets(asked, "id", "text", "path", model).filter("is_secret")
    values = found.groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_set("value")).alias(values_col))
    # longest first, so a secret that holds another goes as a whole
    ordered = F.array_sort(values_col, lambda a, b: F.length(b) - F.length(a))
    masked = rows.join(values, key, "left").withColumn(
        text_col, F.when(F.col(values_col).isNull(), F.col(text_col)).otherwise(F.aggregate(ordered, F.col(text_col), lambda t, v: F.replace(t, v, F.lit(mask))))
    )
    return masked.select(*df.columns).unionByName(df.filter(~hit))
