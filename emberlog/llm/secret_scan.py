"""Secret scans (5): a random forest removes the false positives of candidate patterns. DataFrame functions and Spark ML only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import words

#: Runs of token characters, of which candidates are made. = is none, so that NAME=VALUE is two runs.
RUN = "[A-Za-z0-9+/_.-]{8,}+"
#: A run of so many characters with a digit is a candidate anywhere; shorter ones and those without a digit are, where
#: what lies before them announces a secret.
LONG_RUN = 12
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s\\]{16,}+-----END [A-Z ]{0,40}PRIVATE KEY-----"
#: The end of user information in front of a password, as in scheme://user:
USER_INFO = "://[^/@]*:$"
#: Words that announce a secret, words that announce something else, and dictionary words (fixed values).
SECRET_WORDS = "token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|auth|bearer"
HARMLESS_WORDS = "sha1|sha256|md5|commit|hash|checksum|digest|uuid|guid|revision|version|build|page|order|phone|card|isbn|id"
DICTIONARY = "example|sample|change|your|here|required|protected|environ|getenv|process|undefined|manager|reset|ingredient|generat|authenti|dummy|test|placeholder|password|secret|token|key|value|user|name|file|data|index|page|config|version|build|image|http|www|com|mail|org|net|html|order|report|null|none|true|false"
BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
SAFE_PATHS = "test|example|sample|doc|fixture|mock|spec"
FEATURES = ("length", "distinct", "digits", "upper", "switches", "case_switches", "bigrams", "covered", "hex", "shape", "safe_path", "near_secret", "near_harmless", "assigned")
TREES, DEPTH, SEED = 24, 7, 17
#: Labelled findings that are made for training.
FINDINGS = 4000


def _share(x: Column, pattern: str) -> Column:
    """The part of x's characters that lie in matches of pattern."""
    return 1 - F.length(F.regexp_replace(x, pattern, "")) / F.greatest(F.length(x), F.lit(1))


def with_features(found: DataFrame) -> DataFrame:
    """Add FEATURES to (value, before, path): before holds what candidates() puts in front of the value."""
    v, low, near = F.col("value"), F.lower("value"), F.lower("before")
    n = F.greatest(F.length(v), F.lit(1))
    count = lambda x, p: F.regexp_count(x, F.lit(p)) / n
    return found.withColumns({
        "length": F.least(n, F.lit(200)).cast("double"), "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(40)),
        "digits": _share(v, "[0-9]+"), "upper": _share(v, "[A-Z]+"),
        "switches": count(v, "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), "case_switches": count(v, "[a-z](?=[A-Z])"),
        "bigrams": count(low, f"(?:{BIGRAMS})"), "covered": _share(low, DICTIONARY), "hex": F.when(low.rlike("^[0-9a-f]+$"), 1.0).otherwise(0.0),
        "shape": F.when(v.rlike("^(-----BEGIN .*|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abp]-.*|sk[-_].*)$"), 2.0).when(low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), -1.0).when(v.rlike("^[0-9.+-]+$"), -2.0).when(v.rlike(r"[/.].*[/.]|^[0-9]{1,5}/"), -3.0).otherwise(0.0),
        "safe_path": F.when(F.lower("path").rlike(SAFE_PATHS), 1.0).otherwise(0.0),
        "near_secret": F.when(near.rlike(rf"(?:{SECRET_WORDS})|{USER_INFO}"), 1.0).otherwise(0.0), "near_harmless": F.when(near.rlike(rf"\b(?:{HARMLESS_WORDS})\b"), 1.0).otherwise(0.0),
        "assigned": F.when(near.rlike(rf"[=:]>?\s*[\"'`]*$|[?&][a-z_]+=$|{USER_INFO}"), 1.0).otherwise(0.0),
    })


def labelled_findings(spark: SparkSession, n: int = FINDINGS, salt: str = "train") -> DataFrame:
    """(value, before, path, label): findings of known truth, made from hashes of their numbers."""
    h = lambda k: F.sha2(F.concat_ws(":", F.lit(salt), F.col("id"), F.lit(k)), 256)
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), F.col("id"), F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "[+/=]", "x")
    own = pick("own", ["token =", "api_key:", "secret =", "password =", "export AUTH_TOKEN=", "Authorization: Bearer", "access_key ="])
    other = pick("other", ["commit", "sha256", "checksum", "see page", "uuid", "order id", "the phone", "build version", "md5 hash", "was on"])
    plain = pick("plain", ["the and of", "is on with", "see also the", "of an was"])
    number = F.rpad(F.regexp_replace(h("d"), "[a-f]", ""), 16, "7")
    name = pick("name", ["userConfigValue", "page_index_test", "reportBuilderFile", "thetionanding", "order-number-of", "image_version_"])
    joined = pick("joined", ["API_KEY=", "export OAUTH2_CLIENT_SECRET=", "--password=", '{"token":"', '","secret":"', "{'access_key':'", "https://x.io/cb?token=", "https://x.io/page?lang=en&api_key=", "id=7;pwd="])
    harmless = pick("harmless", ["COMMIT=", "BUILD=", '{"sha256":"', '","commit":"', "https://x.io/cb?page=", "https://x.io/log?lang=en&order=", "checksum=", "id="])
    dsn = pick("dsn", ["postgres://app:", "DATABASE_URL=mysql://root:", "redis://:", "https://bob:", "amqp://svc1:"])
    host = F.concat(pick("db", ["db", "node", "cache", "mail"]), F.substring(number, 1, 2), pick("tld", [".example.com", ".internal.net", ".example.org/main"]))
    password = F.concat(F.substring(F.lower(b64), 1, 6), F.substring(number, 1, 1), F.substring(b64, 8, 6))
    part = lambda k: pick(k, ["river", "stone", "hunter", "blue", "horse", "winter", "dragon", "pass", "phrase", "monkey", "silver", "magic", "tiger", "coffee"])
    phrase = F.concat(part("p1"), part("p2"), F.when(F.pmod(F.col("id"), F.lit(2)) == 0, part("p3")).otherwise(F.lit("")))
    prose = pick("prose", ["required", "protected", "authentication", "ingredients", "generation", "according", "manager", "resetting", "validation", "between", "something", "distributed"])
    talk = pick("talk", ["the password is", "a secret", "with token", "of the api_key", "the secret of", "our credential", "password and", "the auth"])
    code = pick("code", ["os.environ", "config.password", "process.env.TOKEN", "getpass.getpass", "undefined", "settings.SECRET_KEY", "self.password", "request.token", "example_value", "changeme", "your_password_here", "placeholder"])
    kinds = [  # value, words before, is a secret
        (F.substring(h("a"), 1, 32), own, 1), (F.substring(h("a"), 1, 40), own, 1), (F.substring(b64, 1, 40), own, 1), (F.substring(b64, 1, 24), own, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(b64, 1, 16), "x", "Q"))), pick("e", ["token =", "key:", "the of", "was on"]), 1),
        (F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), pick("e", ["token =", "use", "the of"]), 1),
        (F.substring(h("a"), 1, 40), other, 0), (F.substring(h("a"), 1, 32), other, 0), (h("a"), other, 0), (F.expr("uuid_text"), other, 0), (number, plain, 0), (number, own, 0),
        (F.concat(name, F.substring(number, 1, 3)), plain, 0), (F.concat(name, F.substring(number, 1, 2)), own, 0),
        (pick("fake", ["your_token_here_123", "example_password_1", "xxxxxxxxxxxx1234", "change-me-secret-99", "test_key_placeholder0"]), own, 0),
        (F.concat(F.lit("www.example.com/page/"), F.substring(number, 1, 4), F.lit(".html")), plain, 0), (F.concat(F.substring(number, 1, 2), F.lit("."), name, F.lit(".example.com")), plain, 0),
        # joined, JSON, URL and DSN forms
        (F.substring(h("a"), 1, 32), joined, 1), (F.substring(h("a"), 1, 40), joined, 1), (F.substring(b64, 1, 24), joined, 1), (password, joined, 1), (password, dsn, 1), (F.substring(b64, 1, 16), dsn, 1), (F.substring(h("a"), 1, 24), dsn, 1),
        (F.substring(h("a"), 1, 40), harmless, 0), (h("a"), harmless, 0), (F.expr("uuid_text"), harmless, 0), (number, harmless, 0), (number, joined, 0), (F.concat(name, F.substring(number, 1, 2)), joined, 0),
        (host, pick("at", ["@", "postgres://", "https://", "HOST="]), 0), (F.concat(F.substring(number, 1, 4), F.lit("/"), name), pick("port", ["http://localhost:", "https://x.io:", "redis://cache:"]), 0),
        # short ones, words only, and key blocks
        (F.substring(password, 1, 9), own, 1), (F.substring(password, 1, 10), joined, 1), (F.substring(password, 3, 8), dsn, 1), (phrase, own, 1), (phrase, joined, 1), (phrase, dsn, 1), (F.concat(phrase, F.substring(number, 1, 2)), own, 1),
        (F.concat(F.lit("-----BEGIN PRIVATE KEY-----"), b64, b64, F.lit("-----END PRIVATE KEY-----")), pick("e3", ["", "the of"]), 1),
        (prose, talk, 0), (prose, plain, 0), (prose, pick("said", ["the password:", "token:", "api_key is", "your secret", "auth"]), 0), (code, own, 0), (code, joined, 0), (pick("endings", ["thereationed", "oneandtiones", "anthinged", "erauendenst"]), talk, 0),
        (pick("names", ["OAUTH2_CLIENT_SECRET", "S3_SECRET_ACCESS_KEY", "oauth2_client_token", "API_V2_PASSWORD"]), pick("e2", ["export", '{"', "", "https://x.io/cb?"]), 0),
    ]
    uuid = F.concat_ws("-", *(F.substring(h("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kind = F.array(*(F.struct(v.alias("value"), b.alias("before"), F.lit(float(y)).alias("label")) for v, b, y in kinds))
    path = pick("path", ["src1", "src12", "conf/app.env", "deploy/prod.yml", "web/page", "tests/data", "docs/example"])
    rows = spark.range(0, n, 1, 1).withColumn("uuid_text", uuid).withColumn("k", F.element_at(kind, (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int")))
    return rows.select("k.value", "k.before", path.alias("path"), "k.label")


def vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(with_features(found))


def train(spark: SparkSession, findings: DataFrame | None = None) -> RandomForestClassificationModel:
    """Fit the forest on labelled findings (value, before, path, label), FINDINGS made ones unless given."""
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(vectors(findings or labelled_findings(spark)))


def _announced(text: Column) -> Column:
    return F.lower(text).rlike(rf"(?:{SECRET_WORDS})|{USER_INFO}")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, word, value, before, path): all runs of 12 or more token characters with a digit, all of 8 or more that
    come after words which announce a secret, several a word, and whole private-key blocks.

    `word` is the word's number in its text. `before` is, for a word's first run, the three words in front and the
    word's beginning; for the next ones what lies between it and the run before, with that run where it is the name
    (name=value, "name":"value"); in a list, where no name lies between, what was before the run before. Of equal
    key blocks in a text the first counts; its lines are runs like any other.
    """
    text = F.col(text_col).cast("string")
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), text.alias("text"))
    told = F.lower("text").rlike(f"(?:{SECRET_WORDS})|://")
    d = rows.where(F.col("text").rlike("[0-9]") | told).select("doc_id", "path", words(F.col("text")).alias("w"), told.alias("told"))
    # places of words; no lambda looks at another array, which would make it anew for each word
    places = lambda test: F.filter(F.transform("w", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    names = places(lambda x: F.lower(x).rlike(f"(?:{SECRET_WORDS})|://[^/@]*:"))
    after = F.array_distinct(F.flatten(F.transform(names, lambda i: F.sequence(i, i + 3))))
    mixed = places(lambda x: (F.length(x) >= LONG_RUN) & x.rlike("[0-9]"))
    at = F.when(F.col("told"), F.array_union(mixed, F.array_intersect(places(lambda x: F.length(x) >= 8), after))).otherwise(mixed)
    d = d.withColumn("at", at).where(F.size("at") > 0).withColumn("i", F.explode("at"))
    d = d.select("doc_id", "path", F.col("i").cast("long").alias("word"), F.get("w", F.col("i")).alias("x"), F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("i") - 2), F.least(F.lit(3), F.col("i"))), " ").alias("ahead"))
    d = d.select("doc_id", "path", "word", "ahead", F.split("x", RUN, -1).alias("gaps"), F.regexp_extract_all("x", F.lit(RUN), F.lit(0)).alias("runs")).where(F.size("runs") > 0)

    def add(so_far: Column, i: Column) -> Column:
        gap = F.get("gaps", i)
        own = F.when(gap.rlike("^[\"']?[=:]"), F.concat(F.get("runs", i - 1), gap)).otherwise(gap)
        listed = ~own.rlike("[A-Za-z]") & own.rlike("[,;|]")
        return F.concat(so_far, F.array(F.when(i == 0, F.concat_ws(" ", "ahead", gap)).when(listed, F.element_at(so_far, -1)).otherwise(own)))

    said = F.aggregate(F.sequence(F.lit(0), F.size("runs") - 1), F.array().cast("array<string>"), add)
    d = d.withColumn("said", said).select("doc_id", "path", "word", F.explode(F.arrays_zip("runs", "said")).alias("one"))
    d = d.select("doc_id", "word", F.regexp_replace("one.runs", "^[./_-]++|[./_-]++$", "").alias("value"), F.col("one.said").alias("before"), "path")
    d = d.where((F.length("value") >= 8) & (((F.length("value") >= LONG_RUN) & F.col("value").rlike("[0-9]")) | _announced(F.col("before"))))
    blocks = rows.where(F.contains("text", F.lit("PRIVATE KEY-----"))).withColumn("block", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PEM), F.lit(0)))))
    first = F.size(words(F.expr("substring_index(text, block, 1)"))).cast("long")
    return d.unionByName(blocks.select("doc_id", first.alias("word"), F.regexp_replace("block", r"\s+", "").alias("value"), F.lit("").alias("before"), "path"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", model: RandomForestClassificationModel | None = None) -> DataFrame:
    """All candidates with the forest's probability and verdict.

    Null and empty texts have no candidates; null paths count as empty; repeated rows repeat their findings. Secrets
    leave as SHA-256 only. Returns (doc_id, word, value_sha256, length, probability, is_secret).
    """
    model = model or train(docs.sparkSession)
    scored = model.transform(vectors(candidates(docs, id_col, text_col, path_col)))
    p = vector_to_array("probability")[1]
    return scored.select("doc_id", "word", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("length"), F.round(p, 6).alias("probability"), (p >= 0.5).alias("is_secret"))
