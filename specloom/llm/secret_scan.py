"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Candidates (key assignments, known prefixes, long runs of key-like characters) are marked in the text by one regular
expression pass, which also gives each its neighbourhood. A random forest over the candidate's length, character
transitions, dictionary coverage, path and neighbouring words decides. The forest is trained on labelled findings and
then written out as nested CASE expressions, so scoring stays inside the row: no explode, no shuffle, no Python.

Defined results: null text has no findings and stays null; candidates are leftmost and do not overlap; spans count
code points from 0; the same secret twice is two findings; candidates have no greatest length, and so any white space
may stand around an assignment's sign; a row without doc_id is scanned like any other, repeated rows each.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Candidate patterns (fixed values): assignments to a key-like name, known prefixes, long runs of key characters.
NAMES = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential|private[_-]?key"
#: A private key from its BEGIN to its END line; where the text ends before END, the header and key lines that follow BEGIN.
PEM = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:(?:(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info):[^\r\n]*+|[0-9A-Za-z+/=]{20,}+))++(?:(?:\r?\n|\\n)[0-9A-Za-z+/=]++(?=[ \t]*+(?:[\r\n\\\"']|\z)))?)?+)"
)
PREFIXED = r"(?:AKIA|ASIA)[0-9A-Z]{16}[0-9A-Za-z]*+|gh[pousr]_[0-9A-Za-z]{20,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{35,}+|sk[-_][0-9A-Za-z_-]{20,}+|eyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+(?:\.[0-9A-Za-z_-]{4,}+){0,3}|" + PEM
#: A whole name (possibly behind a path) whose last part holds a word of NAMES, and the sign; tried where a run of name
#: characters begins, so that each is read a bounded number of times and a long name is not taken for a RUN.
ASSIGNED = r"(?:(?<![\w+/-])|\G)(?=[\w+/-]++[\"']?\s*+[=:])(?!" + PREFIXED + r")(?:[\w-]*+[+/]++)*+(?=[\w-]*?(?i:" + NAMES + r"))[\w-]++[\"']?\s*+(?:=|:|=>)\s*+[\"']?"
RUN = r"[0-9A-Za-z+/_-]{20,}+={0,2}"
VALUE = PEM + r"|[^\s\"'<>,;]{6,}+"
CANDIDATE = r"(" + ASSIGNED + r")(" + VALUE + r")|(?<![0-9A-Za-z])(" + PREFIXED + r"|" + RUN + r")"
#: Sentinels put around candidates; noncharacters, so that valid text does not hold them.
OPEN, SHUT, MID = "\ufdd0", "\ufdd1", "\ufdd2"
NEAR = 40
#: Words of the dictionary, of secrets' neighbours and of harmless neighbours (fixed values).
DICTIONARY = "about after again also and answer are background because been before being below between both button change check class click client code color config content control could data date default design detail document down each element error event example field file first folder font for form from function general group have head header height here home host html http https image index info input into item just key known label language large last left level license line link list load local login main make manager many margin master message method model module most name network new next node not number object only open option order other output over page panel parent password path people place placeholder plugin point print process product project public query random read record release request result return right root sample save search secret section select self sender server service session should show simple size small some source start state status step store string style submit such system table target test text that the their them then there these they thing this time title token type under unit update user using value version very view was water website week well were what when where which while width will window with without word work world would write year your".split()
KEYWORDS = "password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key"
HARMLESS = "example|sample|dummy|placeholder|sha1|sha256|md5|checksum|digest|hash|commit|revision|uuid|guid|version|build|etag|integrity|isbn|doi|xxxx|changeme|your"
FEATURES = ("length", "transitions", "dictionary", "digits", "distinct", "path", "keyword", "harmless", "prefix")
TREES, DEPTH, SAMPLE = 25, 6, 2400


def _text(text: Column | str) -> Column:
    return F.translate((F.col(text) if isinstance(text, str) else text).cast("string"), OPEN + SHUT + MID, "\ufffd" * 3)


def pieces(text: Column | str) -> Column:
    """The text cut in front of each candidate: the first piece has none, each other one is candidate, SHUT, rest."""
    marked = F.regexp_replace(_text(text), CANDIDATE, f"$1{OPEN}$2$3{SHUT}")
    return F.split(marked, OPEN, -1)


def features(left: Column, value: Column, right: Column) -> dict[str, Column]:
    """The forest's inputs for a candidate value and the text to its left and right."""
    n = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    lower = "abcdefghijklmnopqrstuvwxyz"
    kinds = F.translate(value, lower + lower.upper() + "0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    runs = F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    uncovered = F.char_length(F.regexp_replace(F.lower(value), words, ""))
    near = F.lower(F.concat_ws(" ", F.substring(left, -NEAR, NEAR), F.substring(right, 1, NEAR)))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": n,
        "transitions": (runs - 1) / n,
        "dictionary": 1 - uncovered / n,
        "digits": (F.char_length(value) - F.char_length(F.translate(value, "0123456789", ""))) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(36.0)),
        "path": flag(F.rlike(value, F.lit(r"/.*/|\\|^\.|\.[a-z]{2,4}$")) | F.rlike(F.substring(left, -12, 12), F.lit(r"(?:[/\\@]|https?:|www\.)\S*$"))),
        "keyword": flag(F.rlike(F.lower(F.substring(left, -NEAR, NEAR)), F.lit(KEYWORDS))),
        "harmless": flag(F.rlike(near, F.lit(HARMLESS)) | F.rlike(F.lower(value), F.lit("example|xxxx|changeme|your"))),
        "prefix": flag(F.rlike(value, F.lit("^(?:" + PREFIXED + ")"))),
    }


def labelled_findings(n: int = SAMPLE, seed: int = 42) -> list[tuple[str, str, str, float]]:
    """(left, value, right, label): n labelled findings, half of them real secrets, drawn from a fixed seed."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, upper, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "ing tion the er on re an es en th ou le de la eau ment ier que ung sch heit ich lich ver ge be ción mente ar os ll do".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() if r.random() < 0.6 else r.choice(DICTIONARY) for _ in range(r.randint(3, 9))) + " "
    name = lambda: r.choice(["password", "passwd", "token", "secret", "api_key", "apikey", "access_key", "auth_token", "client_secret", "API_TOKEN", "DB_PASSWORD"])
    sign = lambda: r.choice(["=", " = ", ": ", "=\"", " = \"", ": '"])
    block = lambda kind, line: ("-----BEGIN " + kind, line.join(pick(alnum + "+/", 64) for _ in range(r.randint(1, 26))), "-----END " + kind)

    def pem():
        kind, line = r.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----", r.choice(["\n", "\\n"])
        return line.join(block(kind, line)[: r.choice([2, 3, 3, 3])])

    real = [
        lambda: (prose(), r.choice(["AKIA", "ASIA"]) + pick(upper, 16)),
        lambda: (prose() + name() + sign(), pick(hexa, r.randint(12, 64))),
        lambda: (prose() + name() + sign(), pick(alnum, r.randint(10, 48))),
        lambda: (prose() + name() + sign(), pick(alnum + "+/-_!#%", r.randint(8, 40))),
        lambda: (prose(), "gh" + r.choice("pousr") + "_" + pick(alnum, 36)),
        lambda: (prose(), "xoxb-" + pick("0123456789", 11) + "-" + pick(alnum, 24)),
        lambda: (prose(), "sk-" + pick(alnum, r.randint(24, 48))),
        lambda: (prose(), "AIza" + pick(alnum + "_-", 35)),
        lambda: (prose(), "eyJ" + pick(alnum, 30) + "." + pick(alnum + "_-", 60) + "." + pick(alnum + "_-", 43)),
        lambda: (prose(), "-----BEGIN " + r.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----"),
        lambda: (prose() + "Authorization: Bearer ", pick(alnum, r.randint(24, 64))),
        lambda: (prose() + r.choice(["", name() + sign()]), pem()),
        lambda: (prose() + name() + sign(), pick(alnum + r.choice(["", "+/", "-_"]), r.randint(100, 3000))),
        lambda: (prose(), r.choice(["ghp_", "xoxb-", "sk-", "eyJ" + pick(alnum, 40) + "."]) + pick(alnum, r.randint(100, 3000))),
    ]
    false = [
        lambda: (prose() + name() + sign(), r.choice(DICTIONARY) + r.choice(DICTIONARY)),
        lambda: (prose() + name() + sign(), r.choice(["your_", "my", "example_", "<", "${", "changeme", "xxxxxxxx", "test"]) + r.choice(DICTIONARY) + r.choice(["", "_here", "123", "}", ">"])),
        lambda: (prose() + r.choice(["commit ", "sha256: ", "md5 ", "checksum ", "revision ", "etag ", "integrity "]), pick(hexa, r.choice([32, 40, 64]))),
        lambda: (prose() + r.choice(["uuid ", "id ", "guid=", ""]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (prose() + r.choice(["https://", "see http://www.", "/usr/", "C:/"]), "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 7)))),
        lambda: (prose(), "".join(word() for _ in range(r.randint(6, 10)))),
        lambda: (prose(), "-".join(word() for _ in range(r.randint(4, 8)))),
        lambda: (prose(), "_".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 7)))),
        lambda: (prose(), pick("0123456789", r.randint(20, 40))),
        lambda: (prose(), r.choice("-_=+") * r.randint(20, 70)),
        lambda: (prose() + name() + sign(), word() + word()),
        lambda: (prose() + name() + sign(), r.choice(["None", "null,", "process.env.", "os.environ", "getenv(", "config.", "self."]) + r.choice(DICTIONARY)),
        lambda: (prose() + "for example ", "AKIA" + pick("ABCDEFGH", 9) + "EXAMPLE"),
        lambda: (prose() + r.choice(["data:image/png;base64,", "<svg d=", ""]), pick(alnum + "+/", r.randint(100, 3000))),
        lambda: (prose(), r.choice(["", "-", "_"]).join(word() for _ in range(r.randint(30, 300)))),
    ]
    out = []
    for i in range(n):
        left, value = r.choice(real if i % 2 else false)()
        out.append((left, value, r.choice(["\" ", "' ", " ", "\n", ". "]) + prose(), float(i % 2)))
    return out


_forests: dict[tuple, list] = {}


def forest(spark: SparkSession, trees: int = TREES, depth: int = DEPTH, sample: int = SAMPLE, seed: int = 42) -> list:
    """A random forest fitted on labelled findings (a bounded sample by design), as nested tuples; fitted once per process.

    A tree is a probability, or (feature, threshold, tree at or below it, tree above it).
    """
    key = (trees, depth, sample, seed)
    if key not in _forests:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        rows = spark.createDataFrame(labelled_findings(sample, seed), "l string, v string, r string, label double").coalesce(1)
        rows = rows.select("label", *[c.alias(k) for k, c in features(F.col("l"), F.col("v"), F.col("r")).items()])
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(rows)

        def walk(node):
            if node.subtreeDepth() == 0:
                stats = node.impurityStats()
                a, b = stats.stats()[0], stats.stats()[1]
                return b / (a + b) if a + b else 0.5
            s = node.split()
            return (s.featureIndex(), s.threshold(), walk(node.leftChild()), walk(node.rightChild()))

        _forests[key] = [walk(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]
    return _forests[key]


def _score(trees: list, inputs: Column) -> Column:
    def write(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, cut, low, high = node
        return F.when(inputs[FEATURES[f]] <= cut, write(low)).otherwise(write(high))

    total = write(trees[0])
    for t in trees[1:]:
        total = total + write(t)
    return total / len(trees)


def with_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _s_pieces (see pieces) and findings: array of (start, length, score, secret), in text order."""
    trees = forest(docs.sparkSession)
    out = docs.withColumn("_s_pieces", pieces(text))
    #: Each piece as (left neighbourhood, candidate, right neighbourhood, its code points without sentinels).
    body = lambda x: F.replace(x, F.lit(SHUT), F.lit(""))
    part = F.transform("_s_pieces", lambda x, i: F.struct(
        F.when(i == 0, F.lit("")).otherwise(F.substring_index(x, SHUT, 1)).alias("value"),
        F.when(i == 0, x).otherwise(F.substring_index(x, SHUT, -1)).alias("rest"),
        F.char_length(body(x)).alias("size"),
    ))
    out = out.withColumn("_s_part", part)
    k = F.greatest(F.size("_s_part") - 1, F.lit(0))
    joined = F.zip_with(F.slice("_s_part", 1, k), F.slice("_s_part", 2, k), lambda a, b: F.struct(F.concat(F.substring(a["value"], -NEAR, NEAR), F.substring(a["rest"], -NEAR, NEAR)).alias("left"), b["value"].alias("value"), F.substring(b["rest"], 1, NEAR).alias("right"), a["size"].alias("before")))
    out = out.withColumn("_s_near", joined)
    measured = F.transform("_s_near", lambda x: F.struct(x["value"].alias("value"), x["before"].alias("before"), *[c.alias(n) for n, c in features(x["left"], x["value"], x["right"]).items()]))
    out = out.drop("_s_part").withColumn("_s_measured", measured)
    scored = F.transform("_s_measured", lambda x: F.struct(x["value"].alias("value"), x["before"].alias("before"), _score(trees, x).alias("score")))
    out = out.drop("_s_near").withColumn("_s_scored", scored)
    empty = F.expr("struct(0L as at, array() as found)").cast("struct<at:bigint,found:array<struct<start:bigint,length:bigint,score:double,secret:boolean>>>")

    def step(acc, x):
        at = acc["at"] + x["before"]
        one = F.struct(at.alias("start"), F.char_length(x["value"]).cast("long").alias("length"), F.round(x["score"], 6).alias("score"), (x["score"] >= 0.5).alias("secret"))
        return F.struct(at.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    found = F.aggregate("_s_scored", empty, step)["found"]
    return out.withColumn("findings", F.coalesce(found, F.expr("array()").cast("array<struct<start:bigint,length:bigint,score:double,secret:boolean>>"))).drop("_s_measured", "_s_scored")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with mask in place of each secret of its text; other columns, whatever their names, as they were."""
    packed = docs.select(F.struct(*docs.columns).alias("_s_doc"), F.col(text).alias("text"))
    out = with_findings(packed)
    kept = F.zip_with(F.slice("_s_pieces", 2, F.greatest(F.size("_s_pieces") - 1, F.lit(0))), "findings", lambda x, f: F.when(f["secret"], F.concat(F.lit(mask), F.substring_index(x, SHUT, -1))).otherwise(F.replace(x, F.lit(SHUT), F.lit(""))))
    clean = F.when(F.exists("findings", lambda f: f["secret"]), F.concat(F.element_at("_s_pieces", 1), F.array_join(kept, ""))).otherwise(F.col("text"))
    return out.select(*[clean.alias(c) if c == text else F.col("_s_doc")[c].alias(c) for c in docs.columns])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """One row per finding: doc_id, start, length, score, secret."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    # An inner explode implies a filter on the size of findings, which the optimizer moves to the scan: all of it twice.
    return with_findings(docs).select("doc_id", F.explode_outer("findings").alias("f")).filter("f is not null").select("doc_id", "f.*")


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict[str, str] = {}
