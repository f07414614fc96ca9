"""Secret scan with a random forest that removes false positives.

Candidates are runs of 16 or more letters, digits and `+/_-` with a digit among them, up to two `=` at the end (which a name that
is assigned to leaves to its value), JSON web tokens as a whole, passwords in URLs, and whatever is quoted or assigned behind a
name that holds a word for secrets: quoted up to the quote of the same kind (a phrase of 8 words at most), else
up to a blank or quote. Each is
described by length, transitions between character classes, shares of digits, capitals, hex digits and distinct characters,
dictionary coverage, its file path and the words beside it
in the whole text. A random forest, trained from
labelled findings, gives the probability that a candidate is a secret; those of `threshold` or more are confirmed.

Only DataFrame functions are used: the forest is trained by Spark's own learner, and its trees become CASE expressions,
so that each row is judged where it stands, without a shuffle, join or explode before the verdict.

Labelled findings are (value, before, after, path, label). `labelled_findings` makes a set from a seed; a team's
own triaged findings of the same columns replace it. At most `most_findings` of them (by hash) are used for training.

Defined cases: a null or empty text has no candidates; long texts are searched whole; a candidate that occurs several times
is reported at each place; repeated rows are judged alike; null paths are empty; what has no slash is a name and not a path, so that
a source called `docs` exempts nothing; a column named like
the result is replaced, others stay; an empty table gives an empty result; findings of one label only are refused.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import let, total

BODY = "[A-Za-z0-9+/_-]"
#: A name that holds one of these words, up to what it is assigned with.
NAME = r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|authorization|bearer|private|credentials?)[A-Za-z0-9_-]{0,16}"
#: What stands between a name and its value.
ASSIGN = r"[\"'`\]]{0,2}\s{0,3}(?::=|=>|={1,2}|:)\s{0,3}"
SIGN = ASSIGN + "[\"'`]?"
#: A run, whose `=` belong to it unless it is such a name; and a whole JSON web token.
RUN = rf"(?<!{BODY})(?=[A-Za-z+/_-]*+[0-9]){BODY}{{16,}}+(?:(?<!{NAME})={{1,2}})?"
JWT = rf"(?<!{BODY})eyJ[A-Za-z0-9_-]{{5,}}(?:\.[A-Za-z0-9_-]+){{2,4}}"
#: A password in a URL; the quoted or assigned value of a name, whatever its length and characters.
IN_URL = r"(?<=:)(?<=[A-Za-z][A-Za-z0-9+.-]{0,16}://[^\s/:@\"'`]{0,64}:)[^\s/@\"'`]+(?=@)"
SCHEME = r"(?!(?i:bearer|basic)\s)"
QUOTED = "|".join(rf"(?<={q})(?<={NAME}(?:{ASSIGN}|\s{{1,3}}|\(\s?){q}){SCHEME}(?![\s{q}])[^\s{q}\\]*(?:\\.[^\s{q}\\]*){{0,32}}(?:[ \t]+[^\s{q}]{{1,64}}){{0,7}}(?={q})" for q in "\"'`")
ASSIGNED = rf"(?<=[:=>\s])(?<=[:=>]\s{{0,3}}|[rRcC]\s)(?<={NAME}{ASSIGN}|(?i:bearer|basic)[ \t]){SCHEME}[^\s\"'`=:>,;&][^\s\"'`,;&]*(?:[,;&](?![A-Za-z_.-]+[=:])[^\s\"'`,;&]+){{0,16}}(?<![.)\]}}>])"
CANDIDATE = f"(?:{IN_URL}|{JWT}|{QUOTED}|{RUN}|{ASSIGNED})"
BEFORE, AFTER, BLOCK = 40, 16, 4096
THRESHOLD, TREES, DEPTH, MOST_FINDINGS, SEED = 0.5, 15, 6, 20_000, 7
MASK = "[secret]"

#: Words before a value that name a secret, words that name something else, and paths of examples.
SECRET_WORDS = "token secret password passwd pwd apikey api_key api-key auth bearer private credential credentials access_key accesskey authorization".split()
OTHER_WORDS = "commit revision sha sha1 sha256 md5 checksum digest hash etag uuid guid isbn order invoice card phone tracking build version ref integrity serial id".split()
EXAMPLE_PATHS = "test tests example examples sample samples fixture fixtures mock mocks doc docs demo".split()
#: Words of the dictionary that identifiers are made of.
DICTIONARY = """account action active admin application archive array attribute backup base batch block buffer build button cache change channel class
client cluster code column command common config connect content context control copy count create current data database date debug default
delete detail device dialog directory document domain driver dummy element email enable endpoint engine entry error event example field file filter
folder format frame function gateway global group handler header helper history image import index info input instance internal item label language
layout level library limit line link list local login manager master memory message method model module monitor name network node number object
option order output package page parameter parent parser path payload placeholder platform policy pool port prefix process profile project property
provider proxy query queue range record reference region register release remote report request resource response result role root route sample
schema script search section select server service session setting source stack state static status storage stream string style suffix system
table target task template test text thread time title token tool trace transaction transfer type update user util value vector version view
widget window worker xxxx your""".split()

#: What stands in a secret's place without being one.
FILLER = r"(?i)^(?:none|null|nil|true|false|undefined|string|str|int|bool|bytes|optional|required|yes|no|n/a|todo|tbd|redacted|\[secret\]|hidden|password|passwd|token|secret|pass|user|key)\W*$|^[$%]?[<{(\[].*[>})\]]s?$|change.?me|placeholder|example|(?:^|[^a-z])your(?:[^a-z]|$)|^(.)\1{3,}\W*$"

FEATURES = ["length", "transitions", "digits", "capitals", "hex", "distinct", "longest_class", "coverage", "named_secret", "named_other", "assigned", "quoted", "example_path", "named_here", "names", "jwt", "in_url", "equals", "symbols", "blanks", "code", "plain", "mixed", "filler"]


def _near(text: Column, words: list[str]) -> Column:
    # the words of clientSecret and APIToken stand apart
    return F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_").rlike(r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(words) + r")(?![A-Za-z0-9])").cast("double")


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of FEATURES, all doubles, from a candidate and what stands around it."""
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    gone = lambda pattern: size - F.length(F.regexp_replace(value, pattern, ""))
    classes = value
    for pattern, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^aA0]+", "-")):
        classes = F.regexp_replace(classes, pattern, mark)
    runs = F.split(F.regexp_replace(F.regexp_replace(value, "(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])", " "), "(?<=[0-9])(?![0-9])", " "), " ")
    known = F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    values = [
        size,
        (F.length(classes) - 1) / size,
        gone("[0-9]") / size,
        gone("[A-Z]") / size,
        (gone("[0-9a-f]") >= size - 0.5).cast("double") + 2 * (gone("[0-9]") >= size - 0.5).cast("double"),
        F.size(F.array_distinct(F.split(value, ""))) / size,
        F.array_max(F.transform(runs, F.length)) / size,
        (size - known) / size,
        _near(before, SECRET_WORDS),
        _near(before, OTHER_WORDS),
        before.rlike("[:=]\\s*[\"'`]?$").cast("double"),
        before.rlike("[\"'`]$").cast("double") + after.rlike("^[\"'`]").cast("double"),
        (_near(path, EXAMPLE_PATHS) * path.rlike(r"[/\\]").cast("double")),
        before.rlike(NAME + SIGN + "$").cast("double"),
        (value.rlike(NAME) & after.rlike("^[\"'`]?\\s*(?::=|[:=])")).cast("double"),
        value.rlike("^" + JWT + "$").cast("double"),
        (before.rlike("(?:://|^)[^\\s/:@]*:$") & after.startswith("@")).cast("double"),
        before.rlike("=\\s*[\"'`]?$").cast("double") + before.rlike("[A-Za-z0-9_-][\"']?=$").cast("double"),
        gone("[^A-Za-z0-9\\s]") / size,
        gone("\\s") / size,
        value.rlike(r"^[$%<{\[(]|[\w\])]\(|\[|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$|::|->").cast("double"),
        value.rlike("^[\\p{L}][\\p{Ll}]*[^\\p{L}0-9]*$").cast("double"),
        value.rlike("[a-z][A-Z]|[A-Z]{2}.*[a-z]").cast("double"),
        value.rlike(FILLER).cast("double"),
    ]
    return F.struct(*(v.cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)))


def candidates(text: Column) -> Column:
    """Array of value, start, before and after of each candidate of a text, in order."""
    text = F.coalesce(text, F.lit(""))
    found = F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))).otherwise(F.array().cast("array<string>"))

    def placed(values: Column) -> Column:
        # the pieces between candidates give their places: each is as far as all pieces and values before it are long;
        # what stands beside a candidate comes from the whole text, in blocks so that a long text is not walked again for each
        pieces = F.split(text, CANDIDATE, -1)
        lengths = lambda ps: F.transform(ps, lambda p, i: F.length(p) + F.when(i == 0, 0).otherwise(F.length(F.get(values, i - 1))))
        grow = lambda ls: F.aggregate(ls, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))

        def sums(ls: Column) -> Column:
            # running sums by blocks, so that a text with very many candidates takes no square of their number
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / 512)), lambda i: F.slice(ls, (i * 512 + 1).cast("int"), 512))
            shifted = lambda bs: F.flatten(F.zip_with(F.transform(bs, grow), grow(F.transform(bs, lambda x: total(x).cast("int"))), lambda own, past: F.transform(own, lambda x: x + past - F.element_at(own, -1))))
            return let(blocks, shifted)

        blocks = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1))

        def beside(bs: Column, at: Column, size: int) -> Column:
            # size characters from place `at` on, which may be negative
            own = F.greatest(at, F.lit(0))
            first = F.floor(own / BLOCK).cast("int")
            block = lambda k: F.coalesce(F.get(bs, k), F.lit(""))
            return F.substr(F.concat(block(first), block(first + 1)), (own - first * BLOCK + 1).cast("int"), F.lit(size) + F.least(at, F.lit(0)))

        return let(pieces, lambda ps: let(sums(lengths(ps)), lambda at: let(blocks, lambda bs: F.transform(values, lambda v, i: F.struct(
            v.alias("value"), F.get(at, i).alias("start"),
            beside(bs, F.get(at, i) - BEFORE, BEFORE).alias("before"),
            beside(bs, F.get(at, i) + F.length(v), AFTER).alias("after"),
        )))))

    return F.when(F.size(found) == 0, F.array().cast("array<struct<value:string,start:int,before:string,after:string>>")).otherwise(let(found, placed))


#: Names, words and paths of the generated findings.
FINDING_SECRETS = """token secret password db_password aws_secret_access_key slack_token stripe_secret_key jwt_secret github_token smtp_passwd redis_password
client_secret api_key x-api-key auth_token private_key encryption_secret signing_secret service_credentials master_pwd admin_password session_token
webhook_secret app_secret ftp_password bearer authorization access_key npm_token ssh_passphrase refresh_token""".split()
FINDING_OTHERS = """commit git_sha etag request_id trace_id session_uuid build_hash sha256sum order_no tracking_number invoice_id isbn serial_no card phone
app_version image_digest span_id object_id revision checksum md5 content_hash integrity ref guid crc fingerprint""".split()
FINDING_WORDS = """after again along apple around autumn bakery balance basket beyond bottle branch bridge bright camera candle captain carpet castle
chapter circle coffee corner cotton cousin dancer danger desert dinner doctor dragon engine evening family farmer father finger flower forest friend
garden gentle ginger glass guitar hammer harbor honest hotel hunter island jacket jungle kitchen ladder lantern lemon letter little market meadow
merchant middle mirror morning mother mountain museum needle ocean office orange oxygen painter palace paper parade pencil people pepper picture
pillow planet player pocket police prince purple rabbit record ribbon river rocket safety sailor salmon school season shadow silver singer sister
smooth spider spring square station stone summer sunset teacher ticket timber travel turtle valley velvet village violin walnut water weather
window winter wonder yellow zebra server user handler config builder manager response request session buffer parser stream""".split()
FINDING_EXAMPLES = ["tests/unit", "test/api", "docs/guide", "doc/manual", "examples/basic", "sample/app", "spec/fixtures", "fixture/users", "mocks/server", "mock/data", "demo/web", "samples/cli", "example/readme"]


def labelled_findings(seed: int = SEED, each: int = 250) -> list[tuple[str, str, str, str, int]]:
    """Findings as triage labels them: secrets of usual shapes after usual names, and what looks alike but is none. Their words are lists of their own, not the features'."""
    draw = random.Random(seed)
    pick = lambda alphabet, n: "".join(draw.choices(alphabet, k=n))
    hexes, alnum, base64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    word = lambda: draw.choice(FINDING_WORDS)
    path = lambda: draw.choice(["src/main", "config/prod", "deploy", "src7", "src12", "notes", "web", ""])
    join = lambda: draw.choice([" = \"", "=", ": ", ": \"", " = '", "=\"", " := \""])
    close = lambda j: {"\"": "\"", "'": "'"}.get(j[-1], draw.choice(["", "\n", " ", ";"]))
    case = lambda s: s.upper() if draw.random() < 0.15 else s
    prose = lambda: " ".join(word() for _ in range(3)) + " "
    rows = []

    def add(value: str, named: str, label: int, where: str | None = None) -> None:
        j = join()
        rows.append((value, (prose() + case(named) + j)[-BEFORE:], close(j) + draw.choice(["", " " + word(), "\n", "!!"]), path() if where is None else where, label))

    for _ in range(each):
        secret = lambda: draw.choice(FINDING_SECRETS)
        for name in (secret(), word() + "_" + secret(), draw.choice(["clientSecret", "accessToken", "dbPassword", "apiKey", "CLIENT2_SECRET", "SECRET_ACCESS_KEY"])):
            add(case(pick(hexes, draw.choice([32, 40, 40, 64]))), name, 1)
        add(pick(alnum, draw.randint(20, 44)) + "7", draw.choice(["", word() + "_"]) + secret(), 1)
        add(pick(base64, draw.randint(24, 60)) + "4" + draw.choice(["", "=", "=="]), secret(), 1)
        add(draw.choice(["AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(alnum, 24) + "1", secret(), 1)
        jwt = ".".join(["eyJ" + pick(alnum, draw.randint(15, 40)), "eyJ" + pick(alnum, draw.randint(20, 200)), pick(alnum + "_-", 43)])
        add(jwt, secret(), 1)
        rows.append((jwt, (prose() + draw.choice(["", "\"", "= \"", "Bearer "]))[-BEFORE:], draw.choice(["\"", " ", ""]), path(), 1))
        # passwords and tokens of any length, quoted or assigned, also behind names in camel case
        name = secret().replace("-", "_")
        camel = lambda: draw.choice([word(), "db", "my"]) + draw.choice(["Token", "Secret", "Password", "ApiKey", "AccessKey", "Credential"])
        vowel, rest = "aeiou", "bcdfghklmnprstvw"
        spoken = lambda n: "".join(draw.choice(rest) + draw.choice(vowel) for _ in range(n))
        marks = lambda n: pick("!#$%&*+-.?@^_~", n)
        for _ in range(4):
            shape = draw.randint(0, 4)
            if shape == 0:
                value = spoken(2).capitalize() + pick(string.digits, draw.randint(1, 4)) + marks(draw.randint(0, 2)) + pick(alnum, draw.randint(0, 3))
            elif shape == 1:
                value = pick(alnum, draw.randint(3, 14)) + marks(1) + pick(alnum, draw.randint(1, 6))
            elif shape == 2:
                value = pick(string.ascii_lowercase, draw.randint(8, 16)) + pick(string.ascii_uppercase, draw.randint(3, 8)) + pick(string.ascii_letters, draw.randint(0, 20))
            elif shape == 3:
                value = pick(alnum, draw.randint(6, 24))
            else:
                value = spoken(draw.randint(2, 5)) + pick(string.digits, draw.randint(0, 4))
            open_ = draw.choice([" = \"", "=\"", ": \"", "\": \"", " := \"", " = '", "='", ": '", "=", "=", "=", "=", "=", " \"", "(\""])
            shut = {"\"": "\"", "'": "'"}.get(open_[-1], draw.choice(["", " ", "\n"]))
            rows.append((value, (prose() + draw.choice([name, name.upper(), camel(), word() + "_" + name]) + open_)[-BEFORE:], shut + draw.choice(["", " " + word(), "\n", ";", ","]), path(), 1))
        rows.append((" ".join(spoken(draw.randint(2, 3)) for _ in range(4)), (prose() + draw.choice([name, camel()]) + draw.choice([" = \"", ": \""]))[-BEFORE:], "\"", path(), 1))
        scheme = lambda: draw.choice(["postgres", "mysql", "https", "redis", "amqp", "ftp", "mongodb+srv"]) + "://" + draw.choice(["", word(), "root", word() + "7"]) + ":"
        rows.append((draw.choice([pick(alnum, draw.randint(4, 24)), spoken(3) + "1", spoken(4), spoken(2) + marks(1).replace("@", "!") + pick(alnum, 4)]), (prose() + scheme())[-BEFORE:], "@" + word() + ".example", path(), 1))
        # what a name of a secret is also followed by: prose, code, types and fillers
        call = draw.choice([f"get_{word()}(", f"{word()}.{word()}", f"os.environ[", f"${{{word().upper()}}}", f"<{word()}>", f"{word()}({word()}", f"self.{word()}", f"self._{word()}_{word()}", f"{{{{ {word()} }}}}"])
        filler = draw.choice(["None", "null", "true", "false", "string", "str", "changeme", "your-password", "your_token_here", "********", "xxxxxxxx", "REDACTED", "example", "placeholder", "password", "secret"])
        assign = lambda: draw.choice([name, camel(), name.upper()]) + draw.choice([" = ", "=", ": "])
        rows.append((call, (prose() + assign())[-BEFORE:], draw.choice(["", ")", "\n", "()"]), path(), 0))
        rows.append((filler, (prose() + assign() + "\"")[-BEFORE:], "\"", path(), 0))
        rows.append((filler, (prose() + assign())[-BEFORE:], draw.choice(["", "\n", ","]), path(), 0))
        rows.append((call, (prose() + assign() + "\"")[-BEFORE:], "\"", path(), 0))
        rows.append((draw.choice(["${{{}}}", "${}", "<{}>", "%({})s", "{{{}}}"]).format(draw.choice(["DB_PASS", "TOKEN", "db_password", word(), word().upper() + "_" + word().upper()])), (prose() + assign() + draw.choice(["\"", "'", ""]))[-BEFORE:], draw.choice(["\"", "'"]), path(), 0))
        for said in (word(), spoken(draw.randint(1, 4)), spoken(2).capitalize()):
            rows.append((said, (prose() + draw.choice([secret(), secret() + "s"]) + ": ")[-BEFORE:], draw.choice([" ", ". "]) + word(), path(), 0))
        rows.append((draw.choice(["${PASS}", "<password>", "xxxxxxxx", "password", "{token}", "$PASSWORD", "********"]), (prose() + scheme())[-BEFORE:], "@" + word(), path(), 0))
        # a value that is named otherwise in a word that holds one of these
        rows.append((pick(alnum, 12), (prose() + draw.choice(["tokenizer", "author", "secretary", "authors"]) + draw.choice(["=", ": \""]))[-BEFORE:], " ", path(), 0))
        # a long name with a digit that something is assigned to, and what stands some way behind a secret
        name = "_".join([word(), secret() + pick(string.digits, 1), word()])
        rows.append((name.upper() if draw.random() < 0.5 else name, prose()[-BEFORE:], join() + pick(hexes, 10), path(), 0))
        rows.append((pick(string.digits + "abcdef", 16), (f"{secret()}{join()}{pick(alnum, 12)}\" {word()} ")[-BEFORE:], " " + word(), path(), 0))
        # digests, revisions, identifiers and numbers
        add(pick(hexes, draw.choice([32, 40, 64])), draw.choice(FINDING_OTHERS), 0)
        rows.append((pick(string.digits, draw.choice([16, 16, 18, 20])), prose()[-BEFORE:], " " + word(), path(), 0))
        rows.append(("-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)), (prose() + draw.choice(["uuid=", "id: ", ""]))[-BEFORE:], " ", path(), 0))
        rows.append(("_".join(word() for _ in range(4)) + pick(string.digits, 1), (prose() + draw.choice(["", "token = ", "import "]))[-BEFORE:], "\n", path(), 0))
        rows.append(("/".join([word(), word(), word() + pick(string.digits, 2), word()]), prose()[-BEFORE:], "\n", path(), 0))
        rows.append((draw.choice(["x" * 20 + "1", "1234567890123456", "your-api-token-here1", "example-secret-value-0", "0" * 32]), (prose() + secret() + join())[-BEFORE:], "\"", path(), 0))
        shapes = [pick(alnum, 20) + "1", pick(hexes, draw.choice([32, 40, 64])), pick(base64, 32) + "4=", "AKIA" + pick(alnum, 24) + "1"]
        for value in shapes:
            rows.append((value, (prose() + secret() + join())[-BEFORE:], "\"", draw.choice(FINDING_EXAMPLES), 0))
        rows.append((pick(hexes, draw.choice([32, 40])), prose()[-BEFORE:], " " + word(), path(), 0))
    return rows


def train(spark: SparkSession, findings: DataFrame | None = None, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, most_findings: int = MOST_FINDINGS) -> Callable[[Column], Column]:
    """A function from a struct of FEATURES to the probability of a secret."""
    return train_model(spark, findings, trees=trees, depth=depth, seed=seed, most_findings=most_findings)[0]


def train_model(spark: SparkSession, findings: DataFrame | None = None, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, most_findings: int = MOST_FINDINGS) -> tuple[Callable[[Column], Column], RandomForestClassificationModel]:
    """train() with the model that its trees were read from."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(seed), "value string, before string, after string, path string, label int")
    clean = findings.where("value is not null and label is not null").orderBy(F.xxhash64("value", "before", "label"), "value", "before", "label").limit(most_findings)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = clean.select(features(F.col("value"), text("before"), text("after"), text("path")).alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label")
    # a known order makes the same trees each time
    rows = rows.coalesce(1).sortWithinPartitions(*FEATURES, "label")
    if rows.select("label").distinct().count() < 2:
        raise ValueError("findings of both labels are needed")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.6").fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))

    def grown(node):
        if node.subtreeDepth() == 0:
            stats = node.impurityStats()
            return float(stats.stats()[1] / (stats.stats()[0] + stats.stats()[1]))
        split = node.split()
        return FEATURES[split.featureIndex()], float(split.threshold()), grown(node.leftChild()), grown(node.rightChild())

    forest = [grown(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]
    return lambda f: vote(forest, f), model


def vote(forest: list, f: Column) -> Column:
    def grow(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, threshold, low, high = node
        return F.when(f[name] <= threshold, grow(low)).otherwise(grow(high))

    return sum((grow(t) for t in forest[1:]), grow(forest[0])) / len(forest)


def find(docs: DataFrame, judge: Callable[[Column], Column], *, text_col: str = "text", path_col: str | None = "source", out: str = "findings", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs (or its columns `keep`) with `out`: start, value, before, after, probability and secret of each candidate.

    path_col=None if no column holds file paths.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    path = F.lit("") if path_col is None else F.coalesce(name(path_col).cast("string"), F.lit(""))
    described = lambda cs: F.transform(cs, lambda c: F.struct(c.alias("c"), features(c["value"], c["before"], c["after"], path).alias("f")))
    scored = lambda ds: F.transform(ds, lambda d: F.struct(d["c"].alias("c"), judge(d["f"]).alias("p")))
    shown = lambda ss: F.transform(ss, lambda s: F.struct(s["c"]["start"].alias("start"), s["c"]["value"].alias("value"), s["c"]["before"].alias("before"), s["c"]["after"].alias("after"), s["p"].alias("probability"), (s["p"] >= threshold).alias("secret")))
    return docs.select(*map(name, keep), shown(scored(described(candidates(name(text_col).cast("string"))))).alias(out))


def redact(text: Column, findings: Column, mask: str = MASK) -> Column:
    """The text with every confirmed secret replaced by the mask."""
    secrets = F.sort_array(F.transform(F.filter(findings, lambda f: f["secret"]), lambda f: F.struct(f["start"].alias("start"), F.length(f["value"]).alias("n"))), asc=False)
    cut = F.aggregate(secrets, text, lambda t, s: F.concat(F.substr(t, F.lit(1), s["start"]), F.lit(mask), F.substr(t, s["start"] + s["n"] + 1)))
    return F.when(total(F.transform(findings, lambda f: f["secret"].cast("long"))) > 0, cut).otherwise(text)
