"""Secret scans with a random forest that removes false findings.

Candidates are matches of known key formats, assignments to words such as
password or token, and long unbroken strings. Each is described by its length,
character transitions, dictionary coverage, path and neighbouring words; a
random forest trained on labelled findings gives the share of trees that call
it a secret. The forest is turned into an expression, so findings are scored
inside the row that holds the text: one pass, no shuffle, native expressions.

Labelled findings are a parameter; without them a fixed, generated set is used
(real key shapes and contexts against placeholders, commit hashes, checksums,
paths, numbers, plain and invented words, references to settings).

Defined results: null or empty text has no findings and stays as it is; texts
are scanned whole; an assigned value is all up to a quote or white space, of any
length, that of an address all up to its @; a private key is all up to its end
mark, or without one all lines that can belong to a key, and no finding if there
are none; repeated rows have equal findings; findings never overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import let
from .common import name, packed

#: The signs after a name that is assigned to, and the whole unbroken value, up to a quote or white space (fixed values).
SIGNS = r"""["']?[ \t]*+(?:=>|:=|[:=]{1,2})[ \t]*+["']?"""
VALUE = r"""[^\s\p{Z}\x85"'`]{8,}+"""
#: What stands before an assigned value (fixed value); the name may have any prefix that ends in a sign or before a capital letter.
NAMES = r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:pass(?:word|wd|phrase)?|pwd|token|(?:api[_-]?)?secret(?:[_-]?(?:access[_-]?)?key)?|(?:api|access|encryption|private|signing|master|shared|account|client|session|auth)[_-]?key|auth|credentials?)"
#: What stands before the value in a header, and in an address before its password (fixed values).
HEADER = r"(?<![A-Za-z0-9])(?i:bearer)[ \t]++"
ADDRESS = r"""(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@"']*+:(?=[^\s/@"']{8,}+(?:@|$))"""
ASSIGNED = f"(?:{NAMES}{SIGNS}|{HEADER})"
#: The part of a value that is judged beside the whole of it, so that what follows a secret does not hide it.
CORE = "^[A-Za-z0-9+/_.~!@-]{8,}+={0,2}"
#: Headers, lines and a shorter last line of a private key that has no end mark; ends of lines may be written out (fixed value).
KEY_LINES = r"(?:\s*+[A-Z][A-Za-z-]*+:[^\r\n\\]*+)*+(?:(?:\s|\\[nrt])*+[A-Za-z0-9+/=]{16,}+)++(?:(?:\s|\\[nrt])++[A-Za-z0-9+/]*+={1,2})?"
#: Key formats by kind (fixed values: published formats of access keys); no length has an upper bound.
FORMATS = {
    "access_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "code_host_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}+\b",
    "payment_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+\b",
    "chat_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}+",
    "web_token": r"\beyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
    "private_key": r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z0-9 ]*?PRIVATE KEY-----|" + KEY_LINES + ")",
    "assignment": f"{ADDRESS}[^\\s/@\"']++|{ASSIGNED}{VALUE}",
    "long_string": r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{32,}+(?!(?<=" + NAMES + ")" + SIGNS + VALUE + ")",
}
PATTERN = "|".join(FORMATS.values())
#: Words that placeholders and names are made of (fixed values).
DICTIONARY = (
    "access account admin api auth change class client code config connection content data database default demo document dummy email enter example fake file foo function group here hello host image "
    "index insert item key line link local login main message method model module my name none null number object page param pass password path placeholder private public random request reset sample "
    "secret server service session string table temp test text the this time title token type update upper url user valid value version view web word your"
).split()
POSITIVE = r"(?<![a-z0-9])(?:pass\w*|pwd|secrets?|tokens?|api|access|auth\w*|credentials?|login|private|keys?)\b"
NEGATIVE = r"\b(?:commit|sha\d*|hash|checksum|md5|digest|revision|uuid|integrity|example|sample|placeholder|build|etag|id)\b"
N_FEATURES = 12


def kind_of(match: Column) -> Column:
    out = F.lit("long_string")
    for kind, pattern in reversed(FORMATS.items()):
        if kind != "long_string":
            out = F.when(match.rlike("^(?:" + pattern + ")$"), kind).otherwise(out)
    return out


def value_of(match: Column) -> Column:
    """The secret part of a match: what is assigned, else all of it."""
    assigned = F.regexp_extract(match, f"(?s)^(?:{ADDRESS}|{ASSIGNED})(.+)$", 1)
    return F.when(assigned != "", assigned).otherwise(match)


def judgeable(kind: Column, value: Column) -> Column:
    """What is scored of a value, as an array: all of it, and what an assigned one begins with."""
    core = F.regexp_extract(value, CORE, 0)
    return F.when((kind == "assignment") & (core != "") & (core != value), F.array(value, core)).otherwise(F.array(value))


def features(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """The forest's variables, as an array."""
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda c: c / n
    without = lambda v, p: F.length(v) - F.length(F.regexp_replace(v, p, ""))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    changes = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    lower = F.lower(value)
    return F.array(
        *[
            c.cast("double")
            for c in (
                F.length(value),
                share(changes),
                share(F.size(F.array_distinct(F.split(value, "")))),
                share(without(lower, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))))),
                share(without(value, "[0-9]")),
                share(without(lower, "[aeiou]")),
                share(without(lower, "[bcdfghjklmnpqrstvwxyz]{3,}")),
                F.when(value.rlike("^[0-9a-fA-F]+$"), 1).otherwise(0),
                F.when(before.rlike(r"[/\\]$") | value.rlike(r"[/\\].*[/\\]") | after.rlike(r"^(?:[/\\]|\.[a-z]{2,4}\b)"), 1).otherwise(0),
                F.when(F.lower(before).rlike(POSITIVE) | (kind == "assignment"), 1).otherwise(0),
                F.when(F.lower(F.concat(before, F.lit(" "), after)).rlike(NEGATIVE), 1).otherwise(0),
                F.when(kind.isin("long_string", "assignment"), 0).otherwise(1),
            )
        ]
    )


def labelled_findings(spark: SparkSession, n: int = 16000, first: int = 0) -> DataFrame:
    """Fixed generated findings: match, before, after, label; half of them secrets. first: their first number, for others than the default's."""
    h = lambda k: F.sha2(F.concat(F.lit(f"{k}-"), F.col("id").cast("string")), 256)
    mixed = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), "[=]", "")
    pick = lambda k, *options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(options))) + 1).cast("int"))
    span = lambda k, lo, hi: (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(hi - lo + 1)) + lo).cast("int")
    word = lambda k: F.concat(*[pick(f"{k}{i}", "the", "ther", "an", "tion", "er", "on", "ou", "ment", "re", "in", "lich", "aux", "heit", "is", "ad", "es", "ing") for i in range(4)])
    assign = lambda value: F.concat(pick("name", "password", "token", "secret", "api_key", "passwd", "auth", "PASSWORD", "Token"), pick("sign", "=", " = ", ": ", "=\"", " = \"", "='"), value)
    hex_part = F.substring(h("hex"), F.lit(1), span("n", 12, 40))
    secret = pick(
        "yes",
        assign(hex_part),
        assign(hex_part),
        assign(F.substring(mixed("m"), F.lit(1), span("m", 10, 40))),
        F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(mixed("a"), "[^A-Za-z0-9]", "")), 1, 16)),
        F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(F.concat(mixed("g"), mixed("g2")), "[^A-Za-z0-9]", ""), 1, 36)),
        F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(mixed("s"), "[^A-Za-z0-9]", ""), 1, 24)),
        F.concat(F.lit("xoxb-"), F.substring(h("x"), 1, 24)),
    )
    plain = pick(
        "no",
        assign(pick("r", "${DB_PASSWORD}", "$API_TOKEN_VALUE", "process.env.API_TOKEN", "os.environ.get(", "config.get_secret_value", "<your-token-here>", "********", "getPassword()", "settings.PASSWORD_FIELD", "request.headers.token", "{{vault_password}}", "%(password)s", "self._token_value")),
        assign(pick("p", "changeme", "your_password_here", "example_token", "placeholder", "password123", "xxxxxxxxxxxx", "my_secret_key", "INSERT_TOKEN", "test_password", "default_value", "some.config.value")),
        assign(word("w")),
        assign(F.concat(word("u"), pick("join", "_", "-", "."), word("v"))),
        F.substring(h("commit"), 1, 40),
        h("sum"),
        F.concat(F.lit("src/"), word("d"), F.lit("/"), word("e"), F.lit("/"), word("f"), F.lit("-"), word("g")),
        F.concat(word("l"), word("m"), word("n"), word("o")),
        F.rpad(F.lit(""), span("z", 32, 60), "-"),
        F.concat(F.substring(h("id"), 1, 8), F.lit("-"), F.substring(h("id"), 9, 4), F.lit("-"), F.substring(h("id"), 13, 4), F.lit("-"), F.substring(h("id"), 17, 4), F.lit("-"), F.substring(h("id"), 21, 12)),
        F.regexp_replace(F.concat(h("d1"), h("d2")), "[^0-9]", ""),
    )
    hashes = F.col("match").rlike("^[0-9a-f-]{36,}$")
    rows = spark.range(first, first + n, 1, 4).withColumn("label", (F.col("id") % 2).cast("double")).withColumn("match", F.when(F.col("label") == 1, secret).otherwise(plain))
    before = F.when(hashes & (F.col("label") == 0), pick("b0", "see commit ", "sha256: ", "checksum ", "revision ", "uuid ", "built from hash ", "etag ")).otherwise(
        pick("b", "", "the ", "and then ", "in the file ", "de la ", "set ", "use ", "\"", "{", "with ")
    )
    prefix = F.when(F.col("match").rlike("^" + ASSIGNED), pick("prefix", "", "", "DB_", "client_", "GITHUB_", "MY_APP_", "x-")).otherwise("")
    return rows.select("match", F.concat(before, prefix).alias("before"), pick("c", "", " and", "\" the", ",", ";", "\n", " of").alias("after"), "label")


def _tree(lines: list[str], f: Column) -> Column:
    """The expression of a printed tree; consumes its lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    i, bound = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line).groups()
    yes = _tree(lines, f)
    lines.pop(0)  # Else
    return F.when(F.get(f, F.lit(int(i))) <= float(bound), yes).otherwise(_tree(lines, f))


def forest(findings: DataFrame, trees: int = 20, depth: int = 8):
    """A random forest model fitted to findings (match, before, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = findings.withColumn("kind", kind_of(F.col("match"))).withColumn("value", value_of(F.col("match")))
    rows = rows.select("label", array_to_vector(features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))).alias("features"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(rows)


def as_expression(model) -> Callable[[Column], Column]:
    """The model as a function of a features array: the share of trees for a secret."""
    printed = [t.toDebugString.split("\n")[1:] for t in model.trees]

    def score(f: Column) -> Column:
        total = F.lit(0.0)
        for lines in printed:
            total += _tree(list(lines), f)
        return total / len(printed)

    return score


def judged(match: Column, before: Column, after: Column, score: Callable[[Column], Column]) -> Column:
    """kind, value and score of a match and what stands around it."""
    return let(
        F.struct(kind_of(match).alias("kind"), value_of(match).alias("value")),
        lambda k: let(
            F.array_max(F.transform(judgeable(k["kind"], k["value"]), lambda v: let(features(k["kind"], v, before, after), score))),
            lambda s: F.struct(k["kind"].alias("kind"), k["value"].alias("value"), s.alias("score")),
        ),
    )


def scan_secrets(
    docs: DataFrame, *, findings: DataFrame | None = None, threshold: float = 0.5, marker: str = "[secret removed]", text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Rows (row, findings, clean): the columns of docs (or those in keep), the scored findings, and the text without its secrets.

    findings: array of (kind, start (characters from 0), value, score, secret).
    clean: the text with the value of each secret replaced by marker.
    """
    spark = docs.sparkSession
    score = as_expression(forest(findings if findings is not None else labelled_findings(spark)))
    kept = docs.select(*[name(c) for c in keep]) if keep is not None else docs
    t = name(text)
    pattern = F.lit(PATTERN)

    def described(matches: Column) -> Column:
        def each(pieces: Column) -> Column:
            return F.transform(
                matches,
                lambda m, i: F.struct(m.alias("match"), F.right(F.get(pieces, i), F.lit(40)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(20)).alias("after"), F.length(F.get(pieces, i)).alias("gap")),
            )

        def scored(c: Column) -> Column:
            return let(
                judged(c["match"], c["before"], c["after"], score),
                lambda k: F.struct(k["kind"].alias("kind"), c["match"].alias("match"), k["value"].alias("value"), c["gap"].alias("gap"), k["score"].alias("score"), (k["score"] >= threshold).alias("secret")),
            )

        def built(found: Column, pieces: Column) -> Column:
            marked = F.transform(found, lambda x: F.when(x["secret"], F.concat(F.substr(x["match"], F.lit(1), F.length(x["match"]) - F.length(x["value"])), F.lit(marker))).otherwise(x["match"]))
            ends = lambda i: F.aggregate(F.slice(found, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["gap"] + F.length(x["match"]))
            placed = F.transform(found, lambda x, i: F.struct(x["kind"].alias("kind"), (ends(i) - F.length(x["value"])).alias("start"), x["value"].alias("value"), x["score"].alias("score"), x["secret"].alias("secret")))
            clean = F.array_join(F.zip_with(pieces, F.concat(marked, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
            return F.struct(placed.alias("findings"), clean.alias("clean"))

        return let(F.split(t, PATTERN), lambda pieces: let(F.transform(each(pieces), scored), lambda found: built(found, pieces)))

    kinds = "array<struct<kind:string,start:bigint,value:string,score:double,secret:boolean>>"
    scanned = let(F.coalesce(F.regexp_extract_all(t, pattern, F.lit(0)), F.array().cast("array<string>")), lambda m: F.when(F.size(m) > 0, described(m)))
    rows = docs.select(packed(kept), t.alias("whole"), scanned.alias("scan"))
    return rows.select("row", F.coalesce(F.col("scan.findings"), F.array().cast(kinds)).alias("findings"), F.coalesce(F.col("scan.clean"), F.col("whole")).alias("clean"))
