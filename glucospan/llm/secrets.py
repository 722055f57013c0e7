"""Secrets in texts: candidate strings, judged by a random forest that removes false positives.

Everything on the way from a text to its findings is a column expression, the forest too: the trained
trees become nested conditions. So a scan is one pass over the texts, without a shuffle.

The forest learns from labelled findings: by default from a table of cases (``CASES``), ways in which secrets
and other long values are written, each with many values. Labels come from the cases, not from what the forest sees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glucospan.storage import stored

#: Words that announce a secret, and the published shapes of some providers' keys.
ANNOUNCE = "(?i)(token|secret|passw|pwd|api_?-?key|apikey|credential|bearer|private[ _-]?key|access_?-?key|auth(?!or))"
SHAPES = (
    "AKIA[0-9A-Z]{16}", "ASIA[0-9A-Z]{16}", "gh[pousr]_[0-9A-Za-z]{36}", "sk_live_[0-9A-Za-z]{16,}",
    "xox[abprs]-[0-9A-Za-z-]{10,}", "AIza[0-9A-Za-z_-]{35}",
    "eyJ[0-9A-Za-z_-]+[.]eyJ[0-9A-Za-z_-]+[.][0-9A-Za-z_-]+",
)
EXACT = "^(" + "|".join(SHAPES) + ")$"
#: What may stand before a value in its word: the end of a name, a sign of assignment, quotes and brackets. The
#: bounds keep a search linear in words of any length.
LEAD = "[^\\s\"'`,;|&<>(){}\\[\\]\\\\=:]{0,64}[\"'`\\\\\\]]{0,8}[=:]{1,8}>?[\"'`\\\\(<{\\[]{0,8}"
#: A value that an announcing name or word assigns: any signs up to a space, quote, bracket or separator.
SAID = (
    "(?i)((?:token|secret|passw|passphrase|pwd|api[_-]?key|credential|private[_-]?key|access[_-]?key|auth(?!or))[A-Za-z0-9_-]{0,64}"
    "[\"'`\\\\\\]]{0,8}\\s?(?:[=:]{1,8}>?|\\bis\\s)\\s?(?:(?:bearer|basic)\\s)?[\"'`\\\\(<{\\[]{0,8}|bearer\\s[\"'`\\\\(<{\\[]{0,8})"
    "([^\\s\"'`\\\\,;|&<>(){}\\[\\]]{6,})"
)
#: A provider's shape anywhere, also after an escaped line end.
SHAPED = f"({LEAD}|)(?:(?<![A-Za-z0-9])|(?<=\\\\[nrt]))({'|'.join(SHAPES)})(?![A-Za-z0-9])"
#: A run of 12 or more value characters.
RUN = f"({LEAD}|)([A-Za-z0-9+/_.~@:-]{{12,}}={{0,2}})"
#: The end of the words before, where it announces what comes next.
TAIL = "(?i)(?:token|secret|passw|passphrase|pwd|api[_-]?key|credential|private[_-]?key|access[_-]?key|auth|bearer)[^\\s,;]{0,64}(?:\\s(?:[=:]+>?|is|bearer|basic))*$"
FEATURES = ("length", "transitions", "digits", "upper", "distinct", "hexadecimal", "dictionary", "paths", "own_word", "near_words", "said", "shape")
#: The forest sees all but the last: a provider's shape is sure.
SEEN = len(FEATURES) - 1
#: Labelled cases: 1 for secrets. The name in braces is the kind of value that stands there (``kinds``).
CASES = (
    (1, "token = {hex40}"), (1, "TOKEN = {HEX40}"), (1, 'token: "{base40}"'), (1, '"token":"{hex40}"'), (1, "access_token={base24}"),
    (1, "api_key = {hex32}"), (1, 'apikey: "{base40}"'), (1, "api-key is {base24}"), (1, "X-Api-Key: {hex32}"),
    (1, "secret = {base40}"), (1, "client_secret={hex32}"), (1, 'SECRET_KEY = "{pass}"'), (1, "the secret is {pass}"),
    (1, "password={pass}"), (1, "password: {pass}"), (1, "passwd = {hex18}"), (1, "pwd={pass}"), (1, "DB_PASSWORD='{pass}'"),
    (1, "password={hex18}"), (1, "passphrase: {pass}"), (1, "password: {short}"), (1, "pwd is {short}"), (1, "login_password={short}"), (1, "Authorization: Bearer {base40}"), (1, "auth = {base24}"),
    (1, "auth_token => {hex40}"), (1, "credential: {base40}"), (1, "private_key = {base40}"), (1, "aws_secret_access_key = {base40}"),
    (1, "access-key: {hex32}"), (1, "bearer {hex40}"),
    (0, "commit {hex40}"), (0, "merged as {hex40}"), (0, "sha1: {hex40}"), (0, "sha256={hex64}"), (0, "etag = {hex32}"), (0, "md5 {hex32}"),
    (0, "checksum: {HEX40}"), (0, "digest {base40}"), (0, "blob {base24}"), (0, "at 10:00 {hex18} from"), (0, "id={uuid}"), (0, "request {uuid}"),
    (0, "author={hex18}"), (0, "author: {hex32}"), (0, "authored {date}"), (0, "card {digits16}"), (0, "number {digits16}"), (0, "paid {digits16}"),
    (0, "on {date}"), (0, "since {time}"), (0, "write to {mail}"), (0, "or {mail}"), (0, "see {url}"), (0, "from {ip}"), (0, "host {host}"),
    (0, "version {version}"), (0, "in {path}"), (0, "call {phone}"), (0, "a private garden, {part}"), (0, "part {part}"),
    (0, "the secret garden of {part}"), (0, "order={digits16}"), (0, "key {words}"), (0, "named {words}"),
    (0, "token_url = {url}"), (0, "token expires: {time}"), (0, "tokens: {digits16}"), (0, "auth = {mail}"), (0, "password reset on {date}"),
    (0, "password_file = {path}"), (0, "secret_version: {version}"), (0, "api_key_rotated={date}"), (0, "credential host: {host}"),
    (0, "access_key_id: {uuid}"), (0, "secret = {words}"), (0, "auth: {url}"), (0, "private_key = {path}"),
)


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the findings of each label learnt from, ``values`` those of each case, ``words`` the dictionary."""

    sample: int = 20_000
    values: int = 40
    words: int = 20_000
    trees: int = 20
    depth: int = 6
    seed: int = 5
    threshold: float = 0.5


def dictionary(texts: DataFrame, text: str, s: Settings = Settings()) -> list[str]:
    """The lower-case words of four letters or more that most texts of a table hold; ties by word.

    At most ``s.words`` of them: an input of the forest's one feature, whatever the table's size.
    """
    words = F.array_distinct(F.split(F.lower(F.col(f"`{text}`")), "[^\\p{L}]+"))
    each = texts.select(F.explode(words).alias("word")).filter(F.length("word") > 3)
    most = each.groupBy("word").count().orderBy(F.desc("count"), "word").limit(s.words)
    return sorted(r.word for r in most.select("word").collect())


def _kinds(value: Column) -> Column:
    """One sign for each kind of character."""
    plain = F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[a-z]", "a")
    return F.regexp_replace(F.regexp_replace(plain, "[A-Z]", "A"), "[^9aA]", "-")


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def _near(words: Column, at: Column) -> Column:
    """The three words before a place counted from 0."""
    return F.array_join(F.slice(words, F.greatest(at - 2, F.lit(1)), F.least(at, F.lit(3))), " ")


def _values(word: Column, near: Column) -> Column:
    """The (lead, value, said) of a word: values assigned by an announcing word, provider shapes, other runs.

    Each value once, with the lead of the first kind that finds it. A run holds a digit.
    """
    told = F.concat_ws(" ", F.regexp_extract(near, TAIL, 0), word)

    def all_of(text: Column, pattern: str, said: int) -> Column:
        leads, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) for group in (1, 2))
        return F.zip_with(leads, values, lambda lead, value: F.struct(
            lead.alias("lead"), F.rtrim(value, F.lit(".")).alias("value"), F.lit(said).alias("said")
        ))

    runs = F.filter(all_of(word, RUN, 0), lambda x: x["value"].rlike("[0-9]"))
    found = F.concat(all_of(told, SAID, 1), all_of(word, SHAPED, 0), runs)
    both = F.transform(F.array(found), lambda f: F.struct(f.alias("f"), F.transform(f, lambda y: y["value"]).alias("values")))
    first = F.transform(both, lambda b: F.filter(b["f"], lambda x, i: F.array_position(b["values"], x["value"]) == i + 1))
    return F.element_at(first, 1)


def _finding(lead: Column, value: Column, said: Column, place: Column, known: list[str]) -> Column:
    pieces = F.split(F.lower(value), "[^a-z]+")
    covered = F.aggregate(
        F.filter(pieces, lambda p: p.isin(known)),
        F.lit(0), lambda n, p: n + F.length(p),
    )
    numbers = {
        "length": F.length(value),
        "transitions": (F.length(F.regexp_replace(_kinds(value), "(.)\\1*", "x")) - 1) / F.length(value),
        "digits": _share(value, "[^0-9]"),
        "upper": _share(value, "[^A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "hexadecimal": F.when(value.rlike("^[0-9a-fA-F]+$"), 1).otherwise(0),
        "dictionary": covered / F.length(value),
        "paths": F.length(F.regexp_replace(F.concat(lead, value), "[^/.@:\\\\]", "")),
        "own_word": F.when(lead.rlike(ANNOUNCE), 1).otherwise(0),
        "near_words": place["announced"],
        "said": said,
        "shape": F.when(value.rlike(EXACT), 1).otherwise(0),
    }
    features = F.array(*(numbers[name].cast("double") for name in FEATURES))
    word, near = (place["at"] + 1).cast("int"), F.substring(place["near"], -1000, 1000)
    return F.struct(word.alias("word"), value.alias("value"), near.alias("near"), features.alias("features"))


def candidates(text: Column, known: list[str]) -> Column:
    """An array of (word, value, near, features): every candidate of a text, by the words they stand in.

    ``near`` is the end of the three words before, of 1,000 signs at most; the features are from the whole words.
    Candidates are runs of 12 value characters or more with a digit, provider shapes anywhere, and what an
    announcing word assigns from 6 signs on, whatever its signs. A word may hold any number of them.
    """
    def held(words: Column, w: Column, i: Column) -> Column:
        long = (F.length(w) >= 12) & (w.rlike("[0-9]") | w.rlike(SHAPED))
        before = F.concat_ws(" ", F.get(words, i - 3), F.get(words, i - 2), F.get(words, i - 1), w)
        kept = long | (F.length(w) >= 6) & before.rlike(SAID)
        near = _near(words, i)
        return F.when(kept, F.struct(i.alias("at"), w.alias("word"), near.alias("near"), F.when(near.rlike(ANNOUNCE), 1).otherwise(0).alias("announced")))

    def within(words: Column) -> Column:
        picked = F.filter(F.transform(words, lambda w, i: held(words, w, i)), lambda x: x.isNotNull())
        return F.flatten(F.transform(picked, lambda x: F.transform(
            _values(x["word"], x["near"]), lambda v: _finding(v["lead"], v["value"], v["said"], x, known)
        )))

    # The words are split once for each text: a lambda works out again whatever is not a variable of its own.
    return F.element_at(F.transform(F.array(F.split(text, "\\s+")), within), 1)


def kinds(number: Column) -> dict[str, Column]:
    """A value of each kind that ``CASES`` name, made from a number."""
    sha, md5 = F.sha1(number.cast("string").cast("binary")), F.md5(number.cast("string"))
    base = F.regexp_replace(F.base64(F.unhex(F.sha2(number.cast("string"), 256))), "[+=]", "x")
    digits = F.lpad(F.conv(F.substring(sha, 1, 13), 16, 10), 16, "4")
    small = F.pmod(F.xxhash64(number), F.lit(90)) + 10
    n = small.cast("string")
    day = F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(F.xxhash64(number), F.lit(4000)).cast("int")), "yyyy-MM-dd")
    name = F.translate(F.substring(md5, 1, 7), "0123456789", "ghijklmnop")
    mark = F.substring(F.lit("!@#$%^*_"), (small % 8 + 1).cast("int"), F.lit(1))
    return {
        "hex18": F.substring(sha, 1, 18), "hex32": md5, "hex40": sha, "HEX40": F.upper(sha), "hex64": F.sha2(number.cast("string"), 256),
        "base24": F.substring(base, 1, 24), "base40": F.substring(base, 1, 40), "digits16": digits,
        "pass": F.concat(F.initcap(name), mark, F.substring(digits, 9, 4), F.substring(base, 3, 3)),
        "short": F.concat(F.substring(name, 1, 6), n), "uuid": F.concat_ws("-", *(F.substring(md5, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        "date": day, "time": F.concat(day, F.lit("T10:"), n, F.lit(":00Z")), "mail": F.concat(name, F.lit("."), n, F.lit("@mail.example.com")),
        "url": F.concat(F.lit("https://www.example.com/"), name, F.lit("/"), n), "ip": F.concat(n, F.lit(".51."), n, F.lit(".173")),
        "host": F.concat(F.lit("db-"), n, F.lit("."), name, F.lit(".example.com")), "version": F.concat(n, F.lit(".12.4-rc.1-"), name),
        "path": F.concat(F.lit("/var/lib/"), name, F.lit("/file-"), n, F.lit(".txt")), "phone": F.concat(F.lit("+49-30-"), F.substring(digits, 9, 8)),
        "part": F.concat(day, F.lit("-"), n, F.lit("a")), "words": F.concat(name, F.lit("-"), F.reverse(name), F.lit("-"), n),
    }


def labelled(spark: SparkSession, known: list[str], s: Settings = Settings()) -> DataFrame:
    """Labelled findings (value, near, features, label): what ``candidates`` makes of each case's values."""
    rows = []
    for number, (label, text) in enumerate(CASES):
        before, kind, after = text.replace("{", "\0").replace("}", "\0").split("\0")
        rows.append((number, label, before, kind, after))
    names = ("number", "label", "before", "kind", "after")
    cases = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, row))) for row in rows))
    cases = spark.range(1).select(F.inline(cases))
    each = cases.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(s.values - 1))))
    value = F.lit(None).cast("string")
    for kind, made in kinds(F.col("number") * 1000 + F.col("i")).items():
        value = F.when(F.col("kind") == kind, made).otherwise(value)
    each = each.withColumn("value", value)
    # Other words before and after, as in a text.
    text = F.concat(F.lit("some words here "), F.col("before"), F.col("value"), F.col("after"), F.lit(" and more"))
    found = each.withColumn("x", F.explode(candidates(text, known)))
    return found.filter(F.col("x.value") == F.col("value")).select("x.value", "x.near", "x.features", "label")


def forest(findings: DataFrame, s: Settings = Settings()) -> str:
    """SQL for the probability that a finding ``x`` is a secret, learnt from (features, label).

    Of each label ``s.sample`` findings are learnt from: distinct ones, those with the least hash; however rare a
    label is, both weigh the same. Rows with a null are left out. Findings of one label alone give that label to all,
    and no findings give 0. The last feature, a provider's shape, is not learnt from.
    """
    distinct = stored(findings.select("features", F.col("label").cast("int").alias("label")).dropna().distinct())
    least = [distinct.filter(F.col("label") == x).orderBy(F.xxhash64("features")).limit(s.sample) for x in (0, 1)]
    rows = least[0].unionByName(least[1]).persist()
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        rows.unpersist()
        return f"{float(next(iter(counts), 0))}D"
    weight = F.when(F.col("label") == 1, sum(counts.values()) / (2 * counts[1])).otherwise(sum(counts.values()) / (2 * counts[0]))
    learning = rows.select(array_to_vector(F.slice("features", 1, SEEN)).alias("features"), F.col("label").cast("double").alias("label"), weight.alias("weight"))
    model = RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth, seed=s.seed, weightCol="weight").fit(learning)
    rows.unpersist()
    return "(" + " + ".join(_tree(t._call_java("rootNode")) for t in model.trees) + f") / {s.trees}D"


def _tree(node) -> str:
    if node.subtreeDepth() == 0:
        counts = list(node.impurityStats().stats())
        return repr(counts[1] / sum(counts)) + "D"
    split = node.split()
    test = f"x.features[{split.featureIndex()}] <= {split.threshold()!r}D"
    return f"CASE WHEN {test} THEN {_tree(node.leftChild())} ELSE {_tree(node.rightChild())} END"


def judged(df: DataFrame, probability: str, known: list[str], text: str = "text") -> DataFrame:
    """Add ``findings``: an array of (word, value, score), of every candidate. A null text has none. A column of
    that name is replaced; others come back as they were, whatever their names."""
    found = F.coalesce(candidates(F.col(f"`{text}`"), known), F.array())
    own = [name for name in df.columns if name != "findings"]
    rows = df.select(F.struct(*(F.col(f"`{n}`") for n in own)).alias("row"), found.alias("found"))
    judge = F.expr(f"transform(found, x -> named_struct('word', x.word, 'value', x.value, 'score', {probability}))")
    return rows.select("row.*", judge.alias("findings"))


def learnt(df: DataFrame, known: list[str], s: Settings = Settings()) -> str:
    """SQL for the probability of a finding in the texts of ``df``: the forest of the labelled cases.

    What has a provider's shape is sure, whatever the forest says. The cases do not depend on the table, so neither
    does the forest; findings of your own with a label go to ``forest``.
    """
    return f"CASE WHEN x.features[{SEEN}] = 1D THEN 1.0D ELSE {forest(labelled(df.sparkSession, known, s), s)} END"


def redacted(df: DataFrame, probability: str, known: list[str], s: Settings = Settings(), text: str = "text") -> DataFrame:
    """The rows with every secret in the text replaced by ``[secret]``; other texts stay as they are."""
    names = df.columns
    own = df.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{n}`") for n in names if n != text)).alias("row"), F.col(f"`{text}`").alias("text"))
    rows = judged(own, probability, known)
    secrets = F.filter("findings", lambda x: x["score"] >= s.threshold)
    # The longest first: one may be part of another.
    secrets = F.array_sort(secrets, lambda a, b: F.length(b["value"]) - F.length(a["value"]))
    clean = F.aggregate(secrets, F.col("text"), lambda t, x: F.replace(t, x["value"], F.lit("[secret]")))
    clean = F.when(F.size(secrets) > 0, clean).otherwise(F.col("text"))
    return rows.select(*(clean.alias(n) if n == text else F.col("row").getField(n).alias(n) for n in names))
