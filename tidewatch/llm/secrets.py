"""Secret scan: key blocks, assigned values and long tokens are candidates, a random forest removes the false ones.

Everything that touches the documents is a DataFrame expression on the row of the document:
candidates come from one pattern, their features and the trees of the forest are expressions
within ``transform``, so there is no shuffle and no Python.  The forest is fitted by Spark's
machine learning library on labelled findings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.workspace import new_folder, written

PLACEHOLDER = "[secret]"
#: Key blocks that are secrets by their form, whatever the trees say: data or a line end follows the mark.
BLOCK = r"""^-{4,5} ?BEGIN [^-]*-{4,5}\s*(?:(?<=\s)[A-Za-z0-9+/]{20}|(?<=[\r\n])|[\\"'])"""
#: Labelled findings that the forest learns from at most, its trees and their depth.
MAX_FINDINGS = 4096
TREES, DEPTH = 15, 6
#: Share of the trees that must call a candidate a secret.
THRESHOLD = 0.5

#: Words that make a token look like language or code.
DICTIONARY = (
    "about account address after also article before book build cache chapter check class client code "
    "column config content count create data date default delete der die directory error event example "
    "field file find first for format from function get group handler have header home html http image "
    "index info input item json key lang last length library line link list load local main message "
    "method model module name news not null number object option order output package page param path "
    "placeholder point post print product project query read request response result return row sample "
    "schema search section server session set size source start state static status string style system "
    "table test text that the this time title type und update upload user value version view web which "
    "width with word write year your"
).split()
#: Words that stand before secrets, and words that stand before other long tokens.
SECRET_NAMES = (
    "access[_-]?key api[_-]?key auth authorization bearer client[_-]?secret credential passphrase "
    "passwd password private[_-]?key pwd secret secret[_-]?key signing[_-]?key token"
).split()
HARMLESS_NAMES = (
    "card checksum commit digest etag fingerprint guid hash id integrity invoice isbn md5 object "
    "order phone ref release revision rev serial sha sha1 sha256 sha512 uuid version"
).split()

_NAME_END = r"""["']?\s{0,3}(?:[:=]|=>)?\s{0,3}["'`]?$"""

_NAMES = "(?i:" + "|".join(SECRET_NAMES) + r")\d{0,4}"
_QUOTE = r"""\\{0,3}["'`]"""
#: What stands between a secret's name and its value, up to the quote that opens it.
_ASSIGN = (
    rf"(?:(?:{_QUOTE})?\]?\s{{0,40}}(?:=>|:=|==?|[:=(>])|{_QUOTE}\s{{0,40}},)\s{{0,40}}"
    rf"""(?:[bfruBFRUL@]{{0,2}}(?:\"{{3}}|'{{3}}|{_QUOTE}))?"""
)
_SCHEME = "(?i:bearer|basic|digest|token)"
_RUN = "[A-Za-z0-9+/_-]"
#: Where an unquoted value ends before a blank or quote: closing signs, or the next name of a list.
_VALUE_END = rf"""[.,;:)\]}}>|]{{1,64}}+(?:[\s"'`<>]|$)|[,;&][\w.-]{{1,40}}(?:{_QUOTE})?\s?[:=]|\\{{1,3}}["'`nrt]"""


def _quoted(sign: str) -> str:
    """All of a quoted value, on one line; words around a long token are left to themselves."""
    part = rf"(?!\s{_RUN}{{16}})"
    return (
        rf"(?<=\\{sign})(?:{part}[^{sign}\\\n])++(?=\\{{1,3}}{sign})"
        rf"|(?<={sign})(?!{_RUN}{{16,}}={{0,2}}\s)(?:{part}(?:\\.|[^{sign}\\\n]))++(?={sign})"
    )


#: A private key block; the password of a url, which holds no "://", so that no part of a text is read for
#: two urls; a value of any length after a secret's name,
#: quoted or not; 16 and more characters of keys and digests, unless they are a secret's name
#: with a value behind it.  No loop over alternatives can be re-entered: Java would recurse.
CANDIDATE = (
    r"-{4,5} ?BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)? ?-{4,5}(?:(?!-{4,5} ?(?:BEGIN|END) )[\s\S])*+"
    r"-{4,5} ?END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)? ?-{4,5}"
    r"""|(?<=:)(?!//)(?<=://[^\s/:@"'`<>]{0,255}:)(?!\d{1,5}[/?#,])(?:[^\s/?#"'`<>]+(?=@)|(?:[^\s"'`<>@:]|:(?!//))++(?=@))"""
    r"""|(?<=[:=(>,\s"'`])(?=[^\s"'`])(?:"""
    rf"(?<![A-Za-z0-9]\s)(?<=[:=(>,]\s{{0,40}}(?:[bfruBFRUL@]{{0,2}}[\\\"'`]{{1,4}})?)(?<={_NAMES}{_ASSIGN})"
    rf"|(?<={_SCHEME}\s{{1,4}})(?<=(?i:auth|authorization){_ASSIGN}{_SCHEME}\s{{1,4}}))"
    rf"""(?!\w{{1,20}}://)(?!{_SCHEME}\s)(?!-{{4,5}} ?BEGIN )(?:{"|".join(map(_quoted, "\"'`"))}"""
    rf"""|(?![bfruBFRUL@]{{1,2}}["'`])(?!{_RUN}{{16,}}={{0,2}}[!#.,]*+(?:\s|$))(?:(?!{_VALUE_END})[^\s"'`<>])++)"""
    rf"|(?<!{_RUN})(?={_RUN}{{16}})(?=[+/_-]*+[A-Za-z0-9])"
    rf"(?!{_RUN}*{_NAMES}(?:{_QUOTE})?\]?\s{{0,40}}[:=])"
    rf"""{_RUN}{{16,}}(?:={{1,2}}+(?![A-Za-z0-9+/_$-]|["'`][^\s,;)\]}}"'`:]))?"""
)


def _features(value: Column, before: Column, after: Column) -> list[Column]:
    """Length, characters and their transitions, dictionary coverage, path, neighbouring words."""
    length = F.length(value).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / length

    def flag(text: Column, pattern: str) -> Column:
        return text.rlike(pattern).cast("double")

    steps = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    uncovered = F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return [
        F.least(length, F.lit(200.0)),
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        share("[-+/_=]"),
        share(steps),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(length, F.lit(64.0)),
        flag(value, r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
        flag(value, r"^[0-9]+$"),
        flag(value, r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
        flag(value, r"(?i)x{4}|0{6}|1234567|abcdef|example|your[_-]|changeme|placeholder"),
        flag(value, r"(.)\1{3}"),
        F.lit(1.0) - uncovered / length,
        flag(F.concat(before, F.lit(" ")), r"(?:[/\\.@#?&]|://\S*) $"),
        flag(after, r"^(?:\.[A-Za-z]{2,5}\b|[/\\?@])"),
        flag(before, r"(?i)(?:^|[^a-z])(?:\w{0,20}[_-])?(?:" + "|".join(SECRET_NAMES) + ")" + _NAME_END),
        flag(before, r"(?i)(?:^|[^a-z])(?:" + "|".join(HARMLESS_NAMES) + ")" + _NAME_END),
        flag(before, r"""[:=]\s{0,3}["'`]?$"""),
        flag(before, r"""["'`]$"""),
        flag(value, "^-{4,5} ?BEGIN "),
        share(r"[^-A-Za-z0-9+/_=\s]"),
        share(r"\s"),
        share("(?i)[aeiouy]"),
        share("(?i)[bcdfghjklmnpqrstvwxz]{4}"),
        flag(value, "^(?:[A-Z]?[a-z]+|[A-Z]+)$"),
        flag(value, r"^[-+/]?[A-Za-z]+(?:[-_./][A-Za-z]+)++$"),
        flag(value, r"^(?:\$[{(\w]|%|\{|<|\[)|[(\[]|(?i)^(?:null|nil|none|true|false|undefined|str|string|text|bytes|int|object)\W*$"),
        flag(value, r"(?i)^(?:\W+|x+|your.*|changeme|example|placeholder|redacted|hidden|required|optional|password|secret|token)$"),
        flag(after, r"^[(\[]"),
        flag(before, _NAMES + _ASSIGN + "$"),
        flag(before, _NAMES + _ASSIGN + r"""(?<=["'`])$"""),
        flag(F.concat(before, F.lit(" "), after), r"://[^\s/@]*: @"),
    ]


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_values`` (the candidates of the whole text) and ``_pieces`` (what stands between)."""
    values = F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0))
    held = docs.withColumn("_values", F.coalesce(values, F.array().cast("array<string>")))
    pieces = F.when(F.size("_values") > 0, F.split(F.col(text_col), CANDIDATE, -1))
    return held.withColumn("_pieces", F.coalesce(pieces, F.array(F.col(text_col))))


def _measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """:func:`with_candidates` and, for each candidate, what stands around it and its features."""

    def tail(text: Column) -> Column:
        return F.right(text, F.lit(60))

    def measured(value: Column, at: Column) -> Column:
        # A value has one character at least, so 60 pairs of piece and value fill the text in front.
        piece, first = F.get("_pieces", at), F.greatest(at - 59, F.lit(1))
        nearer = F.array_join(F.slice("_tails", first, at + 1 - first), "")
        before = F.when((at == 0) | (F.length(piece) >= 60), tail(piece)).otherwise(tail(F.concat(nearer, piece)))
        after = F.left(F.concat(F.get("_pieces", at + 1), F.coalesce(F.get("_values", at + 1), F.lit(""))), F.lit(20))
        features = F.array(*_features(value, before, after))
        return F.struct(value.alias("value"), before.alias("before"), features.alias("features"))

    tails = F.transform("_values", lambda value, at: tail(F.concat(tail(F.get("_pieces", at)), tail(value))))
    return with_candidates(docs, text_col).withColumn("_tails", tails).withColumn("_measured", F.transform("_values", measured))


def _list(values: list, kind: str) -> str:
    """A literal array in SQL: one text, which the optimizer turns into the array once."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


class Forest:
    """The trees of a fitted forest, taken from its description, as flat lists of nodes."""

    def __init__(self, description: str):
        self.trees: list[list[str]] = []
        for line in description.splitlines()[1:]:
            if line.strip().startswith("Tree "):
                self.trees.append([])
            elif line.strip():
                self.trees[-1].append(line.strip())

    def _nodes(self) -> tuple[list[int], list[tuple[int, float, int, int, float]], int]:
        """The roots, all nodes as (feature, bound, lower child, upper child, vote), and the longest way down.

        A leaf is its own child, so that every way may be walked for the same number of steps.
        """
        nodes: list[tuple[int, float, int, int, float]] = []

        def place(lines: Iterator[str]) -> tuple[int, int]:
            own, line = len(nodes), next(lines)
            if line.startswith("Predict:"):
                nodes.append((0, 0.0, own, own, float(line.split(":")[1])))
                return own, 0
            column, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
            nodes.append((0, 0.0, own, own, 0.0))
            low, low_depth = place(lines)
            next(lines)  # the Else
            high, high_depth = place(lines)
            nodes[own] = int(column), float(bound), low, high, 0.0
            return own, 1 + max(low_depth, high_depth)

        placed = [place(iter(tree)) for tree in self.trees]
        return [root for root, _ in placed], nodes, max(depth for _, depth in placed)

    def score(self, features: str) -> str:
        """SQL of the share of trees that vote for a secret, given the SQL of the feature array."""
        roots, nodes, depth = self._nodes()
        feature, bound, low, high, vote = (
            _list(list(column), kind) for column, kind in zip(zip(*nodes), ("int", "double", "int", "int", "double")))
        step = f"if({features}[{feature}[at]] <= {bound}[at], {low}[at], {high}[at])"
        leaf = f"aggregate(sequence(1, {max(depth, 1)}), root, (at, step) -> {step})"
        return f"aggregate({_list(roots, 'int')}, 0D, (votes, root) -> votes + {vote}[{leaf}]) / {len(roots)}D"


def fit(findings: DataFrame, max_rows: int = MAX_FINDINGS, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    """A forest from ``findings(text, label)``: each text holds one finding, its first candidate.

    ``label`` is 1 for a secret; rows with null or without a candidate are left out.  At most
    ``max_rows`` rows count, those with the lowest hash.
    """
    held = _measured(findings.filter("text is not null and label is not null").select("text", "label"))
    held = held.filter(F.size("_values") > 0).orderBy(F.xxhash64("text"), "text", "label").limit(max_rows)
    features = F.get("_measured", F.lit(0))["features"]
    rows = written(held.select(features.alias("features"), F.col("label").cast("double").alias("label")), "findings")
    rows = rows.select(array_to_vector("features").alias("features"), "label").coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(rows)
    return Forest(model.toDebugString)


def scan(
    docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = THRESHOLD,
    findings: str = "findings", redacted: str = "redacted",
) -> DataFrame:
    """``docs`` with the columns ``findings`` and ``redacted``; such columns are replaced.

    ``findings`` is an array of (``value``, ``before``, ``score``, ``secret``), one for each
    candidate of the whole text in its order; ``redacted`` is the text with every secret
    replaced by ``[secret]``.  A null text has no findings and stays null; an empty one stays
    empty; repeated rows are judged alike.
    """
    columns = [c for c in docs.columns if c not in (findings, redacted)]
    measured = _measured(docs.select(*columns), text_col)
    found = measured.withColumn("_scores", F.expr(f"transform(_measured, one -> {forest.score('one.features')})"))

    def finding(one: Column, voted: Column) -> Column:
        score = F.when(one["value"].rlike(BLOCK), F.lit(1.0)).otherwise(voted)
        return F.struct(one["value"].alias("value"), one["before"].alias("before"), score.alias("score"), (score > threshold).alias("secret"))

    found = found.withColumn(findings, F.zip_with("_measured", "_scores", finding))

    def rebuilt(piece: Column, at: Column) -> Column:
        one = F.get(findings, at)
        value = F.when(one["secret"], F.lit(PLACEHOLDER)).otherwise(one["value"])
        return F.concat(piece, F.coalesce(value, F.lit("")))

    text = F.when(F.exists(findings, lambda one: one["secret"]), F.array_join(F.transform("_pieces", rebuilt), ""))
    return found.select(*columns, findings, F.coalesce(text, F.col(text_col)).alias(redacted))


def _draw(salt: int, count: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")


def _choose(names: list[str], salt: int) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), _draw(salt, len(names)))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _generated(spark: SparkSession, made: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """The rows of ``made`` as a table of ``spark``.

    They are few and their expressions many, so a session of their own evaluates them without compiling,
    which would take the driver hundreds of megabytes.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    rows, folder = made(session), new_folder(spark, "labelled")
    return spark.read.schema(written(rows, "labelled", folder).schema).parquet(folder)


def _pick(made: list[Column], salt: int) -> Column:
    at = _draw(salt, len(made))
    return reduce(lambda rest, one: F.when(at == one[0], one[1]).otherwise(rest), enumerate(made), F.lit(""))


def labelled_findings(spark: SparkSession, rows: int = MAX_FINDINGS, seed: int = 1) -> DataFrame:
    """``rows`` labelled findings (``text``, ``label``), made by rule from random keys and digests.

    The tables of this library hold no judged findings, so these stand in for a team's
    own.  Half are secrets in the places where people leave them, half what scanners report
    by mistake: digests, commits, numbers, identifiers, paths, links and placeholders.
    Some are in capitals, quoted, or followed by punctuation.
    """
    return _generated(spark, lambda session: _labelled_rows(session, rows, seed))


def _labelled_rows(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    keys = ["token", "api_key", "secret", "access_key", "auth_token", "client_secret", "password", "API-KEY"]
    plain = ["", "see ", "commit ", "sha256: ", "md5 ", "checksum = ", "id: ", "revision ", "etag ", "integrity sha512-"]
    numbers = ["", "card ", "order ", "call ", "invoice ", "phone "]
    made = spark.range(rows).withColumn("hex", F.sha2(F.concat_ws(" ", F.col("id"), F.lit(seed)), 512))
    made = made.withColumn("b64", F.regexp_replace(F.base64(F.unhex("hex")), r"\s", ""))
    made = made.select(
        "id", "hex", "b64",
        F.regexp_replace(F.translate("b64", "+/", "-_"), "=", "").alias("url64"),
        F.regexp_replace("b64", "[^A-Za-z0-9]", "").alias("alnum"),
        F.translate("hex", "abcdef", "274905").alias("digits"),
        F.translate("hex", "0123456789", "aeioubdlnr").alias("letters"),
        F.when(_draw(5, 3) > 0, '"').otherwise("").alias("quote"),
        F.concat(_choose(keys, 6), F.when(_draw(7, 3) == 0, ": ").otherwise(" = ")).alias("name"),
        _choose(plain, 8).alias("plain"), _choose(numbers, 11).alias("number"),
    )

    def part(name: str, start: int, length: int) -> Column:
        return F.substring(name, start, length)

    def named(value: Column | str) -> Column:
        return _text(F.col("name"), F.col("quote"), value, F.col("quote"))

    uuid = F.concat_ws("-", *[part("hex", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    secrets = [
        *[named(part("hex", 1, n)) for n in (32, 40, 64)],
        named(part("alnum", 1, 32)), named(part("b64", 1, 40)), named(part("url64", 1, 64)),
        _text("AWS_SECRET_ACCESS_KEY=", part("b64", 3, 40)), _text("Authorization: Bearer ", part("url64", 1, 80)),
        _text("ghp_", part("alnum", 1, 36)), _text("sk_live_", part("alnum", 1, 24)),
        _text("AKIA", F.upper(part("alnum", 1, 16))),
        _text("-----BEGIN RSA PRIVATE KEY-----\n", F.col("b64"), "\n-----END RSA PRIVATE KEY-----"),
    ]
    others = [
        *[_text(F.col("plain"), part("hex", 1, n)) for n in (32, 40, 64)],
        *[_text(F.col("number"), part("digits", 1, n)) for n in (16, 20)],
        _text("id=", uuid), uuid, _text("get_user_", part("letters", 1, 4), "_by_order", part("digits", 9, 1), "_list2"),
        _text("https://", part("letters", 1, 9), ".example.org/2024/", part("letters", 10, 8), "-", part("digits", 3, 3),
             "-", part("letters", 20, 7)),
        _text("/static/", part("hex", 1, 32), ".png"),
        named("xxxxxxxxxxxxxxxx1234"), named(_text("your_api_key_here_", part("digits", 1, 3))),
        _text(part("letters", 1, 9), "_", part("letters", 10, 7), "_", part("digits", 1, 2)),
        _text("version ", part("digits", 1, 6), "-", part("letters", 3, 5), "-", part("digits", 7, 8)),
        _text('integrity="sha384-', part("b64", 1, 64), '"'),
    ]
    made = made.withColumn("label", _draw(3, 2))
    line = F.when(F.col("label") == 1, _pick(secrets, 20)).otherwise(_pick(others, 21))
    made = made.select("id", "label", line.alias("line"))
    line = F.when(_draw(30, 6) == 0, F.upper("line")).otherwise(F.col("line"))
    lead = _choose(["", "and then ", "erwh thon. ", "| ", "THE!! ", "of%%% the&&& "], 31)
    tail = _choose(["", "", " and so on", "!!", "###", " | rest", ".", ","], 32)
    return made.select(F.concat(lead, line, tail).alias("text"), "label")


def assigned_findings(spark: SparkSession, rows: int = MAX_FINDINGS, seed: int = 2) -> DataFrame:
    """``rows`` labelled findings (``text``, ``label``) of the kinds that :func:`labelled_findings` lacks.

    Secrets are passwords of any length, in urls too, keys without digits, and key blocks
    of other makes; the others are long words, names and paths, and code or placeholders after
    a secret's name.
    """
    return _generated(spark, lambda session: _assigned_rows(session, rows, seed))


def _assigned_rows(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    def part(name: str, start: int, length: int) -> Column:
        return F.substring(name, start, length)

    words, signs = DICTIONARY, list("!@#$%^&*?.-_")
    made = spark.range(rows).withColumn("hex", F.sha2(F.concat_ws(" ", F.col("id"), F.lit(seed)), 512))
    made = made.withColumn("b64", F.regexp_replace(F.base64(F.unhex("hex")), r"\s", ""))
    made = made.withColumn("alnum", F.regexp_replace("b64", "[^A-Za-z0-9]", ""))
    made = made.withColumn("mixed", F.regexp_replace("alnum", "[0-9]", ""))
    made = made.withColumn("letters", F.translate("hex", "0123456789", "aeioubdlnr")).withColumn("word", _choose(words, 41))
    made = made.withColumn("second", _choose(words, 42)).withColumn("third", _choose(words, 43)).withColumn("sign", _choose(signs, 44))
    made = made.withColumn("label", _draw(3, 2)).withColumn("quote", _choose(['"', "'", "", ""], 45))
    name = _choose(["password", "passwd", "pwd", "secret", "token", "DB_PASSWORD", "OAUTH2_CLIENT_SECRET", "apiKey", "auth_token",
                    "passphrase", "credential", "ADMIN_PASSWORD2"], 46)
    sign = _choose([" = ", "=", ": ", ":", " => ", '": ', ">", "(", " = b"], 47)
    made = made.withColumn("name", _text(name, sign))

    def named(value: Column | str) -> Column:
        return _text(F.col("name"), F.col("quote"), value, F.col("quote"))

    title = F.initcap("word")
    short = [
        _text(F.col("word"), part("hex", 1, 1), F.col("sign"), part("mixed", 1, 2)), _text(title, part("alnum", 1, 3), F.col("sign"), part("alnum", 5, 1)),
        part("alnum", 1, 8), part("alnum", 1, 12), _text(part("mixed", 1, 2), "0", part("letters", 1, 3), "4", part("letters", 5, 3)),
        _text(title, F.col("second"), part("hex", 7, 2)), _text(F.col("word"), part("hex", 3, 3)),
        *[_text(one, _draw(52, 1000).cast("string")) for one in (F.col("word"), part("letters", 1, 6))],
    ]
    word = [part("letters", 1, 16), F.concat(F.col("word"), part("letters", 1, 14)), F.concat("word", "second", "third", part("letters", 1, 9))]
    password = _pick([*short, part("mixed", 1, 14), _text(part("alnum", 1, 9), F.col("sign"), part("alnum", 10, 5))], 48)
    body = _pick([_text("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,", F.upper(part("hex", 1, 32)), "\n\n", F.col("b64")),
                  _text("\\n", F.col("b64"), "\\n", part("b64", 1, 40), "\\n"), _text("\n", F.col("b64"), "\n")], 49)
    secrets = [
        *[named(password)] * 5, *[named(part("mixed", 1, n)) for n in (16, 20, 24)], *[part("mixed", 1, n) for n in (20, 32)],
        named(part("hex", 1, 12)), named(part("hex", 1, 40)), _text(F.col("name"), '"', part("letters", 1, 10), '"'),
        _text(F.col("name"), '"', F.col("word"), " ", F.col("second"), " ", F.col("third"), " ", part("letters", 1, 5), '"'),
        *[_text(scheme, "://", F.col("second"), ":", password, "@", F.col("third"), ".example.org/", F.col("word"))
          for scheme in ("postgres", "https", "mongodb+srv")],
        _text("redis://:", part("letters", 1, 9), "@", F.col("third"), ":6379/0"),
        *[_text("-----BEGIN ", kind, "-----\n", body, "\n-----END ", kind, "-----") for kind in ("RSA PRIVATE KEY", "PRIVATE KEY")],
        *[_text("-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2\n\n", one, "\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----")
          for one in (F.col("b64"), part("b64", 1, 9))],
        _text("-----BEGIN ENCRYPTED PRIVATE KEY-----\n", part("alnum", 1, 12), "\n-----END ENCRYPTED PRIVATE KEY-----"),
    ]
    others = [
        *[one for one in word], *[F.initcap(one) for one in word], *[F.upper(one) for one in word],
        _text(F.col("word"), title, F.initcap("second"), F.initcap("third"), "Handler"), _text(title, F.initcap("second"), F.initcap("third"), "Factory"),
        *[F.concat_ws(sign, "word", "second", "third", _choose(words, 50), _choose(words, 51)) for sign in ("_", "-", "/")],
        F.upper(F.concat_ws("_", "word", "second", "third", _choose(words, 50))),
        _text("/usr/", F.concat_ws("/", "word", "second", "third", _choose(words, 50))),
        *[_text(F.col("name"), one) for one in (
            "null", "None", "true", "str", "string", "os.environ[", "getpass(", _text("get_", F.col("word"), "()"),
            _text(F.col("word"), ".", F.col("second"), "("), _text("self.", F.col("word")), _text("request.", F.col("word"), "["),
            "${DB_PASSWORD}", "$PASSWORD", "{{ password }}", "%s", "<password>")],
        *[_text(F.col("name"), '"', one, '"') for one in (
            "********", "changeme", "your_password", "xxxxxxxx", "${DB_PASSWORD}", "<password>", "{{ token }}", "%s", "password",
            "string", "example")],
        *[_text(F.col("name"), one, " ", F.col("second")) for one in (F.col("word"), title)],
        *[_text("https://", F.col("second"), ":", one, "@", F.col("third"), ".example.org/") for one in ("password", "${PASSWORD}", "****", "<password>")],
    ]
    line = F.when(F.col("label") == 1, _pick(secrets, 20)).otherwise(_pick(others, 21))
    lead = _choose(["", "and then ", "erwh thon. ", "| ", "the ", "  "], 31)
    tail = _choose(["", "", " and so on", "\n", " | rest", "\nthe"], 32)
    return made.select(F.concat(lead, line, tail).alias("text"), "label")


def findings_by_rule(spark: SparkSession, rows: int = MAX_FINDINGS) -> DataFrame:
    """``rows`` labelled findings, half of each kind."""
    return labelled_findings(spark, rows // 2).unionByName(assigned_findings(spark, rows - rows // 2))
