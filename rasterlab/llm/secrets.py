"""Secret scan: candidate strings, judged by a random forest; DataFrame functions and Spark ML only."""

from __future__ import annotations

from collections import Counter

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from rasterlab.llm.shared import materialise

# Fixed values. Words before a value that speak for a secret, and words near it that speak against one.
FOR = "token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credential"
AGAINST = "example|sample|dummy|placeholder|changeme|commit|checksum|digest|sha(?:1|256)?|md5|uuid|isbn|order|invoice|phone|card|version"
PATHS_AGAINST = "test|example|sample|fixture|mock|doc|readme|vendor|node_modules"
#: Words of a dictionary at most, and letter pairs of it; both come from the corpus.
DICTIONARY_WORDS, PAIRS = 8000, 200
#: Values of at least 6 characters assigned to a word that speaks for a secret, and strings of at least 16 with a digit.
#: A candidate is the end of a match, behind the word and sign that PREFIX finds. No lookbehind is longer than one
#: character, so a text is searched in time proportional to its length.
#: The name of a scheme behind the sign belongs to the prefix. Long parts joined by dots are one candidate.
PREFIX = rf"(?i:{FOR})[\"']?\s{{0,3}}[:=]{{1,2}}\s{{0,3}}[\"']?(?:(?i:bearer|basic)\s{{1,3}})?(?!(?i:bearer|basic)\s)"
CANDIDATE = rf"{PREFIX}[^\s\"',;<>]{{6,}}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{{16}})(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{16,}}(?:\.[A-Za-z0-9+/_-]{{16,}}){{0,8}}={{0,2}}"
#: Characters of context on each side; labelled findings that are learnt from; findings that are planted.
CONTEXT, TRAIN_ROWS, PLANTED_ROWS = 60, 20_000, 6_000
FEATURES = ("length", "digits", "upper", "lower", "others", "turns", "cases", "distinct", "vowels", "hexadecimal", "pairs", "words", "path", "before_for", "assigned", "quoted", "near_against", "near_words")
#: Matches whose lengths are summed as one, so that the places of m matches take about m * (BLOCK + m / BLOCK**2) steps.
BLOCK = 128


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``(doc_id, start, candidate, before, after, path)``: every match of CANDIDATE in the whole text, in code points.

    What lies between the matches gives their places and their contexts; only the candidates with their short contexts
    become rows. Null and empty texts have none. A null path is empty. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), (F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")).alias("path"))
    base = base.where(F.col("text").rlike(CANDIDATE))
    base = base.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("between"))
    total = lambda array: f"aggregate({array}, 0L, (s, v) -> s + v)"
    start = f"offs[i div {BLOCK}] + {total(f'slice(sizes, i - i % {BLOCK} + 1, i % {BLOCK})')} + length(between[i])"
    spot = f"named_struct('start', {start}, 'match', m, 'before', right(between[i], {CONTEXT}), 'after', left(between[i + 1], {CONTEXT}))"
    spots = _let("offs", f"transform(blocks, (b, j) -> {total('slice(blocks, 1, j)')})", f"transform(found, (m, i) -> {spot})")
    spots = _let("blocks", f"transform(sequence(0, (size(sizes) - 1) div {BLOCK}), j -> {total(f'slice(sizes, j * {BLOCK} + 1, {BLOCK})')})", spots)
    spots = _let("sizes", "transform(found, (m, i) -> cast(length(between[i]) + length(m) AS bigint))", spots)
    # outer, though no list is empty: else Spark filters by the list's size below the projections, and computes all again
    one = base.select("doc_id", "path", F.expr(spots).alias("spots")).select("doc_id", "path", F.explode_outer("spots").alias("x")).select("doc_id", "path", "x.*")
    one = one.withColumn("prefix", F.regexp_extract("match", rf"^{PREFIX}(?=[^\s\"',;<>]{{6,}}$)", 0))
    before = F.right(F.concat("before", "prefix"), F.lit(CONTEXT)).alias("before")
    return one.select("doc_id", (F.col("start") + F.length("prefix")).alias("start"), F.expr("substring(match, length(prefix) + 1)").alias("candidate"), before, "after", "path")


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> list[str]:
    """The words of 3 to 20 letters that most documents hold, ``words`` at most, from the whole corpus.

    Each document counts a word once, and words of a single document are none of the language. Counts are compared by
    steps of a hundredth: those above the step that would exceed ``words`` are taken, so that only a histogram of steps
    and the words themselves reach the driver.
    """
    each = F.array_distinct(F.split(F.lower(F.col(f"`{text_col}`").cast("string")), r"[^\p{L}]+"))
    counts = docs.select(F.explode_outer(F.filter(each, lambda w: F.length(w).between(3, 20))).alias("word")).where("word is not null").groupBy("word").count()
    counts = materialise(counts.where("count > 1").withColumn("step", F.floor(F.log2("count") * 64).cast("int")))
    least, total = None, 0
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r.n
        if total > words:
            break
        least = r.step
    return [] if least is None else sorted(r.word for r in counts.where(F.col("step") >= least).select("word").collect())


def _known(words: list[str]) -> str:
    """SQL: whether ``w`` is in the sorted list of ``words``, by halving."""
    steps = ", ".join(str(1 << i) for i in reversed(range(len(words).bit_length())))
    place = f"aggregate(array({steps}), 0, (p, s) -> if(p + s <= size(list) AND list[p + s - 1] <= w, p + s, p))"
    return f"coalesce(get(list, {place} - 1) = w, false)"


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """The numbers of FEATURES that the forest judges by; ``words`` is the corpus's dictionary.

    ``words`` is the share of the candidate that consists of dictionary words, ``pairs`` the share of its neighbouring
    characters that are frequent letter pairs of these, ``turns`` and ``cases`` its changes between kinds of characters.
    """
    words = sorted(w for w in words if w.isascii() and w.isalpha())
    pairs = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    common = [p for p, _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:PAIRS]] or ["th"]
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    near = F.concat_ws(" ", "before", "after")
    inside = "transform(regexp_extract_all(candidate, '[A-Z]?[a-z]+|[A-Z]+', 0), x -> lower(x))"
    covered = f"aggregate({inside}, 0L, (t, w) -> t + if({_known(words)}, length(w), 0))"
    covered = F.expr(_let("list", f"split('{' '.join(words)}', ' ')", covered)) if words else F.lit(0)
    values = {
        "length": F.length(c).cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "others": share("[^A-Za-z0-9]"),
        "turns": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "cases": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "vowels": share("(?i)[aeiouy]"),
        "hexadecimal": share("(?i)[0-9a-f]"),
        "pairs": share(f"(?i)(?={'|'.join(common)})"),
        "words": covered / n,
        "path": F.lower("path").rlike(PATHS_AGAINST).cast("double"),
        "before_for": F.col("before").rlike(rf"(?i)(?:{FOR})[^\n]{{0,20}}$").cast("double"),
        "assigned": F.col("before").rlike(r"[:=]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "near_against": near.rlike(rf"(?i)\b(?:{AGAINST})\b").cast("double"),
        "near_words": F.size(F.split(F.trim(near), r"\s+")).cast("double"),
    }
    return found.withColumns({f"f_{k}": F.coalesce(values[k].cast("double"), F.lit(0.0)) for k in FEATURES})


# Fixed values. What is planted for learning: label, text before the value, the value, text after it. ``hex``, ``mixed``,
# ``digits`` and ``word`` are drawn for each finding: 64 hexadecimal signs, 43 letters and digits, 19 digits, a word of
# the corpus.
_PLANTED = (
    (1, "token = \"", "substring(hex, 1, 40)", "\""),
    (1, "api_key: ", "substring(mixed, 1, 32)", ""),
    (1, "secret=", "substring(hex, 1, 32)", ""),
    (1, "password = '", "concat(substring(mixed, 1, 5), '!', substring(mixed, 6, 4), '9')", "'"),
    (1, "\"access_key\": \"", "concat('AKIA', upper(substring(mixed, 1, 16)))", "\""),
    (1, "", "concat('ghp_', substring(mixed, 1, 36))", ""),
    (1, "", "concat('xoxb-', substring(digits, 1, 12), '-', substring(mixed, 1, 24))", ""),
    (1, "Authorization: Bearer ", "concat('eyJ', mixed, '_', substring(mixed, 3, 30))", ""),
    (1, "private_key=", "concat(mixed, substring(mixed, 1, 20), '1')", ""),
    (1, "pwd: ", "substring(mixed, 2, 12)", ""),
    (1, "STRIPE_KEY=", "concat('sk_live_', substring(mixed, 1, 24))", ""),
    (1, "GITHUB=", "concat('ghp_', substring(mixed, 1, 36))", ""),
    (1, "/get?sig=", "substring(mixed, 1, 43)", ""),
    (1, "Bearer ", "concat('eyJhbGciOiJIUzI1NiJ9.eyJ', substring(mixed, 1, 30), '.', mixed)", ""),
    (1, "password: ", "concat(word, word2, word3)", ""),
    (1, "passwd=", "concat(word, word2, word3, word)", ""),
    (0, "", "substring(digits, 1, 16)", ""),
    (0, "order ", "substring(digits, 1, 18)", ""),
    (0, "card: ", "substring(digits, 1, 16)", ""),
    (0, "sha256 checksum ", "hex", ""),
    (0, "commit ", "substring(hex, 1, 40)", ""),
    (0, "id=", "concat(substring(hex, 1, 8), '-', substring(hex, 9, 4), '-4', substring(hex, 13, 3), '-a', substring(hex, 16, 3), '-', substring(hex, 19, 12))", ""),
    (0, "password: ", "concat(word, ' ', word2)", ""),
    (0, "password for the ", "concat(word, '_', word2, '_', substring(digits, 1, 6))", ""),
    (0, "/view?page=", "concat(word, '-', word2, '-', word3, '-', substring(digits, 1, 4))", ""),
    (0, "etag=", "substring(hex, 1, 32)", ""),
    (0, "uuid=", "concat(substring(hex, 1, 8), '-', substring(hex, 9, 4), '-4', substring(hex, 13, 3), '-a', substring(hex, 16, 3), '-', substring(hex, 19, 12))", ""),
    (0, "token = \"", "concat('your_', word, '_here')", "\""),
    (0, "secret: ", "'changeme_example'", ""),
    (0, "", "concat(word, '_', word2, '_', substring(digits, 1, 4), '_', word3)", ""),
    (0, "see /", "concat(word, '/', word2, '/', substring(digits, 1, 6), '-', word3)", ""),
    (0, "api_key=", "repeat(substring(hex, 1, 1), 24)", ""),
)


def planted_findings(docs: DataFrame, text_col: str = "text", path_col: str | None = None, rows: int = PLANTED_ROWS) -> DataFrame:
    """``(candidate, before, after, path, label, template)``: findings planted into passages of the corpus, secrets and look-alikes.

    Passages come from ``rows`` different texts at most, drawn by hash; each gets one generated value with the words
    that go with it, and one in eight a path of tests, in which even a secret's form is none (label 0). Candidates are
    then found in these passages as in any text. Everything follows from the texts, so a repeated run plants the same.
    """
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), (F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")).alias("path"))
    n = texts.count()
    texts = texts.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(max(n, rows))) < rows)
    cut = texts.select("h", "path", F.expr(f"substring(text, int(pmod(h div 7, greatest(length(text), 1))) + 1, {2 * CONTEXT})").alias("around"))
    cut = materialise(cut.groupBy("h").agg(F.min("around").alias("around"), F.min("path").alias("path")).orderBy("h").limit(rows))
    word = lambda i: f"coalesce(get(filter(split(around, '[^A-Za-z]+'), w -> length(w) >= 4), {i}), 'sample')"
    drawn = cut.selectExpr("h", "around", "path", "sha2(cast(h AS string), 256) AS hex", "translate(base64(unhex(sha2(concat(h, 'm'), 256))), '+/=', 'kQ') AS mixed",
        "translate(rpad(concat(abs(xxhash64(h, 1)), abs(xxhash64(h, 2))), 19, '7'), '-', '3') AS digits", f"{word(0)} AS word", f"{word(1)} AS word2", f"{word(2)} AS word3")
    kind = f"pmod(xxhash64(h, 3), {len(_PLANTED)})"
    pick = lambda j: "CASE kind " + " ".join(f"WHEN {i} THEN {x[j] if j in (0, 2) else quoted(x[j])}" for i, x in enumerate(_PLANTED)) + " END"
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
    made = drawn.withColumn("kind", F.expr(kind)).select("h", "around", "path", "kind", F.expr(pick(0)).alias("label"), F.expr(pick(1)).alias("left"), F.expr(pick(2)).alias("value"), F.expr(pick(3)).alias("right"))
    tests = F.expr("pmod(xxhash64(h, 4), 8) = 0")
    made = made.withColumn("path", F.when(tests, F.concat(F.lit("tests/fixtures/"), "path")).otherwise(F.col("path"))).withColumn("label", F.when(tests, 0).otherwise(F.col("label")))
    half = f"int(length(around) / 2)"
    text = F.expr(f"concat(left(around, {half}), ' ', left, value, right, ' ', substring(around, {half} + 1))")
    found = candidates(made.select("h", text.alias("text"), "path"), "h", "text", "path")
    labels = made.select(F.col("h").alias("doc_id"), "value", "label", F.col("kind").cast("int").alias("template"))
    return found.join(labels, "doc_id").where("contains(candidate, value) or contains(value, candidate)").select("candidate", "before", "after", "path", "label", "template")


def train(findings: DataFrame, words: list[str], rows: int = TRAIN_ROWS, trees: int = 30, depth: int = 8):
    """A forest from ``(candidate, before, after, path, label)``; None unless both labels occur.

    At most about ``rows`` findings are taken, by the hash of candidate and context, each distinct one once. Rows with
    a null label or candidate are left out; where equal findings differ in label, secret wins.
    """
    use = findings.where("label is not null and candidate is not null").groupBy("candidate", "before", "after", "path").agg(F.max("label").cast("double").alias("label"))
    use = use.withColumn("h", F.xxhash64("candidate", "before", "after", "path"))
    n, positives = use.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < positives < n:
        return None
    use = use.where(F.pmod("h", F.lit(max(n, rows))) < rows)
    examples = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(with_features(use, words)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(materialise(examples))


def score(found: DataFrame, forest, words: list[str], threshold: float = 0.5) -> DataFrame:
    """``found`` with ``score`` (0 to 1) and ``is_secret``. Without a forest nothing is known: every score is 0.5."""
    if forest is None:
        out = found.withColumn("score", F.lit(0.5))
    else:
        rows = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(with_features(found, words))
        out = forest.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*found.columns, "score")
    return out.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``(doc_id, start, candidate, before, after, path, score, is_secret)`` for every candidate of every text.

    ``findings`` are labelled findings (see ``train``); without them, the forest learns from ``planted_findings``. A
    text of any length takes time in proportion to it. Null and empty texts give no rows, repeated rows repeated
    findings; columns other than the three named ones are ignored, whatever their names.
    """
    found = materialise(candidates(docs, id_col, text_col, path_col))
    words = dictionary(docs, text_col)
    return score(found, train(findings if findings is not None else planted_findings(docs, text_col, path_col), words), words)


def hidden(column: str) -> Column:
    """A digest to show in place of a secret."""
    return F.sha2(F.col(column), 256)
