"""Secret scan: candidates by pattern, false positives removed by a random forest trained on labelled findings.

Candidates are runs of key characters (CANDIDATE) and the values of names with a word from KEY_WORDS,
of any length and characters (NAMED). Not found: a secret that no such name introduces and that is
shorter than 12 characters, has no digit or is cut by punctuation; the second and later values of a list;
and a value that follows its name without a sign or quote (``Bearer abc``), unless it is a run.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm.common import documents, is_held_out, sha256
from crosstide.session import reliable_checkpoint

#: What may end a sentence, list or call after a value that is not quoted.
_CLOSING = r",;.)\]}>\"'`&"
#: A run of 12 or more key characters, one of them a digit, that no key character precedes; with its padding, not with a sign that a value follows.
CANDIDATE = rf"(?<![\w+/\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{{12,}}(?:={{1,2}}+(?![\"'`]?[^\s{_CLOSING}]))?"
#: Fixed value: words that name a credential beside it.
KEY_WORDS = ["password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "auth", "bearer", "credential"]
_SHORT = ["key", "pwd", "auth"]
_WORD = f"(?:(?i:{'|'.join(w for w in KEY_WORDS if w not in _SHORT)})|(?i:{'|'.join(_SHORT)})(?i:s)?(?![a-z]))"
_SIGN, _SAYS = r"(?::=|=>|={1,3}|:)", r"(?:\s+(?:is|was))?\s+"
#: A name with a word from KEY_WORDS and what leads from it to its value: a sign, or nothing or "is" where the value is quoted.
_NAME = rf"(?=[\w+/\-]++(?:[\"'`]?\s*[=:]|{_SAYS}[\"'`]\S))(?=[\w+/\-]*?{_WORD})[\w+/\-]++"
_LEAD = rf"{_NAME}(?:[\"'`]?\s*{_SIGN}\s*(?:[\[({{]++\s*(?=[\"'`]))?+|{_SAYS}(?=[\"'`]\S))"
_QUOTED = "|".join(rf"(?<={q})(?=[^{q}\n])[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+(?={q})" for q in "\"'`")
_BARE = rf"(?:[^\s{_CLOSING}]++|(?![,;&)\]}}>]++[\"'`]|[,;&][\w\-]++[=:])[{_CLOSING}]++(?![\s{_CLOSING}]|\Z))++"
#: Group 1 leads to a name's value: up to the closing quote, or up to white space less closing marks; not the name of a further value.
NAMED = rf"(?<![\w+/\-])({_LEAD}(?![\s\[({{\"'`]*{_NAME}[\"'`]?\s*[=:][\s\"'`])[\"'`]?+)(?:{_QUOTED}|{_BARE})"
FOUND = f"{NAMED}|{CANDIDATE}"
#: Characters of context kept on each side.
CONTEXT = 64
#: Bounds of the dictionary and of the findings that a forest is fitted on.
MAX_WORDS = 5_000
MAX_FINDINGS = 50_000
MASK = "<SECRET>"
#: Path parts of places where keys are made up, and values that stand for another.
MOCK_PATH = r"(?i)(^|[/._\-])(tests?|examples?|samples?|mocks?|fixtures?|docs?)([/._\-]|$)"
NAME_BEFORE = rf"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:{'|'.join(KEY_WORDS)})s?(?![a-z])[\w+/\-]*(?:\s+(?:is|was))?\W*$"
STAND_IN = r"(?i)^(?:none|null|nil|undefined|true|false|\*+|x{3,}|\.{3,}|<[^<>]*>|\$\w+|\$?\{+[^{}]*\}*|%\w*%|(?:os\.|process\.)?(?:env|getenv|environ)\b.*)$"
FEATURES = [
    "length", "letter_digit", "case_change", "distinct_share", "coverage", "assigned", "quoted", "key_word", "before_known", "after_known",
    "before_bucket", "after_bucket", "mock_path", "path_depth", "path_bucket",
]


def _parts(text: Column) -> tuple[Column, Column]:
    """Candidates of a text in order, and the stretches before, between and after them."""
    found, leads = (F.regexp_extract_all(text, F.lit(FOUND), F.lit(group)) for group in (0, 1))
    gaps = F.zip_with(F.split(text, FOUND, -1), leads, lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))
    return F.zip_with(found, leads, lambda x, lead: F.substring(x, F.length(lead) + 1, F.length(x))), gaps


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate of a whole text: id, th (text hash), ordinal, start, candidate, before, after, path.

    ``before`` and ``after`` are the CONTEXT characters of text on each side, other candidates among them.
    ``start`` counts code points from 0. A null or empty text has none. Rows that repeat an id
    and a text are reported once.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    found, gaps = _parts(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), path.alias("path"), found.alias("found"), gaps.alias("gaps"))
    # No piece is empty but the last, so CONTEXT pieces on a side hold CONTEXT characters.
    piece = lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))
    ends = lambda p: F.struct(F.left(p, F.lit(CONTEXT)).alias("head"), F.right(p, F.lit(CONTEXT)).alias("tail"))
    rows = rows.filter(F.size("found") > 0).withColumn("ends", F.zip_with("gaps", "found", lambda g, x: ends(piece(g, x))))

    def around(x: Column, i: Column) -> Column:
        gap = F.get("gaps", i)
        earlier = F.slice("ends", F.greatest(i - CONTEXT, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT))).getField("tail")
        later = F.slice("ends", i + 2, CONTEXT).getField("head")
        before = F.right(F.concat(F.array_join(earlier, ""), F.right(gap, F.lit(CONTEXT))), F.lit(CONTEXT))
        after = F.left(F.array_join(later, ""), F.lit(CONTEXT))
        return F.struct(x.alias("candidate"), F.length(gap).alias("gap"), before.alias("before"), after.alias("after"))

    rows = rows.select("id", "th", "path", F.posexplode(F.transform("found", around)).alias("ordinal", "c"))
    rows = rows.select("id", "th", "ordinal", "path", "c.*").dropDuplicates(["id", "th", "ordinal"])
    upto = Window.partitionBy("id", "th").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.sum(F.col("gap") + F.length("candidate")).over(upto) - F.length("candidate")
    return rows.withColumn("start", taken.cast("long")).drop("gap")


def common_words(findings: DataFrame, limit: int = MAX_WORDS) -> list[str]:
    """The ``limit`` most frequent words of four letters or more beside candidates; of equal counts the first by name."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"\p{L}{4,}"), F.lit(0))
    counts = findings.select(F.explode(words).alias("w")).groupBy("w").count()
    return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(limit).collect()]


def with_features(findings: DataFrame, dictionary: list[str]) -> DataFrame:
    """Adds the columns of FEATURES: length, character transitions, dictionary coverage, neighbouring words and path."""
    c = F.col("candidate")
    known = F.lit(dictionary) if dictionary else F.array().cast("array<string>")
    runs = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: F.array_contains(known, w))
    covered = F.aggregate(runs, F.lit(0), lambda n, w: n + F.length(w))
    words = findings.withColumns(
        {
            "wb": F.lower(F.regexp_extract("before", r"(\w+)\W*$", 1)),
            "wa": F.lower(F.regexp_extract("after", r"^\W*(\w+)", 1)),
        }
    )
    share = lambda n: n / F.length(c)
    out = words.withColumns(
        {
            "length": F.length(c),
            "letter_digit": share(F.regexp_count(c, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"))),
            "case_change": share(F.regexp_count(c, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"))),
            "distinct_share": share(F.size(F.array_distinct(F.split(c, "")))),
            "coverage": share(covered),
            "assigned": F.col("before").rlike(r"[=:]>?\s*[\[({]*\s*[\"'`]?$"),
            "quoted": F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]"),
            "key_word": F.col("before").rlike(NAME_BEFORE),
            "before_known": F.array_contains(known, F.col("wb")),
            "after_known": F.array_contains(known, F.col("wa")),
            "before_bucket": F.pmod(F.xxhash64("wb"), F.lit(16)),
            "after_bucket": F.pmod(F.xxhash64("wa"), F.lit(16)),
            "mock_path": F.col("path").rlike(MOCK_PATH),
            "path_depth": F.regexp_count("path", F.lit("[/.]")),
            "path_bucket": F.pmod(F.xxhash64("path"), F.lit(16)),
        }
    ).drop("wb", "wa")
    return out.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES})


def label_by_format() -> Column:
    """Labels for findings whose form settles them, null for all others.

    1: a cloud access key id, or a run of CANDIDATE assigned to a name with a word from KEY_WORDS;
    0: digits only, dates, and identifiers of the 8-4-4-4-12 form without such a name, and values such
    as ``None`` or ``${NAME}`` that stand for another. Other values of names are left to the forest.
    """
    c = F.col("candidate")
    named = F.col("before").rlike(rf"{_WORD}[\w+/\-]*[\"'`]?\s*{_SIGN}\s*[\"'`]?$")
    plain = c.rlike(r"^[0-9\-+/]+$") | c.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    secret = c.rlike("^AKIA[0-9A-Z]{16}$") | (named & ~plain & c.rlike(f"^(?:{CANDIDATE})$"))
    return F.when((plain & ~named) | c.rlike(STAND_IN), 0).when(secret, 1)


def fit_forest(labelled: DataFrame, trees: int = 20, depth: int = 5, seed: int = 7, max_findings: int = MAX_FINDINGS) -> RandomForestClassificationModel | None:
    """Forest over FEATURES from rows with a label 0 or 1, the ``max_findings`` with the smallest hash at most.

    None without examples of both labels.
    """
    rows = labelled.filter("label in (0, 1)").orderBy(F.xxhash64("id", "th", "ordinal"), "id", "ordinal").limit(max_findings)
    rows = reliable_checkpoint(rows.select(F.col("label").cast("double"), *FEATURES))
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)


def by_rule() -> Column:
    """Whether a finding is a secret where no forest could be fitted.

    A label decides. Without one, a value beside a key name is a secret if it is assigned or quoted
    and does not consist of dictionary words, and any other candidate if it has 20 characters or
    more, half of them or ten distinct, and letters and digits change at least once in ten.
    """
    named = (F.col("key_word") > 0) & (F.col("assigned") + F.col("quoted") > 0) & (F.col("coverage") < 1)
    distinct = (F.col("distinct_share") >= 0.5) | (F.col("distinct_share") * F.col("length") >= 10)
    mixed = (F.col("length") >= 20) & distinct & (F.col("letter_digit") >= 0.1)
    return F.coalesce(F.col("label") == 1, named | mixed)


def judge(findings: DataFrame, forest: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """Adds score (the forest's share for a secret) and is_secret; without a forest :func:`by_rule` gives a score of 1 or 0."""
    if forest is None:
        out = findings.withColumn("score", by_rule().cast("double"))
        return out.withColumn("is_secret", F.col("score") >= threshold)
    out = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings))
    out = out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return out.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, label: Column | None = None) -> DataFrame:
    """Judged candidates of all documents; the forest learns from those that ``label`` marks outside the held-out fold.

    The fold is crc32(id) mod 4 = 3. Columns as in :func:`find_candidates`, with label, score, is_secret, held_out.
    """
    found = reliable_checkpoint(find_candidates(docs, id_col, text_col, path_col))
    found = with_features(found, common_words(found)).withColumns(
        {"label": label_by_format() if label is None else label, "held_out": is_held_out("id", 4, 3)}
    )
    forest = fit_forest(found.filter("not held_out"))
    return judge(found, forest).drop(*FEATURES)


def redact(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input columns as struct ``row`` and clean_text, in which each secret of ``judged`` is MASK.

    Texts without a secret stay as they are, null included; rows without an id are masked like all others.
    """
    hits = judged.filter("is_secret").groupBy(F.col("id").alias("hit_id"), F.col("th").alias("hit_th")).agg(F.collect_set("ordinal").alias("hits"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    text = F.col("row").getField(text_col)
    found, gaps = _parts(text)
    said = F.transform(found, lambda x, i: F.when(F.array_contains("hits", i), F.lit(MASK)).otherwise(x))
    clean = F.array_join(F.zip_with(gaps, said, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th"))
    return rows.join(hits, same, "left").select("row", F.when(F.col("hits").isNull(), text).otherwise(clean).alias("clean_text"))


def op5_secret_scan(spark, sf_dir) -> DataFrame:
    judged = scan(documents(spark, sf_dir), path_col="source")
    return judged.select(
        F.col("id").alias("doc_id"), "ordinal", "start", F.length("candidate").cast("long").alias("length"),
        sha256(F.col("candidate")).alias("candidate_sha256"), "label", "score", "is_secret", "held_out",
    )
