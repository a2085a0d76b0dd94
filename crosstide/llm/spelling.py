"""Spelling variants: near words by asymmetric q-chunks, each led to the frequent form it is an edit of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import ascii_lower, documents
from crosstide.session import reliable_checkpoint

#: Fixed value: the letters that the contract names.
LETTER = r"[A-Za-zÀ-ÿ]"
MIN_CHARS = 6
MIN_COUNT = 5
#: A form is so many times as frequent as its variant at least.
RATIO = 5
#: A run loses a letter where its hash is divisible by this.
NOISE = 199


def noisy_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, noise: int | None = NOISE) -> DataFrame:
    """One row per maximal letter run of ``min_chars`` code points or more, A-Z lower-cased: word.

    With ``noise``, a run loses the code point h % length where it divides h, the crc32 of
    ``<id>:<run>``; what is then shorter than ``min_chars`` goes. Null text has no runs, a null id
    counts as an empty one; rows that repeat count each.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"{LETTER}{{{min_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if noise is None:
        return rows.select(F.col("run").alias("word"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, less).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.length("word") >= min_chars)


def word_counts(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Distinct words that occur ``min_count`` times or more: word, n. Counts are pre-aggregated before they are shuffled."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _one_edit(short: Column, long: Column) -> Column:
    """Whether one inserted or replaced code point makes ``long`` of ``short``."""
    return F.levenshtein(short, long, 1) == 1


def near_words(counts: DataFrame) -> DataFrame:
    """All unordered pairs of words that differ by one code point: x, nx, y, ny.

    Of two words, the shorter one, or of equally long ones the first in code-point order, contributes
    two disjoint chunks of half its length, at its start and at its end; the other one contributes all
    its positional grams of that length. One edit touches one of the chunks at most, so the other is a
    gram of the longer word: the first chunk at its own position, the second one shifted by the
    difference in length, which is none or one. Candidates meet on gram, position and both lengths and are
    verified inside the join, so only pairs leave it; a pair that both chunks find is taken from the first.

    Words have two code points at least and are distinct. Without words there are no pairs.
    """
    n = F.length("word")
    half = F.floor(n / 2).cast("int")
    chunk = lambda first, at, text, shift: F.struct(F.lit(first).alias("first"), at.alias("pos"), text.alias("gram"), (n + shift).alias("ylen"))
    chunks = counts.select(
        F.col("word").alias("x"), F.col("n").alias("nx"), n.alias("xlen"), half.alias("q"),
        F.explode(
            F.array(
                *[chunk(True, F.lit(0), F.left("word", half), s) for s in (0, 1)],
                *[chunk(False, n - half + s, F.right("word", half), s) for s in (0, 1)],
            )
        ).alias("c"),
    ).select("x", "nx", "xlen", "q", "c.*")

    def grams(of: Column) -> Column:
        """All grams as long as the chunks of words of length ``of``."""
        q = F.floor(of / 2).cast("int")
        return F.transform(F.sequence(F.lit(0), n - q), lambda i: F.struct(of.alias("xlen"), i.alias("pos"), F.substring("word", i + 1, q).alias("gram")))

    found = counts.select(F.col("word").alias("y"), F.col("n").alias("ny"), n.alias("ylen"), F.explode(F.concat(grams(n), grams(n - 1))).alias("g"))
    found = found.select("y", "ny", "ylen", "g.*")
    again = F.left("x", F.col("q")) == F.left("y", F.col("q"))
    c, g = chunks.alias("c"), found.alias("g")
    same = (F.col("c.gram") == F.col("g.gram")) & (F.col("c.pos") == F.col("g.pos")) & (F.col("c.xlen") == F.col("g.xlen")) & (F.col("c.ylen") == F.col("g.ylen"))
    ordered = (F.col("c.xlen") < F.col("c.ylen")) | (F.col("x") < F.col("y"))
    # the half that holds the edit still shares its outermost letter, unless that letter is the edit
    outer = F.when(
        F.col("first"),
        (F.right("x", F.lit(1)) == F.right("y", F.lit(1))) | (F.left("x", F.col("c.xlen") - 1) == F.left("y", F.col("c.xlen") - 1)),
    ).otherwise((F.left("x", F.lit(1)) == F.left("y", F.lit(1))) | (F.right("x", F.col("c.xlen") - 1) == F.right("y", F.col("c.xlen") - 1)))
    return c.join(g, same & ordered & (F.col("first") | ~again) & outer & _one_edit(F.col("x"), F.col("y"))).select("x", "nx", "y", "ny")


def follow_forms(forms: DataFrame) -> DataFrame:
    """Where the forms of each word end: word, root, for rows (word, form) without a circle.

    Each round doubles how far a word has followed; words that have arrived leave the rounds, so
    there are as many rounds as the logarithm of the longest chain.
    """
    going = reliable_checkpoint(forms.select("word", F.col("form").alias("root")))
    arrived = going.limit(0)
    while not going.isEmpty():
        # a word that has arrived answers with its end, one on its way with where it has come to
        steps = arrived.unionByName(going).select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = reliable_checkpoint(going.join(steps, F.col("root") == F.col("via"), "left").select("word", "root", "next"))
        arrived = reliable_checkpoint(arrived.unionByName(moved.filter("next is null").select("word", "root")))
        going = moved.filter("next is not null").select("word", F.col("next").alias("root"))
    return arrived


def spelling_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word of ``counts`` (word, n) with its form and root: word, n, n_near, form, form_n, root.

    ``n_near`` counts the words one edit away. The form is the most frequent of these (of equal
    counts the first in code-point order), if it is ``ratio`` times as frequent as the word or more;
    the root is where the forms of forms end, the word itself without a form. Forms get more frequent
    at each step, so there is no circle. An empty table returns no rows.
    """
    counts = reliable_checkpoint(counts)
    pairs = reliable_checkpoint(near_words(counts))
    either = pairs.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("ny").alias("m")).unionByName(
        pairs.select(F.col("y").alias("word"), F.col("x").alias("near"), F.col("nx").alias("m"))
    )
    best = either.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    leads = -F.col("best.less") >= ratio * F.col("n")
    judged = counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")
    )
    judged = reliable_checkpoint(judged)
    roots = follow_forms(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    """Words of all documents with their forms; see :func:`noisy_runs` and :func:`spelling_variants` for the edge cases."""
    return spelling_variants(word_counts(noisy_runs(documents(spark, sf_dir))))
