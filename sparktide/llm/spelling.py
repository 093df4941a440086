"""Spelling variants: words of one edit, found by PartEnum signatures of their letter multisets, and the forms that frequent words give to rare ones."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of these; its least code points and occurrences; how many times as frequent a form is; one run in so many loses a letter.
RUN, LEAST_LETTERS, LEAST_COUNT, TIMES, LOSES_ONE_IN = "[A-Za-zÀ-ÿ]+", 6, 5, 5, 199
#: Parts into which the dimensions of the letter vectors fall.
PARTS = 8


def _low(text: Column) -> Column:
    """A-Z lower-cased and no other letter; ASCII texts by the fast function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, one_in: int | None = LOSES_ONE_IN) -> DataFrame:
    """``(word, n)`` of the words of all texts with at least so many code points and occurrences.

    A word is a maximal run of Latin letters, A-Z lower-cased. ``one_in``: the runs whose CRC of ``<id>:<run>`` it divides lose
    one code point, at the CRC modulo their length; None leaves all as they are. A null id counts as an empty one.
    """
    run = F.explode(F.regexp_extract_all(_low(column(docs, text_col)), F.lit(RUN), F.lit(0)))
    words = docs.select(F.coalesce(column(docs, id_col).cast("string"), F.lit("")).alias("id"), run.alias("word")).where(F.length("word") >= least_letters)
    if one_in:
        words = words.select("word", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        words = words.select(F.when(F.col("h") % one_in == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")).alias("word"))
        words = words.where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _part_sums(word: Column, parts: int) -> Column:
    """A hash of each part's share of the word's letter multiset. The multiset is a binary vector with a dimension for each k-th occurrence of a letter; hashes of the dimensions that a word has are added up by part."""
    letters = F.sort_array(F.split(word, ""))
    dims = F.transform(letters, lambda c, i: F.xxhash64(c, (i - F.array_position(letters, c)).cast("int")))
    zero = F.lit(0).cast("long")

    def share(p: int) -> Column:
        return F.aggregate(dims, zero, lambda s, d: s + F.when(F.pmod(d, F.lit(parts)) == p, F.shiftright(d, 8)).otherwise(zero))

    return F.array(*map(share, range(parts)))


def _signatures(words: DataFrame, parts: int) -> DataFrame:
    """Each word of ``(word, n, s)``, where ``s`` are its parts' hashes, with its signatures ``(kind, length, p, q, rest)``.

    Words of one length that differ by a replaced letter have vectors of Hamming distance two, so the letters outside some two
    parts ``p < q`` are the same: a signature for each two parts. Words whose lengths differ by one have distance one: a
    signature for each part, once as the shorter word and once as the longer one.
    """
    sums = words.select("word", "n", "s", F.length("word").alias("size"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("whole"))
    sig = lambda kind, length, p, q: F.struct(F.lit(kind).alias("kind"), length.cast("int").alias("length"), F.lit(p).alias("p"), F.lit(q).alias("q"), (F.col("whole") - F.col("s")[p] - (F.col("s")[q] if q != p else 0)).alias("rest"), F.col("s")[p].alias("sp"), F.col("s")[q].alias("sq"))
    same = [sig("same", F.col("size"), p, q) for p, q in combinations(range(parts), 2)]
    other = [sig(kind, F.col("size") - int(kind == "longer"), p, p) for p in range(parts) for kind in ("shorter", "longer")]
    return sums.select("word", "n", F.explode(F.array(*same, *other)).alias("x")).select("word", "n", "x.*")


def near_pairs(words: DataFrame, *, parts: int = PARTS) -> DataFrame:
    """``(word, n, near, near_n)`` from ``words (word, n, s)``: all pairs of distinct words that differ by exactly one inserted, deleted or replaced code point, in both directions.

    Signatures are joined by equality and verified by edit distance; a pair is taken at one signature only: where both parts
    left out differ, or, where a single part differs, at that part and the next one. Words with the same letters never
    differ by one edit, so groups of anagrams make no candidates. Spark sizes the signatures as it does the words' file,
    though they are 44 a word, and would broadcast them; the joins are merged at any size.
    """
    signed = _signatures(words, parts)
    key = ["length", "p", "q", "rest"]
    left = lambda kind: signed.where(F.col("kind") == kind).select(F.col("word").alias("a"), F.col("n").alias("an"), *key, F.col("sp").alias("ap"), F.col("sq").alias("aq"))
    right = lambda kind: signed.where(F.col("kind") == kind).select(F.col("word").alias("b"), F.col("n").alias("bn"), *key, F.col("sp").alias("bp"), F.col("sq").alias("bq"))
    p, q = F.col("ap") != F.col("bp"), F.col("aq") != F.col("bq")
    once = (p & q) | (p & (F.col("q") == F.col("p") + 1)) | (q & (F.col("p") == 0) & (F.col("q") == parts - 1))
    equal = left("same").join(right("same").hint("merge"), key).where((F.col("a") < F.col("b")) & once)
    unequal = left("shorter").join(right("longer").hint("merge"), key)
    found = equal.select("a", "an", "b", "bn").unionByName(unequal.select("a", "an", "b", "bn")).where(F.levenshtein("a", "b", 1) == 1)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n"))))
    return found.select(both.alias("r")).select("r.*")


def variants(words: DataFrame, *, parts: int = PARTS, times: int = TIMES) -> DataFrame:
    """For each row of ``words (word, n)``: ``form`` (the near word of largest n, ties to the first in code-point order, if that n is ``times`` the word's n at least), ``root`` (the last of the forms that follow from it), ``n``, ``n_near`` and ``form_n``.

    ``words`` has distinct words. Words without a near one have n_near 0, no form, and themselves as root. Forms are followed
    by joins that double their reach; since each form is ``times`` as frequent, a few rounds do, each written to the shared
    folder. Rows of these tables are many times as large in memory as in their files, so that no join broadcasts them. Empty table: no rows. Other columns of ``words`` are left out.
    """
    words = stored(words.select("word", "n", _part_sums(F.col("word"), parts).alias("s")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(words, parts=parts).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"), best.alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    near = stored(near.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "near-words")
    roots = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = roots.select(F.col("word").alias("__of"), F.col("root").alias("__next"))
        longer = roots.join(after.hint("merge"), F.col("root") == F.col("__of"), "left")
        roots = stored(longer.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    out = words.join(near.hint("merge"), "word", "left").join(roots.select("word", "root").hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, one_in: int | None = LOSES_ONE_IN) -> DataFrame:
    """The words of all texts with their forms and roots; see ``word_counts`` and ``variants``.

    Null and empty texts have no words. Repeated rows count as often as they stand there. A very long run of letters is a word
    like any other. Empty table: no rows. Columns of ``docs`` other than the id and the text play no part, whatever their names.
    """
    return variants(word_counts(docs, id_col=id_col, text_col=text_col, one_in=one_in), parts=parts)
