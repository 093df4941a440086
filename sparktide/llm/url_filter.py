"""URL filter: a weighted vocabulary counted by Aho-Corasick with boundary checks, under site rules that come first."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, sliced

#: Terms by what they weigh. A term of weight 1 is strict and rejects alone; soft terms count once each and reject together from LIMIT on: two strong ones, three weak ones, or a strong one with two weak ones.
TERMS = {
    1.0: "bitcoin-doubler camgirl camgirls casino casinos-online counterfeit darknet escort escorts fakeid fentanyl fetish gambling-online hentai hookup keylogger livecams malware milf nudes onlyfans phishing porn porno pornhub ransomware replica-watches sexcams stripper viagra cialis warez xxx xvideos",
    0.5: "ads adult bet bets betting bingo bonus cheap crack cracked free gamble hack hacks jackpot keygen loan loans lottery lotto naked nude payday pharmacy pills poker promo roulette serial sex sexy slots steroids torrent torrents track tracker tracking vape win winner",
    0.34: "ad aff affiliate click coupon coupons deal deals discount download earn instant money offer offers popup prize rich sale sponsor trial",
}
#: Sum of the weights of distinct terms from which on a URL is rejected.
LIMIT = 1.0
#: The rules of the contract; a rule is a host, with all its subdomains, and the beginning of a path.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    tests = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        of, begin = rule.split("/", 1)
        tests.append(F.when(((host == of) | host.endswith("." + of)) & path.startswith("/" + begin), F.lit(rule)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def default_vocabulary() -> dict[str, float]:
    """TERMS as term and weight."""
    return {term: weight for weight, terms in TERMS.items() for term in terms.split()}


@lru_cache(maxsize=8)
def _automaton(vocabulary: tuple[tuple[str, float], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in vocabulary:
        a.add_word(term, (term, weight))
    a.make_automaton()
    return a


_ALONE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _bound(text: str, begin: int, end: int) -> bool:
    """Whether a term stands alone: no ASCII letter or digit on either side."""
    return not (begin and text[begin - 1] in _ALONE) and not (end < len(text) and text[end] in _ALONE)


def count_terms(url: str, vocabulary: tuple[tuple[str, float], ...]) -> tuple[int, int, float]:
    """Distinct strict and soft terms of a URL, A-Z in lower case, that stand between boundaries, and what they weigh together."""
    found: dict[str, float] = {}
    if vocabulary:
        for end, (term, weight) in _automaton(vocabulary).iter(url):
            if term not in found and _bound(url, end + 1 - len(term), end + 1):
                found[term] = weight
    strict = sum(w >= 1 for w in found.values())
    return strict, len(found) - strict, float(round(sum(found.values()), 6))


def _terms_of(vocabulary: DataFrame | None) -> tuple[tuple[str, float], ...]:
    """A vocabulary table ``(term, weight)``, in lower case; null or empty terms and null weights don't count, the greatest weight of a term does."""
    if vocabulary is None:
        held = default_vocabulary()
    else:  # a vocabulary is a configuration table: the automaton goes to every task
        rows = vocabulary.select(F.lower("term").alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> '' and weight is not null").groupBy("term").agg(F.max("weight").alias("weight")).collect()
        held = {r["term"]: r["weight"] for r in rows}
    return tuple(sorted(held.items()))


def judge_urls(pages: DataFrame, *, url_col: str = "url", vocabulary: DataFrame | None = None, limit: float = LIMIT, rules: dict[str, str] = RULES) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, n_strict, n_soft, weight and verdict (allow or block: the longest rule's, else the vocabulary's).

    ``vocabulary`` is a table ``(term, weight)``; without it TERMS holds. A URL is rejected by one strict term (weight 1 and
    more) or by distinct soft ones that weigh ``limit`` together (a tie with it rejects).

    Null URLs and URLs without ``://``: host and path are empty, no rule fits, the terms of the whole string count. URLs of any
    length are searched whole. Copies are judged alike, an empty table gives an empty one. Columns of ``pages`` of the same
    names are replaced. Only the columns that are kept are read; there is no shuffle.
    """
    made = ["host", "path", "rule", "n_strict", "n_soft", "weight", "verdict"]
    terms = _terms_of(vocabulary)
    kept = pages.select(*(column(pages, c) for c in pages.columns if c == url_col or c not in made), F.translate(column(pages, url_col), _UPPER, _LOWER).alias("__low"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("n_strict", T.LongType()), T.StructField("n_soft", T.LongType()), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__low"):
            counts = [count_terms(u or "", terms) for u in batch.column(batch.num_columns - 1).to_pylist()]
            more = [pa.array([c[k] for c in counts], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "n_strict", "n_soft", "weight"])

    out = kept.mapInArrow(run, schema)
    url = column(out, url_col)
    out = out.withColumns({"host": host_of(url), "path": path_of(url)})
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    given = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items())) if rules else F.lit(None)
    own = F.when((F.col("n_strict") >= 1) | (F.col("weight") >= limit), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(given, own))
