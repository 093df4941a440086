"""Column-returning rules: null stays null, and Catalyst sees through all of them."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest share of a window's length that any tolerance may ask for.
LEAST_COVERAGE = 0.75


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Bounds of a value; greatest and least alone would turn null into a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def half_even(x: Column, digits: int) -> Column:
    """``x`` to so many digits, halves to the even one, where a half is what the scaled double says: the decimal text of a double (``bround``) sees its last bits, so that 26.450000000000003, a half but for the order of its terms, would go up."""
    scale = F.lit(float(10**digits))
    return F.rint(x.cast("double") * scale) / scale


def pct_distance(value: Column, anchor: Column) -> Column:
    """Percentage by which a value lies over its anchor; null without either or for an anchor of 0."""
    return (value - anchor) / F.nullif(anchor, F.lit(0.0)) * 100


def required_rows(n: int, coverage: float = 1.0) -> int:
    """Rows that a window of ``n`` must hold for its statistic to count."""
    return max(2, round(n * max(LEAST_COVERAGE, min(1.0, coverage))))


def interpolate(x: Column, bands: tuple[tuple[float, float], ...]) -> Column:
    """Piecewise linear between the bands' points, constant beyond them."""
    out = F.when(x.isNull(), None).when(x <= bands[0][0], F.lit(bands[0][1]))
    for (x0, y0), (x1, y1) in zip(bands, bands[1:]):
        out = out.when(x <= x1, F.lit(y0) + F.lit(y1 - y0) * ((x - x0) / F.lit(x1 - x0)))
    return out.otherwise(F.lit(bands[-1][1]))


def present_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't null; null if none is. Weights are added as decimals: 0.35, 0.30 and 0.15 make 0.8, of which doubles fall short."""
    exact = lambda w: F.lit(Decimal(str(w)))
    weight = sum((F.when(v.isNotNull(), exact(w)).otherwise(exact(0.0)) for v, w in parts), exact(0.0)).cast("double")
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0))
    return total / F.nullif(weight, F.lit(0.0))


def coverage_of(components: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of the weights of the components that are present and weighted."""
    return sum((F.when(components[k].isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for k, w in weights.items() if k in components), F.lit(0.0))


def covered_score(components: dict[str, Column], weights: dict[str, float], penalty: Column | None = None, digits: int | None = 1) -> tuple[Column, Column]:
    """Score (one digit) and coverage (two): the weighted mean of what is present, shrunk toward 50 below a coverage of 0.8."""
    coverage = coverage_of(components, weights)
    mean = present_mean([(components[k], w) for k, w in weights.items() if k in components])
    score = F.coalesce(F.lit(50.0) + (mean - 50) * F.least(F.lit(1.0), coverage / 0.8), F.lit(50.0))
    score = clamp(score - (penalty if penalty is not None else F.lit(0.0)))
    return score if digits is None else half_even(score, digits), half_even(coverage, 2)


def lean(components: dict[str, Column], weights: dict[str, float]) -> Column:
    """An analyst's lean: as a score, with coverage measured against the sum of the weights; 50 if nothing is known."""
    total = sum(weights.values())
    mean = present_mean([(components[k], w) for k, w in weights.items() if k in components])
    coverage = coverage_of(components, weights) / F.lit(total)
    return half_even(clamp(F.coalesce(F.lit(50.0) + (mean - 50) * F.least(F.lit(1.0), coverage / 0.8), F.lit(50.0))), 1)


#: Letters that folding replaces, and what they become.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"


def normalize_text(s: Column) -> Column:
    """White space of any kind as single blanks, none at the ends; null as the empty text."""
    return F.coalesce(F.trim(F.regexp_replace(F.translate(s, "   ", "   "), r"\s+", " ")), F.lit(""))


def fold(s: Column) -> Column:
    """Normalised text in lower case without accents, ligatures, curly quotes, dashes and slashes."""
    plain = F.translate(normalize_text(s), ACCENTED + "’‘`–—-/", PLAIN + "'''    ")
    plain = F.replace(F.replace(plain, F.lit("œ"), F.lit("oe")), F.lit("Œ"), F.lit("oe"))
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value made once, however often it is used: a small array's element instead of a repeated expression."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def parse_number(s: Column) -> Column:
    """A number as issuers write it: unit suffixes, percent and currency signs, decimal commas; null for anything else."""
    point = lambda text: F.when(text.contains(",") & text.contains("."), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    number = lambda text: F.when(text.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))

    def scaled(raw: Column) -> Column:
        scale = F.when(raw.rlike(r"[0-9] ?K$"), 1e3).when(raw.rlike(r"[0-9] ?M$"), 1e6).when(raw.rlike(r"[0-9] ?B$"), 1e9).otherwise(1.0)
        text = F.regexp_replace(F.regexp_replace(raw, r" ?[KMB]$", ""), r"%|MAD|DH| ", "")
        return F.when(raw.isin("", "-", "--", "NA", "N/A"), None).otherwise(let(let(text, point), number) * scale)

    return let(F.upper(normalize_text(s)), scaled)


def direction(change: Column, flat: float = 1.5) -> Column:
    """up, down or flat; null for a null change."""
    return F.when(change > flat, "up").when(change < -flat, "down").when(change.isNotNull(), "flat")


def lean_direction(x: Column) -> Column:
    """up from 58, down to 42, else flat."""
    return F.when(x >= 58, "up").when(x <= 42, "down").when(x.isNotNull(), "flat")


def claim_direction(recommendation: Column) -> Column:
    """What a recommendation claims about the price."""
    return F.when(recommendation.isin("STRONG_OPPORTUNITY", "WATCH"), "up").when(recommendation.isin("AVOID", "RISKY"), "down").otherwise("flat")


def signal_strength(score: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(score - 50) / 50)


def claimed_probability(score: Column, confidence: Column, digits: int = 4) -> Column:
    """0.5 and more by strength and confidence, within 0.1 and 0.9."""
    return half_even(clamp(F.coalesce(F.lit(0.5) + signal_strength(score) * 0.25 * confidence / 100, F.lit(0.5)), 0.1, 0.9), digits)


def evaluation_date(at: Column, horizon: Column) -> Column:
    """10, 60 or 180 days on."""
    days = F.when(horizon == "short", 10).when(horizon == "medium", 60).otherwise(180)
    return F.timestamp_add("DAY", days, at)


def fact_hash(category: Column, key: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", category, key, value), 256)


def age_label(seconds: Column) -> Column:
    """Minutes under an hour, hours under two days, else days."""
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min"))).when(seconds < 172800, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h"))).when(seconds.isNotNull(), F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" j")))


#: Names of days from Monday on, and of months.
DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def date_line(day: Column) -> Column:
    """A date as it heads a summary: name of the day, day, month, year."""
    name = lambda names, k: F.element_at(F.array(*map(F.lit, names)), k)
    return F.when(day.isNotNull(), F.concat_ws(" ", name(DAYS, F.weekday(day) + 1), F.dayofmonth(day).cast("string"), name(MONTHS, F.month(day)), F.year(day).cast("string")))


def guessed_symbol(name: Column, symbol: Column, aliases: dict[str, str]) -> Column:
    """The first alias that the name holds, else its first token of two to five capitals, else the symbol."""
    upper = F.upper(name)
    tests = [F.when(upper.contains(k), F.lit(v)) for k, v in aliases.items()]
    return F.coalesce(*tests, F.nullif(F.regexp_extract(upper, r"^[A-Z]{2,5}", 0), F.lit("")), symbol)


def signed(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%+.{digits}f", x))


def html_to_text(s: Column) -> Column:
    """Markup stripped and the usual character references resolved."""
    out = F.regexp_replace(F.coalesce(s, F.lit("")), r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def trend(price: Column, ma50: Column) -> Column:
    """Price against its 50-day mean, within one percent neutral."""
    return F.when(price > ma50 * 1.01, "haussier").when(price < ma50 * 0.99, "baissier").when(price.isNotNull() & ma50.isNotNull(), "neutre")
