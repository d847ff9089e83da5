"""Personal data by candidate gradient boosting, in built-in functions only.

Generators of high recall propose spans, overlapping ones too: the base patterns, and wider ones for addresses spelt out, bracketed or
separated otherwise, and for cards and phones inside longer runs of digits, which no base match can be. Boosted trees, written out as one SQL
expression, score each candidate by its form and its surroundings, and per-kind thresholds select. There are no labels of personal data, so
the trees learn from sentences put together from contexts and formats; contexts that they never saw set the thresholds, and further
ones measure precision and recall. Valid matches of the base patterns always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")

#: Name, kind, pattern, and plain strings of which a text with a match holds one. The first four are the base patterns, written so that a
#: match starts only where a run starts or the last match ended: the same matches, without trying each start within a run again.
GENERATORS = (
    ("base", 0, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",)),
    ("base", 1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",)),
    ("base", 2, r"[0-9](?:[\x20-]?[0-9])++", ()),
    ("base", 3, r"\+[0-9][\x20().0-9-]+[0-9]", ("+",)),
    ("wide", 0, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?[a-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[a-z0-9-]{2,63}+){1,4}+|\x20at\x20[a-z0-9-]{1,63}+(?:\x20dot\x20[a-z0-9-]{2,63}+){1,4}+)", ("at", "AT", "At")),
    ("wide", 1, r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20|\[dot\])[0-9]{1,3}){3}(?![0-9])", ("[.]", "(.)", " . ", "[dot]")),
    ("wide", 2, r"(?<![0-9])[0-9]{4}(?:[./_–][0-9]{4}){2}[./_–][0-9]{1,7}(?![0-9])", (".", "/", "_", "–")),
    ("wide", 3, r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])", ()),
    ("wide", 2, r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])", ()),
    ("wide", 2, r"(?<![0-9])[0-9]{13,19}(?![0-9])", ()),
    ("wide", 3, r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", ("+",)),
)

#: Words before a candidate that speak for personal data of some kind, and words that speak against any.
FOR = (
    r"(?i)(?:mail|contact|write|reach|server|host|address|login|logged|client|peer|card|visa|credit|charge|pay|paid|phone|call|tel|mobile|fax|dial|ring|text|whatsapp|cell)"
    r"[^0-9]{0,20}$"
)
AGAINST = (
    r"(?i)(?:version|release|build|isbn|order|section|chapter|figure|table|part|item|look|arrive|stay|serial|invoice|ticket|sku|model|total|count|page|year|batch|article|measured)"
    r"[^0-9]{0,12}$"
)
#: Words after a candidate that make it a quantity, and endings of host names.
UNITS = r"(?i)^\x20?(?:pieces|units|items|euro|dollars|meters|pages|votes|copies|times|kg|km)"
ENDINGS = r"(?i)(?:\.|dot\x20|dot[\])}]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"

#: Candidate features, all small integers.
FEATURES = ("kind", "gen", "valid", "digits", "groups", "marks", "wordy", "ending", "for", "against", "units", "tight")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the check."""
    places = F.sequence(F.lit(1), F.char_length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((F.char_length(digits) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.char_length(digits)
    parts = F.filter(F.split(F.regexp_replace(match, "[^0-9]+", "."), r"\."), lambda p: p != "")
    small = F.forall(parts, lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.when(kind == 0, True).when(kind == 1, (F.size(parts) == 4) & small).when(kind == 2, F.when(n.between(13, 19), _luhn(digits)).otherwise(False)).otherwise(n.between(9, 15))


def _tag(g: int) -> Callable[[Column], Column]:
    return lambda z: F.struct(F.lit(g).alias("gen"), z["i"].alias("i"), z["skip"].alias("skip"), z["match"].alias("match"), z["before"].alias("before"), z["after"].alias("after"))


def _of_kind(i: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == i


def candidates(texts: DataFrame) -> DataFrame:
    """``texts`` (k, t: keys of a text, text) -> one row per candidate: k, t, gen, start, end (code points), match, before, after.

    A text is cut at a generator's matches; the lengths of what lies between and of the matches sum up to their places. Repeats of a
    (k, t) are one text. Only candidates are shuffled, never texts.
    """
    found = []
    for g, (_, _, pattern, signs) in enumerate(GENERATORS):
        matches, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
        zipped = F.arrays_zip(matches.alias("m"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
        own = F.transform(
            F.filter(zipped, lambda z: z["m"].isNotNull()),
            lambda z, i: F.struct(i.alias("i"), F.char_length(z["gap"]).alias("skip"), z["m"].alias("match"), F.right(z["gap"], F.lit(40)).alias("before"), F.left(z["next"], F.lit(12)).alias("after")),
        )
        own = F.transform(own, _tag(g))
        there = reduce(lambda a, b: a | b, [F.contains("text", F.lit(s)) for s in signs]) if signs else F.col("text").rlike("[0-9]")
        found.append(F.when(there & F.col("text").rlike(pattern), own))
    none = F.array().cast("array<struct<gen:int,i:int,skip:int,match:string,before:string,after:string>>")
    rows = texts.select("k", "t", F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("c")).select("k", "t", "c.*")
    rows = rows.dropDuplicates(["k", "t", "gen", "i"])
    upto = F.sum(F.col("skip") + F.char_length("match")).over(Window.partitionBy("k", "t", "gen").orderBy("i"))
    return rows.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.char_length("match"))


def _described(rows: DataFrame) -> DataFrame:
    """Candidates with FEATURES, ``base`` (a valid match of a base pattern) and ``clear`` (no such match of its kind overlaps it)."""
    by = F.array(*[F.lit(k) for _, k, _, _ in GENERATORS])
    wide = F.array(*[F.lit(n == "wide") for n, _, _, _ in GENERATORS])
    match, before, after = F.col("match"), F.col("before"), F.coalesce("after", F.lit(""))
    rows = rows.withColumn("kind", F.get(by, F.col("gen"))).withColumn("wide", F.get(wide, F.col("gen")))
    rows = rows.withColumn("valid", _valid(F.col("kind"), match).cast("int"))
    rows = rows.withColumn("digits", F.char_length(_digits(match))).withColumn("groups", F.regexp_count(match, F.lit("[0-9]+")))
    rows = rows.withColumn("marks", F.char_length(F.regexp_replace(match, "[A-Za-z0-9]", "")))
    rows = rows.withColumn("wordy", match.rlike(r"(?i)[a-z0-9]\x20at\x20").cast("int") + match.rlike(r"(?i)\x20dot\x20").cast("int"))
    rows = rows.withColumn("ending", match.rlike(ENDINGS).cast("int"))
    rows = rows.withColumn("for", before.rlike(FOR).cast("int")).withColumn("against", before.rlike(AGAINST).cast("int"))
    rows = rows.withColumn("units", after.rlike(UNITS).cast("int"))
    rows = rows.withColumn("tight", before.rlike(r"[\p{L}0-9]$").cast("int") + after.rlike(r"^[\p{L}0-9]").cast("int"))
    rows = rows.withColumn("base", ~F.col("wide") & (F.col("valid") == 1))
    own = Window.partitionBy("k", "t", "kind")
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(own.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    starts = F.min(F.when(F.col("base"), F.col("start"))).over(own.orderBy("start").rangeBetween(0, Window.unboundedFollowing))
    return rows.withColumn("clear", ~F.coalesce(ends > F.col("start"), F.lit(False)) & ~F.coalesce(starts < F.col("end"), F.lit(False)))


#: Surroundings of examples: what stands before and after, and whether it speaks for (1) or against (-1) personal data. The first third of each
#: class is for fitting, the second for thresholds, the last for measuring.
CONTEXTS = (
    ("please contact ", " about it", 1), ("call ", " now", 1), ("the card ", " was charged", 1), ("server ", " is down", 1),
    ("my address is ", " these days", 1), ("pay with ", " only", 1), ("login from ", " twice", 1), ("fax: ", ".", 1), ("write to ", " soon", 1),
    ("phone ", " tonight", 1), ("credit card no ", ", thanks", 1), ("host ", " answered", 1), ("mail ", " again", 1), ("dial ", "", 1),
    ("visa ", " please", 1), ("peer ", " left", 1), ("you reach them at ", " any time", 1), ("tel. ", ", evenings", 1), ("we paid by ", " then", 1),
    ("client ", " connected", 1), ("e-mail: ", "", 1), ("my mobile is ", ",", 1), ("text me, ", ", today", 1), ("ring ", " first", 1),
    ("and ", " it was", 0), ("seen ", " there", 0), ("", "", 0), ("the other, ", ", came up", 0), ("yes: ", "!", 0), ("near ", " or so", 0),
    ("| ", " | x |", 0), ("then ", " too", 0), ("about ", " again", 0), ("so ", " and", 0), ("\"", "\" he said", 0), ("it read ", " in full", 0),
    ("here, ", " at last", 0), ("not ", " but", 0), ("(", ")", 0), ("with ", " at hand", 0), ("found ", " below", 0), ("- ", "", 0),
    ("order ", " came", -1), ("isbn ", " in print", -1), ("version ", " is out", -1), ("serial ", " on the back", -1), ("section ", " says so", -1),
    ("invoice ", " was sent", -1), ("a total of ", " units", -1), ("part ", " in stock", -1), ("release ", " fixes it", -1),
    ("figure ", " shows", -1), ("ticket ", " is closed", -1), ("chapter ", " ends", -1), ("item no. ", " sold", -1), ("build ", " failed", -1),
    ("we counted ", " votes", -1), ("sku ", " again", -1), ("page ", " of it", -1), ("model ", " works", -1), ("batch ", " is done", -1),
    ("article ", " holds", -1), ("table ", " lists", -1), ("they measured ", " meters", -1), ("in the year ", " or so", -1),
    ("look at ", " once", -1),
)
#: Formats of examples: {n}ame, {h}ost, {a}-{d} up to 255, {x} to {z} of three digits, {w} of four, {v}alid and {f}alse cards in fours; the kind; personal
#: unless the surroundings speak against it (1), only if they speak for it (2), or never (0).
FORMATS = (
    ("{n} [at] {h} [dot] com", 0, 1), ("{n}(at){h}.org", 0, 1), ("{n} at {h} dot net", 0, 1), ("{n} [at] {h}.de", 0, 1),
    ("{n} (at) {h} (dot) info", 0, 1), ("{n} at {h} dot {n}", 0, 2), ("we at {h} dot the is", 0, 0), ("they at noon dot but not", 0, 0),
    ("one at {h} dot by dot", 0, 0), ("it (at) {h}.they", 0, 0), ("{a}[.]{b}[.]{c}[.]{d}", 1, 1), ("{a}(.){b}(.){c}(.){d}", 1, 1),
    ("{a}[dot]{b}[dot]{c}[dot]{d}", 1, 1), ("{a} . {b} . {c} . {d}", 1, 2), ("{x} . {y} . {z} . {x}", 1, 0), ("{x}9.{y}8.{z}7.{x}6", 1, 0),
    ("{v.}", 2, 1), ("{v/}", 2, 1), ("{v_}", 2, 1), ("{v} {v}", 2, 1), ("{v-} {v-}", 2, 1), ("{w} {v }", 2, 1), ("{v} {w}{w}", 2, 1), ("{f.}", 2, 0),
    ("{f/}", 2, 0), ("{f}", 2, 0), ("{f-}", 2, 0), ("{f} {f}", 2, 0), ("{w}", 2, 0), ("{x} {y}", 2, 0), ("{w}-{w}", 2, 0), ("{a}", 2, 0),
    ("{w}{w}{y}", 2, 0), ("({x}) {y}-{w}", 3, 1), ("{x}-{y}-{w}", 3, 2), ("{x}.{y}.{w}", 3, 2), ("{x} {y} {w}", 3, 2), ("+1 ({x}) {y}-{w} {v}", 3, 1),
    ("+44 {x} {y} {w} {w}{w}{w}", 3, 1), ("+{x}", 3, 0), ("+{a} {b}", 3, 0),
)
#: The parts that contexts are dealt to.
FIT, THRESHOLDS, MEASURE = range(3)


def examples(spark: SparkSession, draws: int = 6) -> DataFrame:
    """Example texts: k, t, text, ``part`` (0 to 2, by context), ``about`` (a kind) and ``label``; every format in every context, drawn several times."""

    def pick(salt: str, low: int, high: int) -> Column:
        return F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(high - low + 1)) + low

    def card(valid: bool, mark: str) -> Column:
        first = F.concat(F.lit("4"), *[pick(f"card{i}", 0, 9).cast("string") for i in range(14)])
        check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: _luhn(F.concat(first, c.cast("string"))))[0]
        last = check if valid else (check + pick("off", 1, 9)) % 10
        return F.regexp_replace(F.concat(first, last.cast("string")), "([0-9]{4})(?=[0-9])", "$1" + mark)

    of = [c for _, _, c in CONTEXTS]
    parts = [3 * (of[:i].count(c)) // of.count(c) for i, c in enumerate(of)]
    contexts = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a"), F.lit(c).alias("c"), F.lit(p).alias("p")) for (b, a, c), p in zip(CONTEXTS, parts)])
    formats = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(k).alias("k"), F.lit(y).alias("y")) for f, k, y in FORMATS])
    rows = spark.range(draws).select("id", F.posexplode(contexts).alias("i", "x")).select("id", "i", "x", F.posexplode(formats).alias("j", "z"))
    rows = rows.select(((F.col("id") * len(CONTEXTS) + F.col("i")) * len(FORMATS) + F.col("j")).alias("k"), "x", "z")
    name = F.concat(F.substring(F.md5(F.concat(F.col("k").cast("string"), F.lit("n"))), 1, 5), F.lit("x"))
    host = F.get(F.array(*[F.lit(h) for h in ("example", "home", "mail7", "night", "work-site", "acme")]), pick("h", 0, 5).cast("int"))
    fill = {"n": name, "h": host, "w": pick("w", 1000, 9999)} | {c: pick(c, 0, 255) for c in "abcd"} | {c: pick(c, 200, 989) for c in "xyz"}
    fill |= {f"{k}{m}": card(k == "v", m) for k in "vf" for m in ("", ".", "/", "_", "-", " ")}
    text = F.concat(F.col("x.b"), F.col("z.f"), F.col("x.a"))
    for k, v in fill.items():
        text = F.replace(text, F.lit("{" + k + "}"), v.cast("string"))
    label = F.when(F.col("z.y") == 0, 0).when(F.col("z.y") == 1, (F.col("x.c") >= 0).cast("int")).otherwise((F.col("x.c") > 0).cast("int"))
    return rows.select("k", F.lit(0).cast("long").alias("t"), text.alias("text"), F.col("x.p").alias("part"), F.col("z.k").alias("about"), label.alias("label"))


def example_candidates(spark: SparkSession, draws: int = 6) -> DataFrame:
    """The examples' candidates of the kind they are about that no valid base match overlaps: k, part, FEATURES, start, end and label.

    Of a personal example the widest candidate is personal. A valid card within a longer run of digits always is, as the base pattern has it for one
    that stands alone.
    """
    texts = examples(spark, draws)
    rows = _described(candidates(texts.select("k", "t", "text"))).where(~F.col("base") & F.col("clear")).join(texts.select("k", "part", "about", "label"), "k").where("kind = about")
    long = F.col("end") - F.col("start")
    card = F.col("gen").isin(8, 9) & (F.col("valid") == 1)
    widest = F.max(F.when(F.col("wide"), long)).over(Window.partitionBy("k"))
    right = (F.col("label") == 1) & F.col("wide") & (long == widest) & ((F.col("kind") != 2) | (F.col("valid") == 1))
    label = F.when(card | right, 1).otherwise(0)
    return rows.select("k", "part", *[F.col(f"`{f}`").cast("int") for f in FEATURES], "start", "end", label.alias("label"))


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int, least: int = 8) -> float | tuple:
    """A regression tree on gradients: rows are (features, gradient, curvature); leaves are Newton steps."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = g / (h + 1.0)
    if not depth:
        return leaf
    best = (1e-6, None, None)
    for f in range(len(FEATURES)):
        for at in sorted({r[0][f] for r in rows})[1:]:
            left = [r for r in rows if r[0][f] < at]
            if not least <= len(left) <= len(rows) - least:
                continue
            gl, hl = sum(r[1] for r in left), sum(r[2] for r in left)
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, f, at)
    _, f, at = best
    if f is None:
        return leaf
    return f, at, _grow([r for r in rows if r[0][f] < at], depth - 1, least), _grow([r for r in rows if r[0][f] >= at], depth - 1, least)


def _value(tree: float | tuple, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


def _sql(tree: float | tuple) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"case when `{FEATURES[tree[0]]}` < {tree[1]} then {_sql(tree[2])} else {_sql(tree[3])} end"


class Booster:
    """The trees, fitted to ``fit`` rows (features, label), and for each kind the lowest score at which at least ``precision`` of the ``kept`` ones were personal."""

    def __init__(self, fit: list[tuple[tuple[int, ...], int]], kept: list[tuple[tuple[int, ...], int]], rounds: int = 60, depth: int = 4, rate: float = 0.3, precision: float = 0.97):
        counts: dict[tuple[tuple[int, ...], int], int] = {}
        for x, y in fit:  # equal rows are one row that weighs more
            counts[x, y] = counts.get((x, y), 0) + 1
        self.rate, self.trees, margin = rate, [], {x: 0.0 for x, _ in counts}
        for _ in range(rounds):
            p = {x: 1 / (1 + math.exp(-m)) for x, m in margin.items()}
            tree = _grow([(x, n * (y - p[x]), n * p[x] * (1 - p[x])) for (x, y), n in counts.items()], depth, 1)
            self.trees.append(tree)
            margin = {x: m + rate * _value(tree, x) for x, m in margin.items()}
        self.thresholds = []
        for kind in range(len(KINDS)):
            scored = sorted(((self.score(x), y) for x, y in kept if x[0] == kind), reverse=True)
            at, right = 1.0, 0
            for n, (s, y) in enumerate(scored, 1):
                right += y
                last_of_ties = n == len(scored) or scored[n][0] < s
                if last_of_ties and s >= 0.5 and right >= precision * n:
                    at = (s + scored[n][0]) / 2 if n < len(scored) else s - 1e-9  # half way to the next lower score
            self.thresholds.append(max(0.5, at))

    def score(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-self.rate * sum(_value(t, x) for t in self.trees)))

    def column(self) -> Column:
        return 1 / (1 + F.exp(-F.lit(self.rate) * reduce(lambda a, b: a + b, [F.expr(_sql(t)) for t in self.trees])))

    def threshold(self) -> Column:
        return F.get(F.array(*[F.lit(t) for t in self.thresholds]), F.col("kind"))


_trained: dict[int, Booster] = {}


def train(spark: SparkSession, draws: int = 6) -> Booster:
    """Trees from made-up examples, whose candidates go through the same expressions as those of documents. Their few features reach the driver.

    The examples are the same every time, so the trees are kept for the process.
    """
    if draws in _trained:
        return _trained[draws]
    got = example_candidates(spark, draws).where(F.col("part") != MEASURE).groupBy("part", *FEATURES, "label").agg(F.count("*").alias("n")).collect()
    rows = {part: sorted((tuple(r[f] for f in FEATURES), r["label"]) for r in got if r["part"] == part for _ in range(r["n"])) for part in (FIT, THRESHOLDS)}
    return _trained.setdefault(draws, Booster(rows[FIT], rows[THRESHOLDS]))


def pii_spans(df: DataFrame, text: str = "text", key: str = "doc_id", booster: Booster | None = None) -> DataFrame:
    """One row per span: ``k`` (the key, the smallest long for null), ``t`` (a hash of the text), kind, start, end, match, base, score.

    ``base`` spans are the valid matches of the base patterns; others are selected by the trees and overlap no base span of their kind.
    """
    booster = booster or train(df.sparkSession)
    rows = _described(candidates(_keyed(df, text, key))).withColumn("score", booster.column())
    kept = rows.where(F.col("base") | (F.col("clear") & (F.col("score") >= booster.threshold())))
    # of selected spans of one kind that overlap, the first stays
    own = Window.partitionBy("k", "t", "kind").orderBy("start", F.col("end").desc(), "gen").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("before_end", F.max("end").over(own)).where(F.col("base") | F.coalesce(F.col("before_end") <= F.col("start"), F.lit(True)))
    return kept.select("k", "t", "kind", "start", "end", "match", "base", "score")


def _keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(whole).alias("t"), whole.alias("text"))


def pii_report(df: DataFrame, text: str = "text", key: str = "doc_id", booster: Booster | None = None) -> DataFrame:
    """One row per input row: the key, ``n_email`` to ``n_phone`` (base spans), ``base`` and ``spans``: kind:start:end by kind and start, comma-joined.

    Null and empty texts have no spans. Rows that repeat a key are judged by their own texts; null keys are kept. An empty table gives an
    empty result; other columns are not read. Texts are read whole, by linear patterns, and are never shuffled.
    """
    scratch = Scratch(df.sparkSession)
    spans = pii_spans(df, text, key, booster)
    one = F.struct("kind", "start", "end", "base")
    per = scratch.save(spans.groupBy("k", "t").agg(F.array_sort(F.collect_list(one)).alias("s")).withColumnsRenamed({"k": "_k", "t": "_t"}), "spans")
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    none = F.array().cast(per.schema["s"].dataType)
    base = F.filter("s", lambda s: s["base"])
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    rows = rows.join(per, (F.col("k") == F.col("_k")) & (F.col("t") == F.col("_t")), "left").withColumn("s", F.coalesce("s", none)).withColumn("b", base)
    counts = [F.size(F.filter("b", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(F.col("key").alias(key), *counts, joined(F.col("b")).alias("base"), joined(F.col("s")).alias("spans"))


def redact(df: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "[{}]", booster: Booster | None = None) -> DataFrame:
    """The rows of ``df`` with the spans of their texts replaced by ``mark`` with the kind's name; overlapping spans of several kinds become one, named by the first."""
    spans = pii_spans(df, text, key, booster)
    own = Window.partitionBy("k", "t").orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    marks = F.get(F.array(*[F.lit(mark.format(k)) for k in KINDS]), F.col("kind"))
    first = spans.withColumn("upto", F.max("end").over(own)).where(F.col("upto").isNull() | (F.col("upto") <= F.col("start")))
    per = first.groupBy("k", "t").agg(F.array_sort(F.collect_list(F.struct("start", "end", marks.alias("mark")))).alias("_pii")).withColumnsRenamed({"k": "_pii_k", "t": "_pii_t"})
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.join(per, (F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))) == F.col("_pii_k")) & (F.xxhash64(whole) == F.col("_pii_t")), "left")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate("_pii", begin, lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(whole, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), s["mark"]).alias("out")))
    clean = F.when(F.col("_pii").isNull(), F.col(text)).otherwise(F.concat(done["out"], F.substring(whole, (done["at"] + 1).cast("int"), F.char_length(whole))))
    return rows.withColumn("_pii_text", clean).select(*[(F.col("_pii_text").alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns])
