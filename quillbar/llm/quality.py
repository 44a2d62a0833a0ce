"""Per-document text quality statistics, and which texts are not natural prose.

Five statistics per text, by built-in expressions. Within the text's language
each statistic gets its exact rank: distinct values are counted, sorted in
range partitions, and partition offsets make local counts global. The
empirical tail probabilities of the statistics are combined into an outlier
score (the sum of their negative logarithms, as in outlier detection by
empirical cumulative distributions), in the directions that point away from
prose: many symbols, few closed lines, few common words, unusual word lengths.

Which texts are not prose is decided in the same way, a piece of a text at a
time, since a text may be half a list. A text is cut into lines, and longer
lines into pieces of ten words; each piece has its share of common words, its
symbol ratio, its mean word length and the form of its line (in a run of lines
of one form, repeated, or neither). Their exact ranks within the text's
language give tail probabilities; a piece's score is the sum of the negative
logarithms for few common words and for line form, and of what those for many
symbols and long words exceed ``RARE`` by (prose fills the rest of these two
scales evenly, so their ordinary ranks say nothing). Pieces above ``LIMIT`` count
against prose, those below for it, by their length, and the cheapest division of the text into
prose and the rest settles which characters are not prose. A text is found when
they are more than half.

Scale: pieces are counted where they are read, and only counts per distinct
value are shuffled. Values are rounded, so there are at most some 800 a
statistic, and the ranks of all languages (proven below ``RANK_ROWS`` rows) go to
every task; texts stay where they are scanned and are read twice.

Defined results: a null text has null statistics, an empty or blank one no
words and null ratios; neither is ranked or found. Ties share a rank. A text in
which no language shows is ranked among all texts; its pieces are measured in
every language, and the least score counts (among all pieces where no text
shows a language).
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbar.llm.words import ALL, COMMON, LANGUAGES
from quillbar.session import cut_lineage

#: Score from which a piece counts against prose.
LIMIT = 2.2
#: Negative logarithm of the tail (1 in 20) beyond which symbols and long words count.
RARE = 3.0
#: Cost of a change between prose and the rest, also at the start.
CHANGE = 1.5
#: Characters of a piece that counts once; longer pieces count for more.
UNIT = 60
#: Bound of the rank table: statistics x groups x rounded values.
RANK_ROWS = 4 * 4 * 800
SALTS = 8
STATS = ("word_count", "mean_word_length", "symbol_ratio", "closed_line_share", "common_word_share")
_SPACE = r"[\s\p{Z}\x{feff}]"
_EDGE = r"^[^\p{L}]+|[^\p{L}]+$"
CLOSING = r'[.!?…:;»"”)\]]$'


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, language, the five statistics and the text. Ratios have six decimals."""
    t = F.col("text")
    words = F.filter(F.split(t, f"{_SPACE}+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, f"{_SPACE}+$", "")), lambda x: x != "")
    bare = F.transform("_words", lambda w: F.lower(F.regexp_replace(w, _EDGE, "")))
    share = lambda lang: F.size(F.filter("_bare", lambda w: w.isin(COMMON[lang]))) / F.col("word_count")
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    # a generator of one row keeps the optimizer from copying these expressions into every use of them
    once = lambda **cols: F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    d = docs.select("doc_id", "text", once(_words=words, _lines=lines))
    d = d.select("*", once(_bare=bare, word_count=F.when(t.isNotNull(), F.size("_words")), _n=F.length(t)))
    d = d.select("*", once(**{f"_{x}": F.when(F.col("word_count") > 0, share(x)) for x in LANGUAGES}))
    best = F.greatest(*[F.col(f"_{x}") for x in LANGUAGES])
    shown = F.lit(None).cast("string")
    for lang in reversed(LANGUAGES):
        shown = F.when(F.col(f"_{lang}") == best, lang).otherwise(shown)
    # the declared language is often wrong, so the text decides; without common words it shows none
    language = F.when(best >= 0.1, shown).otherwise("und")
    return d.select(
        "doc_id", language.alias("language"), "word_count",
        ratio(F.length(F.regexp_replace(t, _SPACE, "")), F.col("word_count")).alias("mean_word_length"),
        ratio(F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s\p{Z}\x{feff}]", "")), F.when(F.col("word_count") > 0, F.col("_n"))).alias("symbol_ratio"),
        ratio(F.size(F.filter("_lines", lambda x: x.rlike(CLOSING))), F.when(F.col("word_count") > 0, F.size("_lines"))).alias("closed_line_share"),
        F.round(best, 6).alias("common_word_share"), "text",
    )


def _coarse(v: Column) -> Column:
    """Range partition of a value: grows with it and keeps few distinct values together."""
    return F.floor(F.when(v < 1, v * 1000).when(v < 1000, 1000 + v * 10).otherwise(11000 + v / 1000))


def tails(long: DataFrame) -> DataFrame:
    """Exact empirical tails per (stat, grp, value): left P(X <= v), right P(X >= v).
    With a column ``n`` a row stands for so many.

    Equal values are counted before the shuffle; the distinct values of a group
    are sorted within range partitions, and the partitions' totals give the
    offsets."""
    key = ["stat", "grp"]
    times = F.sum("n") if "n" in long.columns else F.count("*")
    counts = long.groupBy(*key, "value").agg(times.alias("n")).withColumn("part", _coarse(F.col("value")))
    parts = counts.groupBy(*key, "part").agg(F.sum("n").alias("part_n"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    offsets = parts.select(*key, "part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("off"), F.sum("part_n").over(whole).alias("total"))
    inside = Window.partitionBy(*key, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    local = counts.withColumn("upto", F.sum("n").over(inside)).join(offsets, [*key, "part"])
    upto = F.col("off") + F.col("upto")
    return local.select(*key, "value", (upto / F.col("total")).alias("left"), ((F.col("total") - upto + F.col("n")) / F.col("total")).alias("right"))


def outlier_scores(stats: DataFrame) -> DataFrame:
    """doc_id, outlier_score of every text with words. The statistics are written
    once to the checkpoint folder: ranks and scores both read them."""
    live = cut_lineage(stats.where("word_count > 0"))
    entries = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in STATS])
    own = live.select("doc_id", F.col("language").alias("grp"), F.inline(entries)).where("value is not null")
    # every text is also measured against all texts
    pooled = own.withColumn("grp", F.explode(F.array_distinct(F.array("grp", F.lit("und")))))
    t = tails(pooled).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = pooled.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(t, ["stat", "grp", "value", "salt"])
    left, right = -F.log("left"), -F.log("right")
    pull = (
        F.when(F.col("stat") == "symbol_ratio", right)
        .when(F.col("stat").isin("closed_line_share", "common_word_share"), left)
        .when(F.col("stat") == "mean_word_length", F.greatest(left, right))
        .otherwise(F.lit(0.0))
    )
    all_texts = F.col("grp") == "und"

    def stronger(x: Column) -> Column:
        """The larger of the scores within the language and among all texts: in a
        small or mostly foreign language group ranks say little."""
        return F.round(F.greatest(F.sum(F.when(all_texts, x)), F.sum(F.when(~all_texts, x))), 6)

    return hit.groupBy("doc_id").agg(stronger(pull).alias("outlier_score"), stronger(F.greatest(left, right)).alias("two_sided_score"))


# ---- pieces of texts
_MARK = re.compile(r"\s*(?:(\d{1,3}[.)])|([-–—*•·▪]))\s+\S")
_STRIP = ".,;:!?()[]«»\"“”„'’—–->"
_SETS = [frozenset(COMMON[x]) for x in LANGUAGES]
#: Statistics of a piece, in order.
PIECE = ("common_word_share", "symbol_ratio", "mean_word_length", "line_form")
PLAIN, REPEATED, LISTED = 0, 1, 2


class _Words(dict):
    """Word -> its counts in one number: common word, symbols, characters, and
    common word of each language, 40 bits each; sums of words add up field by field."""

    def __missing__(self, w: str) -> int:
        c = w.strip(_STRIP).lower()
        common = False
        if not (len(w) == 2 and w[1] == "."):  # initials are no words
            common = c in ALL
            if not common and ("'" in c or "’" in c):
                a, _, b = c.replace("’", "'").partition("'")
                common = a in ("l", "d", "n", "s", "c", "qu", "j", "m") or b in ("s", "t", "re", "ll", "ve")
        n = common | sum(not x.isalpha() for x in w) << 40 | len(w) << 80
        for k, known in enumerate(_SETS):
            n |= (c in known) << (120 + 40 * k)
        if len(w) <= 40:
            if len(self) >= 300_000:
                self.clear()
            self[w] = n
        return n


_WORDS = _Words()
_FIELD = (1 << 40) - 1


def _list_lines(lines: list[str]) -> list[bool]:
    """Lines in a run of at least three of one form: the same marker, or the
    same pattern of words and numbers."""
    keys: list[str | None] = []
    for line in lines:
        s = line.strip()
        m = _MARK.match(line)
        if not s:
            keys.append(None)
        elif m and len(s) <= 140:
            keys.append("9" + m[1][-1] if m[1] else "bullet")
        elif len(s) <= 90 and any(c.isdigit() for c in s):
            keys.append(re.sub(r"[^\W\d_]+", "A", re.sub(r"\d[\d.,]*", "9", s)))
        else:
            keys.append("")
    out = [False] * len(lines)
    i = 0
    while i < len(lines):
        j = i + 1
        if keys[i]:
            while j < len(lines) and keys[j] in (keys[i], None):
                j += 1
            if sum(k == keys[i] for k in keys[i:j]) >= 3:
                out[i:j] = [True] * (j - i)
        i = j
    return out


def _rounded_length(x: float) -> float:
    """Word lengths to halves below 50, to two digits above."""
    if x < 50:
        return int(2 * x + 0.5) / 2
    unit = 10.0 ** (int(math.log10(x)) - 1)
    return int(x / unit + 0.5) * unit


def pieces(text: str) -> tuple[str, list[tuple[int, tuple]]]:
    """Language of a text (``und`` if none shows) and its pieces: characters, and
    the statistics common_word_share, symbol_ratio (per cent), mean_word_length, line_form."""
    lines = text.splitlines(keepends=True)
    times = Counter(x.strip() for x in lines)
    out: list[tuple[int, tuple]] = []
    total = words = 0
    get = _WORDS.__getitem__
    for line, listed in zip(lines, _list_lines(lines)):
        ws = line.split()
        if not ws:
            continue
        form = LISTED if listed else REPEATED if len(line) <= 40 and times[line.strip()] >= 3 else PLAIN
        if len(ws) <= 14 or listed:
            parts = [ws]
        else:
            parts = [ws[i : i + 10] for i in range(0, len(ws), 10)]
            if len(parts[-1]) < 5:
                last = parts.pop()
                parts[-1] += last
        for p in parts:
            s, n = sum(map(get, p)), len(p)
            total += s
            words += n
            size = s >> 80 & _FIELD
            out.append((size + n, (int(100 * (s & _FIELD) / n + 0.5), int(100 * (s >> 40 & _FIELD) / size + 0.5), _rounded_length(size / n), form)))
    shares = [total >> (120 + 40 * k) & _FIELD for k in range(len(LANGUAGES))]
    best = max(shares)
    return (LANGUAGES[shares.index(best)] if best and best >= 0.1 * words else "und"), out


class Ranks:
    """Tails of every piece statistic per language, and the score of a piece."""

    def __init__(self, rows: list[tuple[str, str, float, float, float]]) -> None:
        by: dict[tuple[str, str], list] = {}
        for stat, grp, value, left, right in rows:
            by.setdefault((grp, stat), []).append((value, -math.log(left), -math.log(right)))
        self.tables = {k: sorted(v) for k, v in by.items()}
        self.languages = [x for x in LANGUAGES if (x, PIECE[0]) in self.tables]
        self.known: dict[tuple, float] = {}

    def tail(self, grp: str, stat: str, value: float, left: bool) -> float:
        """Negative logarithm of P(X <= value) or P(X >= value); beyond all ranks one more than the rarest."""
        t = self.tables[grp, stat]
        if left:
            i = bisect.bisect_right(t, (value, math.inf)) - 1
            return t[i][1] if i >= 0 else t[0][1] + 1.0
        i = bisect.bisect_left(t, (value, -math.inf))
        return t[i][2] if i < len(t) else t[-1][2] + 1.0

    def score(self, language: str, stats: tuple) -> float:
        key = (language, stats)
        if (got := self.known.get(key)) is None:
            if language != "und" or not self.languages:
                common, symbols, length, form = (self.tail(language, s, v, i == 0) for i, (s, v) in enumerate(zip(PIECE, stats)))
                got = common + form + max(0.0, symbols - RARE) + max(0.0, length - RARE)
            else:
                got = min(self.score(x, stats) for x in self.languages)
            if len(self.known) >= 1_000_000:
                self.known.clear()
            self.known[key] = got
        return got


def other_share(text: str, ranks: Ranks, limit: float = LIMIT) -> float:
    """Share of a text's characters outside prose, by the cheapest division of its pieces."""
    language, parts = pieces(text)
    other, prose = 0.0, CHANGE
    back = []
    for n, stats in parts:
        weight = (limit - ranks.score(language, stats)) * n / UNIT
        o = (other, 0) if other >= prose - CHANGE else (prose - CHANGE, 1)
        p = (prose, 1) if prose >= other - CHANGE else (other - CHANGE, 0)
        back.append((o[1], p[1]))
        other, prose = o[0], p[0] + weight
    state = 1 if prose > other else 0
    outside = whole = 0
    for (n, _), (o, p) in zip(reversed(parts), reversed(back)):
        whole += n
        outside += n * (state == 0)
        state = p if state else o
    return outside / whole if whole else 0.0


def piece_counts(docs: DataFrame) -> DataFrame:
    """(stat, grp, value, n): how often each value occurs among the pieces of a
    language, and of all texts (``und``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for t in b["text"]:
                if t is not None and t is not pd.NA:
                    language, parts = pieces(t)
                    seen.setdefault(language, Counter()).update(x for _, x in parts)
            rows: Counter = Counter()
            for language, keys in seen.items():
                for stats, n in keys.items():
                    for s, v in zip(PIECE, stats):
                        rows[s, "und", float(v)] += n
                        if language != "und":
                            rows[s, language, float(v)] += n
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["stat", "grp", "value", "n"])

    return docs.select("text").mapInPandas(run, "stat string, grp string, value double, n bigint")


def piece_ranks(docs: DataFrame) -> Ranks:
    """The rank table of a corpus; its size is bounded by the rounding of the statistics.
    The counts are written to the checkpoint folder, since the ranks read them twice."""
    counts = cut_lineage(piece_counts(docs).groupBy("stat", "grp", "value").agg(F.sum("n").alias("n")))
    rows = tails(counts).select("stat", "grp", "value", "left", "right").collect()
    if len(rows) > RANK_ROWS:
        raise ValueError("more distinct values than the rounding allows")
    return Ranks([tuple(r) for r in rows])


def not_prose(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, other_share of the texts more than half of which is not prose."""
    ranks = piece_ranks(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share = [0.0 if t is None or t is pd.NA else other_share(t, ranks, limit) for t in b["text"]]
            yield b[["doc_id"]].assign(other_share=share)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, other_share double").where("other_share > 0.5")
