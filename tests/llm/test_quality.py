from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillbar.llm import quality as q

PROSE = "I thank the member for that question, and I will say to the house what we have done about it. There was no time to do more than this before the end of the year."
LIST = "\n".join(f"{i}. Local tribunal Inskford" for i in range(1, 12))
TABLE = "\n".join(f"depot\t{i * 7}.2\t{i}%\t-" for i in range(1, 15))
JUNK = "boggqesupbxyy wkdw z qq fknvu uamyhcktta helltae hcirysjts w wwtili ghokcxmd kobttv niivtj"


@pytest.fixture(scope="module")
def ranks(spark):
    """Ranks of a corpus of which a tenth is not prose; speeches hold formulas and names."""
    formulas = ["Order, order.", "I give way.", "Gisla Pellfield [Harbour Union]:", "Dunvford depot, Polvmouth quarry and Inskford tribunal."]
    speeches = spark.createDataFrame([(i, "en", f"{formulas[i % 4]}\n{PROSE}", 0.0) for i in range(40)], "doc_id bigint, lang string, text string, word_count double")
    return q.piece_ranks(_docs(spark).union(speeches))


@pytest.mark.parametrize("text", [PROSE, PROSE.upper().replace(".", "").replace(",", ""), PROSE.replace("question", "ques-\ntion"), "Order, order.", "I give way.", "(a) " + PROSE, PROSE + "\n" + LIST[:60], "216. " + PROSE])
def test_prose(text, ranks):
    assert q.other_share(text, ranks) <= 0.5


@pytest.mark.parametrize("text", [LIST, TABLE, JUNK, "= = = = = =\n" * 9, "Order of the day\n" + TABLE, "tribunal " * 30, "1) Motion by A on the border and the quarry.\n2) Motion by B on the border and the inspector.\n3) Report of the committee on the meter.\n4) Motion by C on the mill."])
def test_other(text, ranks):
    assert q.other_share(text, ranks) > 0.5


def _docs(spark):
    rows = [(i, "en", PROSE + " And so it is, as we all know by now." * (i % 5), 0.0) for i in range(60)]
    rows += [(100, "xx", LIST, 0.0), (101, None, TABLE, 0.0), (102, "de", JUNK, 0.0), (103, "en", None, 0.0), (104, "en", "", 0.0), (105, "en", " \n ", 0.0), (106, "fr", TABLE * 300, 0.0)]
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string, word_count double")


def test_found_and_blank(spark):
    d = _docs(spark)
    assert sorted(r.doc_id for r in q.not_prose(d).collect()) == [100, 101, 102, 106]
    s = {r.doc_id: r for r in q.statistics(d).collect()}
    assert s[103].word_count is None and s[104].word_count == 0 and s[104].mean_word_length is None and s[105].word_count == 0
    assert s[0].language == "en" and s[101].language == "und" and s[0].closed_line_share == 1.0
    assert q.not_prose(d.where("false")).count() == 0


def test_tails_are_exact(spark):
    vals = [0.1, 0.1, 0.3, 0.3, 0.3, 5.0, 1200.5, 1200.5, 7.0]
    df = spark.createDataFrame([("s", "g", v) for v in vals] + [("s", "h", 1.0)], "stat string, grp string, value double")
    got = {(r.grp, r.value): (r.left, r.right) for r in q.tails(df).collect()}
    n = len(vals)
    for v in set(vals):
        assert got[("g", v)] == (sum(x <= v for x in vals) / n, sum(x >= v for x in vals) / n)
    assert got[("h", 1.0)] == (1.0, 1.0)


def test_scores_match_plain_ranks(spark):
    st = q.statistics(_docs(spark)).where("word_count > 0")
    rows = [r.asDict() for r in st.drop("text").collect()]
    got = {r.doc_id: r.outlier_score for r in q.outlier_scores(st.drop("text")).collect()}

    def score(r, pool):
        le = lambda s: sum(x[s] <= r[s] for x in pool) / len(pool)
        ge = lambda s: sum(x[s] >= r[s] for x in pool) / len(pool)
        return -math.log(ge("symbol_ratio")) - math.log(le("closed_line_share")) - math.log(le("common_word_share")) - math.log(min(le("mean_word_length"), ge("mean_word_length")))

    for r in rows:
        own = [x for x in rows if x["language"] == r["language"]] if r["language"] != "und" else rows
        assert got[r["doc_id"]] == pytest.approx(max(score(r, own), score(r, rows)), abs=1e-5)
    assert q.outlier_scores(st.drop("text").where(F.lit(False))).count() == 0


def test_the_ranks_decide(spark, monkeypatch):
    """With tails that say nothing no text is found; a text of one endless word is."""
    d = _docs(spark).union(spark.createDataFrame([(200, "en", "aB3/" * 90, 0.0), (201, "en", None, 0.0)], "doc_id bigint, lang string, text string, word_count double"))
    assert sorted(r.doc_id for r in q.not_prose(d).collect()) == [100, 101, 102, 106, 200]
    from pyspark.sql import functions as F

    exact = q.tails
    monkeypatch.setattr(q, "tails", lambda c: exact(c).withColumn("left", F.lit(1.0)).withColumn("right", F.lit(1.0)))
    blind = q.piece_ranks(d)
    assert all(q.other_share(t, blind) == 0.0 for t in (LIST, TABLE, PROSE))


def test_pieces_against_plain_counts(spark):
    d = _docs(spark)
    got = {(r.stat, r.grp, r.value): r.n for r in q.piece_counts(d).groupBy("stat", "grp", "value").agg(F.sum("n").alias("n")).collect()}
    want: Counter = Counter()
    for r in d.collect():
        language, parts = q.pieces(r.text or "")
        for _, stats in parts:
            for s, v in zip(q.PIECE, stats):
                for g in {language, "und"}:
                    want[s, g, float(v)] += 1
    assert got == dict(want)
    assert sum(n for n, _ in q.pieces(PROSE)[1]) == len(PROSE) + 1
    assert q.pieces("")[1] == [] and q.pieces("der und die")[0] == "de"
    assert q._rounded_length(49.6) == 49.5 and q._rounded_length(1264) == 1300
