"""Pages and titles with letters and marks that the generated tables hold only when they are large."""

from pyspark.sql import functions as F

from plumbline.functions import labels as lb
from plumbline.sources import html, sites


def test_claims_start_with_one_letter_for_one(spark):
    titles = ["Es falso que ßheit", "¿ßa uno? Es falso", "ﬁn, pero es falso", "Son falsas ᾳ b", "Es falso que ñandú", "ßolo", None]
    d = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    assert [r["c"] for r in d.orderBy("i").select(lb.clean_claim(F.col("t")).alias("c")).collect()] == ["ẞheit", "ẞa uno", "ﬁn", "ᾼ b", "Ñandú", "ßolo", None]


def test_outcomes_start_with_one_letter_for_one(spark):
    page = "<h1>Es falso que ßheit</h1><article><p>Redacción: Ana - 2024-02-05</p><p>Es falso, dice el informe</p></article>"
    d = spark.createDataFrame([(1, "perucheck", "https://p.pe/articles/nota-1", page)], "page_id long, publisher string, url string, html string")
    assert sites.fact_check_outcomes(d).first()["claim"] == "ẞheit"


def test_references_without_semicolon_stay(spark):
    heads = {"a &&amp": "a &&amp", "b &amp;&amp;&am": "b &&&am", "c &copy;&copy &copyx; &#233;&#233": "c ©&copy &copyx; é&#233", "d & e": "d & e", "&quot;f&quot;": '"f"'}
    ld = '<script type="application/ld+json">{"@type": "ClaimReview", "claimReviewed": "x & y &amp; z&copy"}</script><!-- & -->'
    d = spark.createDataFrame([(i, f"<h1>{h}</h1>{ld}") for i, h in enumerate(heads)], "page_id long, html string")
    got = html.fact_checks(d).orderBy("page_id").collect()
    assert [r["headline"] for r in got] == list(heads.values()) and {r["claim"] for r in got} == {"x & y &amp; z&copy"}
