import re

from pyspark.sql import functions as F

from gleaner.functions import ids
from gleaner.functions import text as tx
from gleaner.functions import vectors as vx


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tx.tokens("t"), t="The QUICK brown-fox, a 42nd x über!") == ["quick", "brown", "fox", "42nd", "ber"]
    assert one(spark, tx.tokens("t"), t=None) == []
    assert one(spark, tx.estimate_tokens("t"), t="abc") == 1
    assert one(spark, tx.estimate_tokens("t"), t="x" * 4099) == 1024


def test_sentences_and_strip(spark):
    text = "One. Two! Three? four.five"
    assert one(spark, tx.sentences("t"), t=text) == re.split(r"(?<=[.!?])\s+", text)
    assert one(spark, tx.strip("t"), t="　 a b \n") == "a b"


def test_markdown(spark):
    text = "---\ntitle: 'A: b'\n# no: comment\nowner: me\nowner: you\nplain\n---\n\n# One \ntext\n## Two\n###### Six\n####### no"
    assert one(spark, tx.front_matter("t"), t=text) == {"title": "A: b", "owner": "you"}
    assert one(spark, tx.body("t"), t=text).startswith("# One")
    assert one(spark, tx.headings(tx.body("t")), t=text) == ["One", "Two", "Six"]
    assert one(spark, tx.front_matter("t"), t="no matter") == {}
    assert one(spark, tx.body("t"), t="--- never closed") == "--- never closed"


def test_html(spark):
    html = "<html><title> A\n B </title><script>x < 1</script><STYLE>p{}</STYLE><p>One&nbsp;two &amp; <b>three</b></p>"
    assert one(spark, tx.html_title("t"), t=html) == "A B"
    assert one(spark, tx.html_text("t"), t=html) == "A B One two & three"
    assert one(spark, tx.html_title("t"), t="<p>none</p>") is None


def test_stable_hash(spark):
    assert ids.stable_hash("ab", "c") != ids.stable_hash("a", "bc")
    got = one(spark, ids.stable_id("a", "b"), a="it's", b=None)
    assert got == ids.stable_hash("it's", None, length=16) and len(got) == 16


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(vx.dot("a", "b"), vx.norm("a"), vx.l2_normalize("a"), vx.l2_normalize("z"), vx.cosine("a", "b"), vx.cosine("a", "z")).first()
    assert tuple(r) == (24.0, 5.0, [0.6, 0.8], [0.0, 0.0], 0.96, 0.0)
    assert df.select(tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))).first()[0] == 0.5
