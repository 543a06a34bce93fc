"""Clean-up, frontmatter and its removal: inputs and what they become."""
from docmill.functions import text as T


def test_clean_markdown_pairs(spark):
    pairs = {"a\n\n\n\n\nb": "a\n\nb\n", "line   \nnext\t\n": "line\nnext\n", "  \n  \n\n\n x \n": "x\n", "": "\n",
             "a\n \n \n \nb": "a\n\n\n\nb\n", "x\r\ny  ": "x\ny\n", "\u00a0pad\u00a0\n": "pad\n"}
    df = spark.createDataFrame([(s,) for s in pairs], "s string")
    assert dict(df.select("s", T.clean_markdown("s")).collect()) == pairs


def test_frontmatter(spark):
    df = spark.createDataFrame([("T", "https://x/y", "2024-01-15"), ('Say "hi"', "", "2024-01-15")],
                               "t string, s string, d string")
    a, b = [r[0] for r in df.select(T.frontmatter("t", "s", "d")).collect()]
    assert a == '---\ntitle: "T"\nsource: "https://x/y"\nscraped_at: "2024-01-15"\n---'
    assert b == '---\ntitle: "Say "hi""\nscraped_at: "2024-01-15"\n---'
    esc = df.select(T.frontmatter("t", "s", "d", escape=True)).collect()[1][0]
    assert 'title: "Say \\"hi\\""' in esc


def test_strip_frontmatter_pairs(spark):
    pairs = {'---\ntitle: "x"\n---\n\n# Body\n': "# Body\n", "no block here\n": "no block here\n", "": "",
             "intro\n---\nmid\n---\ntail": "intro\ntail", "a --- b\n---\nc\n---\nd": "a --- b\nd", "---\nonly open": "---\nonly open",
             "x\r---\ry\r---\rz": "x\r\rz", "x\u2028---y---z": "x\u2028z", "---a------b---": "---b---"}
    df = spark.createDataFrame([(s,) for s in pairs], "s string")
    assert dict(df.select("s", T.strip_frontmatter("s")).collect()) == pairs


def test_hits_and_code_language(spark):
    df = spark.createDataFrame([("The cat and the hat. THE end", " the ")], "c string, q string")
    r = df.select(T.hit_count("c", "q").alias("n"), T.first_hit("c", "q").alias("f")).first()
    assert (r.n, r.f) == (3, 1)
    from pyspark.sql import functions as F
    blank = df.select(T.hit_count("c", F.lit("   ")).alias("n"), T.first_hit("c", F.lit(" ")).alias("f")).first()
    assert (blank.n, blank.f) == (0, 0)
    langs = spark.createDataFrame([(["x", "Language-Python"], None), (["highlight-js"], None),
                                   (["foo"], ["lang-go"])], "a array<string>, b array<string>")
    out = [r[0] for r in langs.select(T.code_language("a")).collect()]
    assert out == ["python", "js", None]
    out2 = [r[0] for r in langs.select(T.code_language("a", "b")).collect()]
    assert out2[2] == "go"
