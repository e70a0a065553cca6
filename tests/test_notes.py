"""Truth tables of texts made safe, and of draft gates."""

import re

from pyspark.sql import functions as F

from lookback.functions import notes

HOSTILE = [
    ("see [[Secret Note]]", "[["), ("![[embed.png]]", "!["), ("![beacon](http://x.example/p.png)", "!["), ("```dataview\nTABLE x\n```", "```"), ("~~~js\nx\n~~~", "~~~"), ("   ~`~ x", "~`~"), ("`$= dv.pages()`", "`$="),
    ("`= this.file.name`", "`="), ("<% tp.prompt() %>", "<%"), ("<script>x</script>", "<script"), ("<!-- app:claim:1 -->", "<!--"), ("%% hide", "%%"), ("%%%%% odd", "%%"), ("# heading", "\n# "), ("x\n   # heading", "\n   # "),
    ("- [x] forged", "\n- ["), ("[click](javascript:alert(1))", "]("), ("[click](  DATA:text/html)", "]("), ("[[[Odd]]]", "[["), ("x [[[[Secret]]]] y", "[["), ("- item\n  ```js\nx\n```", "```"),
]
HARMLESS = ["a (parenthetical) aside", "cost was $5 per 1k, 5 % off", "1 < 2 and 3 > 2", "call `format()` and ``x``", "see [the paper](https://arxiv.org/abs/2609.01234)", "see https://e.example/x #topic", "狭い質問は安定する。", ""]


def each(spark, rows, column):
    return [r["v"] for r in spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, t string").select("i", column.alias("v")).orderBy("i").collect()]


def test_what_is_hostile_is_dead_and_what_is_not_stays(spark):
    out = each(spark, [h for h, _ in HOSTILE] + HARMLESS, notes.sanitized(F.col("t")))
    for (hostile, dead), got in zip(HOSTILE, out):
        assert dead not in "\n" + got, (hostile, got)
    assert out[len(HOSTILE):] == HARMLESS
    assert out[0] == r"see \[\[Secret Note]]" and out[5] == r"   \~\`\~ x" and out[12] == r"\%\%\%\%\% odd" and out[8] == "&lt;% tp.prompt() %>" and out[6] == r"\`$\= dv.pages()`"


def test_one_line_and_link_texts(spark):
    assert each(spark, [" a \n\t b　c ", "a ] b [c] \\", None], notes.link_text(F.col("t"))) == ["a b c", r"a \] b \[c\] \\", None]


def test_safe_addresses(spark):
    got = each(spark, ["https://x.org/a%%b%41", "http://x/(a) \"b\"?q=é&r=[1]#z", "javascript:alert(1)", "ftp://x", None, "https://x/😀"], notes.safe_url(F.col("t")))
    assert got == ["https://x.org/a%25%25b%41", "http://x/%28a%29%20%22b%22?q=%C3%A9&r=%5B1%5D#z", None, None, None, "https://x/%F0%9F%98%80"]


def test_a_cut_never_halves_an_escape(spark):
    text = "a [[b]] <i> %% <b ``` c &amp d"
    df = spark.createDataFrame([(text,)], "t string")
    limits = list(range(1, 45))
    got = df.select(notes.sanitized(F.col("t"), one_line=True).alias("whole"), *[notes.printable(F.col("t"), "app", n).alias(f"n{n}") for n in limits]).first()
    for n in limits:
        cut = got[f"n{n}"]
        assert got["whole"].startswith(cut) and len(cut) <= n
        if cut != got["whole"]:
            assert not cut.endswith("\\") and not re.search(r"&\w*$", cut)


def test_printable_lines(spark):
    rows = ["see https://a.b/c, doi 10.1234/x.y and arXiv:2609.01234v2 or github.com/a/b/c", "APP:claim:1 and app : x", "x" * 200, "a\nb <!-- c"]
    assert each(spark, rows, notes.printable(F.col("t"), "app", 60)) == ["see &lt;url> doi &lt;url> and &lt;url> or &lt;url>", "APP :claim:1 and app : x", "x" * 60, "a b &lt;!-- c"]


def test_draft_gates(spark):
    m = "Inference:"
    rows = [
        ("It holds [1].\n\nShort frame.\n\nInference: so it may be.", 1, []),
        ("It holds [1].\n\nInference: so [1].", 1, ["inference_cited"]),
        ("Inference: first, with a 1.\n\nIt holds [1].", 1, ["inference_place", "uncited"]),
        ("It grew by 5 per cent.\n\nInference: x.", 1, ["uncited", "no_citation"]),
        ("It grew (S2).\n\nInference: x.", 0, []),
        ("No evidence at all in 2024.\n\nInference: x.", 0, []),
        ("It holds [1].", 1, ["inference_place"]),
        ("", 0, ["inference_place"]),
        ("日本 [1].\n\nInference: x.", 1, ["japanese"]),
    ]
    df = spark.createDataFrame([(i, p, n) for i, (p, n, _) in enumerate(rows)], "i int, p string, n int")
    gates = notes.failed_gates(F.col("p"), F.col("n"), "en", m, "No evidence at all in 2024.")
    got = [r["g"] for r in df.select("i", gates.alias("g")).orderBy("i").collect()]
    assert got == [w for *_, w in rows]
    ja = spark.createDataFrame([("安定する [1]。\n\n推測: そう。", 1), ("安定します [1]。\n\n推測: x。", 1), ("「です」と冷ます [1]。\n\n推測: x。", 1)], "p string, n int").coalesce(1)
    assert [r[0] for r in ja.select(notes.failed_gates(F.col("p"), F.col("n"), "ja", "推測:")).collect()] == [[], ["polite"], []]
