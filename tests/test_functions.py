from pyspark.sql import functions as F

from weftgraph.functions import arrays as A
from weftgraph.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_normalisers(spark):
    r = one(
        spark,
        phrase=T.phrase(F.lit("  The Café-Bar 42! ")),
        compat=T.compat_phrase(F.lit(None).cast("string")),
        answer=T.answer(F.lit("The  Cat, an owl & a dog.")),
        title=T.compact_title(F.lit("x " * 100)),
        slug=T.slug(F.lit("--A b//c--")),
        thoughts=T.without_thoughts(F.lit("plan</think> hi <think>x\ny</think>there")),
        part=T.answer_part(F.lit("Thought: so. Answer: 42 ")),
        wide=T.extracted(F.lit("“北京 大学”")),
        short=T.extracted(F.lit("12")),
    )
    assert r.phrase == "the caf  bar 42" and r.compat == "" and r.answer == "cat owl dog"
    assert len(r.title) == 120 and r.title.endswith("...") and r.slug == "A_b_c"
    assert r.thoughts == "hi there" and r.part == "42" and r.wide == "北京大学" and r.short == ""


def test_damaged_marks(spark):
    for bad in ("<|##|>", "<||#||>", "<#|>", "<|#>", "<#>", "|#|>", "<|#|", "<|#|>"):
        got = one(spark, x=T.repair_marks(F.lit(f"entity{bad}a{bad}b"))).x
        assert got == "entity<|#|>a<|#|>b", bad


def test_id_lists(spark):
    ids = F.array(*[F.lit(x) for x in "abcab"])
    r = one(
        spark,
        fifo=A.cap_ids(ids, 2), keep=A.cap_ids(ids, 2, "KEEP"), none=A.cap_ids(ids, 0),
        less=A.subtract_ids(ids, F.array(F.lit("b"))),
        now=A.incremental_ids(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")), F.array(F.lit("c"))),
        same=A.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")),
    )
    assert r.fifo == ["a", "b"] and r.keep == ["a", "b"] and r.none == [] and r.less == ["a", "c", "a"]
    assert r.now == ["b", "c"] and r.same == 1.0


def test_f1(spark):
    words = lambda s: F.array(*[F.lit(w) for w in s.split()]) if s else F.array().cast("array<string>")
    r = one(spark, a=A.token_overlap_f1(words("x y y"), words("y y z")), b=A.token_overlap_f1(words(""), words(""), 1.0), c=A.token_overlap_f1(words(""), words("x")))
    assert abs(r.a - 2 / 3) < 1e-9 and r.b == 1.0 and r.c == 0.0
